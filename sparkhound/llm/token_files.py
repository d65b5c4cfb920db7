"""Token ids in binary files: frequency-ranked ids, byte-aligned variable-length codes, control bytes apart from data.

File image, all integers little-endian:
    magic "TKF1" | uint32 documents | uint32 ids | uint32 bytes of data
    uint32 length of each document (its ids, the end id included)
    control bytes: two bits an id, four ids a byte, low bits first; each is the id's data bytes less one
    data bytes: each id's rank in 1 to 4 little-endian bytes

Ranks are by falling corpus frequency, so the 256 most frequent ids take one byte. The reader expands control bytes with a
256-entry numpy table into lengths and offsets, gathers up to four bytes an id and maps ranks back; it never loops over ids.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .store import forget, keep, own_dir, shuffle_parts, sliced, small_batches

MAGIC = b"TKF1"
END = 1
#: Ids in a file at most, unless one document alone has more.
FILE_IDS = 1 << 20
#: Words a worker remembers; results never depend on it.
REMEMBERED = 700_000
#: Marks that form a match of their own after a letter, one or several together, up to the word's end.
MARKS = frozenset(".,!?;:|*&$%#@+=~^/()")
#: Bytes of A to Z, a to z and the first byte of U+00C0 to U+00FF; the second bytes of those that are letters there.
LETTER, SECOND = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True
SECOND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
#: Bytes that byte-level pieces write as other characters than their own in Latin-1.
BYTE_LEVEL = {b: 0x100 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
ID = attrgetter("id")
#: Data bytes of the four ids under a control byte, a byte each.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8).view(np.uint32).reshape(-1)
#: Documents encoded at a time; Spark bounds their bytes.
ROWS = 1000


def write_image(lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    pad = np.concatenate([size - 1, np.zeros(-len(size) % 4, np.uint8)]).reshape(-1, 4).astype(np.uint8)
    control = pad[:, 0] | pad[:, 1] << 2 | pad[:, 2] << 4 | pad[:, 3] << 6
    start = np.cumsum(size, dtype=np.int64) - size
    data = np.empty(int(size.sum(dtype=np.int64)), np.uint8)
    data[start] = ranks.astype(np.uint8)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        data[start[has] + k] = (ranks[has] >> np.uint32(8 * k)).astype(np.uint8)
    head = np.array([len(lengths), len(ranks), len(data)], "<u4")
    return b"".join([MAGIC, head.tobytes(), lengths.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def read_image(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document lengths, ranks)."""
    if image[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, n, bytes_ = np.frombuffer(image, "<u4", 3, 4).tolist()
    lengths = np.frombuffer(image, "<u4", docs, 16)
    at = 16 + 4 * docs
    control = np.frombuffer(image, np.uint8, -(-n // 4), at)
    data = np.frombuffer(image, np.uint8, bytes_, at + len(control))
    size = LENGTHS[control].view(np.uint8)[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    ranks = data[start].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        ranks[has] |= data[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return lengths.astype(np.int64), ranks


def _letters(word: str) -> bool:
    """Letters only, before and after what the normalizer does to them."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def _strings(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary array without nulls, the first offset 0."""
    offsets = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, 4 * a.offset)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def _plain(words: pa.Array) -> np.ndarray:
    """Which words are letters up to U+00FF alone, one at least: NFC leaves them, and each letter has one lower case."""
    offsets, data = _strings(words)
    wrong = ~LETTER[data]
    wrong[1:] &= ~(SECOND[data[1:]] & (data[:-1] == 0xC3))
    upto = np.append(0, np.cumsum(wrong))
    return (upto[offsets[1:]] == upto[offsets[:-1]]) & (offsets[1:] > offsets[:-1])


def _endings(words: pa.Array, stems: pa.Array) -> pa.Array:
    """What follows each stem in its word."""
    offsets, data = _strings(words)
    size, stem = np.diff(offsets), np.diff(_strings(stems)[0])
    kept = data[np.arange(len(data)) >= np.repeat(offsets[:-1] + stem, size)]
    at = np.append(0, np.cumsum(size - stem)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(at), pa.py_buffer(kept)])


#: What a tokenizer file must say for its words to be encoded one by one.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def wordwise(file: dict) -> bool:
    """Whether white space parts a text into words that the tokenizer encodes alike alone, and a piece's ending ends a word."""
    model = file.get("model") or {}
    plain = all(not t["normalized"] and not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in file.get("added_tokens") or [])
    return plain and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and all(file.get(k) == v for k, v in WORDWISE.items())


class WordTokens:
    """Ids of whole texts as the tokenizers library gives them, remembered by word.

    The file's normalizer and its pattern never join or look across ASCII white space, and pieces stay inside a match of the
    pattern; so a text's ids are those of its white-space-separated chunks in order. The library itself encodes each chunk:
    letters up to U+00FF in lower case are what its normalizer and pattern leave, so its model gets them at once; all else
    goes through the whole library. With a file that says anything else the library encodes whole texts.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            self.by_word = wordwise(json.load(f))
        self.type = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        vocab = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocab.values()) + 1, bool)
        self.ending[[i for p, i in vocab.items() if p.endswith("</w>")]] = True
        # marks inside an added token may be part of one
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = "".join(MARKS.difference(*added))
        # no letters in a row may be an added token, in whatever case
        self.folds = not any(c.isalpha() for c in added)
        self.model = self.tokenizer.model
        # a long word with an id of its own, which stands between words whose ends the ids do not tell
        whole = sorted((p[:-4] for p in vocab if p.endswith("</w>") and p[:-4].isascii() and p[:-4].isalpha() and p[:-4].islower()), key=lambda p: (-len(p), p))
        alone = (p for p in whole[:100] if self.tokenizer.encode(p, add_special_tokens=False).ids == [vocab[p + "</w>"]])
        self.between = next(alone, None)
        self.between_id = vocab.get(f"{self.between}</w>")
        self.known: dict[str, bytes] = {}

    def _library(self, words: set[str]) -> None:
        # words of letters alone are one match each, whose last piece ends the word: they go to the library together
        plain = [w for w in words if self.folds and _letters(w)]
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, self.type)
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) == len(plain):
                raw, size, at = ids.tobytes(), ids.itemsize, 0
                for w, e in zip(plain, (ends * size).tolist(), strict=True):
                    self.known[w] = raw[at:e]
                    at = e
                words = words.difference(plain)
        rest = [w for w in words if w and self.between and self.between not in w.lower()]
        if rest:
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.between} ".join([*rest, ""])], add_special_tokens=False)[0].ids, self.type)
            ends = np.flatnonzero(ids == self.between_id)
            if len(ends) == len(rest):
                raw, size, at = ids.tobytes(), ids.itemsize, 0
                for w, e in zip(rest, (ends * size).tolist(), strict=True):
                    self.known[w] = raw[at:e]
                    at = e + size
                words = set(words).difference(rest)
        rest = list(words)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, self.type).tobytes()

    def _model(self, words: list[str]) -> None:
        ids, sizes = [], []
        for w in words:
            pieces = self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LEVEL))
            ids.extend(map(ID, pieces))
            sizes.append(len(pieces))
        raw, size, at = np.array(ids, self.type).tobytes(), np.dtype(self.type).itemsize, 0
        for w, e in zip(words, (np.cumsum(sizes, dtype=np.int64) * size).tolist(), strict=True):
            self.known[w] = raw[at:e]
            at = e

    def _looked_up(self, words: pa.Array, plain: bool = False) -> pa.Array:
        """Ids of different words, which are in lower case if ``plain``."""
        words, known = words.to_numpy(zero_copy_only=False).tolist(), self.known
        new = [w for w in words if w not in known]
        if plain:
            self._model(new)
        else:
            # marks after a letter are a match of their own
            cut = {}
            for w in new:
                stem = w.rstrip(self.marks)
                if len(stem) < len(w) and _letters(stem[-1:]):
                    cut[w] = stem, w[len(stem) :]
            self._library({w for w in new if w not in cut} | {x for v in cut.values() for x in v if x not in known})
            for w, (stem, mark) in cut.items():
                known[w] = known[stem] + known[mark]
        return pa.array(list(map(known.__getitem__, words)), pa.binary())

    def _ids(self, words: pa.Array) -> pa.Array:
        """Ids of different words: plain ones are looked up in lower case and without the marks at their ends."""
        stems = pc.ascii_rtrim(words, characters=self.marks)
        plain = _plain(stems) if self.folds else np.zeros(len(words), bool)
        stems = stems.filter(pa.array(plain))
        marks = _endings(words.filter(pa.array(plain)), stems).dictionary_encode()
        lower = pc.utf8_lower(stems).dictionary_encode()
        found = [self._looked_up(x.dictionary, x is lower).take(x.indices) for x in (lower, marks)]
        both = pc.binary_join_element_wise(*found, pa.scalar(b"", pa.binary()))
        place = np.empty(len(words), np.int64)
        place[np.append(np.flatnonzero(plain), np.flatnonzero(~plain))] = np.arange(len(words))
        return pa.concat_arrays([both, self._looked_up(words.filter(pa.array(~plain)))]).take(pa.array(place))

    def encoded(self, texts: pa.Array, last: bytes = b"") -> pa.Array:
        """Binary array of each text's ids, then ``last``."""
        if not self.by_word:
            return pa.array([np.array(e.ids, self.type).tobytes() + last for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)], pa.binary())
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        ids = pa.concat_arrays([self._ids(words.dictionary), pa.array([last], pa.binary())])
        # all ids in a row, ``last`` after each text's words, of which only the texts' ends are kept
        ends = np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)
        row = ids.take(pa.array(np.insert(words.indices.to_numpy(), ends, len(ids) - 1)))
        at, data = _strings(row)
        cuts = np.append(0, at[ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encoded(pa.array(texts, pa.string())).to_pylist()


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(tokenizer_file: str) -> WordTokens:
    if tokenizer_file not in _TOKENS:
        _TOKENS[tokenizer_file] = WordTokens(tokenizer_file)
    return _TOKENS[tokenizer_file]


def tokenized(docs: DataFrame, tokenizer_file: str, end: int = END) -> DataFrame:
    """(doc_id, ids binary): little-endian unsigned ids, the end id last; 16 bits each where the vocabulary fits, else 32.

    Null texts count as empty.
    """

    def run(batches):
        t = word_tokens(tokenizer_file)
        for b in sliced(batches, ROWS):
            last = np.array([end], t.type).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), t.encoded(b.column(1), last)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary")


def id_counts(tokens: DataFrame, width: int) -> np.ndarray:
    """Corpus frequency of each id; the vocabulary bounds its size."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for raw in [b"".join(b.column(0).to_pylist())]:
                c = np.bincount(np.frombuffer(raw, f"<u{width}"))
                if len(c) > len(total):
                    c, total = total, c.astype(np.int64)
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_files(tokens: DataFrame, by_rank: np.ndarray, width: int, path: str) -> None:
    """Files in ascending doc_id order, as rows (part, file, before, doc_ids, image) of the table ``path``/files; ranks beside it.

    Range partitions follow each other in doc_id order (null first; equal doc_ids by their ids); Spark's commit protocol
    makes each partition's files appear once, whichever attempts were lost. ``path``/ranks has the id of each rank, so the
    files can be read by any later session.
    """
    spark = tokens.sparkSession
    rank = np.zeros(int(by_rank.max(initial=-1)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    kind = dict(tokens.dtypes)["doc_id"]
    out_ids = pa.list_(to_arrow_type(tokens.schema["doc_id"].dataType))

    def run(batches):
        part, file, before, ids, raw, n = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def image():
            lengths = np.array([len(x) // width for x in raw], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([before], pa.int64()), pa.array([ids], out_ids), pa.array([write_image(lengths, rank[np.frombuffer(b"".join(raw), f"<u{width}")])], pa.binary())],
                ["part", "file", "before", "doc_ids", "image"],
            )

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n and n + len(x) // width > FILE_IDS:
                    yield image()
                    file, before, ids, raw, n = file + 1, before + n, [], [], 0
                ids.append(d)
                raw.append(x)
                n += len(x) // width
        if ids:
            yield image()

    laid = tokens.repartitionByRange(shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    laid.mapInArrow(run, f"part int, file int, before long, doc_ids array<{kind}>, image binary").write.parquet(f"{path}/files")
    ranks = spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(by_rank)), "id": by_rank.astype(np.int64)}), "rank long, id long")
    ranks.coalesce(1).write.parquet(f"{path}/ranks")


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """(files, ids by rank) of a folder that write_files() made; the vocabulary bounds the ranks."""
    ranks = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")
    return spark.read.parquet(f"{path}/files"), ranks["id"].to_numpy(np.int64)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids): all ids of each document of a folder, the end id last."""
    files, by_rank = opened(spark, path)
    element = files.schema["doc_ids"].dataType.elementType
    out_ids = to_arrow_type(element)

    def run(batches):
        for b in sliced(batches, 1):
            ids, image = b.column(0)[0].as_py(), b.column(1)[0].as_py()
            lengths, ranks = read_image(image)
            values = by_rank[ranks].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(ids, out_ids), lists], ["doc_id", "ids"])

    return files.select("doc_ids", "image").mapInArrow(run, f"doc_id {element.simpleString()}, ids array<int>")


def read_files(files: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """(part, doc_id, n_tokens, ids_crc32, before): decoded from the images; ``before`` counts ids earlier in the partition."""
    element = files.schema["doc_ids"].dataType.elementType
    kind, out_ids = element.simpleString(), to_arrow_type(element)

    def run(batches):
        back = by_rank.astype("<u4")
        for b in sliced(batches, 1):
            for part, before, ids, image in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                lengths, ranks = read_image(image)
                values = back[ranks].tobytes()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(values[4 * (e - n) : 4 * e]) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(ids, out_ids), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(before + ends - lengths)],
                    ["part", "doc_id", "n_tokens", "ids_crc32", "before"],
                )

    return files.select("part", "before", "doc_ids", "image").mapInArrow(run, f"part int, doc_id {kind}, n_tokens long, ids_crc32 long, before long")


def write_token_files(docs: DataFrame, tokenizer_file: str, path: str, end: int = END) -> None:
    """Write all documents' ids to token files in the folder ``path``, which must not exist."""
    width = int(word_tokens(tokenizer_file).type[2:])
    with small_batches(docs.sparkSession, ROWS):
        tokens = keep(tokenized(docs, tokenizer_file, end), "tokens")
    write_files(tokens, np.argsort(-id_counts(tokens, width), kind="stable"), width, path)
    forget(tokens)


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the token files in a folder, as read back from them."""
    with small_batches(spark, 16):
        back = keep(read_files(*opened(spark, path)), "token-index")
    at, starts = 0, []
    for part, n in sorted(tuple(r) for r in back.groupBy("part").agg(F.sum("n_tokens")).collect()):
        starts.append((part, at))
        at += n
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, _at long"))  # a row for each range partition
    return back.join(offsets, "part").select("doc_id", (F.col("_at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_file_index(docs: DataFrame, tokenizer_file: str, end: int = END, path: str | None = None) -> DataFrame:
    """Write all documents' ids to token files, read them back: (doc_id, start, n_tokens, ids_crc32).

    The files stay in the folder ``path``; without one they are in the shared folder until the application ends. Repeated
    doc_ids each get their own entry. An empty table gives an empty result. Only one total per range partition (their number
    is spark.sql.shuffle.partitions) and the vocabulary's counts reach the driver.
    """
    spark = docs.sparkSession
    path = path or f"{own_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer_file, path, end)
    return index_of(spark, path)
