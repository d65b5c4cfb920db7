"""SentencePiece (merge type) encoding and decoding.

Encoding never replays the merge queue over a text. Per unit it
  1. finds with one Aho-Corasick pass the longest vocabulary piece at each position;
  2. walks left to right, taking the longest piece whose end is not known to fail and which is *compatible* with the piece
     before it: re-merging the two pieces' characters gives exactly these two pieces;
  3. falls back to the next shorter prefix piece, and when none is left marks the position in a bit field and steps back.
A sequence in which all neighbours are compatible is the merge result, and there is only one.

A text is cut into units where no piece can reach across: before a run of the space mark that follows another character,
and around line feeds, provided that no piece of the model holds such a place (checked when it is loaded; otherwise the
whole text is one unit). Units repeat a lot, so each Python worker remembers recent ones in a table of bounded size.

Characters outside the vocabulary become their UTF-8 byte pieces. Null texts count as empty; empty texts have no ids.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import sliced

MARK = "▁"
#: Entries a worker remembers; older ones go when a table is full. Results never depend on it.
REMEMBERED = 500_000


class PieceCodec:
    """Exact encoder and decoder for one model file. No begin or end ids, no sampling."""

    def __init__(self, model_file: str):
        import sentencepiece  # reads the model file's pieces and scores; not used to encode or decode

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.unk = sp.unk_id()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.ids = {self.piece[i]: i for i in range(n) if i not in special and i not in self.byte_of}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.special = special
        auto = ahocorasick.Automaton()
        for p, i in self.ids.items():
            auto.add_word(p, (len(p), i))
        auto.make_automaton()
        self.matches = auto.iter
        self.size = {i: len(p) for p, i in self.ids.items()}
        #: id -> the longest shorter piece that starts the same way, or -1
        self.shorter = {}
        for p, i in self.ids.items():
            self.shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), -1)
        inner = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        line = any("\n" in p for p in self.ids)
        self.alphabet = frozenset(p for p in self.ids if len(p) == 1)
        #: marks that no piece holds after a letter: a unit may be cut there
        self.loose = frozenset(c for c in ".,!?;:" if c in self.alphabet and not any(re.search(f"[^\\W\\d_]{re.escape(c)}", p) for p in self.ids))
        self.by_unit = not inner and not line
        self.units = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        self.one = {c: str(self.ids[c]) for c in self.alphabet}
        #: ids that decode alike wherever they stand: pieces, and bytes below 0x80
        self.shown = {str(i): p.replace(MARK, " ") for p, i in self.ids.items()} | {str(i): chr(b) for b, i in self.byte.items() if b < 128}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, str] = {}

    # -- encoding

    def merged(self, chars: str) -> list[str]:
        """Merge a short string: best score first, leftmost on ties."""
        parts, score = list(chars), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            x, y = self.piece[a], self.piece[b]
            found = self.fits[key] = self.merged(x + y) == [x, y]
        return found

    def _known_run(self, run: str) -> list[int]:
        """Ids of a run of characters that are all in the vocabulary."""
        n = len(run)
        longest = [0] * n
        for end, (size, i) in self.matches(run):  # ends ascend, so the last match of a start is its longest
            longest[end + 1 - size] = i
        out: list[int] = []
        failed, pos, tok, last = 0, 0, longest[0], -1
        size, shorter, fits = self.size, self.shorter, self.fits
        while True:
            while tok >= 0:
                end = pos + size[tok]
                if not failed >> end & 1:
                    if last < 0:
                        break
                    ok = fits.get(last << 20 | tok)
                    if ok or ok is None and self.compatible(last, tok):
                        break
                tok = shorter[tok]
            if tok >= 0:
                out.append(tok)
                if end == n:
                    return out
                pos, last, tok = end, tok, longest[end]
            else:
                failed |= 1 << pos
                if not out:
                    raise ValueError("no sequence of pieces")
                tok = out.pop()
                pos -= size[tok]
                last, tok = out[-1] if out else -1, shorter[tok]

    def encode_unit(self, unit: str) -> list[int]:
        if self.alphabet.issuperset(unit):
            return self._known_run(unit)
        ids, single = [], self.alphabet
        start = 0
        for k, c in enumerate(unit):
            if c not in single:
                if start < k:
                    ids += self._known_run(unit[start:k])
                start = k + 1
                ids += [self.byte[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte else [self.unk]
        if start < len(unit):
            ids += self._known_run(unit[start:])
        return ids

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.by_unit:
            return [MARK + text.replace(" ", MARK)]
        if "  " in text or MARK in text or text[0] == " " or "\n " in text:
            return self.units.findall(MARK + text.replace(" ", MARK))
        return list(filter(None, (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")))

    def encode_csv(self, text: str) -> list[str]:
        """Per unit its ids, joined by commas."""
        units, known, loose = self.split(text), self.known, self.loose
        out = list(map(known.get, units))
        at = -1
        while True:
            try:
                at = out.index(None, at + 1)
            except ValueError:
                break
            u = units[at]
            v = known.get(u)
            if v is None:
                stem = u[:-1] if u[-1] in loose and u[-2:-1].isalpha() else u
                v = known.get(stem) or ",".join(map(str, self.encode_unit(stem)))
                if stem is not u:
                    if len(u) <= 64:
                        known[stem] = v
                    v += "," + self.one[u[-1]]
                if len(u) <= 64:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known[u] = v
            out[at] = v
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for u in self.encode_csv(text or "") for i in u.split(",")]

    # -- decoding

    def _pieces(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(utf8(raw))
                raw = bytearray()
            if i == self.unk:
                out.append(" ⁇ ")
            elif i not in self.special:
                out.append(self.piece[i].replace(MARK, " "))
        if raw:
            out.append(utf8(raw))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._pieces(ids)
        first = next((i for i in ids if i not in self.special or i == self.unk), None)
        return text[1:] if first is not None and self.piece[first].startswith(MARK) else text

    def decode_csv(self, ids: str) -> str:
        """decode() of ids joined by commas."""
        ids = ids.split(",")
        try:
            text = "".join(map(self.shown.__getitem__, ids))
        except KeyError:  # bytes beyond ASCII, or special ids
            return self.decode([int(i) for i in ids])
        return text[1:] if self.piece[int(ids[0])].startswith(MARK) else text


def utf8(raw: bytes) -> str:
    """Bytes as text; each byte that belongs to no character becomes U+FFFD."""
    out, k = [], 0
    while k < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[k : k + n]).decode("utf-8"))
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec for each worker and model."""
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def encode_decode(docs: DataFrame, model_file: str, with_text: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for each row of ``docs``.

    Needs columns doc_id and text; others are left out, so their names cannot clash. Null and empty texts: no ids, empty
    decoded text. Repeated rows give repeated results. An empty table gives an empty result. Texts are taken 500 at a
    time; there is no shuffle. ``with_text=False`` leaves out ids and decoded text.
    """
    def run(batches):
        c = codec(model_file)
        for b in sliced(batches):
            counts, ids_sha, texts_sha, ids, texts = [], [], [], [], []
            for text in b.column(1).to_pylist():
                units = c.encode_csv(text or "")
                joined = ",".join(units)
                decoded = c.decode_csv(joined) if units else ""
                counts.append(joined.count(",") + 1 if units else 0)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                texts_sha.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                if with_text:
                    ids.append([int(i) for i in joined.split(",")] if units else [])
                    texts.append(decoded)
            more = [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(texts_sha, pa.string()), *more],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: len(more)]],
            )

    kind = dict(docs.dtypes)["doc_id"]
    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_text
    return docs.select("doc_id", "text").mapInArrow(run, out)
