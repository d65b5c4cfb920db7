import re

import corpus_pipeline
import public_tokenizers

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, columns = docs, docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)  # written and read in production
        assert docs.columns == columns
    n_good = corpus_pipeline.keep_good(spark, first, SF).count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.keep_good(spark, first, SF).collect()}
    assert n_good < first.count() and sum(labels[d] == 1 for d in kept if d in labels) >= 0.95 * sum(labels.values())
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"]) for r in docs.collect())
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r["n_tokens"] for r in last.collect()) == sorted(len(sp.encode(r["text"])) for r in docs.collect())


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_near_duplicates_are_those_of_five_words(spark):
    import random

    rng = random.Random(8)
    texts = []
    for _ in range(40):
        texts.append([f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 120))])
        for _ in range(rng.randint(0, 5)):  # copies of copies, a few words changed or dropped
            words = list(rng.choice(texts[-3:]))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
            texts.append(words[: len(words) - rng.randint(0, 2)])
    base = [f"x{k}" for k in range(49)]  # 45 shingles; one word less at both ends of a copy: exactly 0.8 with 36 of 45
    texts += [base, base[9:], ["one"] + base[9:] + ["y"] * 9, [], ["a"], ["a"]]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a, x in enumerate(sets):
            for b, y in enumerate(sets[:a]):
                if label[a] != label[b] and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert len({*label}) < len({frozenset(s) for s in sets}) and label[-5] == label[-6]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == sorted({*label})


def _near_copies(seed, n=70, words=60):
    """A text, its near copies with one to four words changed, and texts that share only a passage with it."""
    import random

    rng = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    texts = [base]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        texts.append(copy)
    texts += [[f"w{rng.randrange(10**6)}" for _ in range(40)] + base[:20] for _ in range(10)]
    rng.shuffle(texts)
    return texts


def _smallest_of_each(texts):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in texts]
    label, changed = list(range(len(texts))), True
    while changed:
        changed = False
        for a, x in enumerate(sets):
            for b, y in enumerate(sets[:a]):
                if label[a] != label[b] and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sorted({*label})


def test_a_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    from sparkhound.llm import similar

    for block, looked_up in ((7, 4096), (512, 10)):
        monkeypatch.setattr(similar, "BLOCK", block)
        monkeypatch.setattr(similar, "LOOKED_UP", looked_up)
        texts = _near_copies(block)
        docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(3)
        assert sorted(r["doc_id"] for r in similar.one_of_each(docs).collect()) == _smallest_of_each(texts)


def test_forest_of_sets():
    import numpy as np

    from sparkhound.llm import similar

    for seed in range(20):
        rng = np.random.default_rng(seed)
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.int64)) for _ in range(40)]
        sets += [np.setdiff1d(s, s[: rng.integers(0, 4)]) if len(s) > 5 else s for s in sets]
        comps = rng.integers(0, 60, len(sets)).tolist()
        got = similar.linked(sets, comps)
        alike = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        assert all(alike(sets[a], sets[b]) and comps[a] != comps[b] for a, b in got)
        root = {c: c for c in comps}

        def classes(links):
            root = {c: c for c in comps}
            for _ in range(len(comps)):
                for a, b in links:
                    low = min(root[comps[a]], root[comps[b]])
                    root = {c: low if r in (root[comps[a]], root[comps[b]]) else r for c, r in root.items()}
            return root

        every = [(a, b) for b in range(len(sets)) for a in range(b) if comps[a] != comps[b] and alike(sets[a], sets[b])]
        assert classes(got) == classes(every) and len(got) < len(root)


def test_possible_partners_lose_none():
    import numpy as np

    from sparkhound.llm import similar

    rng = np.random.default_rng(5)
    n, i, c = rng.integers(1, 200, 700), rng.integers(0, 40, 700), rng.integers(0, 9, 700)
    i = np.minimum(i, n - 1)
    want = [any(9 * min(n[a] - i[a], n[b] - i[b]) >= 4 * (n[a] + n[b]) and c[a] != c[b] for b in range(700)) for a in range(700)]
    assert similar._may(n, i, c).tolist() == want


def test_sketches_leave_every_similar_pair_open():
    import numpy as np

    from sparkhound.llm import similar

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in rng.integers(1, 300, 40)]
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) < 0.92], rng.integers(0, 1 << 63, len(s) // 12).astype(np.uint64)])) for s in sets]
    sets = [s for s in sets if len(s)]
    n, comps = np.array([len(s) for s in sets]), rng.integers(0, 70, len(sets))
    sketches = [similar.sketch(s) for s in sets]
    got = {(min(p), max(p)) for p in zip(*(x.tolist() for x in similar.close(sketches, n, comps)), strict=True)}
    for b in range(len(sets)):
        for a in range(b):
            assert similar.apart(sketches[a], sketches[b]) <= len(np.setxor1d(sets[a], sets[b]))
            if comps[a] != comps[b] and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])):
                assert (a, b) in got
    assert 0 < len(got) < 100


def test_chance_meetings_bring_no_texts(spark, monkeypatch):
    from sparkhound.llm import similar

    texts = [[f"v{k}_{j}" for j in range(4)] + [f"b{k // 3}_{j}" for j in range(6)] for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    verified, seen = similar._verified, []
    monkeypatch.setattr(similar, "_verified", lambda t, pairs: seen.append(pairs.count()) or verified(t, pairs))
    assert similar.one_of_each(docs).count() == 60
    assert sum(seen) == 0


def test_meetings_with_many_open_pairs_compare_texts_in_blocks(spark, monkeypatch):
    from sparkhound.llm import similar

    monkeypatch.setattr(similar, "MANY", 0)
    monkeypatch.setattr(similar, "BLOCK", 7)
    texts = _near_copies(11)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in similar.one_of_each(docs).collect()) == _smallest_of_each(texts)
