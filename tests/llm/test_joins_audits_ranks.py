"""The n-gram join, the filter audit and ranked search against brute force, with awkward rows."""

import itertools
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from sparkhound.llm import audit, jaccard, ranked

SCHEMA = "doc_id long, text string, lang string, source string, _row long, key binary, n int, bits int, rank int, score double, part string, term string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, x, "s", 7, b"k", 1, 3, 9, 0.5, "p", "q") for i, t, x in rows], SCHEMA).repartition(3)


def _texts(seed, n=150):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    bases = [[r.choice(vocab) for _ in range(r.choice([8, 12, 30, 60, 150]))] for _ in range(4)]
    out = []
    for d in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            k = r.randrange(len(words))
            if r.random() < 0.3:
                words.insert(k, r.choice(vocab))
            elif r.random() < 0.4 and len(words) > 1:
                del words[k]
            else:
                words[k] = r.choice([*vocab, f"x{d}"])
        out.append((d, " ".join(words), r.choice(["en", "de", None])))
    return out


AWKWARD = [
    (1000, None, "en"), (1001, "", None), (1002, " \n\t", "en"), (1003, "a b", "en"), (1004, "A\x0b b", "en"), (1005, "a", ""), (1006, "É é  x 梦 😀 $", "en"), (None, "a b", "de"), (1007, "word " * 30_000, "de"),
    (1007, "word " * 30_000, "de"), (1008, "Z" * 50_000, "en"), (1009, "only here once in all", "en"), (-5, "a", "en"), (1010, "Only here once in all", "fr"),
]


# -- the n-gram join


def _shingles(text):
    words = WORD.findall(_lower(text))
    return frozenset(" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))) if words else frozenset()


def _joined(rows):
    sets, root = [_shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
            root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (d, _, _) in enumerate(rows):
        known = [x for x in (least.get(top(k)), d) if x is not None]
        least[top(k)] = min(known) if known else None
    return Counter((d, len(sets[k]), least[top(k)]) for k, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("seed,block,looked_up", [(1, 512, 4096), (2, 8, 4096), (3, 64, 5)])
def test_join_equals_brute_force(spark, monkeypatch, seed, block, looked_up):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LOOKED_UP", looked_up)
    rows = _texts(seed) + AWKWARD
    assert Counter(map(tuple, jaccard.classes_of(_table(spark, rows)).collect())) == _joined(rows)


def test_join_of_nothing(spark):
    assert jaccard.classes_of(_table(spark, AWKWARD[:0])).count() == 0
    assert [tuple(r) for r in jaccard.classes_of(_table(spark, AWKWARD[:2])).orderBy("doc_id").collect()] == [(1000, 0, 1000), (1001, 0, 1001)]


@pytest.mark.parametrize("seed", range(30))
def test_filters_lose_no_similar_pair(seed):
    """Prefixes meet, and lengths, places and parts allow every similar pair, under any frequencies."""
    r = np.random.default_rng(seed)
    classes = r.integers(0, 20, 1 << jaccard.CELL_BITS).astype(np.uint8)
    n = int(r.integers(1, 400))
    a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    for cut in range(0, max(1, len(a) // 9) + 1):
        b = np.unique(np.concatenate([r.permutation(a)[cut // 2 :], r.integers(0, 1 << 63, cut - cut // 2, dtype=np.uint64)]))
        if not len(b) or not jaccard.similar(a, b):
            continue
        x, y = jaccard.ordered(a, classes), jaccard.ordered(b, classes)
        p, q = x[: jaccard.prefix_length(len(x))], y[: jaccard.prefix_length(len(y))]
        common = np.intersect1d(p, q)
        assert len(common)
        i, j = np.searchsorted(x, common[0]), np.searchsorted(y, common[0])
        assert 19 * min(len(x) - i, len(y) - j) >= 9 * (len(x) + len(y)) and max(len(a), len(b)) * 9 <= min(len(a), len(b)) * 10
        assert jaccard.apart(jaccard.parts_of(a), jaccard.parts_of(b)) <= jaccard._most_apart(len(a), len(b))
        assert jaccard.Apart([jaccard.parts_of(a), jaccard.parts_of(b)]).least(0, np.array([1]))[0] <= jaccard._most_apart(len(a), len(b))


def test_a_pair_is_compared_in_one_star_only():
    classes = np.zeros(1 << jaccard.CELL_BITS, np.uint8)
    a = np.arange(1, 101, dtype=np.uint64) << np.uint64(40)
    b = a[:-1]
    first = jaccard.ordered(a, classes)[:1]
    assert jaccard.joined([1, 2], [1, 2], [a, b], [first, first], classes) == [(0, 1)]
    later = jaccard.ordered(a, classes)[1:2]
    assert jaccard.joined([1, 2], [1, 2], [a, b], [later, later], classes) == []


# -- the filter audit


def _fails(rows):
    out = []
    for d, t, _ in rows:
        t = t or ""
        words = WORD.findall(t)
        out.append(
            "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
            + "E" * (d is not None and any(o is not None and o < d and (u or "") == t for o, u, _ in rows))
        )
    return out


def test_audit_equals_brute_force(spark):
    rows = _texts(4) + AWKWARD + [(2000 + k, t, "en") for k, (_, t, _) in enumerate(_texts(4)[:40])]
    labels = [(d, k % 2, int(k % 3 == 0)) for k, (d, _, _) in enumerate(rows) if d is not None and k % 4] + [(1003, 0, 1), (1003, 1, None), (None, 1, 1), (999_999, 1, 1)]
    fails = _fails(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    want, shapley = {}, Counter()
    for part in {x or "" for _, _, x in rows}:
        own = [(rows[k][0], f) for k, f in enumerate(fails) if (rows[k][2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                kept = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in own) - len(gone)
                want[part, order, step] = [len(kept), len(gone), redundant, sum(x[1] == f for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
                shapley[part, f] += len(gone)
                left = kept
    got = audit.audit(_table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(want) == 600 * len({x or "" for _, _, x in rows})
    for r in got:
        assert list(r)[3:9] == want[r["part"], r["filter_order"], r["step"]] and r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]]


def test_audit_with_more_parts_than_are_held(spark, monkeypatch):
    monkeypatch.setattr(audit, "HELD_PARTS", 3)
    rows = [(k, "x" * (k % 5), f"p{k % 11}") for k in range(60)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit.audit(_table(spark, rows), labels)
    assert got.count() == 11 * 600 and got.where("step = 5").selectExpr("sum(kept) AS k").first()["k"] == 0
    assert audit.audit(_table(spark, rows[:0]), labels).count() == 0


def test_first_failing_step():
    for bits in range(32):
        for o, order in enumerate(audit.ORDERS):
            want = next((k for k, f in enumerate(order) if bits >> "ABCDE".index(f) & 1), 5)
            assert audit.FIRST[bits, o] == want


# -- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _ranked(docs, items, top=50):
    found = [(d, Counter(TERM.findall(_lower(t)))) for d, t, _ in docs]
    found = [(d, c, c.total()) for d, c in found if c]
    n, all_ = len(found), sum(x for *_, x in found)
    df = Counter(t for _, c, _ in found for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(_lower(t)))
    out = []
    for item, words in asked.items():
        scores = []
        for d, c, size in found:
            m = 100 - 50 + 50 * size * n // all_
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "w1 w2 w3 w3 x7"), (2, "A b; word"), (3, None), (4, "nothing-like-it"), (5, "w5 w6"), (5, "w7, W5"), (None, "w9 once"), (6, "É 梦 é"), (7, "")]


@pytest.mark.parametrize("items,block,entries", [(4096, 16384, 1 << 17), (2, 7, 4)])
def test_search_equals_brute_force(spark, monkeypatch, items, block, entries):
    monkeypatch.setattr(ranked, "ITEMS", items)
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "ENTRIES", entries)
    rows = _texts(5) + AWKWARD
    asked = spark.createDataFrame([(i, t, 3, "z") for i, t in ITEMS], "item_id long, text string, row long, block string")
    got = sorted(map(tuple, ranked.search(_table(spark, rows), asked, 20).collect()), key=str)
    assert got == _ranked(rows, ITEMS, 20)


def test_search_of_nothing(spark):
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(_table(spark, AWKWARD[:0]), asked).count() == 0
    assert ranked.search(_table(spark, AWKWARD), asked.limit(0)).count() == 0
    assert ranked.search(_table(spark, [(1, "?!", "en"), (2, None, "en")]), asked).count() == 0


def test_repeated_terms_count_where_asked(spark):
    docs = _table(spark, [(1, "a b", "en"), (2, "b c", "en"), (3, "c d", "en")])
    asked = spark.createDataFrame([(1, "a a")], "item_id long, text string")
    once, twice = ranked.search(docs, asked).first()["score"], ranked.search(docs, asked, repeats=True).first()["score"]
    assert twice == 2 * once > 0
