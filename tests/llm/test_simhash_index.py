"""The byte-position index: tally, postings and links against brute force over all pairs."""

import itertools

import numpy as np
import pytest

from sparkhound.llm import simhash


def _family(seed, n=60):
    """Fingerprints in clusters of a few flipped bits, among them chains and far ones."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x = int(rng.integers(0, 1 << 63)) if rng.random() < 0.4 or not out else out[rng.integers(len(out))]
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


def _near(fps, bits):
    return [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= bits]


def _classes(nodes, links):
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in nodes}


def test_tally_counts_equal_positional_bytes():
    fps = np.array(_family(1), np.uint64)
    got = simhash.tallied(fps, fps)
    for i, a in enumerate(fps.tolist()):
        for j, b in enumerate(fps.tolist()):
            same = sum(a >> 8 * p & 255 == b >> 8 * p & 255 for p in range(8))
            assert got[i, j] == same
            assert (a ^ b).bit_count() > 2 or same >= 6  # the guaranteed minimum loses no pair


@pytest.mark.parametrize("bits", [1, 2])
@pytest.mark.parametrize("seed", range(20))
def test_forest_connects_what_brute_force_links(bits, seed):
    fps = _family(seed)
    a, b = simhash.forest(np.array(fps, np.uint64).view(np.int64), bits)
    found = list(zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist(), strict=True))
    assert all((x ^ y).bit_count() <= bits for x, y in found) and len(found) < len(fps)
    assert _classes(fps, found) == _classes(fps, _near(fps, bits))


@pytest.mark.parametrize("bits,large", [(1, 4096), (2, 4096), (2, 3)])
def test_links_connect_what_brute_force_links(spark, bits, large):
    fps = _family(99, 400)
    rows = spark.createDataFrame([(simhash.as_signed(x),) for x in fps + fps[:20]], "_fp long")
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(rows, bits, large).collect()]
    assert all((x ^ y).bit_count() <= bits for x, y in found)
    assert _classes(fps, found) == _classes(fps, _near(fps, bits))


def test_no_fingerprints(spark):
    assert simhash.links(spark.createDataFrame([], "_fp long")).count() == 0
