import itertools

import numpy as np
import pytest

from tidewheel.operators import hamming, images


def slow_pairs(rows, most):
    of = {}
    for e, c, k, h in rows:
        if h is not None:
            of.setdefault(e, {}).setdefault(c, {})[k] = h & (1 << 64) - 1
    out = {}
    for a, b in itertools.combinations(sorted(of), 2):
        worst, shared = 0.0, 0
        for c in of[a].keys() & of[b].keys():
            frames = of[a][c].keys() & of[b][c].keys()
            if frames:
                worst = max(worst, sum(bin(of[a][c][k] ^ of[b][c][k]).count("1") for k in frames) / 64 / len(frames))
            else:
                worst = 2
            shared += 1
        if shared and worst <= most:
            out[a, b] = worst
    return out


def near_signatures(seed, n, cameras=("top", "wrist"), shared_frame=False):
    rng = np.random.default_rng(seed)
    rows, base = [], {}
    for e in range(n):
        for c in cameras if e % 5 else cameras[:1]:
            for k in range(3):
                if e % 7 == 3 and k == 2:
                    continue
                if e % 3 == 0 or (c, k) not in base:
                    base[c, k] = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
                h = base[c, k]
                for bit in rng.choice(64, rng.integers(0, 22), replace=False) if e % 3 else ():
                    h ^= 1 << int(bit)
                if shared_frame and k == 0:
                    h = 0
                rows.append((f"e{e:03}", c, k, h - (1 << 64) if h >> 63 else h))
    rows += [("x1", "top", 0, 5), ("x2", "top", 0, 5), ("x3", "side", 0, 5), ("none", "top", 0, None)]
    return rows


KIND = "episode_id string, camera string, keyframe int, hash long"


@pytest.mark.parametrize(("most", "shared"), [(0.0, False), (0.05, False), (0.1, True), (0.1875, False), (0.2, True), (0.3, False)])
def test_pairs_against_brute_force(spark, most, shared):
    rows = near_signatures(int(most * 100), 70, shared_frame=shared)
    got = images.signature_pairs(spark.createDataFrame(rows, KIND).repartition(3), most).collect()
    want = slow_pairs(rows, most)
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]): pytest.approx(r["distance"]) for r in got} == want and ("x1", "x2") in want


@pytest.mark.parametrize("long_list", [1, 7])
def test_long_lists_are_dealt_in_blocks(spark, monkeypatch, long_list):
    monkeypatch.setattr(hamming, "LONG_LIST", long_list)
    rows = near_signatures(9, 60, shared_frame=True)
    got = images.signature_pairs(spark.createDataFrame(rows, KIND), 0.2).collect()
    assert {(r["a"], r["b"]) for r in got} == set(slow_pairs(rows, 0.2)) and len(got) == len(slow_pairs(rows, 0.2))


def test_clusters_and_copies(spark):
    rows = near_signatures(4, 40) + [(f"copy{k:03}", c, j, 77 + j) for k in range(200) for c in ("top", "wrist") for j in range(3)]
    got = {r["episode_id"]: (r["representative"], r["kept"]) for r in images.duplicate_clusters(spark.createDataFrame(rows, KIND), 0.15).collect()}
    of = {e: e for e, *_ in rows}
    pairs = slow_pairs(rows, 0.15)
    for _ in range(len(of)):
        before = dict(of)
        for a, b in pairs:
            of[a] = of[b] = min(of[a], of[b])
        if before == of:
            break
    assert got == {e: (r, e == r) for e, r in of.items()}


def test_substrings_meet():
    rng = np.random.default_rng(0)
    for radius in range(0, 30):
        spans = hamming.substrings(radius)
        assert sum(w for _, w in spans) == 64
        for _ in range(50):
            x = np.zeros(1, "u8")
            for bit in rng.choice(64, radius, replace=False):
                x[0] ^= np.uint64(1 << int(bit))
            assert any(np.bitwise_count(hamming._cut(x, s))[0] <= 1 for s in spans)


def test_nothing_and_bad_radius(spark):
    none = spark.createDataFrame([], KIND)
    assert images.signature_pairs(none).count() == 0 and images.duplicate_clusters(none).count() == 0
    for most in (-0.1, 1.0):
        with pytest.raises(ValueError):
            images.signature_pairs(none, most)


@pytest.mark.parametrize("rows_a_block", [5, 16_384])
@pytest.mark.parametrize("shared", [False, True])
def test_blocks_find_what_lists_find(spark, monkeypatch, rows_a_block, shared):
    """Null hashes, several cameras and cells of one block and of two."""
    monkeypatch.setattr(hamming, "DENSE", 0.0)
    monkeypatch.setattr(hamming.blocks, "block_rows", lambda total, width: rows_a_block)
    rows = near_signatures(11, 60, shared_frame=shared)
    got = images.signature_pairs(spark.createDataFrame(rows, KIND).repartition(3), 0.2).collect()
    want = slow_pairs(rows, 0.2)
    assert len(got) == len(want) and {(r["a"], r["b"]): pytest.approx(r["distance"]) for r in got} == want


def test_bits_that_never_vary_make_no_lists(spark, monkeypatch):
    """With half of the bits constant, whole lists would hold all signatures; each pair is compared once instead."""
    called, inner = [], hamming.block_pairs
    monkeypatch.setattr(hamming, "block_pairs", lambda *a: called.append(a[-1]) or inner(*a))
    rng = np.random.default_rng(3)
    rows = [(f"e{k:03}", "all", j, int(rng.integers(0, 1 << 32))) for k in range(300) for j in range(2)]
    want = slow_pairs(rows, 0.15)
    got = images.signature_pairs(spark.createDataFrame(rows, KIND), 0.15).collect()
    assert called and want and {(r["a"], r["b"]): pytest.approx(r["distance"]) for r in got} == want
    called.clear()
    spread = [(f"e{k:03}", "all", j, int(rng.integers(-(1 << 63), 1 << 63))) for k in range(300) for j in range(2)]
    assert images.signature_pairs(spark.createDataFrame(spread, KIND), 0.05).count() == 0 and not called
