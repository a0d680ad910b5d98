"""Near vectors against all pairs."""

import math

import numpy as np
import pytest

from lodestone.llm.spherical_caps import cap_height, codebooks, list_decode, near_vectors, rounded


def brute_force(ids, x, good):
    n = len(ids)
    unit = np.zeros((n, x.shape[1]))
    unit[good] = x[good] / np.linalg.norm(x[good], axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    near &= good[:, None] & good[None, :]
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip(*np.nonzero(near)):
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)  # ids ascend with places
    return {(int(ids[k]), int(near[k].sum() - near[k, k]), int(ids[find(k)])) for k in range(n)}


def test_list_decoding_finds_every_direction():
    books = codebooks(16, 24, 3)
    x = np.random.default_rng(2).standard_normal((20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    height = cap_height(16, 24 * 24, 20)
    turned = x @ books[0]
    scores = ((turned[:, :8] @ books[1].T)[:, :, None] + (turned[:, 8:] @ books[2].T)[:, None, :]) / np.sqrt(2)
    want = {(k, a * 24 + b) for k, a, b in zip(*np.nonzero(scores >= height - 1e-12))}
    row, found = list_decode(x, books, height)
    assert set(zip(row.tolist(), found.tolist())) == want and len(row) == len(want)


@pytest.mark.parametrize("dim", [8, 64])
def test_links_and_components(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((120, dim))
    noisy = base[rng.integers(0, 30, 400)] + rng.standard_normal((400, dim)) * rng.choice([0.0, 0.1, 0.22, 0.3], (400, 1))
    x = np.concatenate([base, noisy, np.repeat(base[:1], 40, axis=0), base[5:6] * 3, np.zeros((1, dim))]).astype(np.float32)
    good = np.abs(x).max(axis=1) > 0
    ids = np.arange(len(x)) * 3
    rows = [(int(k), v.tolist(), 0) for k, v in zip(ids, x)]
    bad = [[float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), None, [], [None] + [1.0] * (dim - 1)]
    rows += [(10_000 + k, v, 0) for k, v in enumerate(bad)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")).collect()
    want = brute_force(ids, x.astype(float), good) | {(10_000 + k, 0, 10_000 + k) for k in range(len(bad))}
    found = {(r["vec_id"], r["n_links"], r["component_id"]) for r in got}
    assert len(got) == len(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert found == want


@pytest.mark.parametrize("dim", [64, 768])
def test_recall_of_the_filters(dim):
    """Pairs of a cosine of 0.95 to 0.97 that share a filter of some code, at the number of
    filters that a corpus of 50 000 or 4 million vectors has."""
    rng = np.random.default_rng(dim)
    for n in (50_000, 4_000_000):
        words = math.ceil(math.sqrt(4 * n))
        for cosine in (0.951, 0.97):
            x = rng.standard_normal((250, dim))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            off = rng.standard_normal((250, dim))
            off -= (off * x).sum(axis=1, keepdims=True) * x
            y = cosine * x + math.sqrt(1 - cosine**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
            met = np.zeros(len(x), bool)
            for c in range(5):
                books, height = codebooks(dim, words, 5 + c), cap_height(dim, words * words, 16.0)
                (r, f), (r2, f2) = list_decode(x, books, height), list_decode(y, books, height)
                met[np.unique(np.intersect1d(r * words * words + f, r2 * words * words + f2) // (words * words))] = True
            assert met.mean() >= 0.99, (n, cosine, met.mean())


def test_bounds_of_rounded_vectors():
    rng = np.random.default_rng(4)
    for dim in (2, 16, 300):
        x = rng.standard_normal((60, dim)) * rng.choice([1, 1, 30], dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        low, scale, over = rounded(x)
        about = (low.astype(float) * scale[:, None]) @ (low.astype(float) * scale[:, None]).T
        off = over[:, None] + over[None] + 3 * over[:, None] * over[None]
        assert (np.abs(x @ x.T - about) <= off + 1e-6).all()


@pytest.mark.parametrize("dim", [64, 256])
def test_planted_pairs_at_the_threshold(spark, dim):
    """Pairs planted just above and just below: all of the former, none of the latter."""
    rng = np.random.default_rng(dim + 1)
    x = rng.standard_normal((600, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((600, dim))
    off -= (off * x).sum(axis=1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = rng.choice([0.949, 0.9501, 0.955, 0.97], 600)
    y = cosine[:, None] * x + np.sqrt(1 - cosine**2)[:, None] * off
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]).astype(np.float32))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    missed = [k for k in range(600) if cosine[k] >= 0.95 and got[600 + k] != (1, k)]
    assert [k for k in range(600) if cosine[k] < 0.95 and got[600 + k] != (0, 600 + k)] == [] and missed == []


def test_corner_cases(spark):
    schema = "vec_id long, embedding array<float>"
    assert near_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (3, [1.0]), (4, [2.0]), (5, [1e-38, 0.0]), (6, [0.0, 1.0])]
    got = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 0, None, True), (3, 1, 3, True), (4, 1, 3, False), (5, 3, 1, False), (6, 0, 6, True)], key=str)
