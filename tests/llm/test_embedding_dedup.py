import math

import numpy as np

from tracequery.llm import embedding_dedup as e
from tracequery.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import compare, connect
from .test_simhash import brute_classes


def brute(rows, threshold=0.98):
    """Rows (vec_id, vector, label) to (vec_id, n_links, component_id, kept), by every pair."""
    ok = []
    for i, v, label in rows:
        good = i is not None and label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, dtype=np.float64) / np.linalg.norm(v) if good else None)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if ok[a] is not None and ok[b] is not None and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold]
    low = brute_classes(range(len(rows)), links)
    count = np.bincount(np.array(links, dtype=int).ravel(), minlength=len(rows))
    out = []
    for k, (i, _, _) in enumerate(rows):
        members = [rows[m][0] for m in range(len(rows)) if low[m] == low[k]]
        c = min(members) if i is not None else None
        out.append((i, int(count[k]), c, i is not None and c == i))
    return sorted(out, key=str)


def collected(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [2.0, 0.0, 0.0], 1), (4, [1.0, 0.05, 0.0], 1), (5, [1.0, 0.0, 0.0], 2),
        (6, [0.0, 0.0, 0.0], 1), (7, None, 1), (8, [nan, 1.0, 0.0], 1), (9, [inf, 1.0, 0.0], 1), (10, [None, 1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], None),
        (12, [1.0, 0.0], 1), (13, [], 1), (None, [1.0, 0.0, 0.0], 1), (15, [-1.0, -0.0, 0.0], 1), (16, [-1.0, 0.0, 0.0], 1), (17, [1e-30, 0.0, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, 7, 7) for r in rows], "vec_id long, embedding array<float>, label int, n long, links long")
    assert collected(e.embedding_links(df)) == brute(rows)
    assert e.embedding_links(df.limit(0)).collect() == []


def test_groups_of_copies_and_near_copies(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 24)
    rng = np.random.default_rng(4)
    center = rng.standard_normal(32)
    near = [center + 0.11 * rng.standard_normal(32) for _ in range(90)]
    other = [rng.standard_normal(32) for _ in range(100)]
    vectors = [*near, *other, *near[:5], *[other[0]] * 30]
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 7 == 0)) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert collected(e.embedding_links(df)) == brute(rows)


def test_sample_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert collected(e.embedding_links(df)) == brute(rows)


def test_vectors_equal_their_sql(spark, sf_dir):
    assert compare("op8_embedding_dedup", spark, sf_dir, QUERIES["op8_embedding_dedup"], ORACLE_SQL["op8_embedding_dedup"], connect(sf_dir)) is None


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((2, 64))
    a, b = a / np.linalg.norm(a), 0.6 * a / np.linalg.norm(a) + 0.8 * b / np.linalg.norm(b)
    b /= np.linalg.norm(b)
    errors, wide = [], 0
    for seed in range(300):
        turn = e.rotations(64, 64, seed)
        x, q = a @ turn, b @ turn
        est, spread = e.estimate(np.packbits(x[None] > 0, axis=1), np.array([np.abs(x).sum() / 8]), q[None])
        errors.append(est[0] - a @ b)
        wide += abs(errors[-1]) > e.SIGMAS * spread[0]
    assert abs(np.mean(errors)) < 0.02 and wide == 0


def test_bands_reach_the_miss_rate():
    for n in (10, 10**4, 10**9):
        bits, bands = e.plan_bands(n, 0.98)
        assert (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** bands <= e.MISS_RATE


def test_codes_settle_only_pairs_below_the_threshold():
    rng = np.random.default_rng(6)
    base = rng.standard_normal((200, 24))
    x = e.unit_rows(np.repeat(base, 4, 0) + 0.03 * rng.standard_normal((800, 24)))
    bits, bands = e.plan_bands(20_000, 0.98)
    codes = np.packbits(x @ e.rotations(24, bits * bands, 3) > 0, axis=1)
    every = np.arange(len(x))
    most = e.most_differing(codes.shape[1] * 8, 0.98)
    found = {(i, j) for a, b in e.pairs_within(codes, every, every, most, bits, 0) for i, j in zip(a.tolist(), b.tolist())}
    near = x @ x.T >= 0.98
    want = {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
    assert len(want) > 500 and want <= found
    keys = e.band_keys(codes, bits, bands)
    met = (keys[:, None] == keys[None]).any(2)
    assert all(met[i, j] for i, j in want)
    # Counted in the first band of agreement only.
    seen = []
    for band in range(bands):
        for k in np.unique(keys[:, band]):
            rows = np.flatnonzero(keys[:, band] == k)
            seen += [(i, j) for a, b in e.pairs_within(codes, rows, rows, most, bits, band) for i, j in zip(a.tolist(), b.tolist())]
    assert len(seen) == len(set(seen)) and want <= set(seen)


def test_vectors_of_unlike_lengths_and_double_components(spark):
    rows = [(i, [1.0 + 1e-9 * i] + [0.1] * (n - 1), 1) for i, n in enumerate([1, 3, 3, 9, 9, 130, 130])] + [(20, [1.0, 2.0, 3.0], 2), (21, [1.0, 2.0, 3.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert collected(e.embedding_links(df)) == brute(rows)
