import math
import random

import numpy as np

from verity.llm import ann

from .helpers import SF, with_clashes

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    ok = list({(i, v.tobytes()): (i, v) for i, v in ok}.values())
    out = {}
    for q, x in ok:
        if q % every == 0:
            s = sorted((-float((x * y).sum()), i) for i, y in ok if i != q and len(y) == len(x))[:k]
            out[q] = [(n + 1, i, -s_) for n, (s_, i) in enumerate(s)]
    return out


def run(df, **kw):
    out = {}
    for r in sorted(ann.nearest(df, **kw).collect()):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want, got = brute([(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]), run(df)
    found = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in w}) for q, w in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))
    for w in got.values():
        assert [n for n, _, _ in w] == list(range(1, len(w) + 1))
        assert [(-s, i) for _, i, s in w] == sorted((-s, i) for _, i, s in w)


def test_exact_when_all_buckets_are_probed(spark):
    """Ties, copies, several norms, several lengths and unusable vectors, against brute force."""
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) * (1 + 9 * (i % 3)) for _ in range(6)]) for i in range(80)]
    rows += [(100 + i, rows[7][1]) for i in range(40)] + [(20, rows[20][1])]
    rows += [(200, None), (220, [0.0] * 6), (240, [float("nan")] * 6), (260, [None] * 6), (280, [float("inf")] * 6), (300, []),
             (None, [1.0] * 6), (320, [1.0, 2.0]), (321, [2.0, 1.0]), (340, [-0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got, want = run(df, share=1.0, k=10), brute(rows, 10)
    want = {q: w for q, w in want.items() if w}
    assert got.keys() == want.keys()
    for q in want:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]]
        assert np.allclose([x[2] for x in got[q]], [x[2] for x in want[q]], rtol=1e-12)


def test_two_hashes(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    assert {q: [x[1] for x in w] for q, w in run(spark.createDataFrame(rows, SCHEMA), hashes=2, share=1.0, k=5).items()} == \
        {q: [x[1] for x in w] for q, w in brute(rows, 5).items()}


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    r = random.Random(6)
    rows = [(i, [1 + r.random() / 50 for _ in range(4)]) for i in range(100)]
    assert {q: [x[1] for x in w] for q, w in run(spark.createDataFrame(rows, SCHEMA), share=1.0, k=6).items()} == \
        {q: [x[1] for x in w] for q, w in brute(rows, 6).items()}


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == {}


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann.rotate(x, 1, 0, 3), axis=1), np.linalg.norm(x, axis=1))


def test_many_exact_ties_go_to_the_smallest_ids(spark):
    """Vectors whose products with the queries are all equal: far more ties than a result holds, in every block."""
    dim = 64
    unit = lambda i, x: [float(x if j == i else 0) for j in range(dim)]
    rows = [(999 - n, [a + b for a, b in zip(unit(0, 10), unit(j, s), strict=True)])
            for n, (j, s) in enumerate((j, s) for j in range(1, dim) for s in (1, -1))]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for share in (1.0, ann.PROBES):
        got = run(df, share=share)
        exact = sum([i for _, i, _ in got[q]] == [i for _, i, _ in w] for q, w in want.items())
        assert exact == len(want) if share == 1.0 else len(got) == len(want)
    hot = [(i, unit(i % 3, 1)) for i in range(3000)] + [(i, unit(i % 40 + 3, 1)) for i in range(3000, 5000)]
    got = run(spark.createDataFrame(hot, SCHEMA), share=1.0, every=500)
    assert {q: [i for _, i, _ in w] for q, w in got.items()} == {q: [i for _, i, _ in w] for q, w in brute(hot, every=500).items()}


def test_recall_on_the_larger_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want, got = brute([(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]), run(df)
    found = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in w}) for q, w in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))
