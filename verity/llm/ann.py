"""Approximate nearest neighbours by cross-polytope hashing (operator 2).

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform.  A vector's hash is the
signed axis nearest to it after the rotation; a bucket is one axis per hash.  Each table has its own
rotations.  A query probes, in every table, the buckets that its own rotated vector points to most.

Nearness is the inner product.  Among vectors of about one norm that is the angle, so vectors are dealt into
bands of norms (a factor of ``BAND`` wide), every band has its own tables, and a query probes all bands.

Equal vectors are one candidate; each keeps its smallest ids, as many as a result can need, and copies are
expanded only at the end.  Buckets are dealt into cells; a cell's vectors and the queries that probe it are
scored block against block.  The number of blocks follows the measured counts, so a bucket
with a third of all vectors is spread over many tasks.  A block returns only the best of each query: all that may tie
with the last one wanted are scored again in double precision on the original vectors, and ties go to the group with the smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialize, ship

TABLES, HASHES, CELLS = 4, 1, 16
PROBES = 0.25              # share of a table's buckets that a query probes
BLOCK = 8192               # vectors, or queries, of one block
BAND = 1.25                # ratio of the norms at the ends of a band; 1 is in the middle of one
SLACK = 1e-9               # of the product of the norms: scores nearer than that are compared exactly
PAIRS = 1 << 20            # scores of one step


def hadamard(a: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row (a power of two long)."""
    rows, n = a.shape
    h = 1
    while h < n:
        a = a.reshape(rows, n // (2 * h), 2, h)
        a = np.stack([a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return a / np.sqrt(n)


def rotate(x: np.ndarray, table: int, number: int, seed: int) -> np.ndarray:
    signs = np.random.default_rng([seed, table, number, x.shape[1]]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def padded(x: np.ndarray) -> np.ndarray:
    """Rows with zeros up to a power of two."""
    n, d = x.shape
    out = np.zeros((n, 1 << (d - 1).bit_length()))
    out[:, :d] = x
    return out


def bands(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1)                  # squares of the largest and smallest numbers overflow
    return np.round((np.log(top) + np.log(((x / top[:, None]) ** 2).sum(axis=1)) / 2) / np.log(BAND)).astype(np.int64)


def axes(r: np.ndarray) -> np.ndarray:
    """How far each rotated row points along each signed axis."""
    return np.stack([r, -r], axis=2).reshape(len(r), -1)


def buckets(x: np.ndarray, table: int, hashes: int, seed: int) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for j in range(hashes):
        out = out * (2 * x.shape[1]) + axes(rotate(x, table, j, seed)).argmax(axis=1)
    return out


def probes(x: np.ndarray, table: int, hashes: int, seed: int, share: float) -> np.ndarray:
    """For each row the buckets to probe, best first: those with the greatest sum along their axes."""
    n_axes = 2 * x.shape[1]
    count = max(1, round(share * n_axes ** hashes))
    each = min(n_axes, max(1, int(np.ceil(count ** (1 / hashes)))) if hashes > 1 else count)
    value, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for j in range(hashes):
        far = axes(rotate(x, table, j, seed))
        best = np.argsort(-far, axis=1, kind="stable")[:, :each]
        value = (value[:, :, None] + np.take_along_axis(far, best, 1)[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * n_axes + best[:, None, :]).reshape(len(x), -1)
    order = np.argsort(-value, axis=1, kind="stable")[:, :count]
    return np.take_along_axis(code, order, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), "<f8").reshape(len(column), -1)


def _by_dimension(batch):
    """Rows of one batch (rep, vector bytes) by the dimension of their vectors."""
    size = np.array([len(x.as_buffer()) for x in batch.column(1)])
    for s in np.unique(size).tolist():
        yield batch.filter(pa.array(size == s))


def _placed(tables, hashes, cells, seed, share=None, all_bands=()):
    """Rows (t, cell, rep, first, v, probed): vectors with their bucket, or queries with the buckets they probe in the cell."""
    def run(batches):
        for whole in batches:
            for b in _by_dimension(whole):
                for at in range(0, b.num_rows, 2000):
                    part = b.slice(at, 2000)
                    raw = _matrix(part.column(1))
                    x = padded(raw)
                    band = bands(raw)
                    for t in range(tables):
                        if share is None:
                            home = buckets(x, t, hashes, seed)
                            yield _rows(band * tables + t, home % cells, part, np.arange(len(x)), [[h] for h in home.tolist()])
                            continue
                        p = probes(x, t, hashes, seed, share)
                        row, cell, lists = [], [], []
                        for c in range(cells):
                            inside = p % cells == c
                            some = np.flatnonzero(inside.any(axis=1))
                            row.append(some)
                            cell.append(np.full(len(some), c))
                            lists += [p[i][inside[i]].tolist() for i in some.tolist()]
                        row, cell = np.concatenate(row), np.concatenate(cell)
                        for other in all_bands:
                            yield _rows(np.full(len(row), other * tables + t), cell, part, row, lists)
    return run


def _rows(t, cell, part, row, lists):
    row = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [pa.array(t.astype(np.int32)), pa.array(cell.astype(np.int32)), part.column(0).take(row), part.column(2).take(row),
         part.column(1).take(row), pa.array(lists, pa.list_(pa.int64()))], ["t", "cell", "rep", "first", "v", "probed"])


def _exact(qv, xv, qi, xi) -> np.ndarray:
    """Inner products of the pairs (qi, xi)."""
    return np.concatenate([np.zeros(0)] + [(qv[qi[i:i + PAIRS // 16]] * xv[xi[i:i + PAIRS // 16]]).sum(axis=1)
                                           for i in range(0, len(qi), PAIRS // 16)])


def _best(qi, score, first, k: int) -> np.ndarray:
    """Positions of each query's best k, by score and then by the smallest id."""
    order = np.lexsort((first, -score, qi))
    start = np.searchsorted(qi[order], qi[order])
    return order[np.arange(len(order)) - start < k]


def _score(k: int):
    """Of one block of queries and one of vectors, the best k vectors of each query, ties to the smallest id."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q_out, x_out, s_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            for q, x in _pairs_of_dimension(left.combine_chunks(), right.combine_chunks()):
                qv, xv = _matrix(q["v"].combine_chunks()), _matrix(x["v"].combine_chunks())
                q_id, x_id, first = q["rep"].to_numpy(), x["rep"].to_numpy(), x["first"].to_numpy()
                far = np.sqrt((qv ** 2).sum(axis=1)), np.sqrt((xv ** 2).sum(axis=1))
                home = x["probed"].combine_chunks().flatten().to_numpy()
                asked = q["probed"].combine_chunks()
                owner = np.repeat(np.arange(len(q_id)), np.diff(asked.offsets.to_numpy()))
                wanted = asked.flatten().to_numpy()
                qi, xi, got = [], [], []
                for b in np.unique(home).tolist():
                    rows, xs = owner[wanted == b], np.flatnonzero(home == b)
                    n, step = min(len(xs), k), max(1, PAIRS // len(xs))
                    for at in range(0, len(rows), step):
                        some = rows[at:at + step]
                        s = qv[some] @ xv[xs].T
                        last = np.partition(s, len(xs) - n, axis=1)[:, len(xs) - n]
                        i, j = np.nonzero(s >= (last - SLACK * far[0][some] * far[1][xs].max())[:, None])
                        i, j = some[i], xs[j]
                        exact = _exact(qv, xv, i, j)
                        top = _best(i, exact, first[j], k)
                        qi.append(i[top]), xi.append(j[top]), got.append(exact[top])
                if not qi:
                    continue
                qi, xi, got = np.concatenate(qi), np.concatenate(xi), np.concatenate(got)
                top = _best(qi, got, first[xi], k)
                q_out.append(q_id[qi[top]]), x_out.append(x_id[xi[top]]), s_out.append(got[top])
        return pa.table({"q": np.concatenate(q_out), "rep": np.concatenate(x_out), "score": np.concatenate(s_out)})
    return run


def _pairs_of_dimension(left: pa.Table, right: pa.Table):
    sizes = [np.array([len(x.as_buffer()) for x in t["v"].combine_chunks()]) for t in (left, right)]
    for s in np.intersect1d(*sizes).tolist():
        yield left.filter(pa.array(sizes[0] == s)), right.filter(pa.array(sizes[1] == s))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20,
            tables: int = TABLES, hashes: int = HASHES, share: float = PROBES, cells: int = CELLS, seed: int = 5) -> DataFrame:
    """The k nearest found of every vector whose id is divisible by ``every``: (query_id, rank, vec_id, score).

    Ties go to the smaller id.  Vectors that are null, zero, or hold null or non-finite components, and rows
    with a null id, take no part; vectors of different lengths are never compared.  A row that repeats an id with the same
    vector counts once; with another vector it is another vector of that id.  An empty table gives an
    empty result; other columns are ignored.  More hashes make smaller buckets, for larger tables.
    """
    ship(vectors.sparkSession)
    v = F.transform(col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), v.alias("a")).where(
        F.col("vec_id").isNotNull() & F.col("a").isNotNull()
        & F.forall("a", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists("a", lambda x: x != 0))
    rows = materialize(rows.distinct(), "vectors")
    asks = (F.col("vec_id") % every == 0).cast("int")
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    ids = few.groupBy("a").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))       # k + 1 ids at most
    asked = rows.groupBy("a").agg(F.max(asks).alias("asked"))
    groups = materialize(ids.join(asked, "a").select(F.xxhash64("a").alias("rep"), "a", "ids", "asked"), "groups")
    schema = "t int, cell int, rep long, first long, v binary, probed array<long>"
    packed = groups.select("rep", F.arrow_udf(_bytes_of, "binary")("a").alias("v"), F.col("ids")[0].alias("first"), "asked")
    data = materialize(packed.select("rep", "v", "first").mapInArrow(_placed(tables, hashes, cells, seed), schema), "placed")
    present = sorted({r["t"] // tables for r in data.select("t").distinct().collect()})   # a few dozen at most
    queries = materialize(packed.where("asked = 1").select("rep", "v", "first").mapInArrow(
        _placed(tables, hashes, cells, seed, share, present), schema), "probing")
    # blocks of each cell, from the counts of its vectors and queries (tables x cells rows)
    sizes = {(r["t"], r["cell"]): (r["x"], r["q"]) for r in
             data.select("t", "cell", F.lit(1).alias("x"), F.lit(0).alias("q")).unionByName(
                 queries.select("t", "cell", F.lit(0).alias("x"), F.lit(1).alias("q")))
             .groupBy("t", "cell").agg(F.sum("x").alias("x"), F.sum("q").alias("q")).collect()}
    spark = vectors.sparkSession
    blocks = F.broadcast(spark.createDataFrame(
        [(t, c, -(-x // BLOCK) or 1, -(-q // BLOCK) or 1) for (t, c), (x, q) in sorted(sizes.items())],
        "t int, cell int, nx long, nq long"))
    salt = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 30))
    data = data.join(blocks, ["t", "cell"]).withColumn("xs", salt % F.col("nx")) \
        .withColumn("qs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)))
    queries = queries.join(blocks, ["t", "cell"]).withColumn("qs", salt % F.col("nq")) \
        .withColumn("xs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)))
    key = ["t", "cell", "xs", "qs"]
    found = queries.select(*key, "rep", "first", "v", "probed").groupBy(*key).cogroup(
        data.select(*key, "rep", "first", "v", "probed").groupBy(*key)).applyInArrow(_score(k + 1), "q long, rep long, score double")
    best = found.groupBy("q", "rep").agg(F.max("score").alias("score"))
    members = groups.select("rep", "ids")
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "first")
    ranked = best.join(members, "rep").withColumn("first", F.col("ids")[0]) \
        .withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).select("q", "score", "ids")
    own = rows.where(asks == 1).select(F.col("vec_id").alias("query_id"), F.xxhash64("a").alias("q"))
    pairs = own.join(ranked, "q").select("query_id", "q", "score", F.explode("ids").alias("vec_id")) \
        .where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "q", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _bytes_of(a: pa.Array) -> pa.Array:
    """Arrays of doubles as their bytes."""
    flat, off = a.flatten().to_numpy(zero_copy_only=False).astype("<f8"), a.offsets.to_numpy()
    off = off - off[0]
    return pa.array([flat[x:y].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)], pa.binary())
