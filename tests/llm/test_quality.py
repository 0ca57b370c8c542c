import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from verity.llm import quality

from .helpers import EDGE_ROWS, frame, with_clashes

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")


@pytest.fixture(scope="module")
def model(data):
    return quality.train(*data)


def test_accuracy_on_held_out_rows(data, model):
    docs, labels = data
    rows = quality.score_documents(docs, model).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(out) > 50 and sum(r.predicted == r.quality for r in out) >= 0.97 * len(out)
    assert sum(r.predicted for r in out if r.quality) >= 0.98 * sum(r.quality for r in out)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_held_out_labels_change_nothing(spark, data, model):
    docs, labels = data
    flipped = labels.withColumn("quality", __import__("pyspark").sql.functions.when(
        quality.held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality))
    again = quality.train(docs, flipped)
    assert again.bias == model.bias and (again.weight == model.weight).all()


def slow_score(model, text):
    """The average of the folded weights of every feature occurrence, word by word."""
    from .helpers import words
    total, count, before = 0.0, 0, None
    for w in words(text):
        bucket, _ = quality.word_features([w])
        total, count = total + model.weight[bucket].sum(), count + len(bucket)
        if before is not None:
            _, pair = quality.pair_features(quality.Words(pa.array([f"{before} {w}"])), quality._names(quality.Words(pa.array([f"{before} {w}"]))))
            total, count = total + model.weight[pair].sum(), count + 1
        before = w
    return 1 / (1 + np.exp(-(total / max(count, 1) + model.bias)))


def test_batches_score_like_single_words(spark):
    r = np.random.default_rng(1)
    m = quality.Model(r.normal(size=quality.BUCKETS), 0.25)
    texts = [t for _, t in EDGE_ROWS] + ["a a a b", "é <b> é", "x"]
    assert np.allclose(m.score(pa.array(texts)), [slow_score(m, t) for t in texts])
    got = quality.score_documents(with_clashes(frame(spark, EDGE_ROWS)), m).collect()
    assert len(got) == len(EDGE_ROWS) and all(r.held_out is not None and r.score is not None for r in got)
    assert quality.score_documents(frame(spark, []), m).collect() == []


def test_odd_labels(spark, data):
    docs, labels = data
    rows = [(None, 1), (5, None), (6, 1), (6, 0), (7, 9)]
    m = quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    assert np.isfinite(m.weight).all()
    m = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert m.score(pa.array(["any text"]))[0] == pytest.approx(0.5, abs=0.01)


def test_learns_a_repeated_word_that_it_never_saw():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = [(" ".join([word()] * 30), 0) if i % 2 else (" ".join(word() for _ in range(30)), 1) for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in texts]), pa.array([y for _, y in texts]),
                                        pa.array(range(200))], ["text", "y", "i"])
    bags = [(b.column(1)[0].values.to_numpy().astype(int), b.column(2)[0].values.to_numpy(), b.column(3)[0].as_py())
            for b in quality._bags([batch])]
    m = quality.sgd(bags)
    assert m.score(pa.array(["zzyyxx " * 20]))[0] < 0.3 < 0.7 < m.score(pa.array([" ".join(word() for _ in range(40))]))[0]


def test_repeated_ids_and_long_texts_are_learned_once_and_whole(spark, data):
    """A third of the rows share one labelled id: one of them, the same in any order, reaches the driver."""
    docs, labels = data
    hot = labels.where(~quality.held_out(labels.doc_id)).first().doc_id
    more = spark.range(400).selectExpr(f"{hot}L as doc_id", "concat('copy ', id) as text")
    rows = docs.select("doc_id", "text").unionByName(more)
    a = quality.train(rows, labels)
    b = quality.train(rows.orderBy("text"), labels)
    assert a.bias == b.bias and (a.weight == b.weight).all()
    seen = {}
    for tail in ("good", "bad"):                       # texts that differ after a hundred thousand characters only
        one = spark.createDataFrame([(hot, "same " * 30_000 + tail * 20_000)], "doc_id long, text string")
        seen[tail] = quality.train(one, labels).weight
    assert (seen["good"] != seen["bad"]).any()
