"""Document quality: supervised subword embeddings (operator 10).

Every word gives features: itself, its character n-grams (with word-edge marks) and the pair
it makes with the word before it; a word that repeats the one before it is also the feature
"again".  Features are hashed into ``BUCKETS`` rows of a learned embedding table.  A document is
the average of its features' vectors, followed by a softmax over the two labels; table and softmax
are trained together by numpy stochastic gradient descent on a bounded sample of labelled rows.

The model is linear in the averaged vector, so for scoring each bucket is folded into one number,
and a document's log-odds are the average of its features' numbers.  Scoring reads whole
texts in Arrow batches; the features of a word are worked out once per batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, col, mix, ship, slices

BUCKETS, DIM = 1 << 16, 16
NGRAMS = (2, 3, 4)
SAMPLE_PER_LABEL = 1200         # the bound of the training sample
STEP_BYTES = 2 << 20             # text that is scored at a time
EPOCHS, RATE = 12, 0.5
KEEP = 0.7
_ROLL = Rolling(0x9E3779B97F4A7C15)
_AGAIN = 0                      # the bucket of "this word repeats the one before it"


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + np.uint64(kind)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def word_features(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of some words, and the word that each belongs to."""
    text = "".join(f"<{v}>" for v in values)
    size = np.fromiter((len(v) + 2 for v in values), np.int64, len(values))
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    prefix = _ROLL.prefix(mix(letters + np.uint64(1)))
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(values)), size)
    out, own = [_bucket(_ROLL.span(prefix, end - size, end), 1)], [np.arange(len(values))]
    for n in NGRAMS:
        i = np.arange(max(0, len(letters) - n + 1))
        i = i[i + n <= end[owner[i]]]
        out.append(_bucket(_ROLL.span(prefix, i, i + n), n))
        own.append(owner[i])
    return np.concatenate(out), np.concatenate(own)


def pair_features(words: Words, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word that has one before it in its text: its position, and the bucket of the pair."""
    has = np.ones(len(words.codes), bool)
    has[words.offsets[:-1][words.offsets[:-1] < len(has)]] = False
    at = np.flatnonzero(has)
    a, b = names[words.codes[at - 1]], names[words.codes[at]]
    return at, np.where(a == b, _AGAIN, _bucket(mix(a) + b, 9))


def _names(words: Words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(v.as_buffer()) for v in words.values), np.uint64, len(words.values))


@dataclass
class Model:
    """Folded scores per bucket, and the bias of the log-odds."""

    weight: np.ndarray
    bias: float

    def score(self, text: pa.Array) -> np.ndarray:
        """The probability of label 1 of each text (no words: that of the bias alone)."""
        out = []
        for at, n in slices(text, STEP_BYTES):
            words = Words(text.slice(at, n))
            if not len(words.codes):
                out.append(np.zeros(n))
                continue
            bucket, owner = word_features(words.values.to_pylist())
            total = np.bincount(owner, self.weight[bucket], len(words.values))[words.codes]
            count = np.bincount(owner, minlength=len(words.values))[words.codes].astype(float)
            pos, pair = pair_features(words, _names(words))
            total[pos] += self.weight[pair]
            count[pos] += 1
            t, c = (np.concatenate([[0.0], np.cumsum(x)])[words.offsets] for x in (total, count))
            out.append(np.diff(t) / np.maximum(np.diff(c), 1))
        odds = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(odds + self.bias, -500, 500)))


def _bags(batches):
    """Per training row (text, label, id): its buckets with their shares of all feature occurrences."""
    for b in batches:
        for i in range(b.num_rows):
            words = Words(b.column(0).slice(i, 1))
            count = np.zeros(BUCKETS)
            if len(words.codes):
                bucket, owner = word_features(words.values.to_pylist())
                count += np.bincount(bucket, np.bincount(words.codes, minlength=len(words.values))[owner], BUCKETS)
                count += np.bincount(pair_features(words, _names(words))[1], minlength=BUCKETS)
            some = np.flatnonzero(count)
            share = (count[some] / max(count.sum(), 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(2).slice(i, 1), pa.array([some.astype(np.int32)], pa.list_(pa.int32())),
                                              pa.array([share], pa.list_(pa.float32())), b.column(1).slice(i, 1)],
                                             ["i", "bucket", "share", "label"])


def held_out(id_column):
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2 (a null id: false)."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sgd(bags: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Train embeddings and softmax by stochastic gradient descent, one document a step."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount([y for _, _, y in bags], minlength=2) / max(len(bags), 1)
    steps, t = max(1, EPOCHS * len(bags)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)).tolist():
            bucket, weight, y = bags[i]
            rate = RATE * (1 - t / steps)
            t += 1
            hidden = weight @ table[bucket] if len(bucket) else np.zeros(DIM, np.float32)
            z = hidden @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= 0.5 / max(share[y], 1e-6)                   # both labels weigh the same
            back = soft @ p
            soft -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            if len(bucket):
                table[bucket] -= (rate * len(bucket) ** 0.5) * np.outer(weight, back)
    d = soft[:, 1] - soft[:, 0]
    return Model((table @ d).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model:
    """Fit on at most SAMPLE_PER_LABEL labelled rows of each label, picked by a hash of the id, none held out.

    A document with several labels counts with the least one; null labels and ids are left out.  Of rows that repeat an id the
    one whose text has the least hash is learned.  Texts are learned whole.
    """
    ship(docs.sparkSession)
    known = labels.select(col(id_col).alias("i"), col(label_col).cast("int").alias("y")) \
        .where("i is not null and y in (0, 1)").where(~held_out(F.col("i"))).groupBy("i").agg(F.min("y").alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(SAMPLE_PER_LABEL) for y in (0, 1)]
    sample = picked[0].unionByName(picked[1])                # at most 2 * SAMPLE_PER_LABEL rows
    texts = docs.join(F.broadcast(sample), col(id_col) == F.col("i")) \
        .select("i", F.coalesce(col(text_col), F.lit("")).alias("text"), "y")
    rows = texts.groupBy("i", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))     # one row an id, each task's own first
    bags = rows.select("text", "y", "i").mapInArrow(_bags, "i long, bucket array<int>, share array<float>, label int")
    got = [(r["i"], (np.array(r["bucket"], np.int32), np.array(r["share"], np.float32), r["label"])) for r in bags.toLocalIterator()]
    return sgd([bag for _, bag in sorted(got, key=lambda x: x[0])])


def score_udf(model: Model):
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(text))
    return score


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                    keep: float = KEEP) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= keep).

    Null and empty texts get the score of the bias; null ids and repeated rows are passed through; an empty
    table gives an empty result; only the text is an input of the score.
    """
    ship(docs.sparkSession)
    return docs.select(col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"),
                       score_udf(model)(col(text_col)).alias("score")) \
        .withColumn("predicted", (F.col("score") >= keep).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``keep``, all columns as they are."""
    ship(docs.sparkSession)
    return docs.where(score_udf(model)(col(text_col)) >= keep)
