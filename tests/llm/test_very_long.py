"""One text of many megabytes, and one word of a megabyte, through the operators that read whole texts."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from verity.llm import decontam, lengths, quality, substring, token_store
from verity.llm.queries import tokenizer_path

from .helpers import frame, prose

JSON = tokenizer_path("byte_bpe_50k.json")
LONG = prose(4_000_000, 1, vocabulary=5000)          # about 20 MB
WORD = "ab" * (1 << 19)


@pytest.fixture(scope="module")
def rows():
    return [(1, LONG), (2, WORD), (3, prose(60, 9)), (4, LONG[:400_000] + " tail")]


def test_token_files_hold_the_long_text():
    c = token_store.coder(JSON)
    ids, off = c.encode(pa.array([LONG, WORD]))
    assert off[1] == sum(np.diff(c.encode(pa.array([part]))[1])[0] for part in (LONG,))
    assert c.tokenizer.decode(ids[:off[1]].tolist()) == LONG and c.tokenizer.decode(ids[off[1]:].tolist()) == WORD
    assert lengths.Lengths(JSON).count(pa.array([LONG, WORD])).tolist() == np.diff(off).tolist()


def test_repeats_of_the_long_text(spark, rows):
    got = {r.doc_id: r for r in substring.dedup_digest(frame(spark, rows), window=50).collect()}
    words = rows[3][1].split()
    kept = words[len(LONG[:400_000].split()) - 1:] if LONG[400_000] != " " else words[len(LONG[:400_000].split()):]
    assert (got[1].n_words, got[1].n_removed, got[2].n_words) == (4_000_000, 0, 1)
    assert got[4].n_removed == len(words) - len(kept) and got[4].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_scores_and_benchmark_of_the_long_text(spark, rows):
    m = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS), 0.1)
    assert np.isfinite(m.score(pa.array([t for _, t in rows]))).all()
    item = prose(30, 77, vocabulary=9000)
    docs = frame(spark, [(1, LONG + " " + item + " " + LONG[:1000]), (2, WORD), (3, "clean")])
    got = decontam.find_matches(docs, frame(spark, [(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.first_word, r.n_words) for r in got] == [(1, 7, 4_000_000, 30)]
    assert [r.doc_id for r in decontam.drop_contaminated(docs, frame(spark, [(7, item)], "item_id long, text string")).orderBy("doc_id").collect()] == [2, 3]
