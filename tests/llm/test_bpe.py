import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from verity.llm import bpe
from verity.llm.queries import tokenizer_path

from .helpers import EDGE_ROWS, SF, frame, prose, with_clashes

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def mine():
    return bpe.WordBPE(PATH)


def want(library, rows):
    out = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


HARD = ["it's 'score don't!!'s we'LL 'D", "ΣΑΣ ΟΔΟΣ σς", "İstanbul DŽ ǅ", "é é ﬁ Å", "１２3 ½ ² Ⅷ 四", "한글 한글", "a\u0085b c　d e",
        "<|endoftext|>x<|startoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaa ababababab", "\U0001f600\U0001f468‍\U0001f469", "x\x1cy\x00z",
        "!!!'s ''s '''", "supercalifragilisticexpialidocious"]


def test_same_as_the_library(spark, library):
    rows = EDGE_ROWS + [(100 + i, t) for i, t in enumerate(HARD)] + [(200, prose(2000, 8)), (201, prose(2000, 8))]
    got = bpe.encode_documents(with_clashes(frame(spark, rows)), PATH).collect()
    assert sorted((tuple(r) for r in got), key=str) == want(library, rows)


def test_test_table(spark, library):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r) for r in bpe.encode_documents(df, PATH).collect()), key=str) == want(library, rows)


def test_ids_and_decoding(spark, library):
    rows = [(i, t) for i, t in enumerate(HARD)]
    got = bpe.encode_documents(frame(spark, rows), PATH, with_ids=True).withColumn("text", bpe.decode_udf(PATH)("ids")).collect()
    for r in got:
        ids = library.encode(HARD[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.text == library.decode(ids, skip_special_tokens=False)


def test_compatibility_decides_as_merging_does(mine):
    """A pair of tokens is compatible exactly when merging their joined letters gives the pair back."""
    r = random.Random(1)
    names = {i: t for t, i in mine.prefixes.items() if i >= 0}
    starts = [i for i, t in names.items() if not t.endswith("\n")]
    pairs = [(r.choice(starts), r.choice(list(names))) for _ in range(3000)]
    good = mine.compatible(*(np.array(x) for x in zip(*pairs)))
    assert good.any() and not good.all()
    for (x, y), ok in zip(pairs, good.tolist()):
        assert ok == (mine.merge(names[x] + names[y]) == [x, y])


def test_words_equal_exact_merging(mine):
    r = random.Random(2)
    words = ["".join(r.choice("abcdeghilnorstu") for _ in range(r.randrange(1, 14))) + "\n" for _ in range(2000)] + ["aaaaaaa\n", "a\n"]
    assert mine.encode_words(words) == [mine.merge(w) for w in words]


def test_full_cache_changes_nothing(mine, monkeypatch):
    text = pa.array([prose(200, i) for i in range(5)])
    ids, off = mine.encode(text)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    mine.cache.clear()
    again, off2 = mine.encode(text)
    assert (ids == again).all() and (off == off2).all()


def test_empty_table(spark):
    assert bpe.encode_documents(frame(spark, []), PATH).collect() == []


def test_very_long_words_and_texts(spark, mine, library):
    """One word of a megabyte, and a text of many: same ids as the library, in time that does not grow with the square."""
    r = random.Random(4)
    for word in ("".join(r.choice("abcdefghijklmnop") for _ in range(1 << 20)), "a" * 100_001, "\u4e2d\u6587" * 3000):
        got = np.frombuffer(mine.encode_chunks([word])[0], "<u4").tolist()
        assert got == library.encode(word, add_special_tokens=False).ids
    rows = [(1, prose(700_000, 5)), (2, "y" * 200_000)]
    assert sorted(tuple(x) for x in bpe.encode_documents(frame(spark, rows), PATH).collect()) == want(library, rows)


def test_long_merging_equals_short_merging(mine, monkeypatch):
    r = random.Random(6)
    words = ["".join(r.choice("aabcdeghilnorstu") for _ in range(r.randrange(1, 40))) + "\n" for _ in range(1500)]
    plain = [mine.merge(w) for w in words]
    monkeypatch.setattr(bpe, "SCAN", 0)
    assert [mine.merge(w) for w in words] == plain
