import random

import pyarrow as pa
import pytest

from verity.llm import lengths
from verity.llm.queries import tokenizer_path

from .helpers import EDGE_ROWS, SF, frame, prose, with_clashes

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
HARD = ["a  b", " a b ", "a \tb", "x\n\n y  z", "it's we'll don't !!! ... 1234 5,678.90", "<|endoftext|> x <|endoftext|>y<s> </s>",
        "▁a ▁ b", "中文 字符 한글 　 x", "\U0001f600 \U0001f468‍\U0001f469", "a b   c", "a\x1c b \x85 c", "  ", " ", "a ",
        "́ é Å", "\x00 \x00a"]


def library(name):
    if name.endswith(".model"):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        return lambda t: len(m.encode(t or ""))
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_padding(), t.no_truncation()
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


def want(name, rows, limit=512):
    count = library(name)
    return sorted(((d, len((t or "").encode()), n := count(t), n > limit) for d, t in rows), key=str)


def run(df, name, **kw):
    return sorted((tuple(r) for r in lengths.count_tokens(df, tokenizer_path(name), **kw).collect()), key=str)


@pytest.mark.parametrize("name", FILES)
def test_same_as_the_library(spark, name):
    rows = EDGE_ROWS + [(100 + i, t) for i, t in enumerate(HARD)] + [(200, prose(2000, 8)), (200, prose(2000, 8))]
    rows += [(300 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert run(with_clashes(frame(spark, rows)), name) == want(name, rows)


@pytest.mark.parametrize("name", FILES)
def test_random_texts_in_small_steps(name, monkeypatch):
    """Texts of odd characters, with every limit so small that texts are split and caches overflow."""
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "b", "'s", "é", " ", " ", "  ", "\n", " ", "!", "7", "中", "▁", "<|endoftext|>", "\x1d", "́"])
                     for _ in range(r.randrange(60))) for _ in range(1500)]
    for limit, x in (("STEP_BYTES", 40), ("BATCH_BYTES", 30), ("CACHE_PARTS", 20)):
        monkeypatch.setattr(lengths, limit, x)
    count = library(name)
    assert lengths.Lengths(tokenizer_path(name)).count(pa.array(texts)).tolist() == [count(t) for t in texts]


def test_very_long_text(spark):
    rows = [(1, prose(2_500_000, 2)), (2, "z" * 50_000 + " " + "y" * 50_000)]
    assert len(rows[0][1]) > 2 * lengths.STEP_BYTES
    assert run(frame(spark, rows), FILES[0]) == want(FILES[0], rows)


def test_safe_boundaries_are_read_from_the_file():
    assert [lengths.Lengths(tokenizer_path(f)).library.safe for f in FILES] == [True, False, True]


def test_limit_and_empty_table(spark):
    assert [r[3] for r in run(frame(spark, [(1, "a b c d")]), FILES[0], limit=3)] == [True]
    assert [r[3] for r in run(frame(spark, [(1, "a b c d")]), FILES[0], limit=4)] == [False]
    assert run(frame(spark, []), FILES[0]) == []
