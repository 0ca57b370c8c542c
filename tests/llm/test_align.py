import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from verity.llm import align
from verity.llm.bpe import byte_letters
from verity.llm.queries import tokenizer_path

from .helpers import EDGE_ROWS, SF, frame, prose, with_clashes

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    """Text to ((id, bytes) of A, of B), whole texts by the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(byte_letters())}

    def run(text):
        x = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return x, y
    return run


def brute(tokens, rows):
    found, counts = [], {}
    for d, t in rows:
        a, b = tokens(t) if t else ([], [])
        want = b" " + (t or "").encode()
        if not t or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            found.append((d, [], [], [], []))
            continue
        ends = [np.cumsum([len(x) for _, x in s]).tolist() for s in (a, b)]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for e in shared:
            x, y = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(str(k) for k, _ in a[i:x]) + "|" + ",".join(str(k) for k, _ in b[j:y]))
            i, j = x, y
        links, j = [], 0
        for i, (k, x) in enumerate(a):
            lo, hi = ends[0][i] - len(x), ends[0][i]
            while ends[1][j] <= lo:
                j += 1
            q = j
            while q < len(b) and ends[1][q] - len(b[q][1]) < hi:
                links.append((k, b[q][0]))
                q += 1
        for p in set(links):
            counts[p] = counts.get(p, 0) + 1
        found.append((d, a, b, groups, links))
    best = {}
    for (k, _), n in counts.items():
        best[k] = max(best.get(k, 0), n)
    return sorted(((d, len(a), len(b), len(g), len(x), sum(counts[p] == best[p[0]] for p in x), sum(counts[p] for p in x),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, g, x in found), key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in align.align_documents(df, A, B, **kw).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


HARD = ["a  b", " a b ", "a \tb", "x\n\n y  z", "it's we'll don't !!! ... 1234 5,678.90", "<|endoftext|> x <|endoftext|>y<s> </s> <unk>",
        "▁a ▁ b", "中文 字符 한글 　 x", "\U0001f600 \U0001f468‍\U0001f469", "a b   c", "  ", " ", "a ", "́ é Å", "\x00 \x00a", "<0x41> <0x0A>"]


def test_same_as_brute_force(spark, tokens):
    rows = EDGE_ROWS + [(100 + i, t) for i, t in enumerate(HARD)] + [(200, prose(800, 8))] * 3
    assert run(with_clashes(frame(spark, rows))) == brute(tokens, rows)


def test_test_table_in_small_chunks(spark, tokens):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute(tokens, [(r.doc_id, r.text) for r in df.collect()])
    assert run(df) == want
    assert run(df.repartition(5), chunk_bytes=2000) == want


def test_cuts_equal_the_common_ends():
    """Random tokenizations: the groups begin where both do, at every step of the recursion's order."""
    r = random.Random(5)
    for _ in range(300):
        a_end, b_end, a_of, b_of, want, base = [], [], [0], [0], [], 0
        for _ in range(r.randrange(1, 5)):
            size = r.randrange(1, 60)
            x, y = (sorted({size, *(r.randrange(1, size + 1) for _ in range(r.randrange(20)))}) for _ in range(2))
            both = [e for e in x if e in y]
            want += [(len(a_end) + (x.index(e) + 1 if e else 0), len(b_end) + (y.index(e) + 1 if e else 0)) for e in [0, *both[:-1]]]
            a_end += [base + e for e in x]
            b_end += [base + e for e in y]
            base += size
            a_of.append(len(a_end)), b_of.append(len(b_end))
        a, b = align.shared_cuts(*(np.array(v) for v in (a_end, b_end, a_of, b_of)))
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == want
        x, y = align.links(np.array(a_end), np.array(b_end), np.array([0, *a_end[:-1]]))
        pairs = [(i, j) for i in range(len(a_end)) for j in range(len(b_end))
                 if max([0, *a_end][i], [0, *b_end][j]) < min(a_end[i], b_end[j])]
        assert list(zip(x.tolist(), y.tolist(), strict=True)) == pairs


def test_full_cache_and_long_words(monkeypatch, tokens):
    texts = ["x" * 3000 + " " + "qu" * 2000, prose(300, 1), "-" * 500 + " a"]
    monkeypatch.setattr(align, "CACHE_PARTS", 5)
    b, c = align.Both(A, B), align.Chunk()
    for t in texts:
        c.add(b, pa.array([1]), pa.array([t]))
    want = {w[0]: w[1:5] + w[7:] for w in brute(tokens, list(enumerate(texts)))}
    for i, d in enumerate(c.docs):
        assert tuple(d.column(k)[0].as_py() for k in (1, 2, 3, 4, 5)) == want[i]


def test_very_long_text(spark, tokens):
    rows = [(1, prose(300_000, 2)), (2, "tail")]
    got = run(frame(spark, rows))
    a, b = tokens(rows[0][1])
    assert [(r[0], r[1], r[2]) for r in got] == [(1, len(a), len(b)), (2, *map(len, tokens("tail")))]


def test_empty_table(spark):
    assert run(frame(spark, [])) == []
