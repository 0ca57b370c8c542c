import zlib

import numpy as np
import pytest

from verity.llm import token_store as store
from verity.llm.queries import tokenizer_path
from verity.session import scratch_path

from .helpers import EDGE_ROWS, SF, frame, prose, with_clashes

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def want(library, rows):
    out, start = [], 0
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", [1, 3, 8, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000, dtype=np.uint64).astype(np.uint32)
    packed = store.pack(ids, bits)
    assert len(packed) == -(-1000 * bits // 8) and (store.unpack(packed, bits, 1000) == ids).all()


def test_segment_random_access():
    ids = np.random.default_rng(1).integers(0, 50_257, 40_000).astype(np.uint32)
    data = b"xx" + store.segment(3, 4, [7, None, -5], np.array([10, 0, 39_990]), ids, 16)
    s = store.Segment(data, 2)
    assert (s.part, s.number, s.bits, s.n_docs) == (3, 4, 16, 3) and s.end == len(data) and s.null.tolist() == [0, 1, 0]
    for a, b in ((0, 0), (0, 40_000), (16_383, 16_385), (39_999, 40_000), (5, 5)):
        assert (s.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        store.Segment(data[:-1], 2)
    with pytest.raises(ValueError):
        store.segment(0, 0, [1], np.array([1]), np.array([70_000], np.uint32), 16)


def test_bits_for():
    assert [store.bits_for(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


def test_same_as_the_library(spark, library):
    rows = EDGE_ROWS + [(9, "it's  two spaces"), (10, " lead"), (11, "trail "), (12, "a\n b \n\nc"), (13, "x<|endoftext|>y z"),
                        (14, "nbsp     thin"), (15, prose(3000, 4))]
    got = store.store_and_read(with_clashes(frame(spark, rows)), scratch_path(spark, "t"), PATH).collect()
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    left = list(rows)
    order = []
    for d, _, n, crc in got:                       # rows with equal ids may be in any fixed order
        t = next(r for r in left if r[0] == d and want(library, [r])[0][2:] == (n, crc))
        left.remove(t)
        order.append(t)
    assert not left and got == want(library, order)


def test_several_segments_and_files(spark, library, monkeypatch):
    rows = [(i, prose(40, i)) for i in range(60)]
    out = scratch_path(spark, "t")
    store.write_ids(frame(spark, rows), out, PATH)
    got = store.read_documents(spark, out).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want(library, rows)


def test_test_table(spark, library):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = store.store_and_read(df, scratch_path(spark, "t"), PATH).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want(library, [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()])


def test_empty_table(spark):
    assert store.store_and_read(frame(spark, []), scratch_path(spark, "t"), PATH).collect() == []
