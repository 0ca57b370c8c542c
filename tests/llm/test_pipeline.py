import corpus_pipeline

from verity.llm import queries

from . import test_decontam, test_simhash, test_substring
from .helpers import SF, prose, with_clashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "simhash", "substring", "decontamination", "encoding"] and corpus_pipeline.ORACLE_SQL is None


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept, its decisions by the brute-force versions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, kinds = docs.columns, docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        rows = [(d, r.text) for d, r in sorted(before.items())]
        docs = stage(spark, docs, SF)
        after = {r.doc_id: r for r in docs.collect()}
        if name == "encoding":
            assert after.keys() == before.keys() and all(r.n_tokens == len(r.ids) for r in after.values())
            continue
        assert docs.columns == columns and docs.dtypes == kinds
        if name == "quality":
            assert after.items() <= before.items() and 0.7 * len(before) < len(after) < len(before)
        elif name == "simhash":
            assert after == {d: before[d] for d, _, c in test_simhash.slow_components(rows) if d == c}
        elif name == "substring":
            want = {d: (n, gone, sha) for d, n, gone, sha in test_substring.brute(rows, 50)}
            assert after.keys() == {d for d, (n, gone, _) in want.items() if not gone or gone < n}
            left = {d: x for d, *x in test_substring.brute([(d, r.text) for d, r in after.items()], 10**9)}
            for d, r in after.items():
                assert left[d][2] == want[d][2] and r.n_chars == (len(r.text) if want[d][1] else before[d].n_chars)
                assert want[d][1] or r == before[d]
        else:
            bad = {d for d, _ in test_decontam.brute(rows, items)}
            assert bad and after == {d: r for d, r in before.items() if d not in bad}


def test_odd_rows_go_through(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "no id " * 9, "en", None, 5),
            (3, prose(120, 1), None, "s", 1), (4, prose(120, 1), "en", "s", 2), (5, "a " * 20_000, "en", "s", 3)]
    for rows in (rows, []):
        docs = with_clashes(spark.createDataFrame(rows, DOCS))
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = stage(spark, docs, SF)
            assert name == "encoding" or docs.columns == with_clashes(spark.createDataFrame([], DOCS)).columns
        assert docs.count() == (4 if rows else 0)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} == set(out.columns)


def test_queries_have_the_contract_columns(spark):
    kinds = {n: {c: k for c, k in queries.QUERIES[n](spark, SF).dtypes} for n in ("op1_simhash", "op4_warc", "op5_bpe", "op9_sharding")}
    assert kinds["op1_simhash"] == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    assert kinds["op4_warc"] == {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string",
                                 "refers_to": "bigint"}
    assert kinds["op5_bpe"] == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    assert kinds["op9_sharding"] == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
                                     "slot": "bigint", "grown_shard": "int"}
