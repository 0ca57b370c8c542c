"""The registered queries of the operators: each reads its whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import align, ann, bpe, decontam, lengths, licenses, prefix_trie, quality, sharding, simhash, substring, token_store, warc


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4).select(
        "doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"),
                                      tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"), scratch_path(spark, "warc")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_digest(table(spark, sf_dir, "documents"), window=50)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents"), licenses.train(spark)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                 tokenizer_path("piece_bpe_32k.model"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_simhash, op2_neighbours, op3_token_store, op4_warc, op5_bpe, op6_decontamination, op7_substring, op8_licences,
    op9_sharding, op10_quality, op11_alignment, op12_token_counts, op13_prefix_trie)}

ORACLE: dict[str, str] = {
    "op4_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
             f as (select d, min(page_id) as first from p where n >= 100 group by d)
        select p.page_id, p.n::bigint as payload_bytes, p.d as payload_digest,
               case when first < page_id then 'revisit' else 'response' end as record_type,
               case when first < page_id then first end as refers_to
        from p left join f on p.d = f.d and p.n >= 100""",
    "op7_substring": r"""
        with t as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
                   from documents),
             p as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from t where len(w) >= 50),
             k as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from p),
             f as (select h, min(doc_id) as first from k group by h),
             g as (select distinct doc_id, unnest(range(i, i + 50)) as j from k join f using (h) where doc_id > first),
             r as (select doc_id, list(j) as js from g group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(len(js), 0)::bigint as n_removed,
               sha256(array_to_string(case when js is null then w else
                   list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(js, x[2])), lambda x: x[1]) end, ' '))
                   as kept_sha256
        from t left join r using (doc_id)""",
    "op13_prefix_trie": """
        with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as pos,
                          coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
             c as (select conv_id, conv_id - conv_id % 5 as first, xor(4294967295::ubigint, list_reduce(list_transform(
                       string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint), lambda crc, byte: list_reduce(
                           list_transform(range(8), lambda i: i::ubigint), lambda v, i: case when v % 2 = 1
                               then xor(v // 2, 3988292384::ubigint) else v // 2 end, xor(crc, byte)), 4294967295::ubigint)) % 9 as h
                   from (select distinct conv_id from t)),
             k as (select c.conv_id, h, count(t.pos) as n from c left join t on t.conv_id = c.first and t.pos < h group by all),
             r as (select c.conv_id, t.pos, role, text from c join t on t.conv_id = c.first where t.pos < h
                   union all select k.conv_id, t.pos - h + n, role, text from k join t using (conv_id) where t.pos >= h),
             s as (select conv_id, list(md5(md5(role) || md5(text)) order by pos) as names, list(strlen(text) order by pos) as sizes
                   from r group by conv_id),
             m as (select conv_id, coalesce(names, []) as names, coalesce(sizes, []) as sizes from c left join s using (conv_id)),
             p as (select conv_id, d, md5(array_to_string(names[1:d], '')) as node, sizes[d] as bytes, d = len(names) as ended,
                          case when d > 0 then md5(array_to_string(names[1:d - 1], '')) end as parent
                   from (select *, unnest(range(0, len(names) + 1)) as d from m)),
             n as (select node, d, min(parent) as parent, min(conv_id) as least, count(*) as n, max(bytes) as bytes,
                          string_agg(conv_id::varchar, ',' order by conv_id) filter (where ended) as ends from p group by node, d),
             f as (select parent as node, count(*) as children from n where parent is not null group by parent),
             a as (select distinct x.node as node, y.node as above from p x join p y on x.conv_id = y.conv_id and y.d <= x.d),
             w as (select above as node, count(*) filter (where f.node is null) as leaves, sum((n.n - 1) * coalesce(bytes, 0)) as saved
                   from a join n on n.node = a.node left join f on f.node = a.node group by above)
        select n.least::bigint as conv_id, n.d::bigint as depth, u.least::bigint as parent_conv_id, n.n::bigint as n_convs,
               coalesce(children, 0)::bigint as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens,
               sha256(coalesce(n.ends, '')) as ends_sha256
        from n left join n u on u.node = n.parent left join f on f.node = n.node join w on w.node = n.node""",
}
