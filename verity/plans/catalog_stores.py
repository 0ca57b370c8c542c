"""Queries over stores with several writers, deltas of versions, and folders of large or mixed uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures
from .catalog import (_HIST_CTE, _RSQL, _all_text, _autofix, _before_after_sql, _customer_fix, _entries, _inspection, _scratch, _vsql,
                      register)
from .oracle_inspect import InspectSQL

_RETAINED = _HIST_CTE + ("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, "
                         "id DESC) AS rn FROM entries) WHERE rn <= 50")


@register("history_two_writers_events", _RETAINED)
def _two_writers(spark, sf_dir):
    """Four appends by two writers; each but the last commits while the other one is between reading and committing."""
    from ..operators.history import HistoryStore
    path, entries = _scratch(spark, "history"), _entries(spark, sf_dir)
    parts = [entries.where(F.pmod(F.col("id").cast("long"), F.lit(4)) == i) for i in range(4)]
    a, b = HistoryStore(spark, path), HistoryStore(spark, path)
    turns = [(a, parts[0]), (b, parts[1]), (a, parts[2]), (b, parts[3])]

    def overtaken(store):
        commit = store.log.commit

        def late(seq, entry):
            if turns:
                other, part = turns.pop()
                other.append(part)
            return commit(seq, entry)
        store.log.commit = late
    overtaken(a), overtaken(b)
    store, part = turns.pop()
    store.append(part)
    return HistoryStore(spark, path).table()


@register("history_clear_overtaken_events", f"SELECT * FROM ({_RETAINED}) WHERE user_id <> (SELECT CAST(min(user_id) AS VARCHAR) FROM events)")
def _clear_overtaken(spark, sf_dir):
    """A clear whose user's bucket gets the other half of the entries before it commits: it is decided again."""
    from ..operators.history import HistoryStore
    path, entries = _scratch(spark, "history"), _entries(spark, sf_dir)
    a, b = HistoryStore(spark, path, buckets=4), HistoryStore(spark, path, buckets=4)
    a.append(entries.where("cast(id as long) % 2 = 0"))
    commit, left = a.log.commit, [entries.where("cast(id as long) % 2 = 1")]

    def late(seq, entry):
        if left:
            b.append(left.pop())
        return commit(seq, entry)
    a.log.commit = late
    a.clear(str(fixtures.table(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]))
    return HistoryStore(spark, path).table()


_ORDERS = "SELECT o_orderkey AS _row_id, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS ordered FROM orders"


def _version_chain(spark, sf_dir):
    """Six versions of the orders: edits, hand edits, removed and added rows; the fourth is a whole table again."""
    from ..operators.review import TableVersions
    o = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_row_id"), F.col("o_orderstatus").alias("status"),
                                                       F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("ordered"))
    tv = TableVersions(spark, _scratch(spark, "versions"), base_every=3)
    tv.push(o)
    key = F.col("_row_id")
    tv.push(o.withColumn("status", F.when(key % 10 == 1, F.lower("status")).otherwise(F.col("status"))))
    tv.push_cells(o.where(key % 10 == 2).select("_row_id", F.lit("price").alias("column"), F.lit("0.5").alias("value")))
    tv.push(tv.current().where(key % 10 != 3))
    tv.push(tv.current().unionByName(o.where(key % 20 == 3).withColumn("status", F.lit("back"))))
    tv.push(tv.current().withColumn("ordered", F.when(key % 10 == 4, F.lit(None)).otherwise(F.col("ordered"))))
    return tv


_VERSION_4 = (f"SELECT _row_id, CASE WHEN _row_id % 20 = 3 THEN 'back' WHEN _row_id % 10 = 1 THEN lower(status) ELSE status END AS status, "
              f"CASE WHEN _row_id % 10 = 2 THEN 0.5 ELSE price END AS price, ordered FROM ({_ORDERS}) WHERE _row_id % 20 <> 13")


@register("versions_delta_orders", f"SELECT _row_id, status, price, CASE WHEN _row_id % 10 <> 4 THEN ordered END AS ordered FROM ({_VERSION_4})")
def _versions_delta(spark, sf_dir):
    """The last version, after everything was undone and done again by another opening of the folder."""
    from ..operators.review import TableVersions
    tv = _version_chain(spark, sf_dir)
    again = TableVersions(spark, tv.path, base_every=3)
    while again.undo():
        pass
    while tv.redo():
        pass
    return again.current()


@register("versions_undone_orders", f"SELECT _row_id, status, price, ordered FROM ({_ORDERS}) WHERE _row_id % 10 NOT IN (1, 2) UNION ALL "
          f"SELECT _row_id, CASE WHEN _row_id % 10 = 1 THEN lower(status) ELSE status END AS status, "
          f"CASE WHEN _row_id % 10 = 2 THEN 0.5 ELSE price END AS price, ordered FROM ({_ORDERS}) WHERE _row_id % 10 IN (1, 2)")
def _versions_undone(spark, sf_dir):
    """Three steps back: the third version, read by the inverse of the fourth one's delta."""
    tv = _version_chain(spark, sf_dir)
    assert tv.undo() and tv.undo() and tv.undo()
    return tv.current()


@register("versions_delta_rows_orders",
          f"""WITH o AS ({_ORDERS}) SELECT step, op, count(*) AS n_rows, count(*) * cells AS n_cells FROM (
              SELECT 1 AS step, 'edit' AS op, 1 AS cells FROM o WHERE _row_id % 10 = 1 AND lower(status) <> status UNION ALL
              SELECT 2, 'edit', 1 FROM o WHERE _row_id % 10 = 2 AND price <> 0.5 UNION ALL
              SELECT 3, 'remove', 3 FROM o WHERE _row_id % 10 = 3 UNION ALL
              SELECT 4, 'add', 3 FROM o WHERE _row_id % 20 = 3 UNION ALL
              SELECT 5, 'edit', 1 FROM o WHERE _row_id % 10 = 4 AND ordered IS NOT NULL) GROUP BY step, op, cells""")
def _versions_rows(spark, sf_dir):
    """What each version wrote: an edit as many rows as it touches, never the table."""
    tv = _version_chain(spark, sf_dir)
    out = None
    for step, v in enumerate(tv.log.head()[1]["kept"]):
        if v["delta"]:
            d = spark.read.parquet(f"{tv.path}/{v['delta']}").select(F.lit(step).alias("step"), "op", F.size("changed").alias("cells"))
            out = d if out is None else out.unionByName(d)
    return out.groupBy("step", "op").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cells").alias("n_cells"))


# ---------------------------------------------------------------------------
# Uploads that are large or not UTF-8
# ---------------------------------------------------------------------------

LINES_OF_A_FILE = 4_000_000


@register("source_json_lines_large_file",
          "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(l_suppkey AS VARCHAR) AS l_suppkey, l_comment FROM ("
          "SELECT l_orderkey, l_linenumber, l_suppkey, 'line \"' || CAST(l_partkey AS VARCHAR) || '\" } {' AS l_comment FROM lineitem)")
def _json_lines(spark, sf_dir):
    """All line items as a large file of JSON Lines: told by counts over its lines, and read in splits.

    A task writes one file, so there is one more for every LINES_OF_A_FILE lines.
    """
    from ..sources.readers import read_json_records
    path = _scratch(spark, "lines")
    rows = fixtures.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.concat(
        F.lit('line "'), F.col("l_partkey").cast("string"), F.lit('" } {')).alias("l_comment"))
    rows.repartition(-(-rows.count() // LINES_OF_A_FILE) or 1).write.json(path)
    return read_json_records(spark, path)


@register("source_json_mixed_folder",
          "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders UNION ALL "
          "SELECT CAST(c_custkey AS VARCHAR), NULL FROM customer")
def _json_mixed(spark, sf_dir):
    """A folder of JSON Lines and of files that are one object with a list."""
    from ..sources.readers import read_json_records
    path = _scratch(spark, "mixed")
    fixtures.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").write.json(path)
    c = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_orderkey"))
    parts = -(-c.count() // 10_000) or 1
    objects = c.groupBy(F.pmod(F.xxhash64("o_orderkey"), F.lit(parts)).alias("p")).agg(F.collect_list(F.struct("o_orderkey")).alias("rows"))
    objects.select(F.to_json(F.struct(F.col("p").alias("part"), "rows")).alias("value")).write.mode("append") \
        .option("maxRecordsPerFile", 1).text(path)
    return read_json_records(spark, path)


@register("source_csv_latin1", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents")
def _csv_latin1(spark, sf_dir):
    """Documents in files of both encodings in one folder; each file is read by its own."""
    from ..sources.readers import LATIN_1, read_upload
    from ..sources.writers import write_csv
    path = _scratch(spark, "latin1")
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    western = F.col("text").rlike(r"^[\x{0}-\x{ff}]*$") & F.col("text").rlike(r"[\x{c0}-\x{ff}]")
    write_csv(docs.where(~western), path)
    docs.where(western).write.mode("append").option("header", True).option("quote", '"').option("escape", '"') \
        .option("quoteAll", True).option("encoding", LATIN_1).csv(path)
    return _all_text(read_upload(spark, path, fmt="csv"))


# ---------------------------------------------------------------------------
# Profiles in parts, scores of a table while it is written, user inspectors, searches by posting lists
# ---------------------------------------------------------------------------

def _register_parts(view: str):
    isql = InspectSQL(view)
    short = view.replace("dirty_", "")

    def store(spark, sf_dir):
        from ..operators.profile import ProfileStore
        out = ProfileStore(spark, _scratch(spark, "profile"))
        df = fixtures.view(spark, sf_dir, view)
        for k in range(3):
            out.add(df.where(F.pmod(F.xxhash64("_row_id"), F.lit(3)) == k))
        return ProfileStore(spark, out.path)

    @register(f"profile_merged_issues_{short}", isql.issues_sql())
    def _issues(spark, sf_dir):
        """Three parts, each profiled alone: the issues of the whole table."""
        return store(spark, sf_dir).inspection().issues()

    @register(f"profile_merged_score_{short}", isql.score_sql())
    def _score(spark, sf_dir):
        from ..operators.score import score_frame
        return score_frame(store(spark, sf_dir).inspection())


for _v in ("dirty_lineitem", "dirty_customer"):
    _register_parts(_v)


@register("score_before_after_written_orders", _before_after_sql("dirty_orders"))
def _before_after_written(spark, sf_dir):
    """The repaired table is scored from what was observed while it was written."""
    from ..operators.inspect import write_and_inspect
    from ..operators.score import score_before_after
    before = _inspection(spark, sf_dir, "dirty_orders")
    return score_before_after(before, write_and_inspect(_autofix(spark, sf_dir, "dirty_orders").clean(), _scratch(spark, "clean")))


@register("dataset_impact_custom_orders",
          _vsql("dirty_orders") + "SELECT count(*) FILTER (_row_id % 7 = 0 OR _row_id % 5 = 1) AS affected_rows, count(*) AS total_rows, "
          "CAST(round(count(*) FILTER (_row_id % 7 = 0 OR _row_id % 5 = 1) * 100.0 / count(*)) AS BIGINT) AS affected_pct FROM dirty_orders")
def _impact_custom(spark, sf_dir):
    """An inspector of a user's own with cells: overlapping findings, and one that is only for information."""
    from ..operators.inspect import Inspector, IssueSpec, inspect
    from ..operators.score import dataset_impact

    class Sevens(Inspector):
        name, category = "Sevens", "accuracy"

        def issues(self, ctx):
            def spec(severity, condition):
                def cells(cap):
                    hit = ctx.df.where(condition).select(F.col(ctx.row_id).alias("row"), F.lit("x").alias("value"))
                    return hit.unionByName(hit)                       # a cell that is named twice is one row
                return IssueSpec(self.name, self.category, [ctx.columns[0]], severity, 1, "rows of a kind", "look", cells=cells, cap=None)
            return [spec("warning", "_row_id % 7 = 0"), spec("critical", "_row_id % 5 = 1"), spec("info", "_row_id % 2 = 0")]
    return dataset_impact(inspect(fixtures.view(spark, sf_dir, "dirty_orders"), inspectors=[Sevens]))


def _search(word: str):
    def run(spark, sf_dir):
        from ..operators.search import SearchIndex
        index = SearchIndex(spark, _scratch(spark, "index"))
        return index.build(_customer_fix(spark, sf_dir).clean(), block_rows=500).search(word)
    return run


register("review_search_indexed_customer", _RSQL["search"])(_search("MachiNery"))
register("review_search_indexed_documents", "SELECT doc_id AS _row_id, text, lang FROM documents WHERE contains(lower(text), 'licensed under cc')")(
    lambda spark, sf_dir: _search_documents(spark, sf_dir))


def _search_documents(spark, sf_dir):
    """Few documents have the phrase: most blocks are never read."""
    from ..operators.search import SearchIndex
    docs = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_row_id"), "text", "lang")
    return SearchIndex(spark, _scratch(spark, "index")).build(docs, block_rows=200).search("Licensed under CC")


# ---------------------------------------------------------------------------
# Row cap, empty guard, the inspector contract
# ---------------------------------------------------------------------------

@register("source_row_cap_events", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 5000")
def _row_cap(spark, sf_dir):
    """The first rows of an upload, as the original takes them; here in the order of the ids, so that they are the same ones."""
    from ..sources.readers import row_cap
    return row_cap(fixtures.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy("event_id"), 5000)


@register("source_empty_guard_orders",
          "SELECT s.status, count(o.o_orderkey) AS n_rows, count(o.o_orderkey) = 0 AS refused FROM (SELECT DISTINCT o_orderstatus AS status FROM orders "
          "UNION ALL SELECT 'none') s LEFT JOIN orders o ON o.o_orderstatus = s.status GROUP BY s.status")
def _empty_guard(spark, sf_dir):
    """An upload of each status' orders, and one of a status that no order has: only that is refused."""
    from ..sources.readers import ensure_not_empty
    o = fixtures.table(spark, sf_dir, "orders")
    rows = []
    for status in [r[0] for r in o.select("o_orderstatus").distinct().collect()] + ["none"]:       # a handful
        some = o.where(F.col("o_orderstatus") == status)
        try:
            rows.append((status, ensure_not_empty(some).count(), False))
        except ValueError:
            rows.append((status, 0, True))
    return spark.createDataFrame(rows, "status string, n_rows long, refused boolean")


@register("inspect_contract_events", _vsql("dirty_events") + (
    "SELECT 'Large Amounts' AS inspector_name, count(*) FILTER (amount > 900) AS \"count\" FROM dirty_events"))
def _contract(spark, sf_dir):
    """A user's inspector beside the library's and beside two that fail, one in its aggregates and one in its findings."""
    from ..operators.inspect import DEFAULT_INSPECTORS, Inspector, IssueSpec, inspect

    class Large(Inspector):
        name, category = "Large Amounts", "accuracy"

        def aggregates(self, ctx):
            return {"large": F.count_if(F.col("amount") > 900)}

        def issues(self, ctx):
            return [IssueSpec(self.name, self.category, ["amount"], "warning", ctx.stats["large"], "large", "look")]

    class NoColumn(Inspector):
        name = "No Column"

        def aggregates(self, ctx):
            return {"none": F.count_if(F.col("no_such_column") > 0)}

    class Raises(Inspector):
        name = "Raises"

        def issues(self, ctx):
            raise RuntimeError("a fault of its own")
    ins = inspect(fixtures.view(spark, sf_dir, "dirty_events"), inspectors=[NoColumn, *DEFAULT_INSPECTORS, Raises, Large])
    return ins.issues().where("inspector_name not in ('No Column', 'Raises')").where(F.col("inspector_name") == "Large Amounts") \
        .select("inspector_name", "count")
