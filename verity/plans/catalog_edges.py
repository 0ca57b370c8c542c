"""Queries at the edges: uploads and exports with quotes and newlines, stores that are opened again,
several e-mail and name columns, partial exports and merges, hand edits, the cells of a report."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures
from .catalog import (_HIST_CTE, _all_text, _customer_fix, _entries, _inspection, _scratch, _vsql, register)
from .oracle_inspect import InspectSQL, ident
from .oracle_repair import RepairSQL


# ---------------------------------------------------------------------------
# Uploads: text files without a row id go through inspection and repair
# ---------------------------------------------------------------------------

def _uploaded(spark, sf_dir, view):
    from ..sources.readers import read_upload
    from ..sources.writers import write_csv
    path = _scratch(spark, "upload")
    write_csv(fixtures.view(spark, sf_dir, view).drop("_row_id"), path)
    return read_upload(spark, path, fmt="csv")


@register("upload_csv_inspect", InspectSQL("dirty_customer").issues_sql())
def _upload_inspect(spark, sf_dir):
    from ..operators.inspect import inspect
    return inspect(_uploaded(spark, sf_dir, "dirty_customer")).issues()


def _repair(view: str) -> RepairSQL:
    rs = RepairSQL(view)
    rs.build()
    return rs


@register("upload_csv_autofix", f"SELECT * EXCLUDE (_row_id) FROM ({_repair('dirty_customer').clean_sql()})")
def _upload_autofix(spark, sf_dir):
    from ..operators.repair import autofix
    return autofix(_uploaded(spark, sf_dir, "dirty_customer")).clean(keep_row_id=False)


EVENTS_PER_OBJECT = 10_000     # what one task holds as one list and one string


@register("upload_json_object",
          "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props, "
          "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS ts, CAST(user_id AS VARCHAR) AS user_id, CAST(value AS VARCHAR) AS value FROM events")
def _upload_json_object(spark, sf_dir):
    """Files that are one object each, with a list of records after a field that is none."""
    from ..sources.readers import read_upload
    e = fixtures.table(spark, sf_dir, "events")
    parts = -(-e.count() // EVENTS_PER_OBJECT) or 1
    # by a hash of the event and of its place in the files: each object has about as many, and rows that repeat one are spread
    rows = e.select(F.pmod(F.xxhash64("event_id", "ts", "user_id", F.monotonically_increasing_id()), F.lit(parts)).alias("part"), F.struct(
        "event_id", "ts", "user_id", "event_type", "value", "props").alias("r"))
    objects = rows.groupBy("part").agg(F.collect_list("r").alias("rows")).select(F.to_json(F.struct(
        F.struct(F.col("part").alias("n")).alias("meta"), "rows")).alias("value"))
    path = _scratch(spark, "objects")
    objects.write.option("maxRecordsPerFile", 1).text(path)
    return read_upload(spark, path, fmt="json")


# ---------------------------------------------------------------------------
# RFC 4180 there and back: commas, quotes and newlines in the cells
# ---------------------------------------------------------------------------

@register("source_csv_quotes_documents", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents")
def _csv_documents(spark, sf_dir):
    from ..sources.readers import read_csv
    from ..sources.writers import write_csv
    path = _scratch(spark, "csv")
    write_csv(fixtures.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), path)
    return _all_text(read_csv(spark, path))


@register("source_csv_quotes_pages", "SELECT CAST(page_id AS VARCHAR) AS page_id, url, html FROM pages")
def _csv_pages(spark, sf_dir):
    from ..sources.readers import read_tsv
    from ..sources.writers import write_tsv
    path = _scratch(spark, "tsv")
    write_tsv(fixtures.table(spark, sf_dir, "pages"), path)
    return _all_text(read_tsv(spark, path))


@register("source_nested_json_orders",
          "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, "
          "'{\"status\":\"' || o_orderstatus || '\",\"note\":null,\"customer\":' || CAST(o_custkey AS VARCHAR) || '}' AS nested FROM orders")
def _nested(spark, sf_dir):
    from ..sources.readers import flatten_nested_to_json
    o = fixtures.table(spark, sf_dir, "orders")
    return flatten_nested_to_json(o.select("o_orderkey", F.struct(
        F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("note"),
        F.col("o_custkey").alias("customer")).alias("nested")))


@register("source_records_json_events", _vsql("dirty_events") + (
    "SELECT '{\"_row_id\": ' || CAST(_row_id AS VARCHAR) || ', \"record_no\": ' || CAST(record_no AS VARCHAR) || "
    "', \"user_id\": ' || CAST(user_id AS VARCHAR) || ', \"kind\": \"' || coalesce(kind, '') || '\", \"amount\": ' || "
    "CASE WHEN amount IS NULL THEN '\"\"' ELSE CAST(amount AS VARCHAR) END || ', \"note\": \"\"}' AS record FROM dirty_events"))
def _records_json(spark, sf_dir):
    from ..sources.writers import to_json_records
    return to_json_records(fixtures.view(spark, sf_dir, "dirty_events"))


def _customer_parts() -> tuple[str, str, str]:
    rs = _repair("dirty_customer")
    cols = ", ".join(ident(c) for c in rs.names)
    marked = ", ".join(f"coalesce({ident(c)}, 'TO_BE_DETERMINED') AS {ident(c)}" for c in rs.names)
    return rs._with(), cols, marked


_WITH, _COLS, _MARKED = _customer_parts()


@register("source_export_clean_customer", _WITH + f"SELECT {_COLS} FROM clean")
def _export_clean(spark, sf_dir):
    from ..sources.writers import export_variant
    r = _customer_fix(spark, sf_dir)
    return export_variant(r.clean(), r.quarantine(), "clean")


@register("source_export_quarantine_customer", _WITH + f"SELECT {_MARKED} FROM fin WHERE _row_id IN (SELECT _row_id FROM qids)")
def _export_quarantine(spark, sf_dir):
    from ..sources.writers import export_variant
    r = _customer_fix(spark, sf_dir)
    return export_variant(r.clean(), r.quarantine(), "quarantine")


# ---------------------------------------------------------------------------
# Review: a selected merge, hand edits
# ---------------------------------------------------------------------------

@register("review_merge_selected_customer", _WITH + (
    f"SELECT _row_id, {_COLS} FROM clean UNION ALL SELECT _row_id, {_MARKED} FROM fin "
    "WHERE _row_id IN (SELECT _row_id FROM qids) AND _row_id % 2 = 0"))
def _merge_selected(spark, sf_dir):
    from ..operators.review import merge_quarantine
    r = _customer_fix(spark, sf_dir)
    q = r.quarantine()
    return merge_quarantine(r.clean(), q, q.where("_row_id % 2 = 0").select("_row_id"))[0]


@register("review_cell_edit_customer", _WITH + (
    "SELECT _row_id, " + _COLS.replace('"segment"', "CASE WHEN _row_id % 10 = 3 THEN 'second ' || CAST(_row_id AS VARCHAR) "
                                       "ELSE segment END AS segment") + " FROM clean"))
def _cell_edit(spark, sf_dir):
    """Two edits of every tenth row's segment; the later one holds."""
    from ..operators.review import edit_cells
    clean = _customer_fix(spark, sf_dir).clean()
    edits = clean.where("_row_id % 10 = 3").select("_row_id", F.lit("segment").alias("column"), F.explode(F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("first").alias("value")),
        F.struct(F.lit(1).alias("seq"), F.concat(F.lit("second "), F.col("_row_id").cast("string")).alias("value")))).alias("e"))
    return edit_cells(clean, edits.select("_row_id", "column", "e.value", "e.seq"))


# ---------------------------------------------------------------------------
# Stores that are opened again
# ---------------------------------------------------------------------------

_RETAINED = _HIST_CTE + ("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, "
                         "id DESC) AS rn FROM entries) WHERE rn <= 50")


def _store(spark, sf_dir):
    from ..operators.history import HistoryStore
    path = _scratch(spark, "history")
    entries = _entries(spark, sf_dir)
    HistoryStore(spark, path).append(entries.where("cast(id as long) % 2 = 0"))
    HistoryStore(spark, path).append(entries.where("cast(id as long) % 2 = 1"))
    return HistoryStore(spark, path)


@register("history_append_reopened_events", _RETAINED)
def _history_append(spark, sf_dir):
    return _store(spark, sf_dir).table()


@register("history_get_events", _HIST_CTE + "SELECT * FROM entries WHERE id = (SELECT CAST(max(event_id) AS VARCHAR) FROM events)")
def _history_get(spark, sf_dir):
    from ..operators.history import history_get
    last = fixtures.table(spark, sf_dir, "events").agg(F.max_by(F.struct("event_id", "user_id"), "event_id")).first()[0]
    return history_get(_entries(spark, sf_dir), str(last["event_id"]), str(last["user_id"]))


@register("history_clear_reopened_events", f"SELECT * FROM ({_RETAINED}) WHERE user_id <> (SELECT CAST(min(user_id) AS VARCHAR) FROM events)")
def _history_cleared(spark, sf_dir):
    from ..operators.history import HistoryStore
    store = _store(spark, sf_dir)
    first = fixtures.table(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    store.clear(str(first))
    return HistoryStore(spark, store.path).table()


@register("versions_reopened_orders", "SELECT o_orderkey, 'redone ' || o_orderstatus AS status FROM orders")
def _versions(spark, sf_dir):
    """Three versions by three openings of the folder: one undone and dropped by a push, the last undone and redone."""
    from ..operators.review import TableVersions
    path = _scratch(spark, "versions")
    o = fixtures.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    TableVersions(spark, path).push(o)
    TableVersions(spark, path).push(o.withColumn("status", F.lower("status")))
    assert TableVersions(spark, path).undo()
    again = TableVersions(spark, path)
    again.push(again.current().withColumn("status", F.concat(F.lit("redone "), "status")))
    assert again.undo() and TableVersions(spark, path).redo() and not TableVersions(spark, path).redo()
    return TableVersions(spark, path).current()


# ---------------------------------------------------------------------------
# Several e-mail and name columns; the report's cells
# ---------------------------------------------------------------------------

@register("autofix_changes_multi_pair", _repair("dirty_contacts").changes_sql())
def _multi_pair(spark, sf_dir):
    from ..operators.repair import autofix
    return autofix(fixtures.view(spark, sf_dir, "dirty_contacts")).changes()


@register("quality_report_cells_customer", InspectSQL("dirty_customer").cells_query(capped=True))
def _report_cells(spark, sf_dir):
    """All cells of the written report: every missing value, and the first hundred of each other issue."""
    from ..operators.score import write_report
    return write_report(_inspection(spark, sf_dir, "dirty_customer"), _scratch(spark, "report")).cells
