"""Review operations, sources/sinks, history and streaming."""

import json

from pyspark.sql import functions as F

from verity.operators.history import HistoryStore, entries_from_events, history_recent
from verity.operators.repair import autofix
from verity.operators.review import (TableVersions, accept_changes, deny_changes, merge_quarantine,
                                     search_rows)
from verity.plans import fixtures
from verity.session import scratch_path
from verity.sources.readers import drop_all_null_columns, drop_junk_columns, read_json_records
from verity.sources.writers import export_variant, to_records

from tests.conftest import SF


def test_accept_all_leaves_clean_unchanged(spark):
    res = autofix(fixtures.view(spark, SF, "dirty_customer"))
    clean = res.clean()
    acc = accept_changes(clean, res.changes())
    assert acc.exceptAll(clean).count() == 0


def test_deny_all_restores_single_changes(spark):
    rows = [(0, " a "), (1, "b")]
    df = spark.createDataFrame(rows, "_row_id long, v string")
    res = autofix(df)
    denied = deny_changes(res.clean(), res.changes())
    assert [r["v"] for r in denied.orderBy("_row_id").collect()] == [" a ", "b"]


def test_merge_and_search(spark):
    res = autofix(fixtures.view(spark, SF, "dirty_customer"))
    merged, rest = merge_quarantine(res.clean(), res.quarantine())
    assert merged.count() == fixtures.view(spark, SF, "dirty_customer").count()
    assert rest.count() == 0
    assert search_rows(res.clean(), "").count() == res.clean().count()


def test_versions_undo_redo(spark):
    tv = TableVersions(spark, scratch_path(spark, "versions"))
    a = spark.createDataFrame([(1, "x")], "_row_id long, v string")
    b = spark.createDataFrame([(1, "y")], "_row_id long, v string")
    tv.push(a)
    tv.push(b)
    assert tv.current().first()["v"] == "y"
    assert tv.undo() and tv.current().first()["v"] == "x"
    tv.push(b.withColumn("v", F.lit("z")))
    assert not tv.redo() and tv.current().first()["v"] == "z"


def test_json_record_field(spark, tmp_path):
    p = tmp_path / "in.json"
    p.write_text(json.dumps({"meta": {"n": 2}, "rows": [{"a": 1, "b": {"c": [1, 2]}}, {"a": 2, "b": None}]}))
    df = read_json_records(spark, str(p), record_field="rows")
    got = sorted((r["a"], r["b"]) for r in df.collect())
    assert got == [("1", '{"c":[1,2]}'), ("2", None)]


def test_junk_and_null_columns(spark):
    df = spark.createDataFrame([(1, 2, None), (3, 4, None)], "`Unnamed: 0` long, a long, e string")
    assert drop_all_null_columns(drop_junk_columns(df)).columns == ["a"]


def test_records_blank_out_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r["x"] for r in to_records(df).collect()] == ["1.0", "", ""]


def test_export_full(spark):
    res = autofix(fixtures.view(spark, SF, "dirty_customer"))
    full = export_variant(res.clean(), res.quarantine(), "full")
    assert "_row_id" not in full.columns and "_issue_reason" not in full.columns


def test_history_retention(spark):
    store = HistoryStore(spark, scratch_path(spark, "history"))
    entries = entries_from_events(fixtures.table(spark, SF, "events"))
    table = store.append(entries)
    worst = table.groupBy("user_id").count().agg(F.max("count")).first()[0]
    assert worst <= 50
    u = table.first()["user_id"]
    assert history_recent(table, u, 99).count() <= 50


def test_stream_monitor(spark):
    from verity.streaming.monitor import quality_monitor
    base = fixtures.table(spark, SF, "events")
    stream = (spark.readStream.schema(base.schema).option("pathGlobFilter", "events.parquet").parquet(SF))
    out, ck = scratch_path(spark, "hist"), scratch_path(spark, "ck")
    quality_monitor(stream, out, ck, key="event_id").awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 1 and rows[0]["total_rows"] == base.count()


def test_custom_inspector_contract(spark):
    from verity.operators.inspect import DEFAULT_INSPECTORS, Inspector, IssueSpec, inspect

    class NegativeAmounts(Inspector):
        name, category = "Negative Amounts", "accuracy"

        def aggregates(self, ctx):
            return {"neg": F.count_if(F.col("amount") < 0)}

        def issues(self, ctx):
            n = ctx.stats["neg"]
            return [IssueSpec(self.name, self.category, ["amount"], "warning", n, f"{n} negative",
                              "check", cell_filter=F.col("amount") < 0, cell_value=F.col("amount"))] if n else []

    df = spark.createDataFrame([(0, 5.0), (1, -1.0), (2, 3.0)], "_row_id long, amount double")
    ins = inspect(df, inspectors=list(DEFAULT_INSPECTORS) + [NegativeAmounts])
    mine = [s for s in ins.specs if s.inspector_name == "Negative Amounts"]
    assert mine and mine[0].count == 1
    assert [r["row"] for r in ins.cells().where(f"seq = {mine[0].seq}").collect()] == [1]


def test_latin1_row_cap_and_empty_guard(spark, tmp_path):
    import pytest
    from verity.sources.readers import ensure_not_empty, read_csv, row_cap
    p = tmp_path / "l1.csv"
    p.write_bytes("name,city\nJos\xe9,M\xfcnchen\nAna,Z\xfcrich\n".encode("latin-1"))
    df = read_csv(spark, str(p), encoding="ISO-8859-1")
    assert sorted(r["city"] for r in df.collect()) == ["München", "Zürich"]
    assert row_cap(df, 1).count() == 1
    with pytest.raises(ValueError):
        ensure_not_empty(df.limit(0))


def test_single_accept_deny_and_edits(spark):
    from verity.operators.review import accept_one, deny_one, edit_cells
    df = spark.createDataFrame([(0, " x ", "a@B.com"), (1, "y", "c@d.com")], "_row_id long, v string, email string")
    res = autofix(df)
    clean, changes = res.clean(), res.changes()
    denied, rest = deny_one(clean, changes, 0, "v")
    assert denied.where("_row_id = 0").first()["v"] == " x "
    assert rest.where("_row_id = 0 AND column = 'v'").count() == 0
    accepted, _ = accept_one(clean, changes, 0, "email")
    assert accepted.where("_row_id = 0").first()["email"] == "a@b.com"
    edits = spark.createDataFrame([(1, "v", "first", 0), (1, "v", "second", 1)],
                                  "_row_id long, column string, value string, seq int")
    assert edit_cells(clean, edits).where("_row_id = 1").first()["v"] == "second"


def test_history_get_and_delete(spark):
    from verity.operators.history import history_delete, history_get
    entries = entries_from_events(fixtures.table(spark, SF, "events"))
    one = entries.first()
    assert history_get(entries, one["id"], one["user_id"]).count() == 1
    assert history_get(entries, one["id"], "nobody").count() == 0
    assert history_delete(entries, one["id"], one["user_id"]).count() == entries.count() - 1


def test_large_json_lines_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from verity.plans import catalog_stores
    spark.range(7000).selectExpr("id as l_orderkey", "cast(id % 7 as int) as l_linenumber", "id % 10 as l_suppkey", "id % 20 as l_partkey") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(catalog_stores, "LINES_OF_A_FILE", 2000, raising=False)
    monkeypatch.setattr(catalog_stores, "_scratch", lambda spark, name: f"{tmp_path}/{name}")
    assert catalog_stores._json_lines(spark, str(tmp_path)).count() == 7000
    lines = spark.read.text(f"{tmp_path}/lines").selectExpr("_metadata.file_path as f").groupBy("f").count().collect()
    assert len(lines) == 4 and max(r["count"] for r in lines) < 2500
