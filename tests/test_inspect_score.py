"""Inspectors and scoring: golden cases and the flagship entry point."""

from verity.operators.inspect import inspect
from verity.operators.score import completeness, score, score_frame


def test_single_capitals_count_as_upper_and_title(spark):
    df = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "_row_id long, code string")
    ins = inspect(df)
    casing = [s for s in ins.specs if s.inspector_name == "Format Inconsistency"]
    assert len(casing) == 1 and casing[0].count == 3
    assert ins.cells().where("seq = %d" % casing[0].seq).count() == 0


def test_score_golden(spark):
    r = spark.range(1).select(completeness(10, [0, 2]).alias("c"), completeness(10, []).alias("none")).first()
    assert round(r["c"]) == 80 and r["none"] == 100


def test_score_ten_rows(spark):
    rows = [(i, f"v{i}", None if i < 2 else i) for i in range(10)]
    df = spark.createDataFrame(rows, "_row_id long, a string, b long")
    sc = score(inspect(df))
    assert sc.category_scores()["completeness"] == 80
    assert sc.overall == 94


def test_duplicates_counted(spark):
    df = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "_row_id long, v string")
    ins = inspect(df)
    dup = [s for s in ins.specs if s.inspector_name == "Duplicate Rows"]
    assert dup[0].count == 1
    assert [r["row"] for r in ins.cells().where(f"seq = {dup[0].seq}").collect()] == [1]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.count() == 1
    assert "overall_quality_score" in out.columns


def test_every_query_has_an_oracle():
    import __spark_entry__ as E
    from verity.plans import catalog
    q, o = E.queries(), E.oracle_sql()
    assert set(catalog.QUERIES) <= set(q)
    assert sorted(set(catalog.QUERIES) - set(o)) == []


def test_score_frame_schema(spark):
    from verity.plans import fixtures
    from tests.conftest import SF
    out = score_frame(inspect(fixtures.view(spark, SF, "dirty_events")))
    assert out.columns[:2] == ["total_rows", "total_columns"]


def test_duplicates_with_signed_zero_and_nan(spark):
    rows = [(0, 0.0), (1, -0.0), (2, float("nan")), (3, float("nan")), (4, 1.0)]
    df = spark.createDataFrame(rows, "_row_id long, x double")
    dup = [s for s in inspect(df).specs if s.inspector_name == "Duplicate Rows"]
    assert dup and dup[0].count == 2


def test_failing_inspectors_are_left_out(spark):
    from pyspark.sql import functions as F

    from verity.operators.inspect import DEFAULT_INSPECTORS, Inspector

    class BadExpression(Inspector):
        def aggregates(self, ctx):
            return {"bad": F.count(F.col("no such column"))}

    class BadIssues(Inspector):
        def issues(self, ctx):
            raise KeyError("nothing here")

    class BadAggregates(Inspector):
        def aggregates(self, ctx):
            raise ValueError("nor here")

    df = spark.createDataFrame([(0, "x"), (1, "x"), (2, None)], "_row_id long, v string")
    whole = [s.description for s in inspect(df).specs]
    broken = inspect(df, inspectors=[BadExpression, *DEFAULT_INSPECTORS, BadIssues, BadAggregates])
    assert whole and [s.description for s in broken.specs] == whole


def test_wide_tables_and_odd_names(spark):
    """More columns than one aggregate takes, with dots and backticks in their names."""
    names = [f"c.{i}`x" for i in range(60)]
    df = spark.createDataFrame([(i, f" v{i}", *["a"] * 59) for i in range(4)],
                               ["_row_id", *names])
    ins = inspect(df)
    assert "Whitespace Issues" in {s.inspector_name for s in ins.specs}
    assert score(ins).columns == 60 and ins.cells().count() > 0


def test_tables_without_a_row_id(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "v string, n int")
    joined = df.join(df.select("v").distinct(), "v")
    for x in (df, joined):
        assert score(inspect(x)).rows == 3


def test_report_lists_affected_cells(spark):
    from verity.operators.score import quality_report
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(300)], "_row_id long, v string")
    issues = quality_report(inspect(df)).first()["issues"]
    missing = next(i for i in issues if i["inspector_name"] == "Missing Values")
    assert missing["count"] == 150 and [c["row"] for c in missing["affected_cells"]] == list(range(1, 200, 2))


def test_impact_counts_each_row_once(spark):
    from verity.operators.score import dataset_impact
    rows = [(0, "a", "x@y.zz"), (1, "a", "x@y.zz"), (2, None, "bad"), (3, "b", "q@r.ss"), (4, "b", "bad"), (5, "b", "bad")]
    ins = inspect(spark.createDataFrame(rows, "_row_id long, v string, email string"))
    assert dataset_impact(ins).first()["affected_rows"] == 4
