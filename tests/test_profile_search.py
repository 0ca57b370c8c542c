"""Profiles that grow with a table, scores of a table while it is written, reports as tables, search by posting lists."""

import re

import pytest
from pyspark.sql import functions as F

from verity.operators.inspect import Inspector, IssueSpec, inspect, write_and_inspect
from verity.operators.profile import ProfileStore, merge_moments
from verity.operators.review import search_rows
from verity.operators.rowid import with_row_id
from verity.operators.score import dataset_impact, distinct_rows, read_report, score_before_after, score_frame, write_report
from verity.operators.search import SearchIndex
from verity.plans import fixtures
from verity.session import scratch_path

from tests.conftest import SF


def _issues(ins):
    return [tuple(r) for r in ins.issues().orderBy("seq").collect()]


def test_moments_merge():
    import statistics
    xs = [3.5, -1.0, 8.25, 8.25, 0.0, 100.0, 7.0]
    whole = (0, 0.0, 0.0)
    for part in (xs[:2], [], xs[2:3], xs[3:]):
        m = sum(part) / len(part) if part else 0.0
        whole = merge_moments(whole, (len(part), m, sum((x - m) ** 2 for x in part)))
    assert whole[0] == 7 and whole[1] == pytest.approx(statistics.mean(xs)) and (whole[2] / 6) ** 0.5 == pytest.approx(statistics.stdev(xs))


def test_merged_profile_equals_the_whole(spark):
    """Uneven parts, an outlier that is one only in its own part, rows that repeat across parts, and an empty part."""
    df = fixtures.view(spark, SF, "dirty_orders")
    store = ProfileStore(spark, scratch_path(spark, "profile"))
    for part in (df.where("_row_id % 10 = 0"), df.where("_row_id % 10 in (1, 2)"), df.limit(0), df.where("_row_id % 10 > 2")):
        store.add(part)
    assert _issues(ProfileStore(spark, store.path).inspection()) == _issues(inspect(df))
    assert score_frame(store.inspection()).first() == score_frame(inspect(df)).first()
    twice = df.unionByName(df.withColumn("_row_id", F.col("_row_id") + 10**6))
    store.add(df.withColumn("_row_id", F.col("_row_id") + 10**6))
    assert _issues(store.inspection()) == _issues(inspect(twice))
    with pytest.raises(ValueError):
        store.add(df.withColumn("more", F.lit(1)))


def test_values_beyond_the_bounds_are_filters_of_the_scan(spark):
    store = ProfileStore(spark, scratch_path(spark, "profile"))
    store.add(spark.range(1000).selectExpr("id as _row_id", "if(id = 7, 1e6, id / 3) as x"))
    assert [i[1] for i in _issues(store.inspection())] == ["Outlier Detection"]
    part = store.log.head()[1]["parts"][0]
    plan = spark.read.parquet(f"{store.path}/{part}/values").where("column = 'x' and value > 5")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(column), IsNotNull(value), EqualTo(column,x), GreaterThan(value,5.0)]" in plan


def test_inspectors_that_do_not_add_up_are_refused(spark):
    class Middle(Inspector):
        additive = False

    with pytest.raises(ValueError):
        ProfileStore(spark, scratch_path(spark, "profile"), inspectors=[Middle])
    with pytest.raises(ValueError):
        ProfileStore(spark, scratch_path(spark, "profile")).inspection()


def test_written_and_inspected_in_one_pass(spark):
    df = fixtures.view(spark, SF, "dirty_customer")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("written", "")
    path = scratch_path(spark, "written")
    ins = write_and_inspect(df, path)
    spark.sparkContext.setJobGroup("plain", "")
    plain = inspect(df)
    n = {g: len(jobs.getJobIdsForGroup(g)) for g in ("written", "plain")}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert _issues(ins) == _issues(plain) and spark.read.parquet(path).count() == df.count()
    assert score_before_after(plain, ins).drop("phase").distinct().count() == 1
    assert n["written"] <= n["plain"]                     # the write carries the profile: no job more than the inspection alone
    assert ins.cells().count() == plain.cells().count()
    with pytest.raises(ValueError):
        write_and_inspect(df.limit(0), scratch_path(spark, "written"))


def test_wide_table_is_observed_in_groups(spark):
    df = spark.range(50).select(F.col("id").alias("_row_id"), *[F.when(F.col("id") % 7 != i % 7, F.concat(F.lit("A"), F.col("id").cast("string"))).alias(f"c{i}")
                                                                for i in range(40)])
    assert _issues(write_and_inspect(df, scratch_path(spark, "written"))) == _issues(inspect(df))


def test_written_report_has_all_missing_cells(spark):
    df = spark.range(500).select(F.col("id").alias("_row_id"), F.when(F.col("id") % 2 == 0, F.lit("a")).alias("v"), F.lit(" x").alias("w"))
    ins = inspect(df)
    path = scratch_path(spark, "report")
    report = write_report(ins, path, "f.csv")
    count = {r["inspector_name"]: r["n"] for r in report.cells.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).join(
        ins.issues(), "seq").select("inspector_name", "n").collect()}
    assert count["Missing Values"] == 250 and count["Whitespace Issues"] == 100
    again = read_report(spark, path)
    assert again.head.first()["dataset_meta"]["filename"] == "f.csv" and len(again.head.first()["issues"]) == len(ins.specs)
    clean = write_report(inspect(spark.range(5).selectExpr("id as _row_id", "id as v")), scratch_path(spark, "report"))
    assert clean.cells.count() == 0 and clean.head.first()["issues"] == []


def test_rows_are_counted_by_bitmaps(spark):
    ids = [0, 1, 1, 5, 32768, 32769, 10**12, 10**12, -3, -3, -40000]
    df = spark.createDataFrame([(i,) for i in ids], "row long")
    assert distinct_rows(df).first()[0] == len(set(ids)) and distinct_rows(df.limit(0)).first()[0] == 0

    class Own(Inspector):
        name, category = "Own", "accuracy"

        def issues(self, ctx):
            return [IssueSpec(self.name, self.category, ["v"], "warning", 1, "d", "s", cap=None,
                              cells=lambda cap: ctx.df.where("_row_id < 30").select(F.col("_row_id").alias("row"), F.lit("x").alias("value")))]

    impact = dataset_impact(inspect(spark.range(100).selectExpr("id as _row_id", "id as v"), inspectors=[Own]))
    assert tuple(impact.first()) == (30, 100, 30)
    plan = impact._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan and "distinct" not in plan.lower()


def test_search_equals_the_scan_and_prunes(spark):
    df = fixtures.view(spark, SF, "dirty_customer").unionByName(spark.createDataFrame(
        [(10**6, "ÄÖÜ straße", None), (10**6 + 1, "MiXeD Needle", "x"), (10**6 + 2, None, "")], "_row_id long, name string, segment string"),
        allowMissingColumns=True)
    index = SearchIndex(spark, scratch_path(spark, "index")).build(df, block_rows=20)
    key = lambda d: sorted(r["_row_id"] for r in d.collect())
    for q in ("mixed needle", "Building", "customer#00000001", "straße", "öü", "x", "", "zzz no such", "nee", "1-"):
        assert key(index.search(q)) == key(search_rows(df, q)), q
    assert index.search("Needle").columns == df.columns
    blocks = index.spark.read.parquet(f"{index.path}/rows").select("_block").distinct().count()
    assert blocks > 4 and index.candidates("mixed needle").count() == 1 and index.candidates("xy") is None
    plan = index.search("mixed needle")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_block", plan)


def test_ranked_rows_leave_nothing_cached(spark):
    spark.catalog.clearCache()
    df = spark.createDataFrame([(f"k{i:03d}", i) for i in range(200)], "key string, v long").repartition(7)
    got = with_row_id(df, key="key").orderBy("key").collect()
    assert [r["_row_id"] for r in got] == list(range(200))
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    assert with_row_id(df.limit(0), key="key").collect() == []


def test_trigrams_of_a_long_text_in_one_pass(spark, tmp_path):
    """Posting lists of long texts, null cells and letters beyond the basic plane."""
    from verity.operators.search import SearchIndex
    rows = [(1, "ab" * 300_000 + " Needle", None), (2, None, "x\U0001f600yz"), (3, "ab", "a\nb"), (4, None, None)]
    index = SearchIndex(spark, str(tmp_path / "index")).build(spark.createDataFrame(rows, "_row_id long, a string, b string"), 1)
    found = {q: sorted(r["_row_id"] for r in index.search(q).collect()) for q in ("needle", "\U0001f600YZ", "a\nb", "abc", "ab")}
    assert found == {"needle": [1], "\U0001f600YZ": [2], "a\nb": [3], "abc": [], "ab": [1, 3]}
