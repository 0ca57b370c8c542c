"""Exact medians, row ids for any input, dates, and the guard on the shared folder."""

import csv
import glob
import json
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from verity.functions.dates import parse_as
from verity.operators.history import HistoryStore, entries_from_events
from verity.operators.inspect import inspect
from verity.operators.repair import autofix
from verity.operators.review import TableVersions
from verity.operators.rowid import with_row_id
from verity.operators.stats import exact_medians
from verity.plans import fixtures
from verity.session import ensure_checkpoint_dir, scratch_path
from verity.sources.readers import read_json_records, read_upload
from verity.sources.writers import write_csv


def medians(df, *names):
    return exact_medians(df, {c: (F.col(c), df.where(F.col(c).isNotNull()).count()) for c in names})


def test_medians_of_any_doubles(spark):
    r = random.Random(1)
    odd = [5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 0.0, -0.0, 1.0, -1.0]
    xs = [r.choice([r.gauss(0, 1), r.uniform(-1e300, 1e300), r.choice(odd), 2.0 ** r.randrange(-1074, 1024)]) for _ in range(1001)]
    df = spark.createDataFrame([(x, -x if i else None) for i, x in enumerate(xs)], "a double, b double")
    assert medians(df, "a", "b") == {"a": median(xs), "b": median(-x for x in xs[1:])}
    assert exact_medians(df, {"a": (F.col("a"), 0)}) == {}


def test_median_in_a_huge_tie(spark):
    ids = spark.range(200_000)
    tie = ids.select(F.when(F.col("id") < 70_000, F.col("id") / 7).when(F.col("id") < 150_000, F.lit(12345.5))
                     .otherwise(F.col("id") * 3.0).cast("double").alias("x"))
    assert medians(tie, "x") == {"x": 12345.5}


def test_median_of_a_million_distinct_values(spark):
    x = spark.range(1_000_000).select((F.col("id") * 1.25 - 7).alias("x"))
    assert medians(x, "x") == {"x": (499_999 * 1.25 - 7 + 500_000 * 1.25 - 7) / 2}


def test_row_ids_of_files_follow_their_order(spark):
    path = scratch_path(spark, "csv")
    write_csv(spark.range(1000).repartitionByRange(7, "id"), path)
    for df in (spark.read.option("header", True).csv(path), read_upload(spark, path, "csv")):
        rows = with_row_id(df, "_row_id").collect()
        assert sorted(r["_row_id"] for r in rows) == list(range(1000))
        assert all(int(r["id"]) == r["_row_id"] for r in rows)
    o = fixtures.table(spark, SF, "orders")
    assert [r[0] for r in with_row_id(o).select("_row_id").orderBy("_row_id").collect()] == list(range(o.count()))


@pytest.mark.parametrize("key", ["k", "day"])
def test_row_ids_by_any_key(spark, key):
    df = spark.createDataFrame([("b7-e2", "2024-01-03"), ("a0-11", "2024-01-01"), ("c9-00", "2024-01-09")], "k string, day string")
    df = df.withColumn("day", F.col("day").cast("date"))
    got = [r[key] for r in with_row_id(df, key=key).orderBy("_row_id").collect()]
    assert got == sorted(got)


def test_dates_as_strptime_reads_them(spark):
    cases = {"01/05/2024": "2024-01-05", "1/5/2024": "2024-01-05", "01/ 5/2024": "2024-01-05", "01/005/2024": None, "001/05/2024": None,
             "01/05/0000": None, "02/30/2024": None, "01/05/24": None, "x01/05/2024": None, "12/31/9999": "9999-12-31"}
    rows = spark.createDataFrame([(v,) for v in cases], "v string").select("v", parse_as("v", 1).alias("d")).collect()
    assert {r["v"]: r["d"] for r in rows} == cases


def test_fill_of_large_integers_stays_plain(spark):
    res = autofix(spark.createDataFrame([(0, "1" + "0" * 22), (1, "1" + "0" * 22), (2, None)], "_row_id long, qty string"))
    assert {r["qty"] for r in res.clean().collect()} == {"1" + "0" * 22}


def test_csv_cells_with_quotes_and_newlines(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,who,when\r\n1,"Ann ""A"" Lee",2024-01-05T10:00:00Z\r\n2,"two\nlines, ok",2024-01-06\r\n3,,\r\n')
    df = read_upload(spark, str(tmp_path / "in.csv"))
    assert df.dtypes == [("id", "bigint"), ("who", "string"), ("when", "string")]
    rows = [("1", 'Ann "A" Lee', "2024-01-05T10:00:00Z"), ("2", "two\nlines, ok", "2024-01-06"), ("3", None, None)]
    assert [tuple(str(x) if isinstance(x, int) else x for x in r) for r in df.orderBy("id").collect()] == rows
    write_csv(df.coalesce(1), str(tmp_path / "out"))
    with open(glob.glob(str(tmp_path / "out" / "part-*"))[0], newline="") as f:
        assert list(csv.reader(f))[1:] == [[x or "" for x in r] for r in rows]


def test_uploads_are_inspected_and_repaired_without_a_key(spark, tmp_path):
    (tmp_path / "in.csv").write_text("name,unit.price\n Ann Lee,5\nBob Roe,\nCy Poe,9\n")
    df = read_upload(spark, str(tmp_path / "in.csv"))
    assert any(s.columns == ["unit.price"] for s in inspect(df).specs)
    clean = autofix(df).clean(keep_row_id=False).orderBy("name").collect()
    assert [tuple(r) for r in clean] == [("Ann Lee", "5"), ("Bob Roe", "7"), ("Cy Poe", "9")]
    (tmp_path / "none.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        read_upload(spark, str(tmp_path / "none.csv"))


def test_json_objects_lists_and_null_fields(spark, tmp_path):
    p = tmp_path / "o.json"
    p.write_text(json.dumps({"meta": {"n": 1}, "z": [{"k": "a", "n": {"a": 1, "b": None}}, {"k": "b", "n": None}], "a": [1, 2]}))
    assert sorted(map(tuple, read_json_records(spark, str(p)).collect())) == [("a", '{"a":1,"b":null}'), ("b", None)]
    p.write_text(json.dumps({"k": 5, "n": {"x": None}}))
    assert [tuple(r) for r in read_json_records(spark, str(p)).collect()] == [("5", '{"x":null}')]
    p.write_text(json.dumps([{"k": 5}, {"k": 6}]))
    assert sorted(r["k"] for r in read_json_records(spark, str(p)).collect()) == ["5", "6"]


def test_stores_go_on_where_the_last_process_stopped(spark):
    path, entries = scratch_path(spark, "history"), entries_from_events(fixtures.table(spark, SF, "events"))
    users = [r[0] for r in entries.select("user_id").distinct().orderBy("user_id").limit(3).collect()]
    some = entries.where(F.col("user_id").isin(users))
    HistoryStore(spark, path).append(some.where(F.col("user_id") == users[0]))
    HistoryStore(spark, path).append(some.where(F.col("user_id") != users[0]))
    store = HistoryStore(spark, path)
    assert store.table().select("user_id").distinct().count() == 3
    store.clear(users[1])
    left = HistoryStore(spark, path).table()
    assert sorted(r[0] for r in left.select("user_id").distinct().collect()) == sorted({users[0], users[2]})
    one = left.first()
    assert HistoryStore(spark, path).delete(one["id"], one["user_id"]).count() == left.count() - 1
    versions = scratch_path(spark, "versions")
    TableVersions(spark, versions).push(spark.range(3))
    TableVersions(spark, versions).push(spark.range(5))
    again = TableVersions(spark, versions)
    assert again.current().count() == 5 and again.undo() and TableVersions(spark, versions).current().count() == 3
    assert TableVersions(spark, versions).redo() and again.current().count() == 5 and not again.redo()


def test_every_pair_cuts_the_plan(spark):
    """What comes after two inferring pairs reads one materialised frame, not the joins of all pairs."""
    rows = [(i, f"Ann{i} Lee{i}" if i % 5 else None, f"ann{i}.lee{i}@x.com" if i % 4 else None, f"a.lee{i}@y.com" if i % 3 else None)
            for i in range(40)]
    res = autofix(spark.createDataFrame(rows, "_row_id long, full_name string, work_email string, home_email string"))
    assert res.frame._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert {r["column"] for r in res.all_changes().where("rule = 10").collect()} >= {"work_email", "home_email"}
    res.unpersist()


def test_no_folder_off_a_local_master():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda k, d: d)

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_uploaded_objects_are_bounded(spark, monkeypatch):
    from verity.plans import catalog_edges
    folders = []
    monkeypatch.setattr(catalog_edges, "EVENTS_PER_OBJECT", 100, raising=False)
    monkeypatch.setattr(catalog_edges, "_scratch", lambda s, name: folders.append(scratch_path(s, name)) or folders[-1])
    events = fixtures.table(spark, SF, "events").withColumn("user_id", F.lit(7).cast("long"))    # one hot user
    monkeypatch.setattr(fixtures, "table", lambda *_: events)
    n = events.count()
    assert catalog_edges._upload_json_object(spark, SF).count() == n
    sizes = [len(json.loads(r["value"])["rows"]) for r in spark.read.text(folders[0], wholetext=True).collect()]
    assert sum(sizes) == n and len(sizes) >= n // 100 and max(sizes) <= 160


def test_json_folder_of_mixed_shapes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    files = {"a b%.json": json.dumps({"meta": {"n": 1}, "rows": [{"k": "a", "t": "} {"}, {"k": "b\\\"}{"}], "items": [1]}, indent=1),
             "b.json": json.dumps({"items": [{"k": "c"}], "rows": [{"k": "no"}]}), "c.json": json.dumps([{"k": "d"}, {"k": "e"}]),
             "d.json": json.dumps({"k": "f", "n": {"x": None}}), "e.json": '{"k": "g"}\r\n\n{"k": "h", "l": [{"k": "i"}]}\n',
             "f.json": json.dumps({"rows": [{"k": "j"}]}), "g.json": '{"rows": []}', "h.json": ""}
    for name, text in files.items():
        (folder / name).write_text(text)
    got = read_json_records(spark, str(folder))
    assert sorted(r["k"] for r in got.collect()) == sorted(["a", 'b\\"}{', *"cdefghj"])
    assert {(r["k"], r["t"], r["n"], r["l"]) for r in got.collect()} >= {
        ("a", "} {", None, None), ("f", None, '{"x":null}', None), ("h", None, None, '[{"k":"i"}]')}
    named = read_json_records(spark, str(folder), record_field="rows")
    assert {"no", "a", "j", "d", "f", "g"} <= {r["k"] for r in named.collect()}
    (folder / "z.json").write_text('{"k": 1} {"k": 2}\n')
    with pytest.raises(ValueError):
        read_json_records(spark, str(folder))


def test_json_lines_are_read_whole(spark, tmp_path):
    from verity.sources.writers import write_json
    df = spark.createDataFrame([(f"k{i}", f"v{i}") for i in range(20)], "a string, b string").coalesce(2)
    write_json(df, str(tmp_path / "out"))
    assert sorted(map(tuple, read_upload(spark, str(tmp_path / "out"), fmt="json").collect())) == sorted(map(tuple, df.collect()))
