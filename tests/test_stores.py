"""Stores with several writers: the commit log, run history, versions as deltas."""

import threading

import pytest
from pyspark.sql import functions as F

from verity.operators.commits import CommitLog, Folder
from verity.operators.history import HistoryStore, entries_from_events, retain
from verity.operators.review import TableVersions, apply_deltas, table_delta
from verity.plans import fixtures
from verity.session import scratch_path

from tests.conftest import SF


def _count(state, entry):
    return {"sum": state["sum"] + entry["x"], "n": state["n"] + 1}


@pytest.mark.parametrize("link", [True, False])
def test_put_if_absent(spark, link):
    folder = Folder(spark, scratch_path(spark, "log"))
    assert folder.read("a") is None
    assert folder.put_if_absent("a", "first", link) and not folder.put_if_absent("a", "second", link)
    assert folder.read("a") == "first"


def test_log_of_many_writers(spark):
    """Four threads add a hundred entries: every number is taken once, and a reader of any moment sees a prefix."""
    path = scratch_path(spark, "log")
    seen = []

    def writer(k):
        log = CommitLog(spark, path, {"sum": 0, "n": 0}, _count)
        for i in range(25):
            log.append(lambda state, x=100 * k + i: ({"x": x}, lambda now: True))
            seen.append(log.head())
    threads = [threading.Thread(target=writer, args=(k,)) for k in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    seq, state = CommitLog(spark, path, {"sum": 0, "n": 0}, _count).head()
    assert (seq, state) == (100, {"sum": sum(100 * k + i for k in range(4) for i in range(25)), "n": 100})
    assert all(at == s["n"] for at, s in seen)


def test_state_is_read_without_the_whole_log(spark):
    path = scratch_path(spark, "log")
    log = CommitLog(spark, path, {"sum": 0, "n": 0}, _count)
    for _ in range(45):
        log.append(lambda state: ({"x": 1}, lambda now: True))
    reads = []
    other = CommitLog(spark, path, {"sum": 0, "n": 0}, _count)
    read = other.folder.read
    other.folder.read = lambda name: reads.append(name) or read(name)
    assert other.head() == (45, {"sum": 45, "n": 45}) and len(reads) <= 8
    log.folder.write("_hint", "not a number")                     # a hint that is lost only costs reading
    assert CommitLog(spark, path, {"sum": 0, "n": 0}, _count).head() == (45, {"sum": 45, "n": 45})


def _rows(df):
    return sorted(tuple(r) for r in df.select("user_id", "id").collect())


def test_writers_of_history_lose_nothing(spark):
    """Another writer commits between a writer's reading and its commit, every time; appends, deletes and clears all hold."""
    path, entries = scratch_path(spark, "history"), entries_from_events(fixtures.table(spark, SF, "events")).cache()
    parts = [entries.where(F.pmod(F.xxhash64("id"), F.lit(4)) == i) for i in range(4)]
    a, b = HistoryStore(spark, path, buckets=4), HistoryStore(spark, path, buckets=4)
    commit, between = a.log.commit, [lambda: b.append(parts[1])]

    def late(seq, entry):
        while between:
            between.pop()()
        return commit(seq, entry)
    a.log.commit = late
    a.append(parts[0])
    assert _rows(b.table()) == _rows(retain(parts[0].unionByName(parts[1])))
    one = b.table().first()
    between.append(lambda: b.append(parts[2]))                    # the deleted user's bucket gets entries meanwhile
    a.delete(one["id"], one["user_id"])
    want = retain(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    got = _rows(HistoryStore(spark, path).table())
    assert (one["user_id"], one["id"]) not in got and set(got) <= set(_rows(want)) and len(got) >= want.count() - 1
    between.append(lambda: b.delete(*[x for x in [b.table().where(F.col("user_id") != one["user_id"]).first()] for x in (x["id"], x["user_id"])]))
    a.clear(one["user_id"])
    assert one["user_id"] not in {u for u, _ in _rows(a.table())} and len(_rows(a.table())) < len(got)
    entries.unpersist()


def test_threads_of_writers(spark):
    path, entries = scratch_path(spark, "history"), entries_from_events(fixtures.table(spark, SF, "events"))
    parts = [entries.where(F.pmod(F.xxhash64("id"), F.lit(6)) == i) for i in range(6)]
    threads = [threading.Thread(target=lambda ps=ps: [HistoryStore(spark, path, buckets=2, max_parts=2).append(p) for p in ps])
               for ps in (parts[:2], parts[2:4], parts[4:])]
    [t.start() for t in threads], [t.join() for t in threads]
    assert _rows(HistoryStore(spark, path).table()) == _rows(retain(entries))


def test_history_is_compacted_and_grows(spark):
    path, entries = scratch_path(spark, "history"), entries_from_events(fixtures.table(spark, SF, "events"))
    store = HistoryStore(spark, path, buckets=2, max_parts=3, rows_per_bucket=100)
    for i in range(6):
        store.append(entries.where(F.pmod(F.xxhash64("id"), F.lit(6)) == i))
    state = HistoryStore(spark, path).log.head()[1]
    assert max(map(len, state["parts"].values())) <= 4 and state["buckets"] > 2
    assert _rows(HistoryStore(spark, path).table()) == _rows(retain(entries))
    assert store.append(entries.limit(0)).count() == retain(entries).count()


# ---------------------------------------------------------------- versions

SCHEMA = "_row_id long, v string, n double, d date, m map<string,int>, s struct<x:int>"


def _table(spark, n=40, shift=0):
    return spark.range(n).selectExpr("id + {0} as _row_id".format(shift), "concat('v', id) as v", "id / 3 as n", "date'2024-01-01' + cast(id as int) as d",
                                     "map('k', cast(id as int)) as m", "named_struct('x', cast(id as int)) as s")


def _same(a, b):
    key = lambda df: sorted(str(r) for r in df.select(*sorted(df.columns)).collect())
    return key(a) == key(b)


def test_delta_there_and_back(spark):
    """Edits of every type, added and removed rows, nulls written and taken away."""
    a = _table(spark)
    b = a.where("_row_id <> 3").withColumns({
        "v": F.when(F.col("_row_id") == 5, None).otherwise(F.col("v")), "n": F.when(F.col("_row_id") == 6, 0.1 + 0.2).otherwise(F.col("n")),
        "m": F.when(F.col("_row_id") == 7, F.create_map(F.lit("z"), F.lit(1))).otherwise(F.col("m")),
        "d": F.when(F.col("_row_id") == 8, F.lit(None)).otherwise(F.col("d"))}).unionByName(_table(spark, 2, 100))
    d = table_delta(a, b)
    assert {(r["_row_id"], r["op"], len(r["changed"])) for r in d.collect()} == {
        (3, "remove", 5), (5, "edit", 1), (6, "edit", 1), (7, "edit", 1), (8, "edit", 1), (100, "add", 5), (101, "add", 5)}
    assert _same(apply_deltas(a, [d]), b) and _same(apply_deltas(b, [d], inverse=True), a)
    c = b.where("_row_id <> 100").unionByName(_table(spark, 4).where("_row_id = 3")).withColumn("v", F.when(F.col("_row_id") == 5, "back").otherwise(F.col("v")))
    e = table_delta(b, c)
    assert _same(apply_deltas(a, [d, e]), c) and _same(apply_deltas(c, [d, e], inverse=True), a)
    assert table_delta(a, a).count() == 0


def test_an_edit_of_ten_cells_writes_ten_rows(spark):
    path = scratch_path(spark, "versions")
    tv = TableVersions(spark, path)
    tv.push(_table(spark, 1000))
    edits = spark.range(10).selectExpr("id * 7 as _row_id", "if(id < 5, 'v', 'n') as column", "if(id < 5, 'new', '0.25') as value")
    for name in (tv.push_cells(edits), tv.push(tv.current().withColumn("v", F.when(F.col("_row_id") < 10, "w").otherwise(F.col("v"))))):
        assert spark.read.parquet(f"{path}/{name}").count() == 10
    assert tv.current().where("n = 0.25 and _row_id >= 35").count() == 5 and tv.current().schema["n"].dataType.simpleString() == "double"
    assert [v["base"] is not None for v in tv.log.head()[1]["kept"]] == [True, False, False]


def test_chain_with_bases_undone_and_redone(spark):
    """Every version is read as it was pushed, from bases on both sides, in any order of undo and redo."""
    tv = TableVersions(spark, scratch_path(spark, "versions"), base_every=4)
    tables = [_table(spark, 20)]
    tv.push(tables[0])
    for k in range(1, 11):
        t = tables[-1].where(F.col("_row_id") != 20 - k).withColumn("n", F.when(F.col("_row_id") == k % 5, float(k)).otherwise(F.col("n")))
        tables.append(t.unionByName(_table(spark, 1, 100 + k)))
        tv.push(tables[-1])
    assert [v["base"] is not None for v in tv.log.head()[1]["kept"]] == [i % 4 == 0 for i in range(11)]
    for k in range(9, -1, -1):
        assert tv.undo() and _same(tv.current(), tables[k])
    assert not tv.undo()
    for k in range(1, 8):
        assert TableVersions(spark, tv.path).redo() and (k % 3 or _same(tv.current(), tables[k]))
    tv.push(tables[2])
    assert not tv.redo() and _same(tv.current(), tables[2]) and tv.undo() and _same(tv.current(), tables[7])


def test_tables_that_cannot_be_compared_are_written_whole(spark):
    tv = TableVersions(spark, scratch_path(spark, "versions"))
    for df in (spark.range(3), spark.range(5), _table(spark, 5), _table(spark, 5).withColumn("extra", F.lit(1))):
        tv.push(df)
        assert _same(tv.current(), df)
    assert all(v["base"] and not v["delta"] for v in tv.log.head()[1]["kept"])
    assert tv.undo() and tv.undo() and tv.current().count() == 5 and tv.undo() and tv.current().count() == 3


def test_two_writers_of_versions(spark):
    """A push that another one overtakes is compared with the other's table, and both stay in the chain."""
    path = scratch_path(spark, "versions")
    a, b = TableVersions(spark, path), TableVersions(spark, path)
    t = _table(spark, 30)
    a.push(t)
    mine, yours = (t.withColumn("v", F.when(F.col("_row_id") == i, "x").otherwise(F.col("v"))) for i in (1, 2))
    commit, between = a.log.commit, [lambda: b.push(yours)]

    def late(seq, entry):
        while between:
            between.pop()()
        return commit(seq, entry)
    a.log.commit = late
    a.push(mine)
    assert _same(b.current(), mine) and b.undo() and _same(a.current(), yours) and a.undo() and _same(b.current(), t)


def test_versions_whose_joins_are_not_broadcast(spark):
    """Hand edits on a version with added rows, when every join deals its rows out by key."""
    key, before = F.col("_row_id"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    o = spark.range(200).select(F.col("id").alias("_row_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("status"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tv = TableVersions(spark, scratch_path(spark, "versions"), base_every=5)
        tv.push(o.where(key % 10 != 3))
        tv.push(o.withColumn("status", F.when(key % 10 != 4, F.col("status"))))
        tv.push_cells(o.where(key % 10 == 2).select("_row_id", F.lit("status").alias("column"), F.lit("x").alias("value")))
        tv.push(tv.current().where(key % 10 != 5))
        want = {i: None if i % 10 == 4 else "x" if i % 10 == 2 else f"s{i % 7}" for i in range(200) if i % 10 != 5}
        assert {r[0]: r[1] for r in tv.current().collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
