"""What a repair spends on rows that nothing happens to."""

import random

from pyspark.sql import functions as F

from verity.functions.text import smart_title
from verity.operators import repair
from verity.operators.repair import autofix
from verity.operators.rowid import dense_index


def test_rows_without_a_change_hold_no_slots(spark):
    rows = [(i, "a " if i == 3 else "a", None if i == 5 else f"{i}.5") for i in range(9)]
    frame = autofix(spark.createDataFrame(rows, "_row_id long, word string, amount string")).frame
    assert {r["_row_id"]: r["n"] for r in frame.select("_row_id", F.size("_changes").alias("n")).collect()} == {
        i: int(i in (3, 5)) for i in range(9)}


def test_a_frame_that_no_rule_changed_is_not_written_again(spark, monkeypatch):
    written = []
    keep = repair.scratch_path
    monkeypatch.setattr(repair, "scratch_path", lambda s, name: written.append(name) or keep(s, name))
    rows = [(i, "a" if i % 2 else "b", None if i == 5 else float(i)) for i in range(9)]
    res = autofix(spark.createDataFrame(rows, "_row_id long, word string, amount double"))
    assert written == ["autofix", "autofix"]
    assert res.counts() == {"clean_count": 9, "quarantine_count": 0, "changes_applied": 0}


def test_numbers_are_repaired_as_their_text_is(spark):
    """A typed column, which no rule for text looks at, comes out as its text does when that is what is given."""
    nan, inf = float("nan"), float("inf")
    wide = [1.5, nan, inf, -inf, 1e16, -0.0, 1.5e-5, -3.0, 12345678.25, None]
    rows = [(i, i % 2, -i, wide[i % 10], float(i) if i % 7 else None, inf if i % 3 else 1e20, i % 2, float(i % 9), i) for i in range(40)]
    df = spark.createDataFrame(rows, "_row_id long, flag int, debt long, wide double, fee double, huge double, "
                                     "on_date int, rating double, phone long")
    w = repair.stringify(df)
    for typed, text in ((autofix(df), autofix(w.df.select("_row_id", *w.columns))),):
        for of in ("clean", "quarantine", "changes"):
            a, b = ([tuple(r) for r in getattr(x, of)().collect()] for x in (typed, text))
            assert sorted(a, key=str) == sorted(b, key=str)
            assert a or of == "quarantine"
        assert {k: v for k, v in typed.plan.items() if k[0] != "_"} == {k: v for k, v in text.plan.items() if k[0] != "_"}


def test_title_case_with_and_without_particles(spark):
    text = ["ludwig VAN beethoven", "vanessa", "van gogh", "a de", "O", "x du  y", " la la ", "", None, "AL el al"]
    df = spark.createDataFrame([(t,) for t in text], "t string").select("t", smart_title("t").alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()} == {
        "ludwig VAN beethoven": "Ludwig van Beethoven", "vanessa": "Vanessa", "van gogh": "Van Gogh", "a de": "A de", "O": "O",
        "x du  y": "X du Y", " la la ": "La la", "": "", None: None, "AL el al": "Al el al"}


def test_dense_index_by_several_columns(spark):
    rows = [(i % 3 or None, i % 5, i) for i in range(40)]
    random.Random(1).shuffle(rows)
    got = dense_index(spark.createDataFrame(rows, "a int, b int, c int"), ["a", "b", "c"], "p").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert [(r["a"], r["b"], r["c"]) for r in sorted(got, key=lambda r: r["p"])] == want
    assert sorted(r["p"] for r in got) == list(range(40))
