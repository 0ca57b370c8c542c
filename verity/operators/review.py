"""Review operations (V1-V10) as DataFrame operators.

The original applies a person's accept/deny/edit decisions to in-browser row
arrays.  Here the table, the change log and the edits are DataFrames keyed by
``_row_id``; each operation is an aggregate of the (small per cell) change log
pivoted back to one row per ``_row_id`` and joined to the table.  No step puts
a whole table, or all changes of a column, into one task.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_
from .commits import CommitLog

SEVERITY_RANK = {"critical": 4, "error": 3, "warning": 2}   # anything else ranks 1
KIND_RANK = {"critical": 3, "warning": 2}                   # anything else ("fixed") ranks 1


def _rank(col: Column, ranks: dict, default: int = 1) -> Column:
    out = None
    for k, v in ranks.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(default)


def _seq(changes: DataFrame) -> Column:
    """Order of changes as they were made (rule, then column ordinal)."""
    return F.struct(F.col("rule"), F.col("col"))


def _apply_cells(table: DataFrame, cells: DataFrame, row_id: str, columns) -> DataFrame:
    """Write (row_id, column, value) cells into ``table``.

    Cells are pivoted to one row per row id (one column per edited column,
    plus a flag per column telling whether the cell was written, so a written
    null is kept), then left-joined on the row id.
    """
    cols = [c for c in columns if c != row_id]
    aggs = []
    for c in cols:
        hit = F.col("column") == c
        aggs.append(F.max_by(F.when(hit, F.col("value")), F.when(hit, F.col("_o"))).alias(f"_v_{c}"))
        aggs.append(F.max(hit).alias(f"_w_{c}"))
    wide = cells.groupBy(F.col(row_id)).agg(*aggs)
    joined = table.join(wide, row_id, "left")
    kinds = dict(table.dtypes)
    out = [F.col(row_id)]
    for c in table.columns:
        if c == row_id:
            continue
        if c in cols:
            value = col_(f"_v_{c}")
            if kinds[c].startswith(("map", "struct", "array")):       # nested cells are edited as JSON text
                value = F.from_json(value, kinds[c])
            out.append(F.when(F.coalesce(col_(f"_w_{c}"), F.lit(False)), value)
                       .otherwise(col_(c)).alias(c))
        else:
            out.append(col_(c))
    return joined.select(*out)


def accept_changes(table: DataFrame, changes: DataFrame, row_id: str = "_row_id",
                   mode: str = "clean") -> DataFrame:
    """V1 accept-all: each cell takes the new value of its latest acceptable change.

    Critical changes and changes with an empty new value are never written.
    ``mode='clean'`` (default) leaves a cell alone when its *latest* change is
    one of those; ``mode='ui'`` reproduces the original loop, where an earlier
    acceptable change of the same cell is still written (so an accept-all can
    bring back a value a later rule removed).
    """
    ok = (F.col("kind") != "critical") & (F.col("new_value") != "")
    ch = changes.select(F.col(row_id), "column", "new_value", "kind", _seq(changes).alias("_o"))
    if mode == "ui":
        cells = ch.where(ok).select(row_id, "column", F.col("new_value").alias("value"), "_o")
    else:
        last = ch.groupBy(row_id, "column").agg(F.max_by(F.struct("new_value", "kind"), "_o").alias("l"),
                                                F.max("_o").alias("_o"))
        cells = (last.where((F.col("l.kind") != "critical") & (F.col("l.new_value") != ""))
                 .select(row_id, "column", F.col("l.new_value").alias("value"), "_o"))
    return _apply_cells(table, cells, row_id, table.columns)


def deny_changes(table: DataFrame, changes: DataFrame, row_id: str = "_row_id",
                 mode: str = "ui") -> DataFrame:
    """V2 deny-all: each changed cell takes back an old value.

    ``mode='ui'`` (default, as the original) writes the *latest* change's old
    value, which for a cell changed twice is the intermediate value;
    ``mode='original'`` writes the first change's old value (the input text).
    """
    ch = changes.select(F.col(row_id), "column", "old_value", _seq(changes).alias("_o"))
    pick = F.max_by if mode == "ui" else F.min_by
    cells = ch.groupBy(row_id, "column").agg(pick("old_value", "_o").alias("value"),
                                            F.max("_o").alias("_o"))
    return _apply_cells(table, cells, row_id, table.columns)


def accept_one(table: DataFrame, changes: DataFrame, row: int, column: str,
               row_id: str = "_row_id") -> tuple[DataFrame, DataFrame]:
    """V1 single: write one change (if acceptable) and drop all pending changes of that cell."""
    ch = changes.where((F.col(row_id) == row) & (F.col("column") == column))
    return accept_changes(table, ch, row_id, mode="ui"), \
        changes.where(~((F.col(row_id) == row) & (F.col("column") == column)))


def deny_one(table: DataFrame, changes: DataFrame, row: int, column: str,
             row_id: str = "_row_id") -> tuple[DataFrame, DataFrame]:
    """V2 single: restore one cell and drop its pending changes."""
    ch = changes.where((F.col(row_id) == row) & (F.col("column") == column))
    return deny_changes(table, ch, row_id), \
        changes.where(~((F.col(row_id) == row) & (F.col("column") == column)))


def edit_cells(table: DataFrame, edits: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """V3: apply (row_id, column, value[, seq]) edits; the last edit of a cell wins."""
    e = edits
    if "seq" not in e.columns:
        e = e.withColumn("seq", F.lit(0))
    cells = e.select(F.col(row_id), "column", F.col("value").cast("string"), F.col("seq").alias("_o"))
    return _apply_cells(table, cells, row_id, table.columns)


def merge_quarantine(clean: DataFrame, quarantine: DataFrame, selected: DataFrame | None = None,
                     row_id: str = "_row_id") -> tuple[DataFrame, DataFrame]:
    """V4: append quarantined rows (internal reason column removed) to the clean table.

    With ``selected`` (a frame of row ids) only those rows move; the others
    stay in quarantine.  Returns (new clean, remaining quarantine).
    """
    q = quarantine.drop("_issue_reason")
    if selected is None:
        return clean.unionByName(q, allowMissingColumns=True), quarantine.limit(0)
    ids = selected.select(row_id).distinct()
    moved = q.join(ids, row_id, "left_semi")
    rest = quarantine.join(ids, row_id, "left_anti")
    return clean.unionByName(moved, allowMissingColumns=True), rest


def search_rows(table: DataFrame, query: str, row_id: str = "_row_id") -> DataFrame:
    """V5: rows where any cell contains ``query`` (case-insensitive); empty query keeps all."""
    if not query:
        return table
    q = query.lower()
    cond = F.lit(False)
    for c in table.columns:
        if c == row_id:
            continue
        cond = cond | F.coalesce(F.instr(F.lower(col_(c).cast("string")), q) > 0, F.lit(False))
    return table.where(cond)


def cell_severity(cells: DataFrame, issues: DataFrame) -> DataFrame:
    """V6: highest severity per affected cell (critical > error > warning > info)."""
    sev = issues.select("seq", "severity")
    return (cells.join(sev, "seq")
            .groupBy("row", "column")
            .agg(F.max_by("severity", _rank(F.col("severity"), SEVERITY_RANK)).alias("severity")))


def last_change_per_cell(changes: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """V7: the latest change of every changed cell."""
    keep = [c for c in changes.columns if c not in (row_id, "column")]
    return (changes.groupBy(row_id, "column")
            .agg(F.max_by(F.struct(*keep), _seq(changes)).alias("c"))
            .select(row_id, "column", "c.*"))


def row_change_kind(changes: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """V8: per row the strongest change kind (critical > warning > fixed)."""
    return (changes.groupBy(row_id)
            .agg(F.max_by("kind", _rank(F.col("kind"), KIND_RANK)).alias("kind")))


def change_stats(changes: DataFrame) -> DataFrame:
    """V9: changes needing review (critical or no new value) and the auto-fixable rest."""
    review = (F.col("kind") == "critical") | (F.col("new_value") == "")
    return changes.agg(F.count_if(~review).cast("long").alias("acceptable"),
                       F.count_if(review).cast("long").alias("needs_review"))


# ---------------------------------------------------------------------------
# Table versions (undo / redo) as a chain of deltas
# ---------------------------------------------------------------------------

def table_delta(old: DataFrame, new: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """What tells ``new`` from ``old``, one row for each row that differs: (row id, op, changed, old, new).

    ``op`` is add, remove or edit, ``changed`` the positions of the changed columns, and ``old`` / ``new`` hold the cells on both sides
    in their own types, null where an edit leaves them.  Row ids are unique and not null.
    """
    cols = [c for c in old.columns if c != row_id]
    kinds = dict(old.dtypes)
    a = old.select(col_(row_id).alias("r"), F.struct(*[col_(c) for c in cols]).alias("old"))
    b = new.select(col_(row_id).alias("r"), F.struct(*[col_(c).cast(kinds[c]).alias(c) for c in cols]).alias("new"))

    def same(c):
        x, y = (F.col(side)[c] for side in ("old", "new"))
        return F.to_json(x).eqNullSafe(F.to_json(y)) if kinds[c].startswith("map") else x.eqNullSafe(y)

    op = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").otherwise("edit")
    changed = F.array_compact(F.array(*[F.when(~same(c), F.lit(i)) for i, c in enumerate(cols)])) if cols \
        else F.array().cast("array<int>")
    both = a.join(b, "r", "full").select("r", op.alias("op"), changed.alias("changed"), "old", "new")
    both = both.where((F.col("op") != "edit") | (F.size("changed") > 0))

    def cells(side):
        kept = [F.when((F.col("op") != "edit") | F.array_contains("changed", i), F.col(side)[c]).alias(c) for i, c in enumerate(cols)]
        return F.when(F.col(side).isNotNull(), F.struct(*kept)).alias(side) if cols else F.col(side)

    return both.select(F.col("r").alias(row_id), "op", F.when(F.col("op") == "edit", F.col("changed")).otherwise(
        F.array(*map(F.lit, range(len(cols)))).cast("array<int>")).alias("changed"), cells("old"), cells("new"))


def apply_deltas(table: DataFrame, deltas: list[DataFrame], row_id: str = "_row_id", inverse: bool = False) -> DataFrame:
    """``table`` after some deltas in order, in one join; with ``inverse`` they are taken back, the last one first."""
    if not deltas:
        return table
    steps = None
    for k, d in enumerate(reversed(deltas) if inverse else deltas):
        if inverse:
            op = F.when(F.col("op") == "add", "remove").when(F.col("op") == "remove", "add").otherwise(F.col("op"))
            d = d.select(row_id, op.alias("op"), "changed", F.col("new").alias("old"), F.col("old").alias("new"))
        d = d.select(col_(row_id).alias("_r"), "op", "changed", "new", F.lit(k).alias("_k"))
        steps = d if steps is None else steps.unionByName(d)
    cols = [c for c in table.columns if c != row_id]

    def last(i, c):
        hit = (F.col("op") != "remove") & F.array_contains("changed", i)
        return F.max_by(F.when(hit, F.struct(F.col("new")[c].alias("v"))), F.when(hit, F.col("_k"))).alias(f"_c{i}")

    rows = steps.groupBy("_r").agg(F.min_by("op", "_k").alias("_first"), F.max_by("op", "_k").alias("_last"),
                                   *[last(i, c) for i, c in enumerate(cols)])
    at = {c: i for i, c in enumerate(cols)}
    # one full join: a union of the known and the added rows, both dealt out by the row id, counts as dealt out too, and a
    # later join that relies on it fails when their partitions differ in number
    known, first_last = F.col("_known").isNotNull(), F.col("_last") != "remove"
    both = table.withColumn("_known", F.lit(True)).join(rows, (col_(row_id) == F.col("_r")) & (F.col("_first") != "add"), "full")
    both = both.where(F.when(known, F.coalesce(first_last, F.lit(True))).otherwise((F.col("_first") == "add") & first_last))

    def cell(c):
        if c == row_id:
            return F.when(known, col_(c)).otherwise(F.col("_r")).alias(c)
        new = F.col(f"_c{at[c]}")
        return F.when(~known | new.isNotNull(), new["v"]).otherwise(col_(c)).alias(c)

    return both.select(*[cell(c) for c in table.columns])


class TableVersions:
    """Versions of a table in a shared folder, for several writers: push, undo and redo.

    A version is a delta against the one before it (``table_delta``): an edit of ten cells writes ten rows.  Every ``base_every``
    versions the whole table is written as well, and always for a table without the row id or with other columns
    than the version before it.  Reading a version starts from the nearest whole table, on from an earlier one or back from a later
    one by inverse deltas, in one join.

    What was done is entries of a commit log (commits.py): whoever opens the folder goes on where the last one was, and a writer
    that loses a number looks at what the other did and decides again.  ``push`` drops the redo tail, ``undo`` / ``redo`` move the cursor.
    """

    def __init__(self, spark, path: str, row_id: str = "_row_id", base_every: int = 10):
        self.spark, self.path, self.row_id, self.base_every = spark, path.rstrip("/"), row_id, base_every
        self.log = CommitLog(spark, self.path, {"kept": [], "cursor": -1}, self._fold)

    @staticmethod
    def _fold(state: dict, entry: dict) -> dict:
        kept, cursor = state["kept"], state["cursor"]
        if entry["action"] == "push":
            kept = [*kept[:cursor + 1], {"base": entry["base"], "delta": entry["delta"], "schema": entry["schema"]}]
        return {"kept": kept, "cursor": cursor + {"push": 1, "redo": 1, "undo": -1}[entry["action"]]}

    @property
    def versions(self) -> list[str]:
        return [v["delta"] or v["base"] for v in self.log.head()[1]["kept"]]

    @property
    def cursor(self) -> int:
        return self.log.head()[1]["cursor"]

    def _folder(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _version(self, state: dict) -> DataFrame:
        kept, at = state["kept"], state["cursor"]
        back = next(i for i in range(at, -1, -1) if kept[i]["base"])
        ahead = next((i for i in range(at + 1, len(kept)) if kept[i]["base"] or not kept[i]["delta"]), None)
        if ahead is not None and ahead - at < at - back and kept[ahead]["delta"]:
            return apply_deltas(self._folder(kept[ahead]["base"]), [self._folder(v["delta"]) for v in kept[at + 1:ahead + 1]],
                                self.row_id, inverse=True)
        return apply_deltas(self._folder(kept[back]["base"]), [self._folder(v["delta"]) for v in kept[back + 1:at + 1]], self.row_id)

    def _write(self, kind: str, df: DataFrame) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _push(self, make) -> str:
        """Commit ``make(state)``: (whole table, delta); made again if another push, undo or redo came first."""
        def decide(state):
            table, delta = make(state)
            name = self._write("delta", delta) if delta is not None else None
            kept, at = state["kept"], state["cursor"]
            steps = at - next((i for i in range(at, -1, -1) if kept[i]["base"]), at)
            whole = name is None or steps + 1 >= self.base_every
            entry = {"action": "push", "base": self._write("base", table()) if whole else None, "delta": name,
                     "schema": table().schema.json() if name is None else kept[at]["schema"]}
            made.append(name or entry["base"])
            return entry, lambda now: now == state
        made: list[str] = []
        self.log.append(decide)
        return made[-1]

    def push(self, df: DataFrame) -> str:
        """A new version of the table; the name of its delta, or of the whole table."""
        def make(state):
            alike = state["cursor"] >= 0 and self.row_id in df.columns and \
                _shape(df.schema) == _shape(T.StructType.fromJson(json.loads(state["kept"][state["cursor"]]["schema"])))
            return lambda: df, table_delta(self._version(state), df, self.row_id) if alike else None
        return self._push(make)

    def push_cells(self, edits: DataFrame) -> str:
        """A new version by hand edits (row id, column, value[, seq]), as ``edit_cells`` takes them; only their rows are compared."""
        def make(state):
            now = self._version(state)
            touched = now.join(edits.select(self.row_id).distinct(), self.row_id, "left_semi").select(*[col_(c) for c in now.columns])
            delta = table_delta(touched, edit_cells(touched, edits, self.row_id), self.row_id)
            return lambda: apply_deltas(now, [delta], self.row_id), delta
        return self._push(make)

    def _move(self, action: str, allowed) -> bool:
        return self.log.append(lambda state: ({"action": action} if allowed(state) else None, allowed)) is not None

    def undo(self) -> bool:
        return self._move("undo", lambda s: s["cursor"] > 0)

    def redo(self) -> bool:
        return self._move("redo", lambda s: s["cursor"] < len(s["kept"]) - 1)

    def current(self) -> DataFrame:
        return self._version(self.log.head()[1])


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    """Names and types, which tell whether two versions can be compared cell by cell."""
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]
