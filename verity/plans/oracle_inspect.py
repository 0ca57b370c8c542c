"""DuckDB SQL for inspection, scoring and report queries over the dirty views.

The SQL is generated from each view's static schema (names and types only);
every statistic and every decision is computed by DuckDB itself.
"""

from __future__ import annotations

from ..functions.constants import (CATEGORY_WEIGHTS, EMAIL_NAME_WORDS, EMAIL_PATTERN, FIXED_COST,
                                   ROW_SCALE)
from ..functions.numeric import DECIMAL_TEXT
from .views_sql import VIEW_SQL

# Static schemas of the dirty views: s = text, i = integer, d = double.
VIEW_COLUMNS = {
    "dirty_customer": [("customer_id", "i"), ("full_name", "s"), ("segment", "s"), ("email", "s"),
                       ("phone", "s"), ("opted_in", "s"), ("performance_rating", "s")],
    "dirty_orders": [("record_no", "i"), ("user_id", "i"), ("status", "s"), ("amount", "s"),
                     ("order_date_mixed", "s"), ("ship_date", "s")],
    "dirty_price": [("record_no", "i"), ("fee", "s")],
    "dirty_events": [("record_no", "i"), ("user_id", "i"), ("kind", "s"), ("amount", "d"),
                     ("note", "s")],
    "dirty_people": [("emp_id", "i"), ("employee_name", "s"), ("work_email", "s"), ("team", "s"),
                     ("salary_band", "s")],
    "events": [("event_id", "i"), ("ts", "t"), ("user_id", "i"), ("event_type", "s"), ("value", "d"),
               ("props", "s")],
    "dirty_staff": [("staff_id", "i"), ("full_name", "s"), ("email", "s"), ("department", "s")],
    "dirty_ratings": [("part_no", "i"), ("feedback", "s"), ("points", "s"), ("finish", "s"), ("unit.price", "s")],
    "dirty_contacts": [("employee_name", "s"), ("work_email", "s"), ("manager_name", "s"), ("manager_email", "s")],
    "dirty_lineitem": [("l_orderkey", "i"), ("l_partkey", "i"), ("l_suppkey", "i"),
                       ("l_linenumber", "i"), ("l_quantity", "d"), ("l_extendedprice", "d"),
                       ("l_discount", "d"), ("l_tax", "d"), ("l_returnflag", "s"),
                       ("l_linestatus", "s"), ("l_shipdate", "s")],
}

NOT_TITLE = r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]"
WS = r"^\s+|\s+$"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def ident(c: str) -> str:
    return '"' + c + '"'


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(WS)}, '', 'g')"


def lower_style(x):
    return f"({x} = lower({x}) AND {x} <> upper({x}))"


def upper_style(x):
    return f"({x} = upper({x}) AND {x} <> lower({x}))"


def title_style(x):
    return f"(NOT regexp_matches({x}, {q(NOT_TITLE)}))"


def numeric_sql(c: str, t: str) -> str:
    x = ident(c)
    if t == "t":  # timestamps are not numeric
        return "CAST(NULL AS DOUBLE)"
    if t in ("i", "d"):
        return f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN regexp_matches({x}, {q(DECIMAL_TEXT)}) THEN CAST({x} AS DOUBLE) END"


def value_text_sql(c: str, t: str) -> str:
    return f"CAST({ident(c)} AS VARCHAR)"


def repr_sql(x: str) -> str:
    esc = f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    return (f"CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', '\\''') || '''' END")


def email_named(c: str) -> bool:
    lc = c.lower().replace(" ", "_")
    return any(k in lc for k in EMAIL_NAME_WORDS)


def bad_email_sql(c: str) -> str:
    return f"({ident(c)} IS NOT NULL AND NOT regexp_matches({strip_sql(ident(c))}, {q(EMAIL_PATTERN)}))"


class InspectSQL:
    """SQL fragments for one view: stats CTE, issues CTE, cells CTE."""

    def __init__(self, view: str, cols=None, source_ctes: str | None = None):
        self.view = view
        self.cols = cols if cols is not None else VIEW_COLUMNS[view]
        self.source_ctes = source_ctes  # CTE text that defines ``view`` (instead of VIEW_SQL)

    # --- statistics -------------------------------------------------------
    def stats_cte(self) -> str:
        parts = ["count(*) AS n"]
        for i, (c, t) in enumerate(self.cols):
            x = ident(c)
            parts.append(f"count({x}) AS nn_{i}")
            if t == "s":
                parts += [f"count_if({x} IS NOT NULL AND {lower_style(x)}) AS lo_{i}",
                          f"count_if({x} IS NOT NULL AND {upper_style(x)}) AS up_{i}",
                          f"count_if({x} IS NOT NULL AND {title_style(x)}) AS ti_{i}",
                          f"count_if({x} IS NOT NULL AND {x} <> {strip_sql(x)}) AS ws_{i}",
                          f"count_if(regexp_matches({x}, {q(DECIMAL_TEXT)})) AS ca_{i}"]
                if email_named(c):
                    parts.append(f"count_if({bad_email_sql(c)}) AS be_{i}")
            num = numeric_sql(c, t)
            parts += [f"count({num}) AS num_{i}", f"avg({num}) AS mean_{i}",
                      f"stddev_samp({num}) AS std_{i}"]
        names = ", ".join(ident(c) for c, _ in self.cols)
        return (f"st AS (SELECT {', '.join(parts)}, "
                f"(SELECT count(*) FROM {self.view}) - (SELECT count(*) FROM (SELECT DISTINCT {names} "
                f"FROM {self.view})) AS dup FROM {self.view})")

    def outlier_flag(self, i, c, t) -> str:
        num = numeric_sql(c, t)
        return f"({num} < st.mean_{i} - 3 * st.std_{i} OR {num} > st.mean_{i} + 3 * st.std_{i})"

    def outlier_candidate(self, i, t) -> str:
        ratio_ok = "TRUE" if t in ("i", "d") else f"st.num_{i} / greatest(st.n, 1) >= 0.5"
        return (f"({ratio_ok} AND st.num_{i} >= 4 AND st.std_{i} IS NOT NULL AND st.std_{i} <> 0 "
                f"AND NOT isnan(st.std_{i}))")

    def outlier_cte(self) -> str:
        parts = ["0 AS _z"]
        for i, (c, t) in enumerate(self.cols):
            parts.append(f"count_if({self.outlier_flag(i, c, t)}) AS oc_{i}")
        return f"oc AS (SELECT {', '.join(parts)} FROM {self.view}, st)"

    # --- issues -----------------------------------------------------------
    def issue_rows(self) -> list:
        """(key, inspector, category, column, severity, count_sql, description_sql, suggestion, cond)."""
        rows = []
        rows.append(((0, 0, 0), "Duplicate Rows", "uniqueness", "*all*", "warning", "st.dup",
                     "'Found ' || CAST(st.dup AS VARCHAR) || ' exact duplicate row(s).'",
                     q("Remove duplicates or verify that they represent legitimate repeated entries."),
                     "st.dup > 0"))
        for i, (c, t) in enumerate(self.cols):
            if t != "s":
                continue
            tot = f"(st.lo_{i} + st.up_{i} + st.ti_{i})"
            mx = f"greatest(st.lo_{i}, st.up_{i}, st.ti_{i})"
            dom = (f"CASE WHEN {mx} = st.ti_{i} THEN 'Title Case' WHEN {mx} = st.lo_{i} THEN 'lowercase' "
                   f"ELSE 'UPPERCASE' END")
            rows.append(((1, i, 0), "Format Inconsistency", "format", c, "info", f"({tot} - {mx})",
                         f"'Column ' || {q(repr_quote(c))} || ' has inconsistent casing. Dominant style: ' || "
                         f"{dom} || ' (' || CAST({mx} AS VARCHAR) || '/' || CAST({tot} AS VARCHAR) || ').'",
                         None,
                         f"st.nn_{i} >= 2 AND {tot} > 0 AND {tot} - {mx} > 0 AND {mx} / {tot} < 0.95"))
            rows[-1] = rows[-1][:7] + (f"'Standardize all values to ' || {dom} || '.'",) + rows[-1][8:]
            rows.append(((1, i, 1), "Whitespace Issues", "format", c, "info", f"st.ws_{i}",
                         f"'Column ' || {q(repr_quote(c))} || ' has ' || CAST(st.ws_{i} AS VARCHAR) || "
                         f"' value(s) with leading/trailing whitespace.'",
                         q("Strip whitespace from all values in this column."),
                         f"st.nn_{i} >= 2 AND st.ws_{i} > 0"))
        for i, (c, t) in enumerate(self.cols):
            nulls = f"(st.n - st.nn_{i})"
            rows.append(((2, i, 0), "Missing Values", "completeness", c,
                         f"CASE WHEN {nulls} / st.n > 0.3 THEN 'critical' ELSE 'warning' END", nulls,
                         f"'Column ' || {q(repr_quote(c))} || ' has ' || CAST({nulls} AS VARCHAR) || "
                         f"' missing value(s) out of ' || CAST(st.n AS VARCHAR) || ' rows (' || "
                         f"printf('%.1f', 100 * {nulls} / st.n) || '%).'",
                         q("Fill missing values with the column median (numeric) or mode (text), "
                           "or investigate why data is absent."),
                         f"{nulls} > 0"))
        for i, (c, t) in enumerate(self.cols):
            rows.append(((3, i, 0), "Outlier Detection", "accuracy", c, "warning", f"oc.oc_{i}",
                         f"'Column ' || {q(repr_quote(c))} || ' has ' || CAST(oc.oc_{i} AS VARCHAR) || "
                         f"' statistical outlier(s) (>3σ from mean).'",
                         q("Review these values. They may be data entry errors or legitimate edge cases."),
                         f"{self.outlier_candidate(i, t)} AND oc.oc_{i} > 0"))
        for i, (c, t) in enumerate(self.cols):
            if t == "s" and email_named(c):
                rows.append(((4, 0, i), "Schema Validation", "accuracy", c, "critical", f"st.be_{i}",
                             f"'Column ' || {q(repr_quote(c))} || ' (email) has ' || CAST(st.be_{i} AS VARCHAR)"
                             f" || ' invalid email address(es).'",
                             q("Repair or remove invalid email addresses."),
                             f"st.nn_{i} > 0 AND st.be_{i} > 0"))
        for i, (c, t) in enumerate(self.cols):
            rows.append(((4, 1, i), "Schema Validation", "completeness", c, "info", "st.n",
                         f"'Column ' || {q(repr_quote(c))} || ' is entirely empty.'",
                         q("Remove this column or populate it with data."), f"st.nn_{i} = 0"))
        for i, (c, t) in enumerate(self.cols):
            if t != "s":
                continue
            rows.append(((5, i, 0), "Type Mismatch", "consistency", c, "warning", f"(st.nn_{i} - st.ca_{i})",
                         f"'Column ' || {q(repr_quote(c))} || ' appears numeric but has ' || "
                         f"CAST(st.nn_{i} - st.ca_{i} AS VARCHAR) || ' non-numeric value(s).'",
                         q("Convert non-numeric entries or separate them into a different column."),
                         f"st.nn_{i} > 0 AND st.ca_{i} / st.nn_{i} > 0.6 AND st.ca_{i} / st.nn_{i} < 1.0"))
        return rows

    def issues_cte(self) -> str:
        sels = []
        for key, insp, cat, col, sev, cnt, desc, sugg, cond in self.issue_rows():
            sev_sql = sev if sev.startswith("CASE") else q(sev)
            sels.append(f"SELECT {key[0]} AS k1, {key[1]} AS k2, {key[2]} AS k3, {q(insp)} AS inspector_name, "
                        f"{q(cat)} AS category, {q(col)} AS \"column\", {sev_sql} AS severity, "
                        f"CAST({cnt} AS BIGINT) AS \"count\", {desc} AS description, {sugg} AS suggestion "
                        f"FROM st, oc WHERE {cond}")
        body = "\nUNION ALL\n".join(sels)
        return (f"iss0 AS ({body}),\n"
                f"iss AS (SELECT CAST(row_number() OVER (ORDER BY k1, k2, k3) - 1 AS INTEGER) AS seq, "
                f"k1, k2, k3, inspector_name, category, \"column\", severity, \"count\", description, "
                f"suggestion FROM iss0)")

    def ctes(self) -> str:
        src = self.source_ctes if self.source_ctes is not None else f"{self.view} AS ({VIEW_SQL[self.view]}\n)"
        return f"{src},\n{self.stats_cte()},\n{self.outlier_cte()},\n{self.issues_cte()}"

    def issues_sql(self) -> str:
        return (f"WITH {self.ctes()}\nSELECT seq, inspector_name, category, \"column\", severity, \"count\", "
                f"description, suggestion FROM iss")

    # --- affected cells ---------------------------------------------------
    def cell_parts(self, capped: bool = True) -> list:
        """SELECTs of (k1, k2, k3, row, column, value) for every cell-listing check."""
        v = self.view
        parts = []
        names = ", ".join(ident(c) for c, _ in self.cols)
        dup = (f"SELECT 0 AS k1, 0 AS k2, 0 AS k3, _row_id AS row, '*all*' AS \"column\", 'duplicate' AS value "
               f"FROM (SELECT _row_id, row_number() OVER (PARTITION BY {names} ORDER BY _row_id) AS rn "
               f"FROM {v}) WHERE rn > 1")
        if capped:
            dup = f"SELECT * FROM ({dup}) ORDER BY row LIMIT 100"
        parts.append((dup, False))
        for i, (c, t) in enumerate(self.cols):
            x = ident(c)
            if t == "s":
                mx = f"greatest(st.lo_{i}, st.up_{i}, st.ti_{i})"
                pred = (f"CASE WHEN {mx} = st.ti_{i} THEN NOT {title_style(x)} "
                        f"WHEN {mx} = st.lo_{i} THEN {x} <> lower({x}) ELSE {x} <> upper({x}) END")
                parts.append((f"SELECT 1, {i}, 0, _row_id, {q(c)}, {x} FROM {v}, st "
                              f"WHERE {x} IS NOT NULL AND ({pred})", True))
                parts.append((f"SELECT 1, {i}, 1, _row_id, {q(c)}, {repr_sql(x)} FROM {v} "
                              f"WHERE {x} IS NOT NULL AND {x} <> {strip_sql(x)}", True))
        for i, (c, t) in enumerate(self.cols):
            parts.append((f"SELECT 2, {i}, 0, _row_id, {q(c)}, CAST(NULL AS VARCHAR) FROM {v} "
                          f"WHERE {ident(c)} IS NULL", False))
        for i, (c, t) in enumerate(self.cols):
            parts.append((f"SELECT 3, {i}, 0, _row_id, {q(c)}, {value_text_sql(c, t)} FROM {v}, st "
                          f"WHERE coalesce({self.outlier_flag(i, c, t)}, FALSE)", True))
        for i, (c, t) in enumerate(self.cols):
            if t == "s" and email_named(c):
                parts.append((f"SELECT 4, 0, {i}, _row_id, {q(c)}, {ident(c)} FROM {v} "
                              f"WHERE {bad_email_sql(c)}", True))
        for i, (c, t) in enumerate(self.cols):
            if t == "s":
                parts.append((f"SELECT 5, {i}, 0, _row_id, {q(c)}, {ident(c)} FROM {v} WHERE {ident(c)} "
                              f"IS NOT NULL AND NOT regexp_matches({ident(c)}, {q(DECIMAL_TEXT)})", True))
        return parts

    def cells_sql(self, capped: bool = True) -> str:
        sels = []
        for sql, cap in self.cell_parts(capped):
            if cap and capped:
                sels.append(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k1, k2, k3 "
                            f"ORDER BY row) AS rn FROM ({sql}) t(k1, k2, k3, row, \"column\", value)) "
                            f"WHERE rn <= 100")
            else:
                sels.append(f"SELECT *, 0 AS rn FROM ({sql}) t(k1, k2, k3, row, \"column\", value)")
        return "\nUNION ALL\n".join(sels)

    def cells_query(self, capped: bool = True) -> str:
        return (f"WITH {self.ctes()},\ncells AS ({self.cells_sql(capped)})\n"
                f"SELECT iss.seq, CAST(cells.row AS BIGINT) AS row, cells.\"column\", "
                f"CAST(cells.value AS VARCHAR) AS value "
                f"FROM cells JOIN iss USING (k1, k2, k3)")

    # --- score and reports -----------------------------------------------
    def score_ctes(self) -> str:
        k = len(self.cols)
        nulls = " + ".join(f"(st.n - st.nn_{i})" for i in range(k))
        worst = "greatest(" + ", ".join(f"(st.n - st.nn_{i}) / greatest(st.n, 1)" for i in range(k)) + ")"
        if k == 1:
            worst = f"((st.n - st.nn_0) / greatest(st.n, 1))"
        pen = ("least(100.0, sum(CASE severity WHEN 'critical' THEN {fc} WHEN 'warning' THEN {fw} "
               "WHEN 'info' THEN {fi} ELSE 0 END + CASE severity WHEN 'critical' THEN {sc} "
               "WHEN 'warning' THEN {sw} WHEN 'info' THEN {si} ELSE 0 END * least(1.0, \"count\" / "
               "greatest(st.n, 1)) * 100.0))").format(
            fc=FIXED_COST["critical"], fw=FIXED_COST["warning"], fi=FIXED_COST["info"],
            sc=ROW_SCALE["critical"], sw=ROW_SCALE["warning"], si=ROW_SCALE["info"])
        w = dict(CATEGORY_WEIGHTS)
        return (
            f"comp AS (SELECT 100.0 * pow(greatest(0.0, 1.0 - (0.6 * ({nulls}) / (greatest(st.n, 1) * {k}) "
            f"+ 0.4 * {worst})), 1.5) AS completeness, "
            f"100.0 * greatest(0.0, 1.0 - st.dup / greatest(st.n, 1) * 2.0) AS uniqueness, st.n AS n FROM st),\n"
            f"pen AS (SELECT category, {pen} AS p FROM iss, st "
            f"WHERE category IN ('consistency', 'accuracy', 'format') GROUP BY category),\n"
            f"cats AS (SELECT comp.*, "
            f"100.0 - coalesce((SELECT p FROM pen WHERE category = 'consistency'), 0.0) AS consistency, "
            f"100.0 - coalesce((SELECT p FROM pen WHERE category = 'accuracy'), 0.0) AS accuracy, "
            f"100.0 - coalesce((SELECT p FROM pen WHERE category = 'format'), 0.0) AS fmt FROM comp),\n"
            f"sc AS (SELECT *, CAST(greatest(0, least(100, round_even(completeness * {w['completeness']} + "
            f"uniqueness * {w['uniqueness']} + consistency * {w['consistency']} + accuracy * "
            f"{w['accuracy']} + fmt * {w['format']}, 0))) AS BIGINT) AS overall FROM cats)")

    def score_sql(self) -> str:
        k = len(self.cols)
        return (f"WITH {self.ctes()},\n{self.score_ctes()}\n"
                f"SELECT CAST(n AS BIGINT) AS total_rows, CAST({k} AS BIGINT) AS total_columns, "
                f"CAST(round_even(completeness, 0) AS BIGINT) AS completeness, "
                f"CAST(round_even(uniqueness, 0) AS BIGINT) AS uniqueness, "
                f"CAST(round_even(consistency, 0) AS BIGINT) AS consistency, "
                f"CAST(round_even(accuracy, 0) AS BIGINT) AS accuracy, "
                f"CAST(round_even(fmt, 0) AS BIGINT) AS format, overall AS overall_quality_score, "
                f"CASE WHEN overall >= 80 THEN 'GREEN' WHEN overall >= 50 THEN 'YELLOW' ELSE 'RED' END "
                f"AS traffic_light, "
                f"(SELECT CAST(coalesce(count_if(severity = 'critical'), 0) AS BIGINT) FROM iss) AS n_critical, "
                f"(SELECT CAST(coalesce(count_if(severity = 'warning'), 0) AS BIGINT) FROM iss) AS n_warning, "
                f"(SELECT CAST(coalesce(count_if(severity = 'info'), 0) AS BIGINT) FROM iss) AS n_info FROM sc")

    def severity_sql(self) -> str:
        return (f"WITH {self.ctes()}\nSELECT severity, CAST(count(*) AS BIGINT) AS n_issues, "
                f"CAST(sum(\"count\") AS BIGINT) AS n_cells FROM iss GROUP BY severity")

    def digest_sql(self, top: int = 30) -> str:
        line = ("'- ' || upper(severity) || ': ' || inspector_name || ' found ' || CAST(\"count\" AS VARCHAR)"
                " || ' issues in ''[''' || \"column\" || ''']''.'")
        return (f"WITH {self.ctes()},\n"
                f"ranked AS (SELECT seq, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 "
                f"WHEN 'info' THEN 2 ELSE 3 END AS r, {line} AS line FROM iss),\n"
                f"topk AS (SELECT * FROM ranked ORDER BY r, seq LIMIT {top}),\n"
                f"ctx AS (SELECT string_agg(line, chr(10) ORDER BY r, seq) AS context FROM topk),\n"
                f"tot AS (SELECT count(*) AS n FROM iss)\n"
                f"SELECT CASE WHEN n = 0 THEN 'Perfect dataset — no quality issues detected.' "
                f"WHEN n > {top} THEN context || chr(10) || '...and ' || CAST(n - {top} AS VARCHAR) || "
                f"' more minor issues.' ELSE context END AS digest, CAST(n AS BIGINT) AS n_issues FROM tot, ctx")

    def impact_sql(self, capped: bool) -> str:
        return (f"WITH {self.ctes()},\ncells AS ({self.cells_sql(capped)})\n"
                f"SELECT CAST(count(DISTINCT cells.row) AS BIGINT) AS affected_rows, "
                f"CAST((SELECT n FROM st) AS BIGINT) AS total_rows, "
                f"CAST(round(count(DISTINCT cells.row) * 100.0 / (SELECT n FROM st)) AS BIGINT) AS affected_pct "
                f"FROM cells JOIN iss USING (k1, k2, k3) WHERE iss.severity <> 'info'")


def repr_quote(c: str) -> str:
    return "'" + c + "'"
