"""Registered queries: each name maps to a Spark callable and, where SQL can say
the same thing, the DuckDB oracle SQL used to check it."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures
from .oracle_inspect import InspectSQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Inspection and scoring
# ---------------------------------------------------------------------------

def _inspection(spark, sf_dir, view):
    from ..operators.inspect import inspect
    return inspect(fixtures.view(spark, sf_dir, view))


INSPECT_VIEWS = ("dirty_orders", "dirty_customer", "dirty_events", "dirty_price", "dirty_people",
                 "dirty_staff", "dirty_lineitem", "dirty_ratings")


def _register_inspection(view: str):
    short = view.replace("dirty_", "")
    isql = InspectSQL(view)

    @register(f"inspect_issues_{short}", isql.issues_sql())
    def _issues(spark, sf_dir):
        return _inspection(spark, sf_dir, view).issues()

    @register(f"inspect_cells_{short}", isql.cells_query(capped=True))
    def _cells(spark, sf_dir):
        return _inspection(spark, sf_dir, view).cells()

    @register(f"score_{short}", isql.score_sql())
    def _score(spark, sf_dir):
        from ..operators.score import score_frame
        return score_frame(_inspection(spark, sf_dir, view))

    @register(f"severity_summary_{short}", isql.severity_sql())
    def _sev(spark, sf_dir):
        from ..operators.score import severity_summary
        return severity_summary(_inspection(spark, sf_dir, view).issues())

    @register(f"issue_digest_{short}", isql.digest_sql())
    def _digest(spark, sf_dir):
        from ..operators.score import issue_digest
        return issue_digest(_inspection(spark, sf_dir, view).issues())

    @register(f"dataset_impact_{short}", isql.impact_sql(capped=False))
    def _impact(spark, sf_dir):
        from ..operators.score import dataset_impact
        return dataset_impact(_inspection(spark, sf_dir, view))

    @register(f"dataset_impact_ui_{short}", isql.impact_sql(capped=True))
    def _impact_ui(spark, sf_dir):
        from ..operators.score import dataset_impact
        return dataset_impact(_inspection(spark, sf_dir, view), cap=100)


for _v in INSPECT_VIEWS:
    _register_inspection(_v)


# ---------------------------------------------------------------------------
# Repair (F0-F18, O1-O7): the whole ordered pipeline on each dirty view
# ---------------------------------------------------------------------------

REPAIR_VIEWS = ("dirty_customer", "dirty_orders", "dirty_price", "dirty_events", "dirty_people",
                "dirty_staff", "dirty_lineitem", "dirty_ratings")


def _autofix(spark, sf_dir, view):
    from ..operators.repair import autofix
    return autofix(fixtures.view(spark, sf_dir, view))


def _register_repair(view: str):
    from .oracle_repair import RepairSQL
    short = view.replace("dirty_", "")
    rs = RepairSQL(view)
    rs.build()

    @register(f"autofix_changes_{short}", rs.changes_sql())
    def _changes(spark, sf_dir):
        return _autofix(spark, sf_dir, view).changes()

    @register(f"autofix_clean_{short}", rs.clean_sql())
    def _clean(spark, sf_dir):
        return _autofix(spark, sf_dir, view).clean()

    @register(f"autofix_quarantine_{short}", rs.quarantine_sql())
    def _quar(spark, sf_dir):
        return _autofix(spark, sf_dir, view).quarantine()

    @register(f"autofix_counts_{short}", rs.counts_sql())
    def _counts(spark, sf_dir):
        return _autofix(spark, sf_dir, view).counts_frame()


for _v in REPAIR_VIEWS:
    _register_repair(_v)


# ---------------------------------------------------------------------------
# Review operations (V1-V9) on the repaired customer table
# ---------------------------------------------------------------------------

def _review_sql():
    from .oracle_inspect import ident
    from .oracle_repair import RepairSQL
    rs = RepairSQL("dirty_customer")
    rs.build()
    base = rs._with()
    names = rs.names
    cols = ", ".join(ident(c) for c in names)

    def apply(cells_cte: str) -> str:
        piv = ", ".join(f"max(CASE WHEN \"column\" = '{c}' THEN value END) AS \"v_{c}\", "
                        f"bool_or(\"column\" = '{c}') AS \"w_{c}\"" for c in names)
        out = ", ".join(f"CASE WHEN coalesce(p.\"w_{c}\", FALSE) THEN p.\"v_{c}\" ELSE t.{ident(c)} END AS {ident(c)}"
                        for c in names)
        return (f", cells AS ({cells_cte}), piv AS (SELECT _row_id, {piv} FROM cells GROUP BY _row_id)\n"
                f"SELECT t._row_id, {out} FROM clean t LEFT JOIN piv p USING (_row_id)")

    ch = "SELECT chall.* FROM chall JOIN clean USING (_row_id)"
    sql = {}
    sql["deny"] = base.rstrip() + apply(
        f"SELECT _row_id, \"column\", arg_max(old_value, rule * 100000 + col) AS value FROM ({ch}) GROUP BY ALL")
    sql["accept"] = base.rstrip() + apply(
        f"SELECT _row_id, \"column\", l.new_value AS value FROM (SELECT _row_id, \"column\", "
        f"arg_max({{'new_value': new_value, 'kind': kind}}, rule * 100000 + col) AS l FROM ({ch}) GROUP BY ALL) "
        f"WHERE l.kind <> 'critical' AND l.new_value <> ''")
    sql["accept_ui"] = base.rstrip() + apply(
        f"SELECT _row_id, \"column\", arg_max(new_value, rule * 100000 + col) AS value FROM ({ch}) "
        f"WHERE kind <> 'critical' AND new_value <> '' GROUP BY ALL")
    cond = " OR ".join(f"coalesce(contains(lower(CAST({ident(c)} AS VARCHAR)), 'machinery'), FALSE)" for c in names)
    sql["search"] = base + f"SELECT _row_id, {cols} FROM clean WHERE {cond}"
    sql["last_change"] = base + (
        "SELECT _row_id, \"column\", l.rule AS rule, l.col AS col, l.old_value AS old_value, "
        "l.new_value AS new_value, l.kind AS kind, l.reason AS reason FROM (SELECT _row_id, \"column\", "
        "arg_max({'rule': CAST(rule AS INTEGER), 'col': CAST(col AS INTEGER), 'old_value': old_value, "
        "'new_value': new_value, 'kind': kind, 'reason': reason}, rule * 100000 + col) AS l FROM chall GROUP BY ALL)")
    sql["row_kind"] = base + (
        "SELECT _row_id, arg_max(kind, CASE kind WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS kind "
        "FROM chall GROUP BY _row_id")
    sql["stats"] = base + (
        "SELECT CAST(count_if(NOT (kind = 'critical' OR new_value = '')) AS BIGINT) AS acceptable, "
        "CAST(count_if(kind = 'critical' OR new_value = '') AS BIGINT) AS needs_review FROM chall")
    sql["export"] = base + (
        f"SELECT {cols} FROM clean UNION ALL SELECT "
        + ", ".join(f"coalesce({ident(c)}, 'TO_BE_DETERMINED') AS {ident(c)}" for c in names)
        + " FROM fin WHERE _row_id IN (SELECT _row_id FROM qids)")
    sql["merge"] = base + (
        f"SELECT _row_id, {cols} FROM clean UNION ALL SELECT _row_id, "
        + ", ".join(f"coalesce({ident(c)}, 'TO_BE_DETERMINED') AS {ident(c)}" for c in names)
        + " FROM fin WHERE _row_id IN (SELECT _row_id FROM qids)")
    return sql


_RSQL = _review_sql()


def _customer_fix(spark, sf_dir):
    return _autofix(spark, sf_dir, "dirty_customer")


@register("review_deny_all_customer", _RSQL["deny"])
def _review_deny(spark, sf_dir):
    from ..operators.review import deny_changes
    r = _customer_fix(spark, sf_dir)
    return deny_changes(r.clean(), r.changes())


@register("review_accept_all_customer", _RSQL["accept"])
def _review_accept(spark, sf_dir):
    from ..operators.review import accept_changes
    r = _customer_fix(spark, sf_dir)
    return accept_changes(r.clean(), r.changes())


@register("review_accept_all_ui_customer", _RSQL["accept_ui"])
def _review_accept_ui(spark, sf_dir):
    from ..operators.review import accept_changes
    r = _customer_fix(spark, sf_dir)
    return accept_changes(r.clean(), r.changes(), mode="ui")


@register("review_search_customer", _RSQL["search"])
def _review_search(spark, sf_dir):
    from ..operators.review import search_rows
    return search_rows(_customer_fix(spark, sf_dir).clean(), "MachiNery")


@register("review_last_change_customer", _RSQL["last_change"])
def _review_last(spark, sf_dir):
    from ..operators.review import last_change_per_cell
    return last_change_per_cell(_customer_fix(spark, sf_dir).all_changes())


@register("review_row_kind_customer", _RSQL["row_kind"])
def _review_row_kind(spark, sf_dir):
    from ..operators.review import row_change_kind
    return row_change_kind(_customer_fix(spark, sf_dir).all_changes())


@register("review_change_stats_customer", _RSQL["stats"])
def _review_stats(spark, sf_dir):
    from ..operators.review import change_stats
    return change_stats(_customer_fix(spark, sf_dir).all_changes())


@register("review_merge_quarantine_customer", _RSQL["merge"])
def _review_merge(spark, sf_dir):
    from ..operators.review import merge_quarantine
    r = _customer_fix(spark, sf_dir)
    merged, _rest = merge_quarantine(r.clean(), r.quarantine())
    return merged


def _cell_severity_sql(view: str) -> str:
    isql = InspectSQL(view)
    return (f"WITH {isql.ctes()},\ncells AS ({isql.cells_sql(True)})\n"
            "SELECT CAST(cells.row AS BIGINT) AS row, cells.\"column\", arg_max(iss.severity, CASE iss.severity "
            "WHEN 'critical' THEN 4 WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS severity "
            "FROM cells JOIN iss USING (k1, k2, k3) GROUP BY ALL")


@register("review_cell_severity_customer", _cell_severity_sql("dirty_customer"))
def _review_cell_sev(spark, sf_dir):
    from ..operators.review import cell_severity
    ins = _inspection(spark, sf_dir, "dirty_customer")
    return cell_severity(ins.cells(), ins.issues())


# ---------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------

def _scratch(spark, name):
    from ..session import scratch_path
    return scratch_path(spark, name)


def _all_text(df):
    from pyspark.sql import functions as F
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def _varchar_sql(view, cols, src=None):
    from .oracle_inspect import ident
    return "SELECT " + ", ".join(f"CAST({ident(c)} AS VARCHAR) AS {ident(c)}" for c in cols) + \
        f" FROM {src or view}"


_CUST_COLS = ["_row_id"] + [c for c, _ in __import__("verity.plans.oracle_inspect",
                                                      fromlist=["VIEW_COLUMNS"]).VIEW_COLUMNS["dirty_customer"]]
_ORD_COLS = ["_row_id"] + [c for c, _ in __import__("verity.plans.oracle_inspect",
                                                     fromlist=["VIEW_COLUMNS"]).VIEW_COLUMNS["dirty_orders"]]


@register("source_csv_roundtrip_customer",
          f"WITH dirty_customer AS ({__import__('verity.plans.views_sql', fromlist=['VIEW_SQL']).VIEW_SQL['dirty_customer']})\n"
          + _varchar_sql("dirty_customer", _CUST_COLS))
def _src_csv(spark, sf_dir):
    from ..sources.readers import read_csv
    from ..sources.writers import write_csv
    path = _scratch(spark, "csv")
    write_csv(fixtures.view(spark, sf_dir, "dirty_customer"), path)
    return _all_text(read_csv(spark, path))


@register("source_tsv_roundtrip_orders",
          f"WITH dirty_orders AS ({__import__('verity.plans.views_sql', fromlist=['VIEW_SQL']).VIEW_SQL['dirty_orders']})\n"
          + _varchar_sql("dirty_orders", _ORD_COLS))
def _src_tsv(spark, sf_dir):
    from ..sources.readers import read_tsv
    from ..sources.writers import write_tsv
    path = _scratch(spark, "tsv")
    write_tsv(fixtures.view(spark, sf_dir, "dirty_orders"), path)
    return _all_text(read_tsv(spark, path))


@register("source_json_roundtrip_events",
          "SELECT CAST(CAST(event_id AS DOUBLE) AS VARCHAR) AS event_id, event_type, props, "
          "CAST(CAST(user_id AS DOUBLE) AS VARCHAR) AS user_id, CAST(value AS VARCHAR) AS value FROM events")
def _src_json(spark, sf_dir):
    from ..sources.readers import read_json_records
    from ..sources.writers import write_json
    path = _scratch(spark, "json")
    ev = fixtures.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    write_json(ev, path)
    return read_json_records(spark, path, multiline=False)


@register("source_drop_junk_columns_orders", "SELECT * FROM orders")
def _src_junk(spark, sf_dir):
    from pyspark.sql import functions as F
    from ..sources.readers import drop_junk_columns
    o = fixtures.table(spark, sf_dir, "orders")
    with_junk = o.select(F.col("o_orderkey").alias("Unnamed: 0"), "*",
                         F.col("o_orderkey").alias("__index_level_0__"))
    return drop_junk_columns(with_junk)


@register("source_drop_all_null_columns_events",
          f"WITH dirty_events AS ({__import__('verity.plans.views_sql', fromlist=['VIEW_SQL']).VIEW_SQL['dirty_events']})\n"
          "SELECT _row_id, record_no, user_id, kind, amount FROM dirty_events")
def _src_nullcols(spark, sf_dir):
    from ..sources.readers import drop_all_null_columns
    return drop_all_null_columns(fixtures.view(spark, sf_dir, "dirty_events"))


@register("source_try_cast_numeric_orders",
          f"WITH dirty_orders AS ({__import__('verity.plans.views_sql', fromlist=['VIEW_SQL']).VIEW_SQL['dirty_orders']})\n"
          "SELECT CAST(_row_id AS DOUBLE) AS _row_id, CAST(record_no AS DOUBLE) AS record_no, "
          "CAST(user_id AS DOUBLE) AS user_id, status, amount, order_date_mixed, ship_date FROM dirty_orders")
def _src_trycast(spark, sf_dir):
    from ..sources.readers import try_cast_numeric
    return try_cast_numeric(fixtures.view(spark, sf_dir, "dirty_orders"))


@register("source_to_records_events",
          f"WITH dirty_events AS ({__import__('verity.plans.views_sql', fromlist=['VIEW_SQL']).VIEW_SQL['dirty_events']})\n"
          "SELECT CAST(_row_id AS VARCHAR) AS _row_id, CAST(record_no AS VARCHAR) AS record_no, "
          "CAST(user_id AS VARCHAR) AS user_id, coalesce(kind, '') AS kind, "
          "CASE WHEN amount IS NULL OR isnan(amount) OR isinf(amount) THEN '' ELSE CAST(amount AS VARCHAR) END AS amount, "
          "coalesce(note, '') AS note FROM dirty_events")
def _src_records(spark, sf_dir):
    from ..sources.writers import to_records
    return to_records(fixtures.view(spark, sf_dir, "dirty_events"))


@register("source_export_full_customer", _RSQL["export"])
def _src_export(spark, sf_dir):
    from ..sources.writers import export_variant
    r = _customer_fix(spark, sf_dir)
    return export_variant(r.clean(), r.quarantine(), "full")


# ---------------------------------------------------------------------------
# Run history (H1-H4), exercised with entries derived from the events table
# ---------------------------------------------------------------------------

_HIST_CTE = ("WITH entries AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, "
             "event_type || '.csv' AS filename, 'csv' AS original_format, CAST(NULL AS BIGINT) AS row_count, "
             "CAST(NULL AS BIGINT) AS column_count, CAST(floor(value) AS BIGINT) AS quality_score_before, "
             "CAST(NULL AS BIGINT) AS quality_score_after, CAST(NULL AS VARCHAR) AS file_content, "
             "props AS report_json, CAST(ts AS TIMESTAMP) AS created_at FROM events),\n"
             "u AS (SELECT min(user_id) AS uid FROM events)\n")


def _entries(spark, sf_dir):
    from ..operators.history import entries_from_events
    return entries_from_events(fixtures.table(spark, sf_dir, "events"))


def _first_user(spark, sf_dir):
    from pyspark.sql import functions as F
    return str(fixtures.table(spark, sf_dir, "events").agg(F.min("user_id")).first()[0])


@register("history_retain_events", _HIST_CTE +
          "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, "
          "id DESC) AS rn FROM entries) WHERE rn <= 50")
def _hist_retain(spark, sf_dir):
    from ..operators.history import retain
    return retain(_entries(spark, sf_dir))


@register("history_recent_events", _HIST_CTE +
          "SELECT id, filename, original_format, row_count, column_count, quality_score_before, "
          "quality_score_after, created_at FROM entries WHERE user_id = (SELECT CAST(uid AS VARCHAR) FROM u) "
          "ORDER BY created_at DESC, id DESC LIMIT 10")
def _hist_recent(spark, sf_dir):
    from ..operators.history import history_recent
    return history_recent(_entries(spark, sf_dir), _first_user(spark, sf_dir), 10)


@register("history_clear_events", _HIST_CTE +
          "SELECT * FROM entries WHERE user_id <> (SELECT CAST(uid AS VARCHAR) FROM u)")
def _hist_clear(spark, sf_dir):
    from ..operators.history import history_clear
    return history_clear(_entries(spark, sf_dir), _first_user(spark, sf_dir))


@register("history_delete_events", _HIST_CTE +
          "SELECT * FROM entries WHERE id <> (SELECT CAST(min(event_id) AS VARCHAR) FROM events)")
def _hist_delete(spark, sf_dir):
    from pyspark.sql import functions as F
    from ..operators.history import history_delete
    ev = fixtures.table(spark, sf_dir, "events")
    first = ev.agg(F.min("event_id")).first()[0]
    uid = ev.where(F.col("event_id") == first).first()["user_id"]
    return history_delete(_entries(spark, sf_dir), str(first), str(uid))


# ---------------------------------------------------------------------------
# Column statistics operators (R2, R3, R7) and scalar functions
# ---------------------------------------------------------------------------

def _vsql(view):
    from .views_sql import VIEW_SQL
    return f"WITH {view} AS ({VIEW_SQL[view]})\n"


@register("fn_dominant_date_format_orders", _vsql("dirty_orders") + """
, shapes AS (
  SELECT c, fmt, count(*) AS n, min(_row_id) AS fr FROM (
    SELECT _row_id, 'order_date_mixed' AS c, order_date_mixed AS v FROM dirty_orders
    UNION ALL SELECT _row_id, 'ship_date', ship_date FROM dirty_orders)
  CROSS JOIN LATERAL (SELECT CASE
      WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}$') THEN '%Y-%m-%d'
      WHEN regexp_matches(v, '^\\d{2}/\\d{2}/\\d{4}$') THEN '%m/%d/%Y'
      WHEN regexp_matches(v, '^\\d{2}-\\d{2}-\\d{4}$') THEN '%m-%d-%Y'
      WHEN regexp_matches(v, '^\\d{2}\\.\\d{2}\\.\\d{4}$') THEN '%d.%m.%Y'
      WHEN regexp_matches(v, '^\\d{4}/\\d{2}/\\d{2}$') THEN '%Y/%m/%d' END AS fmt)
  WHERE fmt IS NOT NULL GROUP BY c, fmt)
SELECT c AS "column", first(fmt ORDER BY n DESC, fr ASC) AS format FROM shapes GROUP BY c""")
def _fn_dates(spark, sf_dir):
    from ..operators.repair import dominant_date_formats
    return dominant_date_formats(fixtures.view(spark, sf_dir, "dirty_orders"))


@register("fn_numeric_columns_orders", _vsql("dirty_orders") + """
SELECT * FROM (VALUES ('record_no', TRUE), ('user_id', TRUE)) t("column", is_numeric)
UNION ALL
SELECT c, count(x) > 0 AND count(d) / count(x) > 0.6 FROM (
  SELECT 'status' AS c, status AS x FROM dirty_orders UNION ALL SELECT 'amount', amount FROM dirty_orders
  UNION ALL SELECT 'order_date_mixed', order_date_mixed FROM dirty_orders
  UNION ALL SELECT 'ship_date', ship_date FROM dirty_orders)
CROSS JOIN LATERAL (SELECT CASE WHEN regexp_matches(x, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')
                                THEN CAST(x AS DOUBLE) END AS d)
GROUP BY c""")
def _fn_numeric(spark, sf_dir):
    from ..operators.repair import numeric_columns
    return numeric_columns(fixtures.view(spark, sf_dir, "dirty_orders"))


def _pattern_sql(view, ecol, ncol):
    from .oracle_repair import RepairSQL
    rs = RepairSQL(view)
    rs.ctes.append(f"{view} AS ({__import__('verity.plans.views_sql', fromlist=['VIEW_SQL']).VIEW_SQL[view]}\n)")
    cast = ", ".join(f"CAST(\"{c}\" AS VARCHAR) AS \"{c}\"" for c in rs.names)
    rs.add("s0", f"SELECT CAST(_row_id AS BIGINT) AS _row_id, {cast} FROM {view}")
    from .oracle_repair import strip
    rs.step(1, {c: [(f"\"{c}\" IS NOT NULL AND \"{c}\" <> {strip(chr(34) + c + chr(34))}",
                     strip(chr(34) + c + chr(34)), "'fixed'", "''", True, False)] for c in rs.names})
    rs.cross(0, ecol, ncol)
    body = "WITH " + ",\n".join(rs.ctes)
    pats = "CASE p " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(
        ("first.last", "first.linit", "finit.last", "last.first", "last.finit", "first"))) + " END"
    return (body + f"\nSELECT max({pats}) AS pattern, max(CASE o WHEN 0 THEN 'first_last' ELSE 'last_first' END) "
            f"AS name_order, max(dom) AS domain, max(conf) AS confidence FROM (SELECT 1) d LEFT JOIN x0_ok ON TRUE")


@register("fn_naming_pattern_staff", _pattern_sql("dirty_staff", "email", "full_name"))
def _fn_pattern_staff(spark, sf_dir):
    from ..operators.repair import naming_pattern
    return naming_pattern(fixtures.view(spark, sf_dir, "dirty_staff"), "email", "full_name")


@register("fn_naming_pattern_people", _pattern_sql("dirty_people", "work_email", "employee_name"))
def _fn_pattern_people(spark, sf_dir):
    from ..operators.repair import naming_pattern
    return naming_pattern(fixtures.view(spark, sf_dir, "dirty_people"), "work_email", "employee_name")


def _scalar_sql():
    from . import oracle_repair as O
    return ("SELECT p_partkey, " + O.smart_title("p_name") + " AS title, "
            + O.rating_number("lower(p_type)") + " AS rating, "
            + O.rating_label("(p_size / 10.0)") + " AS label, "
            + O.castable_float("p_brand") + " AS castable, "
            + O.castable_float("CAST(p_retailprice AS VARCHAR)") + " AS castable_price, "
            + O.title_style("p_name") + " AS is_title FROM part")


@register("fn_scalars_part", _scalar_sql())
def _fn_scalars(spark, sf_dir):
    from pyspark.sql import functions as F
    from ..functions import (castable_float, closest_rating_label, is_title_style, rating_word_number,
                             smart_title)
    p = fixtures.table(spark, sf_dir, "part")
    return p.select("p_partkey", smart_title("p_name").alias("title"),
                    rating_word_number(F.lower("p_type")).alias("rating"),
                    closest_rating_label(F.col("p_size") / 10.0).alias("label"),
                    castable_float("p_brand").alias("castable"),
                    castable_float(F.col("p_retailprice").cast("string")).alias("castable_price"),
                    is_title_style("p_name").alias("is_title"))


@register("fn_email_phone_customer", _vsql("dirty_customer") +
          "SELECT _row_id, " + __import__("verity.plans.oracle_repair", fromlist=["x"]).email_norm("email")
          + " AS email_norm, " + __import__("verity.plans.oracle_repair", fromlist=["x"]).valid_email(
              __import__("verity.plans.oracle_repair", fromlist=["x"]).email_norm("email"))
          + " AS email_ok, " + __import__("verity.plans.oracle_repair", fromlist=["x"]).phone("phone")
          + " AS phone_fmt FROM dirty_customer")
def _fn_email_phone(spark, sf_dir):
    from ..functions import is_valid_email, normalise_email
    from ..operators.repair import phone_format
    d = fixtures.view(spark, sf_dir, "dirty_customer")
    e = normalise_email("email")
    return d.select("_row_id", e.alias("email_norm"), is_valid_email(e).alias("email_ok"),
                    phone_format(d.phone).alias("phone_fmt"))


# ---------------------------------------------------------------------------
# Q7 quality report (flattened for the SQL check) and Q10 before / after repair
# ---------------------------------------------------------------------------

def _report_sql(view: str) -> str:
    isql = InspectSQL(view)
    k = len(isql.cols)
    return (f"WITH {isql.ctes()},\n{isql.score_ctes()}\n"
            f"SELECT '{view}' AS filename, CAST(n AS BIGINT) AS total_rows, CAST({k} AS BIGINT) AS total_columns, "
            f"0.0 AS file_size_mb, overall AS overall_quality_score, 'Summary pending…' AS executive_summary, "
            f"CAST(round_even(completeness, 0) AS BIGINT) AS completeness, "
            f"CAST(round_even(uniqueness, 0) AS BIGINT) AS uniqueness, "
            f"CAST(round_even(consistency, 0) AS BIGINT) AS consistency, "
            f"CAST(round_even(accuracy, 0) AS BIGINT) AS accuracy, CAST(round_even(fmt, 0) AS BIGINT) AS format, "
            f"CASE WHEN overall >= 80 THEN 'GREEN' WHEN overall >= 50 THEN 'YELLOW' ELSE 'RED' END AS traffic_light, "
            f"CAST((SELECT count(*) FROM iss) AS INTEGER) AS n_issues FROM sc")


def _flat_report(spark, sf_dir, view):
    from pyspark.sql import functions as F
    from ..operators.score import quality_report
    rep = quality_report(_inspection(spark, sf_dir, view), filename=view)
    return rep.select("dataset_meta.*", "overall_quality_score", "executive_summary", "category_breakdown.*",
                      "traffic_light", F.size("issues").alias("n_issues"))


for _v in ("dirty_orders", "dirty_customer"):
    register(f"quality_report_{_v.replace('dirty_', '')}", _report_sql(_v))(
        lambda spark, sf_dir, _v=_v: _flat_report(spark, sf_dir, _v))


def _before_after_sql(view: str) -> str:
    from .oracle_repair import RepairSQL
    rs = RepairSQL(view)
    rs.build()
    repair_ctes = rs._with()[len("WITH "):].rstrip()
    cols = ", ".join(f"\"{c}\"" for c in rs.names)
    src = repair_ctes + f",\ncleanv AS (SELECT _row_id, {cols} FROM clean)"
    before = InspectSQL(view).score_sql()
    after = InspectSQL("cleanv", cols=[(c, "s") for c in rs.names], source_ctes=src).score_sql()
    return (f"SELECT *, 'before' AS phase FROM ({before})\nUNION ALL\n"
            f"SELECT *, 'after' AS phase FROM ({after})")


@register("score_before_after_customer", _before_after_sql("dirty_customer"))
def _before_after(spark, sf_dir):
    from ..operators.inspect import inspect
    from ..operators.score import score_before_after
    before = _inspection(spark, sf_dir, "dirty_customer")
    after = inspect(_customer_fix(spark, sf_dir).clean())
    return score_before_after(before, after)


@register("score_before_after_orders", _before_after_sql("dirty_orders"))
def _before_after_orders(spark, sf_dir):
    from ..operators.inspect import inspect
    from ..operators.score import score_before_after
    before = _inspection(spark, sf_dir, "dirty_orders")
    after = inspect(_autofix(spark, sf_dir, "dirty_orders").clean())
    return score_before_after(before, after)


# ---------------------------------------------------------------------------
# Streaming: the events table streamed as micro-batches, each scored into history
# ---------------------------------------------------------------------------

def _stream_report_sql() -> str:
    isql = InspectSQL("events", source_ctes="ev AS (SELECT 1)")
    body = isql.ctes().replace("ev AS (SELECT 1),\n", "", 1)
    body = body.replace("FROM events", "FROM ev_src").replace("FROM events,", "FROM ev_src,")
    k = len(isql.cols)
    return (f"WITH ev_src AS (SELECT * FROM events),\n{body},\n{isql.score_ctes()}\n"
            f"SELECT CAST(n AS BIGINT) AS total_rows, CAST({k} AS BIGINT) AS total_columns, "
            f"overall AS overall_quality_score, CAST(round_even(completeness, 0) AS BIGINT) AS completeness, "
            f"CAST(round_even(uniqueness, 0) AS BIGINT) AS uniqueness, "
            f"CAST(round_even(consistency, 0) AS BIGINT) AS consistency, "
            f"CAST(round_even(accuracy, 0) AS BIGINT) AS accuracy, CAST(round_even(fmt, 0) AS BIGINT) AS format, "
            f"CASE WHEN overall >= 80 THEN 'GREEN' WHEN overall >= 50 THEN 'YELLOW' ELSE 'RED' END AS traffic_light, "
            f"CAST((SELECT count(*) FROM iss) AS BIGINT) AS n_issues FROM sc")


@register("stream_quality_events", _stream_report_sql())
def _stream_quality(spark, sf_dir):
    from ..streaming.monitor import quality_monitor
    base = fixtures.table(spark, sf_dir, "events")
    stream = (spark.readStream.schema(base.schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    out, ck = _scratch(spark, "stream-history"), _scratch(spark, "stream-ckpt")
    q = quality_monitor(stream, out, ck, source="events", key="event_id")
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch_id", "source", "created_at")


from . import catalog_edges  # noqa: E402, F401  registers more queries
from . import catalog_stores  # noqa: E402, F401  registers more queries
