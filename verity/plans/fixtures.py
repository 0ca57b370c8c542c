"""Dirty views: the driver tables made dirty by pure functions of their keys.

Spark and DuckDB (see :mod:`verity.plans.views_sql`) build identical rows from
the same parquet files, so every operator can be checked against SQL.  Each
view keeps every row of its source table (rows are only ever added, never
filtered) and carries ``_row_id``: a unique, order-giving id derived from the
key so that "first row" semantics are the same on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(k: Column, m: int, cases: list) -> Column:
    """CASE k % m WHEN i THEN v ... (last entry is ELSE)."""
    out = None
    for i, v in enumerate(cases[:-1]):
        out = F.when(k % m == i, v) if out is None else out.when(k % m == i, v)
    return out.otherwise(cases[-1])


def _lpad_key(k: Column, n: int) -> Column:
    return F.lpad(k.cast("string"), n, "5")


def dirty_customer(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    return c.select(
        k.alias("_row_id"),
        k.alias("customer_id"),
        F.when(k % 11 == 0, F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")))
        .when(k % 13 == 0, F.lit("N/A")).otherwise(F.col("c_name")).alias("full_name"),
        _pick(k, 10, [F.lower(seg),
                      F.concat(F.upper(F.substring(seg, 1, 1)), F.lower(F.substring(seg, 2, 1000))),
                      seg]).alias("segment"),
        F.when(k % 17 == 0, F.lit("not-an-email"))
        .when(k % 5 == 0, F.concat(F.lit("User"), k.cast("string"), F.lit("@gmial.com")))
        .otherwise(F.concat(F.lit("user"), k.cast("string"), F.lit("@gmail.com"))).alias("email"),
        _pick(k, 3, [_lpad_key(k, 10), F.concat(F.lit("1-"), _lpad_key(k, 10)),
                     _lpad_key(k, 7)]).alias("phone"),
        _pick(k, 4, [F.lit("yes"), F.lit("NO"), F.lit("Y"), F.lit("f")]).alias("opted_in"),
        _pick(k, 9, [F.lit("unsatisfactory"), F.lit("Excellent"), F.lit("below average"),
                     F.lit("7"), F.lit("-2"), F.lit("4")]).alias("performance_rating"),
    )


def dirty_orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    copies = F.when(F.col("o_orderkey") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    o = o.select("*", F.explode(copies).alias("_copy"))
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    return o.select(
        (k * 2 + F.col("_copy")).alias("_row_id"),
        k.alias("record_no"),
        F.col("o_custkey").alias("user_id"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 19 == 0, F.lit("abc"))
        .otherwise(F.floor(F.col("o_totalprice")).cast("bigint").cast("string")).alias("amount"),
        F.when(k % 4 == 0, F.date_format(d, "MM/dd/yyyy"))
        .otherwise(F.date_format(d, "yyyy-MM-dd")).alias("order_date_mixed"),
        F.when(k % 3 == 0, F.date_format(d, "yyyy/MM/dd"))
        .otherwise(F.date_format(d, "MM/dd/yyyy")).alias("ship_date"),
    )


def dirty_price(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    n = F.floor(F.col("o_totalprice")).cast("bigint").cast("string")
    return o.select(
        k.alias("_row_id"),
        k.alias("record_no"),
        F.when(k % 6 == 0, F.lit(None).cast("string"))
        .when(k % 5 == 0, F.concat(F.lit("$"), n))
        .when(k % 5 == 1, F.concat(n, F.lit(",000")))
        .otherwise(n).alias("fee"),
    )


def dirty_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("_row_id"),
        k.alias("record_no"),
        F.col("user_id"),
        F.when(k % 12 == 0, F.lit("unknown")).when(k % 12 == 1, F.upper("event_type"))
        .otherwise(F.col("event_type")).alias("kind"),
        F.when(k % 500 == 0, F.col("value") + 100000.0)
        .when(k % 8 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("amount"),
        F.lit(None).cast("string").alias("note"),
    )


def _person_parts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    w = F.element_at(F.split(n.n_name, " "), -1)
    n = n.select("n_nationkey", F.concat(F.upper(F.substring(w, 1, 1)),
                                         F.lower(F.substring(w, 2, 1000))).alias("given"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left")


def dirty_people(spark, sf_dir) -> DataFrame:
    """Names and e-mails following first.last, with gaps on either side.

    name = "<nation word> Cust<k>"; e-mail = <nation word>.cust<k>@corp.example.com.
    Each complete pair votes for two patterns, so inference runs at 50% confidence.
    """
    j = _person_parts(spark, sf_dir)
    k = F.col("c_custkey")
    last = F.concat(F.lit("Cust"), k.cast("string"))
    name = F.concat(F.col("given"), F.lit(" "), last)
    mail = F.concat(F.lower(F.col("given")), F.lit("."), F.lower(last), F.lit("@corp.example.com"))
    return j.select(
        k.alias("_row_id"),
        k.alias("emp_id"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(name).alias("employee_name"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(mail).alias("work_email"),
        F.concat(F.lit("team "), (k % 5).cast("string")).alias("team"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.floor(F.col("c_acctbal")).cast("bigint").cast("string")).alias("salary_band"),
    )


def dirty_staff(spark, sf_dir) -> DataFrame:
    """E-mails following finit.last (a few first.last), some surnames shared.

    Keys 7 mod 14 share the surname of the key 7 below (both without e-mail:
    the first row wins); keys 0 mod 10 take the surname of the next key (whose
    address already exists).
    """
    j = _person_parts(spark, sf_dir)
    k = F.col("c_custkey")
    sk = F.when(k % 14 == 7, k - 7).when(k % 10 == 0, k + 1).otherwise(k)
    last = F.concat(F.lit("Cust"), sk.cast("string"))
    name = F.concat(F.col("given"), F.lit(" "), last)
    f, l = F.lower(F.col("given")), F.lower(last)
    local = F.when(k % 29 == 0, F.concat(f, F.lit("."), l)).otherwise(
        F.concat(F.substring(f, 1, 1), F.lit("."), l))
    return j.select(
        k.alias("_row_id"),
        k.alias("staff_id"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(name).alias("full_name"),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(local, F.lit("@staff.example.org"))).alias("email"),
        F.col("c_mktsegment").alias("department"),
    )


def dirty_ratings(spark, sf_dir) -> DataFrame:
    """Mixed rating columns, a dominant text with gaps, and a column name with a dot.

    ``feedback`` is mostly rating words with some numbers, ``points`` mostly numbers with rating words.
    """
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("_row_id"),
        k.alias("part_no"),
        _pick(k, 5, [F.lit("excellent"), F.lit("good"), F.lit("poor"), F.lit("4.2"), F.lit("average")]).alias("feedback"),
        F.when(k % 4 == 0, F.lit("good")).otherwise((k % 5).cast("string")).alias("points"),
        F.when(k % 10 < 6, F.lit("matte")).when(k % 10 == 6, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("f"), k.cast("string"))).alias("finish"),
        F.when(k % 9 == 0, F.lit(None).cast("string"))
        .otherwise(F.floor(F.col("p_retailprice")).cast("bigint").cast("string")).alias("unit.price"),
    )


def dirty_contacts(spark, sf_dir) -> DataFrame:
    """Two e-mail and two name columns, so that four pairs are looked at one after the other."""
    j = _person_parts(spark, sf_dir)
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    given, low = F.col("given"), F.lower(F.col("given"))
    return j.select(
        k.alias("_row_id"),
        F.when(k % 6 == 0, none).otherwise(F.concat(given, F.lit(" Cust"), k.cast("string"))).alias("employee_name"),
        F.when(k % 7 == 0, none).otherwise(F.concat(low, F.lit(".cust"), k.cast("string"), F.lit("@corp.example.com")))
        .alias("work_email"),
        F.when(k % 8 == 0, none).otherwise(F.concat(given, F.lit(" Boss"), k.cast("string"))).alias("manager_name"),
        F.when(k % 5 == 0, none).otherwise(F.concat(F.substring(low, 1, 1), F.lit(".boss"), k.cast("string"),
                                                    F.lit("@head.example.com"))).alias("manager_email"),
    )


LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def dirty_lineitem(spark, sf_dir) -> DataFrame:
    """Lineitem with gaps, stray text, padded flags and a few extreme values.

    Its keys are not unique, so the row id is the position in the order of all
    columns (a range-partitioned dense index, no single-partition window).
    """
    from ..operators.rowid import dense_index
    li = table(spark, sf_dir, "lineitem")
    li = dense_index(li, LINEITEM_ORDER, "_row_id")
    k = F.col("_row_id")
    return li.select(
        k.alias("_row_id"),
        F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"),
        F.when(k % 97 == 0, F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(k % 1009 == 0, F.col("l_extendedprice") * 1000.0)
        .otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        F.col("l_discount"), F.col("l_tax"),
        F.when(k % 17 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        F.when(k % 19 == 0, F.concat(F.col("l_linestatus"), F.lit(" "))).otherwise(F.col("l_linestatus"))
        .alias("l_linestatus"),
        F.when(k % 31 == 0, F.lit("n/a"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("l_shipdate"),
    )


VIEWS = {
    "dirty_customer": dirty_customer,
    "dirty_orders": dirty_orders,
    "dirty_price": dirty_price,
    "dirty_events": dirty_events,
    "dirty_people": dirty_people,
    "dirty_staff": dirty_staff,
    "dirty_lineitem": dirty_lineitem,
    "dirty_ratings": dirty_ratings,
    "dirty_contacts": dirty_contacts,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)
