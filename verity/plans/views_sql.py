"""The dirty views of :mod:`verity.plans.fixtures`, written as DuckDB SQL."""

from __future__ import annotations

VIEW_SQL = {
    "dirty_customer": """
SELECT c_custkey AS _row_id, c_custkey AS customer_id,
  CASE WHEN c_custkey % 11 = 0 THEN '  ' || c_name || ' '
       WHEN c_custkey % 13 = 0 THEN 'N/A' ELSE c_name END AS full_name,
  CASE c_custkey % 10 WHEN 0 THEN lower(c_mktsegment)
       WHEN 1 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2, 1000))
       ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 17 = 0 THEN 'not-an-email'
       WHEN c_custkey % 5 = 0 THEN 'User' || CAST(c_custkey AS VARCHAR) || '@gmial.com'
       ELSE 'user' || CAST(c_custkey AS VARCHAR) || '@gmail.com' END AS email,
  CASE c_custkey % 3 WHEN 0 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '5')
       WHEN 1 THEN '1-' || lpad(CAST(c_custkey AS VARCHAR), 10, '5')
       ELSE lpad(CAST(c_custkey AS VARCHAR), 7, '5') END AS phone,
  CASE c_custkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'NO' WHEN 2 THEN 'Y' ELSE 'f' END AS opted_in,
  CASE c_custkey % 9 WHEN 0 THEN 'unsatisfactory' WHEN 1 THEN 'Excellent'
       WHEN 2 THEN 'below average' WHEN 3 THEN '7' WHEN 4 THEN '-2' ELSE '4' END AS performance_rating
FROM customer""",
    "dirty_orders": """
SELECT o_orderkey * 2 + cp AS _row_id, o_orderkey AS record_no, o_custkey AS user_id,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'abc'
       ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS amount,
  CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date_mixed,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y/%m/%d')
       ELSE strftime(o_orderdate, '%m/%d/%Y') END AS ship_date
FROM orders, (SELECT unnest([0, 1]) AS cp) copies
WHERE cp = 0 OR o_orderkey % 50 = 0""",
    "dirty_price": """
SELECT o_orderkey AS _row_id, o_orderkey AS record_no,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL
       WHEN o_orderkey % 5 = 0 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
       WHEN o_orderkey % 5 = 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ',000'
       ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS fee
FROM orders""",
    "dirty_events": """
SELECT event_id AS _row_id, event_id AS record_no, user_id,
  CASE WHEN event_id % 12 = 0 THEN 'unknown' WHEN event_id % 12 = 1 THEN upper(event_type)
       ELSE event_type END AS kind,
  CASE WHEN event_id % 500 = 0 THEN value + 100000.0 WHEN event_id % 8 = 0 THEN NULL
       ELSE value END AS amount,
  CAST(NULL AS VARCHAR) AS note
FROM events""",
    "dirty_people": """
SELECT c_custkey AS _row_id, c_custkey AS emp_id,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE given || ' Cust' || CAST(c_custkey AS VARCHAR) END
    AS employee_name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL
       ELSE lower(given) || '.cust' || CAST(c_custkey AS VARCHAR) || '@corp.example.com' END AS work_email,
  'team ' || CAST(c_custkey % 5 AS VARCHAR) AS team,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END
    AS salary_band
FROM customer c LEFT JOIN
     (SELECT n_nationkey, upper(substr(w, 1, 1)) || lower(substr(w, 2, 1000)) AS given
      FROM (SELECT n_nationkey, string_split(n_name, ' ')[-1] AS w FROM nation)) n
     ON c.c_nationkey = n.n_nationkey""",
    "dirty_staff": """
SELECT c_custkey AS _row_id, c_custkey AS staff_id,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE given || ' Cust' || CAST(sk AS VARCHAR) END AS full_name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL
       WHEN c_custkey % 29 = 0 THEN lower(given) || '.cust' || CAST(sk AS VARCHAR) || '@staff.example.org'
       ELSE substr(lower(given), 1, 1) || '.cust' || CAST(sk AS VARCHAR) || '@staff.example.org' END AS email,
  c_mktsegment AS department
FROM (SELECT *, CASE WHEN c_custkey % 14 = 7 THEN c_custkey - 7 WHEN c_custkey % 10 = 0 THEN c_custkey + 1
                     ELSE c_custkey END AS sk FROM customer) c LEFT JOIN
     (SELECT n_nationkey, upper(substr(w, 1, 1)) || lower(substr(w, 2, 1000)) AS given
      FROM (SELECT n_nationkey, string_split(n_name, ' ')[-1] AS w FROM nation)) n
     ON c.c_nationkey = n.n_nationkey""",
    "dirty_ratings": """
SELECT p_partkey AS _row_id, p_partkey AS part_no,
  CASE p_partkey % 5 WHEN 0 THEN 'excellent' WHEN 1 THEN 'good' WHEN 2 THEN 'poor' WHEN 3 THEN '4.2' ELSE 'average' END AS feedback,
  CASE WHEN p_partkey % 4 = 0 THEN 'good' ELSE CAST(p_partkey % 5 AS VARCHAR) END AS points,
  CASE WHEN p_partkey % 10 < 6 THEN 'matte' WHEN p_partkey % 10 = 6 THEN NULL ELSE 'f' || CAST(p_partkey AS VARCHAR) END AS finish,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) END AS "unit.price"
FROM part""",
    "dirty_contacts": """
SELECT c_custkey AS _row_id,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE given || ' Cust' || CAST(c_custkey AS VARCHAR) END AS employee_name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE lower(given) || '.cust' || CAST(c_custkey AS VARCHAR) || '@corp.example.com' END
    AS work_email,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE given || ' Boss' || CAST(c_custkey AS VARCHAR) END AS manager_name,
  CASE WHEN c_custkey % 5 = 0 THEN NULL
       ELSE substr(lower(given), 1, 1) || '.boss' || CAST(c_custkey AS VARCHAR) || '@head.example.com' END AS manager_email
FROM customer c LEFT JOIN
     (SELECT n_nationkey, upper(substr(w, 1, 1)) || lower(substr(w, 2, 1000)) AS given
      FROM (SELECT n_nationkey, string_split(n_name, ' ')[-1] AS w FROM nation)) n
     ON c.c_nationkey = n.n_nationkey""",
    "dirty_lineitem": """
SELECT k AS _row_id, l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN k % 97 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN k % 1009 = 0 THEN l_extendedprice * 1000.0 ELSE l_extendedprice END AS l_extendedprice,
  l_discount, l_tax,
  CASE WHEN k % 17 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS l_returnflag,
  CASE WHEN k % 19 = 0 THEN l_linestatus || ' ' ELSE l_linestatus END AS l_linestatus,
  CASE WHEN k % 31 = 0 THEN 'n/a' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS l_shipdate
FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS k FROM lineitem) li""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the named views as CTEs."""
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]}\n)" for n in names)
    return f"WITH {ctes}\n{body}"
