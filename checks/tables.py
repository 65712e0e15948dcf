"""Column profiles and chart-ready aggregates over orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.operators import profile as P
from inkstone.plans import summaries as S
from inkstone.sources.readers import read_table

from .kit import check, r6

COLS = {
    "order_date": "CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END",
    "status": "o_orderstatus", "priority": "CASE WHEN o_custkey % 13 = 0 THEN ' ' ELSE o_orderpriority END",
    "total": "'$' || CAST(o_totalprice AS STRING)", "customer": "CAST(o_custkey AS STRING)",
    "note": "'order ' || CAST(o_orderkey AS STRING)",
}
TABLE_SQL = "t AS (SELECT o_orderkey AS row_no, " + ", ".join(f"{e} AS {c}" for c, e in COLS.items()) + " FROM orders)"
CELLS_SQL = f"{TABLE_SQL}, cells AS (" + " UNION ALL ".join(
    f"SELECT row_no, {i} AS pos, '{c}' AS col, trim({c}) AS v FROM t" for i, c in enumerate(COLS)
) + ")"
NUM = lambda v: rf"TRY_CAST(CASE WHEN regexp_full_match(regexp_replace({v}, '[,$%]', '', 'g'), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN regexp_replace({v}, '[,$%]', '', 'g') END AS DOUBLE)"
DATE = r"(regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') OR regexp_matches(v, '^\d{1,2}/\d{1,2}/\d{4}$') OR regexp_matches(v, '^[A-Za-z]+ \d{4}$'))"
ROLE_SQL = f"""{CELLS_SQL}, smp AS (SELECT * FROM cells WHERE v <> ''),
sa AS (SELECT col, any_value(pos) AS pos, count(*) FILTER ({DATE}) AS d, count(*) AS n, count({NUM('v')}) AS nn FROM smp GROUP BY 1),
dv AS (SELECT col, count(DISTINCT v) AS k FROM cells WHERE v <> '' GROUP BY 1),
roles AS (SELECT sa.pos, sa.col, CASE WHEN d >= n * 0.7 THEN 'date' WHEN nn >= n * 0.7 THEN 'numeric' WHEN k BETWEEN 2 AND 20 THEN 'categorical' ELSE 'other' END AS role FROM sa JOIN dv ON dv.col = sa.col)"""


def table(spark, sf):
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_no"), *[F.expr(e).alias(c) for c, e in COLS.items()])


@check("column_roles", f'WITH {ROLE_SQL} SELECT CAST(pos AS INT) AS pos, col AS "column", role FROM roles')
def _(spark, sf):
    return P.column_roles(table(spark, sf))


@check("column_roles_sample", f"""WITH {CELLS_SQL}, smp AS (SELECT * FROM cells WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY col ORDER BY row_no) <= 20),
 sa AS (SELECT col, any_value(pos) AS pos, bool_or({DATE}) AS d, count(*) AS n, count({NUM('v')}) AS nn FROM smp GROUP BY 1), dv AS (SELECT col, count(DISTINCT v) AS k FROM cells WHERE v <> '' GROUP BY 1)
 SELECT CAST(pos AS INT) AS pos, sa.col AS "column", CASE WHEN d THEN 'date' WHEN nn >= n * 0.7 THEN 'numeric' WHEN k BETWEEN 2 AND 20 THEN 'categorical' ELSE 'other' END AS role FROM sa JOIN dv ON dv.col = sa.col""")
def _(spark, sf):
    """The same with dates and numbers looked for in the first 20 cells, where one date is enough."""
    return P.column_roles(table(spark, sf), sample=20)


@check("column_profile", f"""WITH {ROLE_SQL}, st AS (SELECT col, count(*) AS n, count(*) FILTER (v = '') AS m, min({NUM('v')}) AS lo, max({NUM('v')}) AS hi, avg({NUM('v')}) AS av FROM cells GROUP BY 1),
 vc AS (SELECT col, v, count(*) AS n, min(row_no) AS f FROM cells WHERE v <> '' GROUP BY 1, 2), tp AS (SELECT col, string_agg(v, ' | ' ORDER BY n DESC, f) AS top FROM (SELECT * FROM vc QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, f) <= 5) GROUP BY 1)
 SELECT st.col AS "column", CASE WHEN nn >= sa.n * 0.7 THEN 'numeric' ELSE 'categorical' END AS dtype, round(100.0 * m / st.n, 1) AS missing_pct,
 CASE WHEN nn >= sa.n * 0.7 THEN round(lo, 2) END AS "min", CASE WHEN nn >= sa.n * 0.7 THEN round(hi, 2) END AS "max", CASE WHEN nn >= sa.n * 0.7 THEN round(av, 2) END AS "avg",
 CASE WHEN nn < sa.n * 0.7 THEN top END AS top_values FROM st JOIN sa ON sa.col = st.col JOIN tp ON tp.col = st.col""")
def _(spark, sf):
    return P.column_profile(table(spark, sf))


@check("numeric_insights", f"""WITH {CELLS_SQL} SELECT col AS "column", round(sum({NUM('v')}), 2) AS total, round(avg({NUM('v')}), 4) AS "avg", min({NUM('v')}) AS "min", max({NUM('v')}) AS "max" FROM cells WHERE col IN ('total', 'customer') GROUP BY 1""")
def _(spark, sf):
    o = P.numeric_insights(table(spark, sf), ["total", "customer"])
    return o.select("column", F.round("total", 2).alias("total"), F.round("avg", 4).alias("avg"), "min", "max")


@check("category_insights", f"""WITH {CELLS_SQL}, vc AS (SELECT col, v, count(*) AS n, min(row_no) AS f FROM cells WHERE v <> '' AND col IN ('status', 'priority') GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, f) AS rn FROM vc)
 SELECT col AS "column", count(*) AS distinct_values, string_agg(v || ': ' || CAST(n AS VARCHAR), ' | ' ORDER BY rn) FILTER (rn <= 3) AS top_counts FROM r GROUP BY 1""")
def _(spark, sf):
    return P.category_insights(table(spark, sf), ["status", "priority"])


@check("date_range", f"WITH {TABLE_SQL} SELECT min(order_date) AS first_date, max(order_date) AS last_date FROM t WHERE order_date <> ''")
def _(spark, sf):
    return P.date_range(table(spark, sf), "order_date")


@check("value_counts", f"WITH {TABLE_SQL} SELECT trim(priority) AS value, count(*) AS n, min(row_no) AS first_row FROM t WHERE trim(priority) <> '' GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 15")
def _(spark, sf):
    return P.value_counts(table(spark, sf), "priority")


@check("sum_by_date", f"WITH {TABLE_SQL} SELECT order_date, round(sum({NUM('total')}), 2) AS total FROM t WHERE order_date <> '' GROUP BY 1")
def _(spark, sf):
    return P.sum_by(table(spark, sf), "order_date", ["total"]).select("order_date", F.round("total", 2).alias("total"))


@check("grouped_metrics", f"WITH {TABLE_SQL} SELECT trim(priority) AS priority, round(sum({NUM('total')}), 2) AS total, round(sum({NUM('customer')}), 2) AS customer, 0.0::DOUBLE AS note FROM t WHERE trim(priority) <> '' GROUP BY 1")
def _(spark, sf):
    o = P.sum_by(table(spark, sf), "priority", ["total", "customer", "note"], 0.0)
    return o.select("priority", *[F.round(c, 2).alias(c) for c in ("total", "customer", "note")])


@check("category_total", f"WITH {TABLE_SQL} SELECT status, round(sum({NUM('total')}), 2) AS total FROM t GROUP BY 1")
def _(spark, sf):
    return P.sum_by(table(spark, sf), "status", ["total"]).select("status", F.round("total", 2).alias("total"))


@check("share_of_total", "WITH s AS (SELECT l_returnflag AS chart, l_linestatus AS name, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2) SELECT chart, name, round(value / sum(value) OVER (PARTITION BY chart), 6) AS share FROM s")
def _(spark, sf):
    from inkstone.operators.charts import share_of_total

    s = read_table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("chart"), F.col("l_linestatus").alias("name")).agg(F.sum("l_quantity").alias("value"))
    return share_of_total(s).select("chart", "name", r6("share").alias("share"))


@check("table_insights", f"""WITH {ROLE_SQL}, st AS (SELECT col, min(v) AS v0, max(v) AS v1, count(DISTINCT v) AS kinds, sum({NUM('v')}) AS total, count({NUM('v')}) AS n, min({NUM('v')}) AS lo, max({NUM('v')}) AS hi FROM cells WHERE v <> '' GROUP BY 1),
 vc AS (SELECT col, v, count(*) AS n, min(row_no) AS f FROM cells WHERE v <> '' GROUP BY 1, 2),
 tp AS (SELECT col, string_agg(v || ': ' || format('{{:,}}', n), ' | ' ORDER BY n DESC, f) AS top FROM (SELECT * FROM vc QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, f) <= 3) GROUP BY 1),
 nm AS (SELECT col, string_agg('"' || v || '"', ', ' ORDER BY v) AS names FROM (SELECT * FROM vc QUALIFY row_number() OVER (PARTITION BY col ORDER BY v) <= 7) GROUP BY 1),
 body AS (SELECT 'The dataset contains ' || format('{{:,}}', (SELECT count(*) FROM t)) || ' records across 6 columns: "order_date", "status", "priority", "total", "customer", "note".' AS insight, 0 AS o
  UNION ALL SELECT 'Date range (' || r.col || '): ' || st.v0 || ' → ' || st.v1 || '.', 100 + r.pos FROM roles r JOIN st ON st.col = r.col WHERE role = 'date'
  UNION ALL SELECT '"' || r.col || '": Total = ' || format('{{:,.2f}}', total) || ' | Avg = ' || format('{{:,.2f}}', total / n) || ' | Min = ' || format('{{:,.2f}}', lo) || ' | Max = ' || format('{{:,.2f}}', hi) || '.', 200 + r.pos FROM roles r JOIN st ON st.col = r.col WHERE role = 'numeric'
  UNION ALL SELECT '"' || r.col || '" — ' || kinds || ' categories: ' || names || CASE WHEN kinds > 7 THEN ' … (' || kinds || ' total)' ELSE '' END || '. Top: ' || top || '.', 300 + r.pos FROM roles r JOIN st ON st.col = r.col JOIN tp ON tp.col = r.col JOIN nm ON nm.col = r.col WHERE role = 'categorical'
  UNION ALL SELECT 'Suitable for trend analysis, performance comparison, and decision-making based on ' || count(*) FILTER (role = 'numeric') || ' numeric and ' || count(*) FILTER (role = 'categorical') || ' categorical columns.', 900 FROM roles)
 SELECT CAST(row_number() OVER (ORDER BY o) AS INT) AS insight_no, insight FROM body""")
def _(spark, sf):
    return S.table_insights(P.unpivot_cells(table(spark, sf)), [], limit=None).select("insight_no", "insight")


@check("profile_table", f"""WITH {ROLE_SQL}, vc AS (SELECT col, v, count(*) AS n, min(row_no) AS f FROM cells WHERE v <> '' AND col IN ('status', 'priority') GROUP BY 1, 2),
 c1 AS (SELECT 'status Distribution' AS title, CASE WHEN count(*) > 8 THEN 'hbar' ELSE 'bar' END AS chart_type, string_agg(v || '=' || CAST(n AS VARCHAR), ';' ORDER BY n DESC, f) AS points FROM vc WHERE col = 'status' HAVING count(*) >= 3),
 c2 AS (SELECT 'total over order_date' AS title, 'line' AS chart_type, string_agg(k || '=' || CAST(CAST(round(round(s, 2), 0) AS BIGINT) AS VARCHAR), ';' ORDER BY k) AS points FROM (SELECT order_date AS k, sum({NUM('total')}) AS s FROM t WHERE order_date <> '' GROUP BY 1)),
 c3 AS (SELECT 'status by Metric' AS title, 'grouped-bar' AS chart_type, string_agg(k || ' / ' || m || '=' || CAST(CAST(round(round(s, 2), 0) AS BIGINT) AS VARCHAR), ';' ORDER BY k, o) AS points FROM (SELECT status AS k, 'total' AS m, 0 AS o, sum({NUM('total')}) AS s FROM t GROUP BY 1 UNION ALL SELECT status, 'customer', 1, sum({NUM('customer')}) FROM t GROUP BY 1)),
 c4 AS (SELECT 'priority Breakdown' AS title, 'bar' AS chart_type, string_agg(v || '=' || CAST(n AS VARCHAR), ';' ORDER BY n DESC, f) AS points FROM vc WHERE col = 'priority'),
 al AS (SELECT 1 AS o, * FROM c1 UNION ALL SELECT 2, * FROM c2 UNION ALL SELECT 3, * FROM c3 UNION ALL SELECT 4, * FROM c4) SELECT CAST(row_number() OVER (ORDER BY o) AS INT) AS chart_no, title, chart_type, points FROM al""")
def _(spark, sf):
    shown = F.array_join(F.transform("points", lambda x: F.concat(x["name"], F.lit("="), F.round(x["value"], 0).cast("long").cast("string"))), ";")
    return S.profile_table(table(spark, sf)).select("chart_no", "title", "chart_type", shown.alias("points"))
