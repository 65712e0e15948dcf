"""Column profiles and chart-ready aggregates of a table whose cells are text.

All columns are handled in one pass: the table is turned into (column, value)
rows and first reduced to one row per distinct value, so wide tables do not
cost one scan per column and hot values shuffle as one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import values as V
from ..session import materialize


def unpivot_cells(df: DataFrame, row_no: str = "row_no") -> DataFrame:
    """(row_no, pos, column, value) with trimmed values, blanks kept as ''."""
    cols = [c for c in df.columns if c != row_no]
    cells = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"),
                 F.coalesce(T.strip(F.col(c).cast("string")), F.lit("")).alias("value"))
        for i, c in enumerate(cols)
    ])
    return df.select(row_no, F.explode(cells).alias("c")).select(row_no, "c.*")


def distinct_values(cells: DataFrame, row_no: str = "row_no") -> DataFrame:
    """(pos, column, value, n, first_row): every column's value counts."""
    return cells.groupBy("pos", "column", "value").agg(F.count("*").alias("n"), F.min(row_no).alias("first_row"))


def first_cells(cells: DataFrame, k: int, row_no: str = "row_no") -> DataFrame:
    """The first ``k`` non-blank cells of every column, by row; the limit applies before the shuffle."""
    w = Window.partitionBy("pos", "column").orderBy(row_no)
    return cells.filter(F.col("value") != "").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def _is_date(c: Column) -> Column:
    hit = F.lit(False)
    for p in L.DATE_PATTERNS:
        hit = hit | c.rlike(p)
    return hit


def value_kinds(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dates, sampled, numbers, distinct_values) from value counts (keys, value, n) without blanks."""
    x = V.parse_number(F.col("value"))
    return counts.groupBy(*keys).agg(
        F.sum(F.when(_is_date(F.col("value")), F.col("n")).otherwise(0)).alias("dates"), F.sum("n").alias("sampled"),
        F.sum(F.when(x.isNotNull(), F.col("n")).otherwise(0)).alias("numbers"), F.count("*").alias("distinct_values"),
    )


def weighted_total(x: Column, n: Column) -> Column:
    """Sum of ``x`` times ``n``: in decimals, so that it is the same in any order of the rows,
    where every value has at most six decimals and 14 digits before them; else in doubles."""
    exact = x.try_cast("decimal(20,6)")
    whole = F.bool_and(x.isNull() | F.coalesce(exact.cast("double") == x, F.lit(False)))
    return F.when(whole, F.sum(exact * n.cast("decimal(17,0)")).cast("double")).otherwise(F.sum(x * n))


def role_of(one_date: bool = False) -> Column:
    """Role of a column from its ``value_kinds``: seventy percent dates (with ``one_date``
    a single one) make it a date, seventy percent numbers make it numeric, 2 to 20
    distinct values categorical."""
    dated = F.col("dates") > 0 if one_date else F.col("dates") >= F.col("sampled") * 0.7
    return (
        F.when(dated, "date").when(F.col("numbers") >= F.col("sampled") * 0.7, "numeric")
        .when(F.col("distinct_values").between(2, 20), "categorical").otherwise("other")
    )


def column_roles(df: DataFrame, row_no: str = "row_no", sample: int | None = None) -> DataFrame:
    """(pos, column, role): date, numeric, categorical or other, from all values.

    ``sample`` looks for dates and numbers in the first so many non-blank cells of each
    column only, where one date is enough; among all values strays would decide.
    """
    cells = unpivot_cells(df, row_no)
    keys = ["pos", "column"]
    kinds = value_kinds(distinct_values(cells, row_no).filter(F.col("value") != ""), keys)
    if sample is not None:
        seen = value_kinds(distinct_values(first_cells(cells, sample, row_no), row_no), keys)
        kinds = seen.drop("distinct_values").join(kinds.select(*keys, "distinct_values"), keys)
    return kinds.select(*keys, role_of(one_date=sample is not None).alias("role"))


def best_values(counts: DataFrame, keys: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each group, numbered by ``name``.

    Every task passes on its own first ``k`` of a group only, so none gets more than
    ``k`` from each of the others, however many values a group has.
    """
    return counts.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def column_profile(df: DataFrame, row_no: str = "row_no", max_columns: int | None = None) -> DataFrame:
    """dtype, missing percent, and min/max/avg or the five top values per column (or per the first ``max_columns``)."""
    keep = [c for c in df.columns if c != row_no][:max_columns]
    keys = ["pos", "column"]
    counts = materialize(distinct_values(unpivot_cells(df.select(row_no, *keep), row_no), row_no), "values")
    x, filled = V.parse_number(F.col("value")), F.col("value") != ""
    stats = counts.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.sum(F.when(~filled, F.col("n")).otherwise(0)).alias("missing"),
        F.min(x).alias("lo"), F.max(x).alias("hi"),
        F.sum(F.when(x.isNotNull(), F.col("n")).otherwise(0)).alias("numbers"), F.sum(x * F.col("n")).alias("total"),
    )
    top = (
        best_values(counts.filter(filled), keys, [F.desc("n"), F.col("first_row")], 5, "rn")
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("t"))
    )
    some = F.col("rows") - F.col("missing")
    kind = F.when(some == 0, "unknown").when(F.col("numbers") >= some * 0.7, "numeric").otherwise("categorical")
    num = kind == "numeric"
    return stats.join(top, keys, "left").select(
        F.col("column"), kind.alias("dtype"),
        F.round(100.0 * F.col("missing") / F.col("rows"), 1).alias("missing_pct"),
        F.when(num, F.round("lo", 2)).alias("min"), F.when(num, F.round("hi", 2)).alias("max"),
        F.when(num, F.round(F.col("total") / F.nullif(F.col("numbers"), F.lit(0)), 2)).alias("avg"),
        F.when(kind == "categorical", F.array_join(F.transform("t", lambda v: v["value"]), " | ")).alias("top_values"),
    )


def value_counts(df: DataFrame, column: str, row_no: str = "row_no", k: int = 15) -> DataFrame:
    """Top values of one column; ties in first-seen order."""
    v = T.strip(F.col(column).cast("string"))
    return (
        df.filter(v != "").groupBy(v.alias("value"))
        .agg(F.count("*").alias("n"), F.min(row_no).alias("first_row"))
        .orderBy(F.desc("n"), "first_row").limit(k)
    )


def numeric_insights(df: DataFrame, columns: list[str]) -> DataFrame:
    """Total, average, minimum and maximum of each numeric column, in one scan."""
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), V.parse_number(F.col(c).cast("string")).alias("x")) for c in columns
    ])).alias("c")).select("c.*")
    return cells.filter(F.col("x").isNotNull()).groupBy("column").agg(
        F.sum("x").alias("total"), F.avg("x").alias("avg"), F.min("x").alias("min"), F.max("x").alias("max"),
    )


def category_insights(df: DataFrame, columns: list[str], row_no: str = "row_no", k: int = 3) -> DataFrame:
    """Number of distinct values and the top three counts per column."""
    counts = distinct_values(unpivot_cells(df.select(row_no, *columns), row_no), row_no).filter(F.col("value") != "")
    top = (
        best_values(counts, ["column"], [F.desc("n"), F.col("first_row")], k, "rn").groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "value", "n"))).alias("t"))
    )
    kinds = counts.groupBy("column").agg(F.count("*").alias("distinct_values"))
    shown = F.array_join(F.transform("t", lambda v: F.concat(v["value"], F.lit(": "), v["n"].cast("string"))), " | ")
    return kinds.join(top, "column").select("column", "distinct_values", shown.alias("top_counts"))


def date_range(df: DataFrame, column: str) -> DataFrame:
    v = T.strip(F.col(column).cast("string"))
    return df.filter(v != "").agg(F.min(v).alias("first_date"), F.max(v).alias("last_date"))


def sum_by(df: DataFrame, key: str, numbers: list[str], missing: float | None = None) -> DataFrame:
    """Sums per trimmed key; cells that are no number do not count."""
    k = T.strip(F.col(key).cast("string"))
    parsed = [V.parse_number(F.col(c).cast("string")).alias(c) for c in numbers]
    kept = df.select(k.alias(key), *parsed).filter(F.col(key) != "")
    total = lambda c: F.sum(c) if missing is None else F.coalesce(F.sum(c), F.lit(missing))
    return kept.groupBy(key).agg(*[total(c).alias(c) for c in numbers])
