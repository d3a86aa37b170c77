"""Burn rate, projection, health score, affordability and the prediction row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.dates import as_timestamp
from spendframe.functions.values import DEFAULT_CURRENCY, currency_symbol, round2, settled
from spendframe.operators.keyed import attach
from spendframe.operators.patterns import anomaly_counts
from spendframe.operators.totals import top_descriptions

DEFAULT_DAYS = 30
PROJECTED_DAYS = 30


def _dated(df: DataFrame) -> DataFrame:
    """Add the parsed date, once for all aggregates that need it."""
    if "Date" not in df.columns:
        return df.withColumn("_ts", F.lit(None).cast("timestamp_ntz"))
    return df.withColumn("_ts", as_timestamp(F.col("Date"), df.schema["Date"].dataType.typeName()))


def _days() -> Column:
    """Whole days elapsed between the first and last date; 30 if none or not positive."""
    elapsed = F.extract(F.lit("DAY"), F.max("_ts") - F.min("_ts"))
    return F.when(elapsed > 0, elapsed).otherwise(F.lit(DEFAULT_DAYS))


def _currency(df: DataFrame) -> Column:
    rank = F.min("CurrencyRank") if "CurrencyRank" in df.columns else F.lit(None).cast("int")
    return currency_symbol(rank, DEFAULT_CURRENCY)


def ledger_cells(df: DataFrame, keys: Sequence[str] = (), dated: bool = True) -> DataFrame:
    """One row per ledger whose ``cells`` hold what its rows come to, by category.

    A cell can be merged with others: count, sum, mean and squared deviations (``m2``),
    extremes, first and last date, lowest currency. Every figure of a ledger follows
    from its cells, for whatever categories it has, so they are the one pass over its
    rows. Rows are summed up by ledger and category before anything is shuffled; a ledger
    with most of the rows is a few cells for each task. Without ``Category`` a ledger has
    a single cell.

    ``dated=False`` leaves the dates null, for figures that need none and spare their parsing.

    As ``cells`` is one column, plans that use different figures of it are equal up to
    here and Spark computes it once for all of them.
    """
    name = F.col("Category") if "Category" in df.columns else F.lit(None).cast("string")
    rank = F.min("CurrencyRank") if "CurrencyRank" in df.columns else F.lit(None).cast("int")
    rows = _dated(df if dated else df.select(*[f"`{column}`" for column in df.columns if column != "Date"]))
    parts = rows.withColumn("_name", name).groupBy(*keys, "_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("Amt").alias("total"),
        F.avg("Amt").alias("mean"),
        (F.var_pop("Amt") * F.count(F.lit(1))).alias("m2"),
        F.max("Amt").alias("highest"),
        F.min(F.when(F.col("Amt") > 0, F.col("Amt"))).alias("lowest"),
        F.min("_ts").alias("first"),
        F.max("_ts").alias("last"),
        rank.alias("rank"),
    )
    fields = [F.col("_name").alias("name"), "n", "total", "mean", "m2", "highest", "lowest", "first", "last", "rank"]
    return parts.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("cells"))


def _over_cells(field: str) -> Column:
    return F.transform("cells", lambda cell: cell[field])


def _summed(one: Callable[[Column], Column], kind: str = "double") -> Column:
    """Sum over the cells; null without any."""
    total = F.aggregate("cells", F.lit(0).cast(kind), lambda sofar, cell: sofar + one(cell))
    return F.when(F.size("cells") > 0, total)


def _rows() -> Column:
    return F.coalesce(_summed(lambda cell: cell["n"], "bigint"), F.lit(0))


def cell_limits(cells: DataFrame, keys: Sequence[str], sigmas: float) -> DataFrame:
    """Rows and limit (mean and sample deviations) of each ledger, as ``anomalies`` takes them."""
    mean = _summed(lambda cell: cell["total"]) / F.col("_rows")
    apart = _summed(lambda cell: cell["m2"] + cell["n"] * F.pow(cell["mean"] - F.col("_mean"), F.lit(2.0)))
    limit = F.when(F.col("_rows") > 1, F.col("_mean") + sigmas * F.sqrt(apart / (F.col("_rows") - 1)))
    return cells.withColumn("_rows", _rows()).withColumn("_mean", mean).select(*keys, limit.alias("_limit"), "_rows")


def ledger_metrics(df: DataFrame, keys: Sequence[str] = (),
                   categories: Sequence[str] | None = None) -> DataFrame:
    """Everything about a ledger that its cells give.

    ``ranked`` lists all categories present as ``struct(lost, name)`` with the largest
    sum first, or only those in ``categories``. A ledger table without ``Category`` ranks
    its five largest descriptions instead.
    """
    return _metrics(df, ledger_cells(df, keys), keys, categories)


def _metrics(df: DataFrame, cells: DataFrame, keys: Sequence[str],
             categories: Sequence[str] | None) -> DataFrame:
    elapsed = F.extract(F.lit("DAY"), F.array_max(_over_cells("last")) - F.array_min(_over_cells("first")))
    figures = [
        _rows().alias("transaction_count"),
        settled(_summed(lambda cell: cell["total"])).alias("total"),
        F.array_max(_over_cells("highest")).alias("highest"),
        F.coalesce(F.array_min(_over_cells("lowest")), F.lit(0.0)).alias("lowest"),
        F.when(elapsed > 0, elapsed).otherwise(F.lit(DEFAULT_DAYS)).alias("days"),
        currency_symbol(F.array_min(_over_cells("rank")), DEFAULT_CURRENCY).alias("currency"),
    ]
    if "Category" in df.columns:
        counted = F.filter("cells", lambda cell: cell["total"].isNotNull())
        if categories is not None:
            counted = F.filter(counted, lambda cell: cell["name"].isin(list(categories)))
        ranked = F.array_sort(F.transform(counted, lambda cell: F.struct(
            (-settled(cell["total"])).alias("lost"), cell["name"].alias("name"))))
        metrics = cells.select(*keys, *figures, ranked.alias("ranked"))
    else:
        place = F.struct((-F.col("amount")).alias("lost"), F.col("Desc").alias("name"))
        largest = (
            top_descriptions(df, keys)
            .groupBy(*keys)
            .agg(F.array_sort(F.collect_list(place)).alias("ranked"))
        )
        metrics = attach(cells.select(*keys, *figures), largest, keys)
    return (
        metrics.withColumn("burn", F.col("total") / F.col("days"))
        .withColumn("projection", F.col("burn") * PROJECTED_DAYS)
        .withColumn("top_amount", -F.get(F.col("ranked"), F.lit(0))["lost"])
        .withColumn("top_category", F.get(F.col("ranked"), F.lit(0))["name"])
    )


def top_category(df: DataFrame, keys: Sequence[str] = (),
                 categories: Sequence[str] | None = None) -> DataFrame:
    """Largest category, its percentage, its ratio to the second, and whether it is over half."""
    metrics = _metrics(df, ledger_cells(df, keys, dated=False), keys, categories)
    return with_shares(metrics).select(
        *keys, "top_category", "top_amount", "top_percent", "ratio", "concentrated"
    )


def with_shares(metrics: DataFrame) -> DataFrame:
    """Add the top category's percentage, its ratio to the second and the over-half flag."""
    second = -F.get(F.col("ranked"), F.lit(1))["lost"]
    percent = F.when(
        F.col("total") > 0, F.col("top_amount") / F.col("total") * 100
    ).otherwise(F.lit(0.0))
    return metrics.withColumns(
        {
            "top_percent": percent,
            "ratio": F.when(second > 0, F.col("top_amount") / second).otherwise(F.lit(0.0)),
            "concentrated": percent > 50,
        }
    )


def burn_rate(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total over days, and 30 times that; both rounded to two places."""
    burn = settled(F.sum("Amt")) / _days()
    return _dated(df).groupBy(*keys).agg(
        _days().alias("days"),
        round2(burn).alias("burn_rate"),
        round2(burn * PROJECTED_DAYS).alias("projected"),
    )


def detect_currency(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First symbol of the fixed list that occurs in any amount; rupee if none does."""
    return df.groupBy(*keys).agg(_currency(df).alias("currency"))


def _score(has_categories: bool) -> Column:
    concentrated = (F.col("total") > 0) & (F.col("top_amount") / F.col("total") > 0.5)
    penalty = F.when(concentrated & F.lit(has_categories), 20).otherwise(0)
    points = 100 - penalty - 5 * F.col("anomalies")
    return F.greatest(F.lit(10), F.least(F.lit(100), points)).cast("int")


def scored_metrics(df: DataFrame, keys: Sequence[str] = (),
                   categories: Sequence[str] | None = None, sigmas: float = 2.5, dated: bool = True) -> DataFrame:
    """:func:`ledger_metrics` with the number of anomalies and the health score.

    Figures and limits come from the same cells; one more pass counts what is above.
    """
    cells = ledger_cells(df, keys, dated)
    limits = cell_limits(cells, keys, sigmas)
    metrics = attach(_metrics(df, cells, keys, categories), anomaly_counts(df, keys, sigmas, limits), keys)
    return metrics.withColumn("anomalies", F.coalesce(F.col("anomalies"), F.lit(0))).withColumn(
        "score", _score("Category" in df.columns)
    )


def health_score(df: DataFrame, keys: Sequence[str] = (),
                 categories: Sequence[str] | None = None) -> DataFrame:
    """100, less 20 if one category is over half, less 5 per anomaly, within 10 and 100."""
    return scored_metrics(df, keys, categories, dated=False).select(*keys, "anomalies", "score")


def affordable(projection: Column, price: float | Column, rule: str = "half") -> Column:
    """Verdict on a price.

    ``half``: Affordable below half the exact projection, else Risky.
    ``strict30``: Invalid without a positive price, Risky above 30 % of the
    rounded projection, else Affordable.
    """
    price = price if isinstance(price, Column) else F.lit(price).cast("double")
    if rule == "half":
        return F.when(price < projection * 0.5, F.lit("Affordable")).otherwise(F.lit("Risky"))
    if rule == "strict30":
        return (
            F.when(price.isNull() | F.isnan(price) | (price <= 0), F.lit("Invalid"))
            .when(price > round2(projection) * 0.30, F.lit("Risky"))
            .otherwise(F.lit("Affordable"))
        )
    raise ValueError(f"Unknown rule {rule!r}; use 'half' or 'strict30'")


def affordability(df: DataFrame, keys: Sequence[str] = (), price: float | Column = 0.0,
                  rule: str = "half") -> DataFrame:
    projection = settled(F.sum("Amt")) / _days() * PROJECTED_DAYS
    return (
        _dated(df).groupBy(*keys)
        .agg(projection.alias("_projection"))
        .select(
            *keys,
            round2(F.col("_projection")).alias("projected"),
            affordable(F.col("_projection"), price, rule).alias("status"),
        )
    )


def predict(df: DataFrame, keys: Sequence[str] = (), price: float | Column = 0.0,
            rule: str = "half", categories: Sequence[str] | None = None) -> DataFrame:
    """One row per ledger: burn rate, projection, verdict, currency, score and count."""
    return scored_metrics(df, keys, categories).select(
        *keys,
        round2(F.col("burn")).alias("burn_rate"),
        round2(F.col("projection")).alias("projected"),
        affordable(F.col("projection"), price, rule).alias("status"),
        "currency",
        "score",
        "transaction_count",
    )
