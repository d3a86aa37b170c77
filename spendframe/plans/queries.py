"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.functions.dates import parse_date
from spendframe.functions.text import data_url, folder_name, latin1, line_count
from spendframe.functions.values import human_size, short_size
from spendframe.operators import inventory as files
from spendframe.operators import outlook, patterns, sequences, totals
from spendframe.plans import views
from spendframe.plans.ledger import load_table, summarize_table
from spendframe.plans.report import report_lines

USER = ["user_id"]
PRICE = 250.0
PERIOD = "January 2024"
#: Categories of a caller's own, in place of the library's.
OWN_TAXONOMY = {"Rides": ["uber", "lyft"], "Coffee & Tea": ["starbucks", "tea"], "Home": ["bill", "pharmacy", "rent"],
                "Income": ["salary"]}

Query = Callable[[SparkSession, str], DataFrame]


def _four(column: str | Column) -> Column:
    """Four places for comparing engines; the shift keeps exact halves from flipping."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value + 1e-9, 4)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: _four(name) for name in names})


def _ledger(spark: SparkSession, folder: str, *keys: str, drop_empty: bool = False,
            taxonomy: dict[str, list[str]] | None = None) -> DataFrame:
    """The messy ledger, its roles found from the headers."""
    raw = views.raw_ledger(spark, folder).select(
        *keys,
        F.col("raw_date").alias("Txn Date"),
        F.col("raw_desc").alias("Payee"),
        F.col("raw_amt").alias("Debit"),
    )
    return load_table(raw, keys, taxonomy=taxonomy, drop_empty=drop_empty)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def normalize_ledger(spark: SparkSession, folder: str) -> DataFrame:
    ledger = _ledger(spark, folder, "event_id", drop_empty=True)
    return ledger.select("event_id", "Date", "Desc", "Amt", "Category")


def normalize_sparse_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger with empty rows, an empty date column ahead of the filled one, and a currency header."""
    given = F.col("event_id") % 10 != 0
    raw = views.raw_ledger(spark, folder).select(
        F.when(F.col("event_id") < 0, F.col("raw_date")).alias("Old Date"),
        F.when(given, F.col("raw_date")).alias("New Date"),
        F.when(given, F.col("raw_desc")).alias("Merchant"),
        F.when(given, F.col("raw_amt")).alias("Paid (€)"),
    )
    ledger = load_table(raw)
    currency = outlook.detect_currency(ledger).first()["currency"]
    return ledger.select("Date", "Desc", "Amt", F.lit(currency).alias("currency"))


def categorize_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(totals.category_totals(_ledger(spark, folder)), "amount")


def category_share_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(
        totals.category_shares(_ledger(spark, folder, *USER), USER), "amount", "percent"
    )


def top_category_by_user(spark: SparkSession, folder: str) -> DataFrame:
    top = outlook.top_category(_ledger(spark, folder, *USER), USER)
    return _rounded(top, "top_amount", "top_percent", "ratio")


def top_category_own_taxonomy_by_user(spark: SparkSession, folder: str) -> DataFrame:
    top = outlook.top_category(_ledger(spark, folder, *USER, taxonomy=OWN_TAXONOMY), USER)
    return _rounded(top, "top_amount", "top_percent", "ratio")


def prediction_own_taxonomy_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return outlook.predict(_ledger(spark, folder, *USER, taxonomy=OWN_TAXONOMY), USER, PRICE)


def recurring_charges(spark: SparkSession, folder: str) -> DataFrame:
    return patterns.recurring_charges(_ledger(spark, folder))


def recurring_charges_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return patterns.recurring_charges(_ledger(spark, folder, *USER), USER)


def habits(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(patterns.habits(_ledger(spark, folder)), "mean")


def habits_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(patterns.habits(_ledger(spark, folder, *USER), USER), "mean")


def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return patterns.anomalies(_ledger(spark, folder)).drop("CurrencyRank")


def anomalies_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return patterns.anomalies(_ledger(spark, folder, *USER), USER).drop("CurrencyRank")


def ledger_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(totals.ledger_stats(_ledger(spark, folder)), "total", "mean", "std")


def ledger_stats_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(
        totals.ledger_stats(_ledger(spark, folder, *USER), USER), "total", "mean", "std"
    )


def burn_rate_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return outlook.burn_rate(_ledger(spark, folder, *USER), USER)


def burn_rate_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = _table(spark, folder, "orders").select(
        "o_custkey", F.col("o_orderdate").alias("Date"), F.col("o_totalprice").alias("Amt")
    )
    return outlook.burn_rate(orders, ["o_custkey"])


def health_score_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return outlook.health_score(_ledger(spark, folder, *USER), USER)


def affordability_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return outlook.affordability(_ledger(spark, folder, *USER), USER, PRICE)


def affordability_strict_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return outlook.affordability(_ledger(spark, folder, *USER), USER, PRICE, rule="strict30")


def prediction(spark: SparkSession, folder: str) -> DataFrame:
    return outlook.predict(_ledger(spark, folder), price=PRICE)


def prediction_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return outlook.predict(_ledger(spark, folder, *USER), USER, PRICE)


def detect_currency(spark: SparkSession, folder: str) -> DataFrame:
    return outlook.detect_currency(_ledger(spark, folder, *USER), USER)


def date_parse_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return views.raw_ledger(spark, folder).select(
        "event_id", parse_date(F.col("raw_date")).alias("date_ts")
    )


def daily_trend(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(totals.daily_trend(_ledger(spark, folder)), "amount")


def daily_trend_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(totals.daily_trend(_ledger(spark, folder, *USER), USER), "amount")


def top5_desc(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(totals.top_descriptions(_ledger(spark, folder)), "amount")


def top5_desc_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(totals.top_descriptions(_ledger(spark, folder, *USER), USER), "amount")


def summary_by_value(spark: SparkSession, folder: str) -> DataFrame:
    raw = views.raw_ledger(spark, folder).select(
        F.col("raw_desc").alias("Payee"), F.col("raw_amt").alias("Total Cost")
    )
    return _rounded(summarize_table(raw), "amount")


def strict_share_amount(spark: SparkSession, folder: str) -> DataFrame:
    raw = views.raw_ledger(spark, folder).select(
        "event_id",
        F.col("raw_date").alias("Date"),
        F.col("raw_desc").alias("Description"),
        F.col("value").alias("Cost"),
        F.col("raw_amt").alias("Your share"),
    )
    ledger = load_table(raw, ["event_id"], share_mode=True, drop_empty=False)
    return ledger.select("event_id", "Desc", "Amt")


def report(spark: SparkSession, folder: str) -> DataFrame:
    return report_lines(_ledger(spark, folder), period=PERIOD)


def report_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return report_lines(_ledger(spark, folder, *USER), USER, period=PERIOD)


def report_own_taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    return report_lines(_ledger(spark, folder, taxonomy=OWN_TAXONOMY), period=PERIOD)


def file_classify(spark: SparkSession, folder: str) -> DataFrame:
    return files.classify(views.inventory(spark, folder)).select("path", "name", "ext", "category")


def file_category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return files.category_counts(files.classify(views.inventory(spark, folder)))


def file_suffix_filter(spark: SparkSession, folder: str) -> DataFrame:
    named = files.classify(views.inventory(spark, folder))
    return files.with_suffix(named, ".pdf", prefix="doc_").select("path", "name")


def file_name_plan(spark: SparkSession, folder: str) -> DataFrame:
    return files.organize(views.inventory(spark, folder)).select(
        "path", "category", "name", "new_name"
    )


def file_export_plan(spark: SparkSession, folder: str) -> DataFrame:
    existing = (
        views.inventory(spark, folder)
        .select(F.lit("").alias("folder"), F.concat(F.lit("scan_en_"), F.col("doc_id").cast("string"),
                                                    F.lit(".txt")).alias("name"))
        .union(spark.range(1).select(F.lit(""), F.lit("scan_en.txt")))
    )
    plan = files.export_plan(views.outputs(spark, folder), existing)
    return plan.select("path", "name", "clean_name", "new_name")


def latest_file_per_folder(spark: SparkSession, folder: str) -> DataFrame:
    inventory = views.inventory(spark, folder).withColumn("folder", folder_name(F.col("path")))
    return files.latest(inventory)


def stale_files(spark: SparkSession, folder: str) -> DataFrame:
    inventory = views.inventory(spark, folder).withColumn("folder", folder_name(F.col("path")))
    return files.mark_stale(inventory).select("folder", "path", "modified", "stale")


def file_size_label(spark: SparkSession, folder: str) -> DataFrame:
    return views.inventory(spark, folder).select(
        "path", human_size(F.col("length")).alias("size"), short_size(F.col("length")).alias("label")
    )


def text_profile(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return _table(spark, folder, "documents").select(
        "doc_id",
        F.length(text).cast("bigint").alias("chars"),
        line_count(text).cast("bigint").alias("lines"),
    )


def latin1_sanitize(spark: SparkSession, folder: str) -> DataFrame:
    return views.markdown(spark, folder).select("doc_id", latin1(F.col("text")).alias("text"))


def line_table(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.line_table(views.markdown(spark, folder))


def markdown_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.block_table(views.markdown(spark, folder))


def transcript_join(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.join_text(_table(spark, folder, "conversations"), "conv_id", "turn")


def page_count(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.item_counts(_table(spark, folder, "conversations"), "conv_id")


def sequence_merge(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "text")
    members = turns.select("conv_id").distinct().select(
        F.floor(F.col("conv_id") / 2).alias("merge_id"),
        (1 - F.col("conv_id") % 2).alias("rank"),
        "conv_id",
    )
    # A conversation without its other half is nothing to merge.
    whole = members.groupBy("merge_id").count().filter("count = 2").select("merge_id")
    order = members.join(whole, "merge_id", "left_semi")
    return sequences.merge(turns, order, doc="conv_id", pos="turn")


def sequence_split_default(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return sequences.split(turns, doc="conv_id", pos="turn")


def sequence_split_at(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return sequences.split(turns, at=4, doc="conv_id", pos="turn")


def page_data_url(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "pages").select(
        "page_id", data_url(F.col("html").cast("binary"), "text/html").alias("url")
    )


QUERIES: dict[str, Query] = {
    "normalize_ledger": normalize_ledger,
    "normalize_sparse_ledger": normalize_sparse_ledger,
    "categorize_totals": categorize_totals,
    "category_share_by_user": category_share_by_user,
    "top_category_by_user": top_category_by_user,
    "top_category_own_taxonomy_by_user": top_category_own_taxonomy_by_user,
    "prediction_own_taxonomy_by_user": prediction_own_taxonomy_by_user,
    "recurring_charges": recurring_charges,
    "recurring_charges_by_user": recurring_charges_by_user,
    "habits": habits,
    "habits_by_user": habits_by_user,
    "anomalies": anomalies,
    "anomalies_by_user": anomalies_by_user,
    "ledger_stats": ledger_stats,
    "ledger_stats_by_user": ledger_stats_by_user,
    "burn_rate_by_user": burn_rate_by_user,
    "burn_rate_orders": burn_rate_orders,
    "health_score_by_user": health_score_by_user,
    "affordability_by_user": affordability_by_user,
    "affordability_strict_by_user": affordability_strict_by_user,
    "prediction": prediction,
    "prediction_by_user": prediction_by_user,
    "detect_currency": detect_currency,
    "date_parse_mixed": date_parse_mixed,
    "daily_trend": daily_trend,
    "daily_trend_by_user": daily_trend_by_user,
    "top5_desc": top5_desc,
    "top5_desc_by_user": top5_desc_by_user,
    "summary_by_value": summary_by_value,
    "strict_share_amount": strict_share_amount,
    "report_lines": report,
    "report_lines_by_user": report_by_user,
    "report_own_taxonomy": report_own_taxonomy,
    "file_classify": file_classify,
    "file_category_counts": file_category_counts,
    "file_suffix_filter": file_suffix_filter,
    "file_name_plan": file_name_plan,
    "file_export_plan": file_export_plan,
    "latest_file_per_folder": latest_file_per_folder,
    "stale_files": stale_files,
    "file_size_label": file_size_label,
    "text_profile": text_profile,
    "latin1_sanitize": latin1_sanitize,
    "line_table": line_table,
    "markdown_blocks": markdown_blocks,
    "transcript_join": transcript_join,
    "page_count": page_count,
    "sequence_merge": sequence_merge,
    "sequence_split_default": sequence_split_default,
    "sequence_split_at": sequence_split_at,
    "data_url": page_data_url,
}
