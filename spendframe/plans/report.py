"""The text of the report, as a table of labelled lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.case import case
from spendframe.functions.values import currency_label, fixed, plain, round2, settled
from spendframe.operators.keyed import attach
from spendframe.operators.outlook import scored_metrics, with_shares
from spendframe.operators.patterns import first_habit

# Section titles by number.
SECTIONS = [
    "FINANCIAL INTELLIGENCE REPORT",
    "Category Breakdown",
    "Key Insights",
    "Spending Patterns",
    "Recommendations",
    "Financial Health Breakdown",
]
SUMMARY_TITLE = "EXECUTIVE SUMMARY"


def report_metrics(df: DataFrame, keys: Sequence[str] = (),
                   categories: Sequence[str] | None = None) -> DataFrame:
    """One row per ledger with all figures that the report shows."""
    metrics = attach(with_shares(scored_metrics(df, keys, categories)), first_habit(df, keys), keys)
    top_over_half = F.col("top_percent") > 50
    return metrics.withColumns(
        {
            "burn_rate": round2(F.col("burn")),
            "projected": round2(F.col("projection")),
            "label": currency_label(F.col("currency")),
            "savings": settled(F.col("top_amount")) * 0.15,
            "category_balance": F.when(top_over_half, 80).otherwise(100),
            "spending_control": F.when(round2(F.col("burn")) > 100, 85).otherwise(100),
            "risk_level": case(
                [(F.col("anomalies") > 2, F.lit("High")), (F.col("anomalies") > 0, F.lit("Moderate"))],
                F.lit("Low"),
            ),
            "score_band": case(
                [(F.col("score") >= 80, F.lit("good")), (F.col("score") >= 50, F.lit("fair"))],
                F.lit("poor"),
            ),
        }
    )


def _line(label: str | Column, value: Column) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.struct(label.alias("label"), value.cast("string").alias("value"))


def report_lines(df: DataFrame, keys: Sequence[str] = (),
                 categories: Sequence[str] | None = None,
                 period: str | Column | None = None) -> DataFrame:
    """``keys, section, line, label, value``; lines count from 1 in each section.

    Section 0 is the title block with the summary. Lines that do not apply to a
    ledger are left out. ``period`` is the month named in the title, the current
    one by default.
    """
    metrics = report_metrics(df, keys, categories)
    if period is None:
        period = F.date_format(F.current_date(), "MMMM yyyy")
    elif isinstance(period, str):
        period = F.lit(period)

    col = F.col
    money = col("label")
    top = col("top_category")
    percent = fixed(settled(col("top_percent")), 1)
    has_category = F.size("ranked") > 0
    has_anomaly = col("anomalies") > 0
    count = col("anomalies").cast("string")

    title = [
        (F.lit(True), _line("Title", F.lit(SECTIONS[0]))),
        (F.lit(True), _line("Generated Period", period)),
        (F.lit(True), _line("Financial Health Score",
                            F.concat(col("score").cast("string"), F.lit(" / 100")))),
        (F.lit(True), _line("Score Band", col("score_band"))),
        (F.lit(True), _line("Heading", F.lit(SUMMARY_TITLE))),
        (F.lit(True), _line("Total Transactions", col("transaction_count"))),
        (F.lit(True), _line("Daily Burn Rate", F.concat(money, plain(col("burn_rate"))))),
        (F.lit(True), _line("Monthly Projection", F.concat(money, plain(col("projected"))))),
        (F.lit(True), _line("Top Category", F.concat(
            F.coalesce(top, F.lit("Misc")), F.lit(" ("), percent, F.lit("%)")))),
    ]

    def share(one: Column) -> Column:
        amount = -one["lost"]
        part = F.when(col("total") > 0, amount / col("total") * 100).otherwise(F.lit(0.0))
        return _line(one["name"], F.concat(
            fixed(settled(amount), 2), F.lit(" ("), fixed(settled(part), 1), F.lit("%)")))

    breakdown = F.concat(
        F.array(_line("Category", F.concat(F.lit("Amount ("), F.trim(money), F.lit(") Percentage")))),
        F.transform("ranked", share),
    )
    insights = [
        (has_category, _line("Insight", F.concat(
            top, F.lit(" dominates your spending ("), percent, F.lit("% of total expenses).")))),
        (col("ratio") >= 1.5, _line("Insight", F.concat(
            F.lit("You spend ~"), fixed(settled(col("ratio")), 1), F.lit("x more on "), top,
            F.lit(" compared to your 2nd highest category.")))),
        (has_category & col("concentrated"), _line("Insight", F.lit(
            "Spending is highly concentrated -> low diversification."))),
    ]
    patterns = [
        (F.lit(True), _line("Highest Single Transaction",
                            F.concat(money, plain(col("highest"))))),
        (F.lit(True), _line("Lowest Single Transaction", F.concat(money, F.when(
            col("lowest") > 0, plain(col("lowest"))).otherwise(F.lit("0"))))),
        (col("habit").isNotNull(), _line("Frequent small expenses detected in", col("habit"))),
        (has_anomaly, _line("Unusual", F.concat(
            count, F.lit(" unusually high transactions found.")))),
    ]
    advice = [
        (has_category, _line("TIP", F.concat(
            F.lit("Reduce "), top, F.lit(" spending by 15% -> Save "), money,
            fixed(col("savings"), 2), F.lit("/month")))),
        (col("habit").isNotNull(), _line("TIP", F.concat(
            F.lit("Track frequent small expenses like '"), col("habit"), F.lit("' closely.")))),
        (has_anomaly, _line("ALERT", F.concat(
            count, F.lit(" unusually high transactions -- review immediately.")))),
    ]
    health = [
        (F.lit(True), _line("Category Balance", F.concat(
            col("category_balance").cast("string"), F.lit(" / 100")))),
        (F.lit(True), _line("Spending Control", F.concat(
            col("spending_control").cast("string"), F.lit(" / 100")))),
        (F.lit(True), _line("Risk Level", col("risk_level"))),
    ]

    def present(lines: list[tuple[Column, Column]]) -> Column:
        return F.filter(
            F.array(*[F.when(applies, line) for applies, line in lines]),
            lambda line: line.isNotNull(),
        )

    sections = F.array(
        present(title), breakdown, present(insights), present(patterns), present(advice),
        present(health),
    )
    by_section = metrics.select(*keys, F.posexplode(sections).alias("section", "_lines"))
    return by_section.select(
        *keys, "section", F.posexplode("_lines").alias("_at", "_line")
    ).select(
        *keys,
        "section",
        (F.col("_at") + 1).alias("line"),
        F.col("_line.label").alias("label"),
        F.col("_line.value").alias("value"),
    )
