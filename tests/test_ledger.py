"""Ledger operators against plain Python on small, skewed ledgers."""

import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spendframe.operators import outlook, patterns, totals
from spendframe.operators.cleaning import categorize
from spendframe.plans.report import report_lines

SCHEMA = "user string, Date string, Desc string, Amt double, CurrencyRank int"


def make_rows(seed=3, users=40, rows=3000):
    """A third of all rows belong to one ledger; one has no key, some have one row."""
    generator = random.Random(seed)
    names = ["Uber trip", "pizza", "rent", "Unknown", "amazon", "salary", "gym"]
    found = []
    for i in range(rows):
        user = "hot" if i % 3 == 0 else generator.choice([None, *map(str, range(users))])
        amount = round(generator.expovariate(1 / 20), 2) - (30 if i % 11 == 0 else 0)
        date = None if i % 17 == 0 else f"2024-01-{generator.randrange(1, 29):02d}"
        found.append((user, date, generator.choice(names), amount, generator.choice([None, 1, 4])))
    found += [(f"single{i}", "2024-01-01", "rent", 5.0 + i, None) for i in range(20)]
    found.append(("debt", "2024-01-01", "rent", -5.0, None))
    return found


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def ledger(spark, rows):
    return categorize(spark.createDataFrame(rows, SCHEMA)).cache()


def by_user(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    return groups


def expected_anomalies(rows):
    amounts = [row[3] for row in rows]
    if len(amounts) < 2:
        return []
    limit = statistics.mean(amounts) + 2.5 * statistics.stdev(amounts)
    return [row for row in rows if row[3] > limit]


@pytest.mark.parametrize("large,slots", [(1000, 65536), (1, 65536), (0, 2), (3, 1)])
def test_anomalies_by_user(ledger, rows, monkeypatch, large, slots):
    monkeypatch.setattr(patterns, "LARGE_LEDGERS", large)
    monkeypatch.setattr(patterns, "BOUND_SLOTS", slots)
    found = Counter(tuple(row)[:5] for row in patterns.anomalies(ledger, ["user"]).collect())
    wanted = Counter()
    for group in by_user(rows).values():
        wanted.update(expected_anomalies(group))
    assert found == wanted and wanted


def test_anomalies_of_one_ledger(ledger, rows):
    found = Counter(tuple(row)[:5] for row in patterns.anomalies(ledger).collect())
    assert found == Counter(expected_anomalies(rows))


def test_anomalies_keep_columns(ledger):
    assert patterns.anomalies(ledger, ["user"]).columns == ledger.columns


def test_score_and_prediction(ledger, rows):
    found = {row["user"]: row for row in outlook.predict(ledger, ["user"], 100.0).collect()}
    scores = {row["user"]: row for row in outlook.health_score(ledger, ["user"]).collect()}
    groups = by_user(rows)
    assert set(found) == set(groups)
    category = {(r["Desc"]): r["Category"] for r in ledger.select("Desc", "Category").distinct().collect()}
    for user, group in groups.items():
        total = sum(row[3] for row in group)
        sums = defaultdict(float)
        for row in group:
            sums[category[row[2]]] += row[3]
        odd = len(expected_anomalies(group))
        score = 100 - (20 if total > 0 and max(sums.values()) / total > 0.5 else 0) - 5 * odd
        assert scores[user]["anomalies"] == odd
        assert found[user]["score"] == max(10, min(100, score)) == scores[user]["score"]
        days = sorted(int(row[1][-2:]) for row in group if row[1])
        span = days[-1] - days[0] if days and days[-1] > days[0] else 30
        assert found[user]["burn_rate"] == pytest.approx(total / span, abs=0.0051)
        assert found[user]["status"] == ("Affordable" if 100 < total / span * 15 else "Risky")
        assert found[user]["transaction_count"] == len(group)
        rank = min((row[4] for row in group if row[4] is not None), default=3)
        assert found[user]["currency"] == ["$", "€", "£", "₹", "¥"][rank]


def test_keyed_equals_filtered(ledger):
    keyed = outlook.predict(ledger, ["user"], 50.0)
    for user in ("hot", "7", "single3", "debt"):
        one = outlook.predict(ledger.filter(ledger.user == user), [], 50.0).collect()
        assert [tuple(r)[1:] for r in keyed.filter(keyed.user == user).collect()] == [tuple(one[0])]


def test_score_bounds(spark):
    even = [("a", None, name, 10.0, None) for name in ("pizza", "uber", "gym", "rent")]
    heavy = [("b", None, "pizza", 60.0, None), ("b", None, "uber", 40.0, None)]
    many = [("c", None, n, 1.0, None) for n in ("pizza", "uber", "gym") for _ in range(400)]
    many += [("c", None, n, 100.0, None) for n in ("pizza", "uber", "gym", "rent", "bill") for _ in range(5)]
    df = categorize(spark.createDataFrame(even + heavy + many, SCHEMA))
    found = {row["user"]: row["score"] for row in outlook.health_score(df, ["user"]).collect()}
    assert found == {"a": 100, "b": 80, "c": 10}


def test_shares_sum_to_100(ledger):
    sums = defaultdict(float)
    for row in totals.category_shares(ledger, ["user"]).collect():
        sums[row["user"]] += row["percent"]
    assert sums.pop("debt") == 0
    assert all(value == pytest.approx(100) for value in sums.values())


def test_results_over_one_ledger_are_sorted(ledger):
    amounts = [row["amount"] for row in totals.category_totals(ledger).collect()]
    assert amounts == sorted(amounts, reverse=True)
    names = [row["Desc"] for row in patterns.habits(ledger).collect()]
    assert names == sorted(names) and names
    dates = [row["Date"] for row in totals.daily_trend(ledger).collect()]
    assert dates == sorted(dates)


def test_top_category(ledger):
    found = {row["user"]: row for row in outlook.top_category(ledger, ["user"]).collect()}
    assert found["single1"]["top_category"] == "Other / Misc"
    assert found["single1"]["ratio"] == 0 and found["single1"]["concentrated"]
    assert found["debt"]["top_percent"] == 0


def test_without_categories_descriptions_stand_in(ledger):
    plain = ledger.drop("Category")
    found = {row["user"]: row for row in outlook.top_category(plain, ["user"]).collect()}
    assert found["single1"]["top_category"] == "rent"
    scores = {row["user"]: row["score"] for row in outlook.health_score(plain, ["user"]).collect()}
    assert scores["single1"] == 100


def test_top_descriptions(ledger, rows):
    sums = defaultdict(float)
    for user, _, name, amount, _ in rows:
        sums[user, name] += amount
    wanted = defaultdict(list)
    for (user, name), amount in sums.items():
        wanted[user].append((-amount, name))
    found = defaultdict(list)
    for row in totals.top_descriptions(ledger, ["user"], 3).collect():
        found[row["user"]].append((row["place"], row["Desc"]))
    for user, pairs in wanted.items():
        assert [name for _, name in sorted(found[user])] == [name for _, name in sorted(pairs)[:3]]


def test_strict_rule(spark):
    from pyspark.sql import functions as F

    cases = [(100.0, None), (100.0, 0.0), (100.0, -1.0), (100.0, 30.0), (100.0, 30.01), (100.0, 29.0)]
    df = spark.createDataFrame(cases, "projection double, price double")
    verdict = outlook.affordable(F.col("projection"), F.col("price"), "strict30").alias("v")
    assert [row["v"] for row in df.select(verdict).collect()] == [
        "Invalid", "Invalid", "Invalid", "Affordable", "Risky", "Affordable"]
    with pytest.raises(ValueError):
        outlook.affordable(F.col("projection"), 1.0, "other")


def test_own_categories(spark):
    """Categories that the library does not know, many in one ledger, and a null one."""
    rows = [("a", "Housing", 900.0), ("a", "Food & Dining", 10.0), ("b", None, 7.0), ("b", "x", 2.0)]
    rows += [("c", f"name {i}", float(i)) for i in range(300)] + [("c", "name 7", 1000.0)]
    ledger = spark.createDataFrame(rows, "user string, Category string, Amt double").withColumn("Desc", F.lit("d"))
    top = {row["user"]: row for row in outlook.top_category(ledger, ["user"]).collect()}
    assert (top["a"]["top_category"], round(top["a"]["top_percent"], 1), top["a"]["ratio"]) == ("Housing", 98.9, 90.0)
    assert (top["b"]["top_category"], top["b"]["top_amount"], top["c"]["top_category"], top["c"]["top_amount"]) == (None, 7.0, "name 7", 1007.0)
    assert {row["user"]: row["score"] for row in outlook.health_score(ledger, ["user"]).collect()}["a"] == 80
    only = outlook.top_category(ledger, ["user"], categories=["Food & Dining"]).collect()
    assert {row["user"]: row["top_category"] for row in only} == {"a": "Food & Dining", "b": None, "c": None}
    assert outlook.top_category(ledger).first()["top_category"] == "name 7"


def test_limits_of_cells_are_those_of_rows(ledger):
    cells = outlook.cell_limits(outlook.ledger_cells(ledger, ["user"]), ["user"], 2.5)
    found = {row["user"]: (row["_limit"], row["_rows"]) for row in cells.collect()}
    for row in totals.ledger_stats(ledger, ["user"]).collect():
        limit, count = found[row["user"]]
        assert count == row["count"] and (limit is None) == (row["std"] is None)
        assert limit is None or limit == pytest.approx(row["mean"] + 2.5 * row["std"], rel=1e-12)


def test_report_reads_the_ledger_three_times(spark, tmp_path, ledger):
    """Figures, limits and score share a pass; anomalies and habits need one each."""
    path = str(tmp_path / "ledger")
    ledger.write.parquet(path)
    report = report_lines(spark.read.parquet(path), ["user"])
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 3
