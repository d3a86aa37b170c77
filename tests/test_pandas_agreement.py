"""Reading, amounts, dates and statistics against pandas on random inputs."""

import random
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendframe.functions.dates import as_timestamp, parse_date
from spendframe.functions.values import amount, round2
from spendframe.operators import totals
from spendframe.sources.delimited import guess_separator, read_delimited


def evaluate(spark, inputs, kind, build):
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [row["y"] for row in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_amounts(spark):
    generator = random.Random(11)
    texts = ["".join(generator.choices("0123456789.-,$( )eE+x€", k=generator.randrange(0, 9))) for _ in range(3000)]
    wanted = pd.to_numeric(
        pd.Series(texts).astype(str).str.replace(r"[^\d.-]", "", regex=True), errors="coerce").fillna(0)
    assert evaluate(spark, texts, "string", amount) == [float(x) for x in wanted]


DATE_STYLES = [
    "%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y", "%d %b %Y", "%b %d, %Y", "%d-%b-%Y",
    "%B %d, %Y", "%d %B %Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%m/%d/%Y %H:%M", "%Y-%m-%d %H:%M",
    "%d %b %Y %H:%M:%S", "%Y-%m-%dT%H:%M:%SZ",
]


def test_dates(spark):
    generator = random.Random(5)
    texts = [
        (pd.Timestamp("2001-01-01") + pd.Timedelta(minutes=generator.randrange(12_000_000))).strftime(style)
        for style in DATE_STYLES for _ in range(60)]
    texts += ["garbage", "", "2024-02-30", "31/31/2024", "Foo 3, 2024", "99/99/9999"]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        wanted = [pd.to_datetime(t, errors="coerce", format="mixed") for t in texts]
    wanted = [None if pd.isna(w) else w.tz_localize(None).to_pydatetime() for w in wanted]
    assert evaluate(spark, texts, "string", parse_date) == wanted


# Values to agree on: notations by kind, then texts that are no date.
NOTATIONS = """
2024-01-05|2024/1/5|2024.01.05|2024 1 5|20240105|240105|01-02-2024|13-02-2024|02-13-2024|01.02.2024|1 2 2024
1/2/24|13/2/24|1-2-24|13.2.24|24/1/2|24.01.02|99/1/5|75/1/5|1/5/76|32/1/5|3/4/5|1/1/1|12/31/24|29/2/2024
5 Jan 24|05-Jan-2024|5-Jan-24|Jan 5, 2024|January 5 2024|5 January 2024|5th January 2024|January 5th, 2024|Sept 5 2024
5th of January 2024|2024-Jan-05|2024 Jan 5|Jan/05/2024|5. Jan 2024|Jan. 5, 2024|05Jan2024|5Jan24|05 JAN 2024|Jan 5 '24
Jan 2024|2024 January|March-2024|2024-01|2024/1|01/2024|12-2024|2024.01|2024|2024Q1|1Q2024|2024-Q3
Mon, 05 Jan 2024|Friday, January 5, 2024|Fri Jan 5 2024|Mon Jan  5 2024|Wednesday 3 January 2024|Saturday 6 Jan 2024
20240105T101500|20240105 101500|20240105101500|20240105T1015|202401051015|2024-01-05T10:15|2024-01-05 10|2024-01-05T10
2024-01-05T10:15:00+02|2024-01-05T10:15:00-0530|2024-01-05T10:15:00+02:00|2024-01-05T10:15Z|2024-01-05 10:15:00 UTC
2024-01-05 10:15:00 +0200|2024-01-05 10:15 PM|1/5/2024 3:04PM|1/5/2024 3:04:05 am|1/5/2024 12:00 AM|1/5/2024 12:30 PM
1/5/2024 3 PM|1/5/2024 3pm|Jan 5, 2024 3:04 PM|Jan 5 2024 at 3pm|January 5, 2024, 3:04 PM|1/13/24 4:05 PM|13.01.24 10:15
2024-01-05 10:15:00.123|2024-01-05 10:15:00,123|2024-01-05 1:02|Fri Jan  5 10:15:00 2024|Fri Jan 05 10:15:00 UTC 2024
10:15 2024-01-05|1/2/03 4:05|31-Dec-24 23:59|05.01.2024 08:00|2024-1-5T3:04|  2024-01-05  |2024-01-05.|July 4 1976
1/32/5|Jan 24|5 Jan|1/5|202401|2024-13-05|2024-13|13-2024|00/05/2024|2024-00-05|2024-02-30|31/31/2024|29/2/2023|01/02/0024
1600-01-01|2300-01-01|2024-01-05 25:00|2024-01-05 10:60|1/5/2024 13:04 PM|2024-W01-5|2024-005|2024-01-05Z|Q1 2024|0|12
1704412800|1.5|Tues 5 Jan 2024|5 de enero 2024|(2024-01-05)|2024-01-05+02:00|5/Jan/2024:10:15:00 +0000
""".strip().replace("\n", "|").split("|")


def test_date_notations(spark):
    def wanted(text):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            moment = pd.to_datetime(text, errors="coerce", format="mixed")
        if pd.isna(moment):
            return None
        return (moment.tz_convert("UTC").tz_localize(None) if moment.tzinfo else moment).to_pydatetime()

    found = evaluate(spark, NOTATIONS, "string", parse_date)
    assert dict(zip(NOTATIONS, found, strict=True)) == {text: wanted(text) for text in NOTATIONS}
    assert sum(moment is not None for moment in found) > 100


def test_numeric_dates_are_compact(spark):
    found = evaluate(spark, [20240105, None, 5], "bigint", lambda c: as_timestamp(c, "long"))
    assert [str(x) for x in found] == ["2024-01-05 00:00:00", "None", "None"]


def test_round2(spark):
    generator = random.Random(2)
    values = [generator.uniform(-1e5, 1e5) for _ in range(500)] + [i / 8 for i in range(-200, 200)]
    assert evaluate(spark, values, "double", round2) == [float(np.round(v, 2)) for v in values]


@pytest.mark.parametrize("seed", range(6))
def test_delimited_files(spark, tmp_path, seed):
    generator = random.Random(seed)
    separator = generator.choice(",;\t")
    words = ["rent", "a b", 'say "hi"', f"x{separator}y", "", "NA", "é€", "12.5", " pad ", "-"]

    def quoted(field):
        return '"' + field.replace('"', '""') + '"' if generator.random() < 0.3 or separator in field or '"' in field else field

    lines = [separator.join(["Date", "Payee name", "Debit", "Extra"])]
    for i in range(200):
        # pandas takes leading fields for an index if the first row is too long; here
        # such a row is left out like any other, so the first one has its width.
        width = generator.choice([4, 4, 4, 4, 3, 2, 6]) if i else 4
        fields = [quoted(generator.choice(words)) for _ in range(width)]
        if width > 4:
            fields[4] = "over"
        if fields[0] == "":
            fields[0] = "d"
        lines.append(separator.join(fields))
    path = tmp_path / "a.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    wanted = pd.read_csv(path, sep=None, engine="python", encoding="utf-8-sig", on_bad_lines="skip",
                         dtype=str, keep_default_na=False)
    wanted = wanted.astype(object).where(wanted.notna(), None)
    (raw,) = read_delimited(spark, str(path))
    found = [tuple(row) for row in raw.drop("source_file").collect()]
    # The scan gives null for an empty field, as the missing-value rule would.
    assert raw.columns[:4] == list(wanted.columns)
    assert found == [tuple(None if x == "" else x for x in row) for row in wanted.itertuples(index=False)]


def test_separators_like_the_sniffer():
    for header, separator in [("Date,Desc,Amount", ","), ("a;b;c", ";"), ("a\tb\tc", "\t"), ('"x;y","z"', ","),
                              ("Txn Date|Payee|Debit", "|"), ("Date|Payee|Debit", "|")]:
        assert guess_separator(header) == separator


def test_statistics(spark):
    generator = random.Random(9)
    frame = pd.DataFrame({"k": [generator.randrange(30) for _ in range(2000)],
                          "Amt": [round(generator.gauss(10, 40), 2) for _ in range(2000)]})
    wanted = frame.groupby("k")["Amt"].agg(["sum", "mean", "std", "count", "max"])
    found = totals.ledger_stats(spark.createDataFrame(frame), ["k"]).toPandas().set_index("k").sort_index()
    np.testing.assert_allclose(found[["total", "mean", "std", "count", "highest"]].to_numpy(), wanted.to_numpy())
    positive = frame[frame["Amt"] > 0].groupby("k")["Amt"].min()
    assert found["lowest"].tolist() == positive.tolist()
