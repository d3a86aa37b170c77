"""Scalar expressions on literal edge cases."""

import random
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spendframe.functions import text, values
from spendframe.functions.dates import parse_date
from spendframe.functions.taxonomy import category


def evaluate(spark, inputs, kind, build):
    rows = [(i, value) for i, value in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", build(F.col("x")).alias("y"))
    return [row["y"] for row in df.orderBy("i").collect()]


AMOUNTS = {
    "1,234.50": 1234.5, "$5": 5.0, "(500)": 500.0, "-7": -7.0, "5-3": 0.0, "": 0.0, "--": 0.0,
    "1.2.3": 0.0, "12.": 12.0, ".5": 0.5, "1.234,56": 1.23456, "12-": 0.0, "1e3": 13.0,
    "+4": 4.0, "٣": 0.0, "5٣": 0.0, "₹ 1,00,000.25": 100000.25,
}


def test_amount(spark):
    assert evaluate(spark, AMOUNTS, "string", values.amount) == list(AMOUNTS.values())
    assert evaluate(spark, [None], "string", values.amount) == [0.0]


def test_unsigned_amount(spark):
    found = evaluate(spark, ["-7", "(1.5)", "5-3", "x"], "string",
                     lambda c: values.amount(c, signed=False))
    assert found == [7.0, 1.5, 53.0, 0.0]


def test_strict_amount(spark):
    assert evaluate(spark, ["$5", "", None, "abc"], "string", values.strict_amount) == [5.0, 0, 0, 0]
    with pytest.raises(PySparkException, match="Unable to parse amount"):
        evaluate(spark, ["1.2.3"], "string", values.strict_amount)


def test_description(spark):
    found = evaluate(spark, ["a", " b ", "", "  \t", "　\xa0", None], "string", values.description)
    assert found == ["a", " b ", "Unknown", "Unknown", "Unknown", "Unknown"]


def test_missing_values(spark):
    inputs = [*values.NA_SPELLINGS, "na", "none", "0", " "]
    found = evaluate(spark, inputs, "string", values.known_or_null)
    assert found == [None] * len(values.NA_SPELLINGS) + ["na", "none", "0", " "]


DATES = {
    **dict.fromkeys(
        ["2024-01-05", "2024/01/05", "20240105", "5 Jan 2024", "Jan 5, 2024", "05-Jan-2024",
         "January 5, 2024", "1/5/2024", " 2024-01-05 ", "05-JAN-2024", "2024-1-5"],
        datetime(2024, 1, 5)),
    "2024-01-05 10:00:00": datetime(2024, 1, 5, 10),
    "2024-01-05T10:00:00Z": datetime(2024, 1, 5, 10),
    "2024-01-05T10:00:00+05:30": datetime(2024, 1, 5, 4, 30),
    "2024-01-05 10:20": datetime(2024, 1, 5, 10, 20),
    "01/05/2024 09:08:07": datetime(2024, 1, 5, 9, 8, 7),
    "5 Jan 2024 9:05": datetime(2024, 1, 5, 9, 5),
    "01/02/2024": datetime(2024, 1, 2),
    "13/05/2024": datetime(2024, 5, 13),
    "05.01.2024": datetime(2024, 5, 1),
    "31.12.2023": datetime(2023, 12, 31),
    "garbage": None, "": None, "2024-13-45": None, "30/30/2024": None, "99999999": None,
    "5 Foo 2024": None, "Sept 3, 2024": datetime(2024, 9, 3), "3 September 2024": datetime(2024, 9, 3),
    "Mayor 3, 2024": None, "1 may 2024": datetime(2024, 5, 1),
}


def test_parse_date(spark):
    found = dict(zip(DATES, evaluate(spark, DATES, "string", parse_date)))
    assert found == DATES


def test_parse_date_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = dict(zip(DATES, evaluate(spark, DATES, "string", parse_date)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == DATES


def test_round2(spark):
    found = evaluate(spark, [0.125, 0.375, 2.675, 1.005, -0.125], "double", values.round2)
    assert found == [0.12, 0.38, 2.68, 1.0, -0.12]


def test_fixed_prints_like_exact_rounding(spark):
    generator = random.Random(7)
    inputs = [0.125, 0.375, 2.675, 1.005, 0.15, 0.25, 0.35, 1.45, -0.001, -2.5, 0.0, 1e7, 123456789.125]
    inputs += [generator.randrange(-10**7, 10**7) / 1000 for _ in range(3000)]
    inputs += [generator.uniform(-1e6, 1e6) for _ in range(1000)]
    for places in (0, 1, 2):
        found = evaluate(spark, inputs, "double", lambda c: values.fixed(c, places))
        assert found == [f"{x:.{places}f}" for x in inputs]
    assert evaluate(spark, [None], "double", lambda c: values.fixed(c, 1)) == [None]


def test_plain(spark):
    inputs = [12.5, 7.0, 0.0, 1234567.89, 12345678.9, 98765432.0, 100.0, -3.25, 123456789012.34]
    assert evaluate(spark, inputs, "double", values.plain) == [repr(x) for x in inputs]


def test_sizes(spark):
    inputs = [0, 1023, 1024, 1280, 1536, 1048576, 1048577, 1342177, 5 * 1024**3, 3 * 1024**4, 2 * 1024**5]
    human = evaluate(spark, inputs, "bigint", values.human_size)

    def expected(size):
        for unit in ("B", "KB", "MB", "GB"):
            if size < 1024:
                return f"{size:.1f} {unit}"
            size /= 1024
        return f"{size:.1f} TB"

    assert human == [expected(x) for x in inputs]
    short = evaluate(spark, inputs, "bigint", values.short_size)
    assert short[:7] == ["0.0 KB", "1.0 KB", "1.0 KB", "1.3 KB", "1.5 KB", "1024.0 KB", "1.00 MB"]


def test_currency(spark):
    inputs = ["A$5", "C$5", "5 rs", "€5", "5", None, "£5 €6"]
    ranks = evaluate(spark, inputs, "string", values.currency_rank)
    assert ranks == [0, 0, 9, 1, None, None, 1]
    assert evaluate(spark, ranks, "int", values.currency_symbol) == ["$", "$", "Rs", "€", "₹", "₹", "€"]
    labels = evaluate(spark, ["₹", "₽", "€", "£", "¥", "$", "₩"], "string", values.currency_label)
    assert labels == ["Rs. ", "Rs. ", "EUR ", "GBP ", "JPY ", "$", "₩"]


def test_category(spark):
    cases = {
        "Uber Eats order": "Food & Dining", "UBER trip": "Transport & Auto", "AT&T bill": "Utilities & Bills",
        "Barcelona tapas": "Other / Misc", "the bar": "Entertainment & Leisure", "cafébar": "Other / Misc",
        "smart phone": "Utilities & Bills", "smartphone": "Other / Misc", "pocket money": "Transfers & Income",
        "misc": "Other / Misc", "bar_tab": "Other / Misc", "Amazon.com": "Shopping & Retail",
    }
    assert evaluate(spark, cases, "string", category) == list(cases.values())
    own = {"Pets": ["vet"], "None": []}
    assert evaluate(spark, ["a vet", "x"], "string", lambda c: category(c, own, "?")) == ["Pets", "?"]


LINES = ["", "a", "a\n", "a\n\n", "a\r\nb", "a\x0bb", "a\u2028b", "a\rb\r", "\n", "a\r\n", "x\x85", "a\n\rb"]


def test_line_count(spark):
    assert evaluate(spark, LINES, "string", text.line_count) == [len(t.splitlines()) for t in LINES]


def test_extension(spark):
    import os.path

    names = ["A.PDF", ".hidden", "a.tar.gz", "a.", "..a.b", "plain", "...", ".a.b", "a.b\nc"]
    assert evaluate(spark, names, "string", text.extension) == [os.path.splitext(n)[1] for n in names]
    assert evaluate(spark, names, "string", text.stem) == [os.path.splitext(n)[0] for n in names]


def test_file_kind(spark):
    names = ["a.JPG", "b.mkv", "c.ogg", "d.xlsx", "e.tar.gz", "f", ".pdf"]
    assert evaluate(spark, names, "string", text.file_kind) == [
        "Images", "Videos", "Audio", "Documents", "Others", "Others", "Others"]


def test_latin1(spark):
    inputs = ["aé€b", "日本", "ÿĀ", "😀x", "a" * 2100]
    assert evaluate(spark, inputs, "string", text.latin1) == [
        t.encode("latin-1", "replace").decode("latin-1") for t in inputs]
    cut = evaluate(spark, inputs, "string", lambda c: text.latin1(c, 2000))
    assert [len(t) for t in cut] == [4, 2, 2, 2, 2000]


def test_data_url(spark):
    import base64

    content = bytes(range(256))
    (found,) = evaluate(spark, [bytearray(content)], "binary", lambda c: text.data_url(c, "image/png"))
    assert found == "data:image/png;base64," + base64.b64encode(content).decode()


def test_strip_takes_all_white_space(spark):
    every = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())
    assert evaluate(spark, [every + "a b" + every], "string", text.strip) == ["a b"]
    assert sorted(every) == sorted(text.WHITESPACE)
