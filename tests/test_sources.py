"""Reading delimited files, listings and text profiles from a temporary folder."""

import os

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spendframe import MappingRequiredError, sinks
from spendframe.operators import cleaning, inventory, outlook, roles
from spendframe.plans.ledger import NO_ROLES, load, load_ledgers, load_table, summarize_files
from spendframe.plans.report import report_lines
from spendframe.sources import delimited, files


def write(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def rows(df, *names):
    return sorted((tuple(row[n] for n in names) for row in df.collect()), key=str)


def test_bad_lines(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'Date,Payee,Debit\n2024-01-01,"a, b",1\n2024-01-02,x\n1,2,3,4\n"q ""x""",NA,2\n')
    (raw,) = delimited.read_delimited(spark, path)
    assert raw.columns == ["Date", "Payee", "Debit", "source_file"]
    assert rows(raw, "Date", "Payee", "Debit") == sorted(
        [("2024-01-01", "a, b", "1"), ("2024-01-02", "x", None), ('q "x"', "NA", "2")], key=str)


@pytest.mark.parametrize("separator", [",", ";", "\t", "|"])
def test_separators(spark, tmp_path, separator):
    lines = [["Txn Date", "Payee", "Debit"], ["2024-01-01", "rent", "5"]]
    path = write(tmp_path, "a.csv", "".join(separator.join(line) + "\n" for line in lines))
    ledger = load_ledgers(spark, path)
    assert rows(ledger, "Date", "Desc", "Amt") == [("2024-01-01", "rent", 5.0)]


def test_encodings_and_layouts(spark, tmp_path):
    text = "Date,Payee,Debit\n2024-01-01,café,{}5\n"
    write(tmp_path, "in/bom.csv", b"\xef\xbb\xbf" + text.format("€").encode())
    write(tmp_path, "in/utf8.csv", text.format("£").encode())
    write(tmp_path, "in/cp1252.csv", text.format("€").encode("cp1252"))
    write(tmp_path, "in/latin1.csv", text.format("\x81¥").encode("latin1"))
    write(tmp_path, "in/other.csv", "value;when day;merchant\n7;2024-02-02;bar\n")
    layouts = delimited.find_layouts(spark, str(tmp_path / "in"))
    assert sorted((x.encoding, x.separator, len(x.files)) for x in layouts) == [
        ("cp1252", ",", 1), ("latin1", ",", 1), ("utf-8", ",", 2), ("utf-8", ";", 1)]
    ledger = load_ledgers(spark, str(tmp_path / "in"))
    found = {row["source_file"].rsplit("/", 1)[1]: row for row in
             outlook.predict(ledger, ["source_file"]).collect()}
    assert {name: row["currency"] for name, row in found.items()} == {
        "bom.csv": "€", "utf8.csv": "£", "cp1252.csv": "€", "latin1.csv": "¥", "other.csv": "₹"}
    assert {row["Desc"] for row in ledger.collect()} == {"café", "bar"}


def test_known_layout_skips_the_search(spark, tmp_path):
    for i in range(3):
        write(tmp_path, f"in/{i}.csv", f"\nDate,Payee,Debit\n2024-01-0{i + 1},x{i},{i}\n")
    ledger = load_ledgers(spark, str(tmp_path / "in"), encoding="utf-8")
    assert rows(ledger, "Desc", "Amt") == [("x0", 0.0), ("x1", 1.0), ("x2", 2.0)]


def test_awkward_file_names(spark, tmp_path):
    names = ["a b+c[1].csv", "é 100%.csv", "x{y}.csv"]
    for i, name in enumerate(names):
        write(tmp_path, f"in/{name}", f"Date,Payee,Debit{i}\n2024-01-01,x,{i}\n")
    write(tmp_path, "in/blank.csv", "\n\n")
    ledger = load_ledgers(spark, str(tmp_path / "in"))
    assert rows(ledger, "source_file", "Amt") == sorted(
        [(f"file://{tmp_path}/in/{name}", float(i)) for i, name in enumerate(names)], key=str)
    profiled = {r["path"] for r in files.profile_text_files(spark, str(tmp_path / "in")).collect()}
    assert {f"file://{tmp_path}/in/{name}" for name in names} < profiled
    listed = {r["name"] for r in files.list_files(spark, str(tmp_path / "in")).collect()}
    assert set(names) < listed


def test_quoted_newline(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'Date,Payee,Debit\n2024-01-01,"a\nb",1\n')
    ledger = load_ledgers(spark, path, multi_line=True)
    assert rows(ledger, "Desc", "Amt") == [("a\nb", 1.0)]


def test_quoted_newlines_in_a_mixed_folder(spark, tmp_path):
    """Files with line breaks in quotes are found and read whole; the others stay splittable."""
    contents = {
        "a.csv": 'Date,Payee,Debit\n2024-01-01,"two\nlines",1\n2024-01-02,plain,2\n2024-01-03,"a ""b""\nc",3\n',
        "b.csv": "Date,Payee,Debit\n2024-01-04,x,4\n2024-01-05,y\n",
        "c.csv": 'Date;Payee;Debit\n2024-01-06;"q\r\nr";6\n',
        "d.csv": 'Date,Payee,Debit\n2024-01-07,5" pipe,7\n2024-01-08,6 feet,8\n',
    }
    for name, text in contents.items():
        write(tmp_path, f"in/{name}", text)
    layouts = delimited.find_layouts(spark, str(tmp_path / "in"))
    assert sorted((one.multi_line, len(one.files)) for one in layouts) == [(False, 1), (True, 1), (True, 2)]
    found = load_ledgers(spark, str(tmp_path / "in"))
    wanted = []
    for name in contents:
        frame = pd.read_csv(tmp_path / "in" / name, sep=None, engine="python", on_bad_lines="skip")
        wanted += [(f"file://{tmp_path}/in/{name}", date, payee, 0.0 if pd.isna(debit) else float(debit))
                   for date, payee, debit in frame.itertuples(index=False)]
    assert rows(found, "source_file", "Date", "Desc", "Amt") == sorted(wanted, key=str)


def test_bad_files_stop_no_others(spark, tmp_path):
    write(tmp_path, "in/good.csv", "Date,Payee,Debit\n2024-01-01,x,1\n")
    write(tmp_path, "in/other.csv", "foo,bar\n1,2\n")
    write(tmp_path, "in/word.csv", "x\n1\n")
    write(tmp_path, "in/blank.csv", "\n \n")
    write(tmp_path, "in/header é.csv", "Day;Name;Cost\n")
    loaded = load(spark, str(tmp_path / "in"))
    assert rows(loaded.ledger, "Desc", "Amt") == [("x", 1.0)]
    found = {row["source_file"].rsplit("/", 1)[1]: (row["reason"], row["headers"]) for row in loaded.rejects.collect()}
    assert found == {"other.csv": (NO_ROLES, ["foo", "bar"]), "word.csv": (delimited.NO_SEPARATOR, ["x"]),
                     "blank.csv": (delimited.NO_TEXT, []), "header é.csv": (delimited.NO_ROWS, ["Day", "Name", "Cost"])}
    with pytest.warns(UserWarning, match="Files left out .* and more"):
        assert load_ledgers(spark, str(tmp_path / "in")).count() == 1
    with pytest.raises(MappingRequiredError) as problem:
        load(spark, [str(tmp_path / "in/other.csv"), str(tmp_path / "in/word.csv")])
    assert problem.value.columns == ["foo", "bar"]
    with pytest.raises(ValueError, match="no separator"):
        load(spark, str(tmp_path / "in/word.csv"))


def test_mapping_for_each_file(spark, tmp_path):
    same = "When,What,In,Out\n2024-01-01,x,1,2\n"
    for name in ("a [1].csv", "b.csv", "c.csv"):
        write(tmp_path, f"in/{name}", same)
    write(tmp_path, "in/d.csv", "Date,Payee,Debit\n2024-02-02,y,9\n")
    folder = f"file://{tmp_path}/in"
    table = spark.createDataFrame(
        [(f"{folder}/a [1].csv", "when", "WHAT", "in"), (f"{folder}/b.csv", None, "What", "Out"), (f"{folder}/none.csv", "x", "y", "z")],
        "source_file string, date string, desc string, amt string")
    loaded = load(spark, str(tmp_path / "in"), table)
    assert rows(loaded.ledger, "source_file", "Date", "Desc", "Amt") == [
        (f"{folder}/a [1].csv", "2024-01-01", "x", 1.0), (f"{folder}/b.csv", None, "x", 2.0), (f"{folder}/d.csv", "2024-02-02", "y", 9.0)]
    assert rows(loaded.rejects, "source_file", "headers") == [(f"{folder}/c.csv", ["When", "What", "In", "Out"])]


def test_headers_are_looked_at_with_a_known_encoding(spark, tmp_path):
    write(tmp_path, "in/a.csv", "Label,Date,Amount\ncaf\xe9,d,5\n".encode("latin1"))
    write(tmp_path, "in/b.csv", "Amount,Label,Date\n7,caf\xe9,d\n2,x,d\n".encode("latin1"))
    assert [tuple(row) for row in summarize_files(spark, str(tmp_path / "in")).collect()] == [("caf\xe9", 12.0), ("x", 2.0)]
    write(tmp_path, "out/a.csv", "Date,Payee,Debit\n2024-01-01,x,1\n")
    write(tmp_path, "out/b.csv", "Debit,Date,Payee\n7,2024-01-02,y\n")
    found = load_ledgers(spark, str(tmp_path / "out"), encoding="utf-8")
    assert rows(found, "Date", "Desc", "Amt") == [("2024-01-01", "x", 1.0), ("2024-01-02", "y", 7.0)]


def test_complete_listing(spark, tmp_path, monkeypatch):
    names = ["a.txt", ".hidden", "_under.csv", "empty.bin", "sub/.x/y.TXT", "sub/_e", "b c+é.txt"]
    for name in names:
        write(tmp_path, f"in/{name}", b"" if "e" in name else b"abc")
    folder = str(tmp_path / "in")
    for at_once in (2, 100):
        monkeypatch.setattr(files, "LISTED_AT_ONCE", at_once)
        listed = files.list_files(spark, folder, complete=True)
        assert {(row["path"].split("/in/")[1], row["length"]) for row in listed.collect()} == {
            (name, os.path.getsize(tmp_path / "in" / name)) for name in names}
    flat = files.list_files(spark, folder, recursive=False, complete=True)
    assert {row["name"] for row in flat.collect()} == {name for name in os.listdir(folder) if os.path.isfile(f"{folder}/{name}")}
    only = files.list_files(spark, folder, pattern="*.txt", complete=True)
    assert {row["name"] for row in only.collect()} == {"a.txt", "b c+é.txt"}
    assert listed.columns == files.list_files(spark, folder).columns and listed.dtypes == files.list_files(spark, folder).dtypes
    plan = inventory.export_plan(listed.withColumn("folder", F.lit("")))
    assert {row["name"] for row in plan.collect()} == {"a.txt", "b c+é.txt", "_under.csv", "y.TXT"} - {
        os.path.basename(name) for name in names if "e" in name}


def test_empty_inputs(spark, tmp_path):
    header_only = write(tmp_path, "h.csv", "Date,Payee,Debit\n")
    with pytest.raises((ValueError, MappingRequiredError)):
        load_ledgers(spark, header_only)
    one_column = write(tmp_path, "o.csv", "abc\n1\n")
    with pytest.raises((ValueError, MappingRequiredError)):
        load_ledgers(spark, one_column)
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="Nothing to read"):
        load_ledgers(spark, str(tmp_path / "none"))


def test_missing_spellings_and_zero_fill(spark, tmp_path):
    path = write(tmp_path, "a.csv", "Date,Payee,Debit\nNA,None,n/a\n,,\n2024-01-01,  ,(5)\n")
    ledger = load_ledgers(spark, path)
    assert rows(ledger, "Date", "Desc", "Amt") == sorted(
        [("2024-01-01", "Unknown", 5.0)], key=str)


def test_empty_column_takes_no_part(spark):
    df = spark.createDataFrame(
        [(None, "2024-01-01", "x", "", "5"), ("NA", None, None, None, None)],
        "`Old Date` string, `New Date` string, Payee string, Value string, Debit string")
    ledger = load_table(df)
    assert rows(ledger, "Date", "Desc", "Amt") == [("2024-01-01", "x", 5.0)]
    bare = df.drop("Payee")
    with pytest.raises(MappingRequiredError) as problem:
        load_table(bare)
    assert problem.value.columns == ["New Date", "Debit"]
    assert cleaning.drop_empty_columns(cleaning.nulls_at_read(df)).columns == ["New Date", "Payee", "Debit"]
    assert cleaning.drop_empty_rows(cleaning.nulls_at_read(df)).count() == 1


def test_numeric_amounts_and_keys(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01", "x", 5.5), (2, "2024-01-01", "y", None)], "id int, Date string, Name string, Total double")
    assert rows(load_table(df, ["id"]), "id", "Amt", "Category") == [
        (1, 5.5, "Other / Misc"), (2, 0.0, "Other / Misc")]


def test_roles():
    assert roles.infer_roles(["Txn Date", "Payee", "Debit"]) == {"Date": 0, "Desc": 1, "Amt": 2}
    assert roles.infer_roles([" DATE ", "Other Date", "Name", "Type", "Price", "Cost"]) == {
        "Date": 0, "Desc": 2, "Amt": 4}
    for headers in (["Value Date", "Payee", "Debit"], ["Foo", "Bar", "Baz"]):
        with pytest.raises(MappingRequiredError) as problem:
            roles.infer_roles(headers)
        assert problem.value.columns == headers


def test_explicit_mapping(spark):
    df = spark.createDataFrame([("2024-01-01", "x", "$5", "7")], "A string, B string, C string, D string")
    ledger = load_table(df, mapping={"DATE": " a", "desc": "B", "amt": "c"})
    assert rows(ledger, "Date", "Desc", "Amt", "CurrencyRank") == [("2024-01-01", "x", 5.0, 0)]
    partial = load_table(df, mapping={"amt": "D", "date": "nothing"})
    assert partial.columns == ["Amt", "CurrencyRank"]
    with pytest.raises(ValueError):
        load_table(df, mapping={"date": "A"})


def test_share_mode(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "x", "10", "2.5"), ("2024-01-01", "y", "10", "")],
        "Date string, Desc string, Cost string, `Your Share` string")
    assert rows(load_table(df, share_mode=True), "Desc", "Amt") == [("x", 2.5), ("y", 0.0)]
    bad = df.replace("2.5", "1.2.3", ["Your Share"])
    assert rows(load_table(bad), "Amt") == [(10.0,), (10.0,)]
    with pytest.raises(PySparkException, match="Unable to parse"):
        load_table(bad, share_mode=True).collect()


def test_header_names_and_currency():
    assert delimited.header_names('a,"b, c",,a', ",") == ["a", "b, c", "Unnamed: 2", "a.1"]
    assert roles.header_currency(["amount ($)", "fee €"]) == 1
    assert roles.header_currency(["amount rs", "A$"]) == 0
    assert roles.header_currency(["amount"]) is None


def test_same_headers_but_for_case(spark, tmp_path):
    path = write(tmp_path, "a.csv", "Date,date,Name,Price,price\n2024-01-01,b,x,5,6\n")
    assert rows(load_ledgers(spark, path), "Date", "Desc", "Amt") == [("2024-01-01", "x", 5.0)]
    (raw,) = delimited.read_delimited(spark, path)
    assert cleaning.normalize_headers(raw).columns[:5] == ["date", "date.1", "name", "price", "price.1"]


def test_summary(spark, tmp_path):
    path = write(tmp_path, "s.csv", "Label,Amount\ncaf\xe9,-5\nx,$2\ncaf\xe9,1\n,9\n".encode("latin1"))
    summary = summarize_files(spark, path)
    assert [tuple(r) for r in summary.collect()] == [("caf\xe9", 6.0), ("x", 2.0)]
    out = str(tmp_path / "out")
    sinks.write_csv(summary, out)
    back = spark.read.csv(out, header=True)
    assert back.columns == ["category", "amount"] and rows(back, "amount") == [("2.0",), ("6.0",)]
    with pytest.raises(ValueError, match="No category or value"):
        roles.summary_columns(["foo", "bar"])
    assert roles.summary_columns(["Total", "Tag", "Amount"]) == (1, 2)
    assert roles.summary_columns(["Total income", "Tag"]) == (1, 0)


def test_record_and_ledger_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write_records(df, str(tmp_path / "json"))
    assert rows(spark.read.json(str(tmp_path / "json")), "k", "v") == [(1, "a"), (2, "b")]
    sinks.write_ledger(df, str(tmp_path / "ledger"), ["k"])
    assert (tmp_path / "ledger" / "k=1").is_dir()


def test_list_files(spark, tmp_path):
    write(tmp_path, "in/a.TXT", "abc")
    write(tmp_path, "in/sub/b.tar.gz", "abcd")
    listed = files.list_files(spark, str(tmp_path / "in"))
    assert rows(listed, "name", "ext", "length") == [("a.TXT", ".txt", 3), ("b.tar.gz", ".gz", 4)]
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    only = files.list_files(spark, str(tmp_path / "in"), pattern="*.gz")
    assert rows(only, "name") == [("b.tar.gz",)]


TEXTS = [b"a", b"a\n", b"a\n\n", b"a\r\nb", b"a\x0bb", "a\u2028b".encode(), b"\n", b"x\r", b"x\x0c", b"a\nb\x1c",
         b"a\r\n", b"bad \xff\xfe\xe2\x82 end", "é€😀\n".encode(), b"\r\r\n\n\r", b"l\n" * 500 + b"tail\x1d"]


def test_text_profiles(spark, tmp_path):
    for i, content in enumerate(TEXTS):
        write(tmp_path, f"in/{i}.txt", content)
    decoded = [content.decode("utf-8", errors="replace") for content in TEXTS]
    wanted = sorted((f"{i}.txt", len(TEXTS[i]), len(t), len(t.splitlines())) for i, t in enumerate(decoded))
    for size in ("134217728", "64"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = files.profile_text_files(spark, str(tmp_path / "in")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted((r["path"].rsplit("/", 1)[1], r["length"], r["chars"], r["lines"]) for r in found) == wanted
    whole = files.read_texts(spark, str(tmp_path / "in")).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["text"] for r in whole} == {
        f"{i}.txt": t for i, t in enumerate(decoded)}


def test_report(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "pizza", "60.5"), ("2024-01-11", "uber", "$20"), ("2024-01-05", "pizza", "60.5"),
         ("2024-01-06", "pizza", "0")], "Date string, Payee string, Debit string")
    found = report_lines(load_table(df), period="May 2024").orderBy("section", "line").collect()
    text = {(r["section"], r["line"]): (r["label"], r["value"]) for r in found}
    assert text[0, 2] == ("Generated Period", "May 2024")
    assert text[0, 3] == ("Financial Health Score", "80 / 100")
    assert text[0, 6] == ("Total Transactions", "4")
    assert text[0, 7] == ("Daily Burn Rate", "$14.1")
    assert text[0, 8] == ("Monthly Projection", "$423.0")
    assert text[0, 9] == ("Top Category", "Food & Dining (85.8%)")
    assert text[1, 1] == ("Category", "Amount ($) Percentage")
    assert text[1, 2] == ("Food & Dining", "121.00 (85.8%)")
    assert text[1, 3] == ("Transport & Auto", "20.00 (14.2%)")
    assert text[2, 2] == ("Insight", "You spend ~6.0x more on Food & Dining compared to your 2nd highest category.")
    assert text[2, 3][1].startswith("Spending is highly concentrated")
    assert text[3, 1] == ("Highest Single Transaction", "$60.5")
    assert text[3, 2] == ("Lowest Single Transaction", "$20.0")
    assert text[3, 3] == ("Frequent small expenses detected in", "pizza")
    assert text[4, 1] == ("TIP", "Reduce Food & Dining spending by 15% -> Save $18.15/month")
    assert text[5, 1] == ("Category Balance", "80 / 100")
    assert text[5, 2] == ("Spending Control", "100 / 100")
    assert text[5, 3] == ("Risk Level", "Low")
    assert (3, 4) not in text and (4, 3) not in text
