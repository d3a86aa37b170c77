"""Numbering, merging, splitting and joining of sequences."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spendframe.operators import ordering, sequences


def pages(spark, sizes, gap=1):
    rows = [(doc, i * gap, f"{doc}:{i}") for doc, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id string, pos int, text string")


@pytest.mark.parametrize("block", [1, 3, 65536])
def test_number_rows(spark, block):
    sizes = {"a": 50, "b": 1, None: 7}
    numbered = ordering.number_rows(pages(spark, sizes, gap=2), ["doc_id"], "pos", block)
    assert {(r["doc_id"], r["pos"], r["seq"], r["total"]) for r in numbered.collect()} == {
        (doc, i * 2, i + 1, n) for doc, n in sizes.items() for i in range(n)}


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_sums_before(spark, block):
    rows = [("g", i, i * i) for i in range(30)] + [("h", 5, 2)]
    df = spark.createDataFrame(rows, "g string, p int, v bigint")
    found = ordering.sums_before(df, ["g"], "p", "v", "before", block)
    wanted = {("g", i): sum(j * j for j in range(i)) for i in range(30)} | {("h", 5): 0}
    assert {(r["g"], r["p"]): r["before"] for r in found.collect()} == wanted


@pytest.mark.parametrize("n,at,first,second", [
    (5, None, 2, 3), (1, None, 0, 1), (5, 9, 4, 1), (5, 1, 0, 5), (5, 0, 2, 3), (5, 3, 2, 3), (4, None, 1, 3)])
def test_split(spark, n, at, first, second):
    found = sequences.split(pages(spark, {"d": n}), at).orderBy("pos").collect()
    assert [(r["part"], r["part_pos"]) for r in found] == [
        *((1, i + 1) for i in range(first)), *((2, i + 1) for i in range(second))]


def test_split_at_column_and_merge_back(spark):
    df = pages(spark, {"x": 9, "y": 4}).withColumn("s", F.when(F.col("doc_id") == "x", 7))
    parts = sequences.split(df, "s")
    assert {(r["doc_id"], r["split_at"]) for r in parts.collect()} == {("x", 7), ("y", 2)}
    halves = parts.select(
        F.concat("doc_id", F.col("part").cast("string")).alias("half"), "doc_id", "part", "part_pos", "text")
    order = halves.select(F.col("doc_id").alias("merge_id"), F.col("part").alias("rank"), "half").distinct()
    merged = sequences.merge(halves.select("half", "part_pos", "text"), order, doc="half", pos="part_pos")
    assert sorted((r["merge_id"], r["new_pos"], r["text"]) for r in merged.collect()) == sorted(
        (d, i + 1, f"{d}:{i}") for d, n in (("x", 9), ("y", 4)) for i in range(n))


def test_merge_order_and_shared_documents(spark):
    df = pages(spark, {"a": 3, "b": 2, "c": 1})
    order = spark.createDataFrame(
        [(1, 0, "b"), (1, 5, "a"), (2, 1, "c"), (2, 2, "b"), (2, 3, "missing")],
        "merge_id int, rank int, doc_id string")
    found = sequences.merge(df, order).orderBy("merge_id", "new_pos").collect()
    assert [(r["merge_id"], r["new_pos"], r["text"]) for r in found] == [
        (1, 1, "b:0"), (1, 2, "b:1"), (1, 3, "a:0"), (1, 4, "a:1"), (1, 5, "a:2"),
        (2, 1, "c:0"), (2, 2, "b:0"), (2, 3, "b:1")]


def test_merge_needs_two(spark):
    order = spark.createDataFrame([(1, 0, "a")], "merge_id int, rank int, doc_id string")
    with pytest.raises(PySparkException, match="At least 2"):
        sequences.merge(pages(spark, {"a": 3}), order).collect()


def test_names(spark):
    order = spark.createDataFrame(
        [(1, 2, "x.pdf"), (1, 1, "my.report.pdf")], "merge_id int, rank int, name string")
    assert sequences.merged_names(order, "name").first()["name"] == "merged_my.report.pdf"
    named = order.select(sequences.split_name(F.col("name"), F.col("rank")).alias("n"))
    assert {r["n"] for r in named.collect()} == {"split_part2_x.pdf", "split_part1_my.report.pdf"}


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_join_text(spark, block):
    df = pages(spark, {"a": 23, "b": 1})
    found = {r["doc_id"]: r["text"] for r in sequences.join_text(df, block=block).collect()}
    assert found == {"a": "\n".join(f"a:{i}" for i in range(23)), "b": "b:0"}
    quoted = sequences.join_text(df, separator="'\\").filter("doc_id = 'a'").first()["text"]
    assert quoted == "'\\".join(f"a:{i}" for i in range(23))


def test_write_joined_text(spark, tmp_path):
    out = str(tmp_path / "joined")
    sequences.write_joined_text(pages(spark, {"a": 500, "b": 3}), out)
    for doc, n in (("a", 500), ("b", 3)):
        files = sorted((tmp_path / "joined" / f"doc_id={doc}").glob("part-*"))
        text = "".join(f.read_text() for f in files)
        assert text == "".join(f"{doc}:{i}\n" for i in range(n))


@pytest.mark.parametrize("file_bytes", [64, 1 << 20])
def test_packed_text(spark, tmp_path, file_bytes):
    out = str(tmp_path / "packed")
    odd = spark.createDataFrame([(None, 1, "no\nid"), (None, 0, ""), ("é", 3, "ü\n"), ("n", 0, None)],
                                "doc_id string, pos int, text string")
    df = pages(spark, {"a": 300, "b": 3, "c": 1}, gap=7).union(odd)
    sequences.write_packed_text(df, out, file_bytes=file_bytes, block=10)
    found = sequences.read_packed_text(spark, out).orderBy("file").collect()
    texts = {}
    for row in found:
        texts[row["doc_id"]] = texts.get(row["doc_id"], "") + row["text"]
    wanted = {doc: "".join(f"{doc}:{i}\n" for i in range(n)) for doc, n in (("a", 300), ("b", 3), ("c", 1))}
    assert texts == wanted | {None: "\nno\nid\n", "é": "ü\n\n"}
    some = sequences.read_packed_text(spark, out, spark.createDataFrame([("b",), ("x",)], "doc_id string"))
    assert {row["doc_id"] for row in some.collect()} == {"b"}
    assert (sum(row["doc_id"] == "a" for row in found) > 10) == (file_bytes == 64)


def test_packed_text_of_many_and_of_one_large_document(spark, tmp_path):
    out = str(tmp_path / "packed")
    small = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("pos"), F.concat(F.lit("d"), "id").alias("text"))
    large = spark.range(100_000).select(F.lit(-1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("pos"),
                                        F.concat(F.lit("part "), "id").alias("text"))
    sequences.write_packed_text(small.union(large), out, file_bytes=1 << 20)
    pieces = sequences.read_packed_text(spark, out)
    assert pieces.filter("doc_id >= 0 AND text = concat('d', doc_id, '\n')").select("doc_id").distinct().count() == 300_000
    whole = "".join(row["text"] for row in pieces.filter("doc_id = -1").orderBy("file").collect())
    assert whole == "".join(f"part {i}\n" for i in range(100_000))
    assert 4 < spark.read.parquet(f"{out}/manifest").select("file").distinct().count() < 64


def test_blocks(spark):
    source = "# T\n\n  ## U  \n### V\n- b\n* c\n#x\n-y\n \xa0 \nplain\n#### deep"
    df = spark.createDataFrame([(1, source), (2, "")], "doc_id int, text string")
    found = sequences.block_table(df).orderBy("block_no").collect()
    assert [tuple(r)[1:] for r in found] == [
        (0, "heading", 1, "T"), (1, "heading", 2, "U"), (2, "heading", 3, "V"), (3, "bullet", None, "b"),
        (4, "bullet", None, "c"), (5, "paragraph", None, "#x"), (6, "paragraph", None, "-y"),
        (7, "paragraph", None, "plain"), (8, "paragraph", None, "#### deep")]
    assert [r["line"] for r in sequences.line_table(df).filter("doc_id = 2").collect()] == [""]
