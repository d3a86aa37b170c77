"""The pipeline on planted documents."""

import corpus_pipeline
from spendframe.llm import packing
from test_operators import prose


def test_stages(spark, tmp_path):
    leak = prose(900, 40)
    rows = [(i, prose(i, 200), "en", f"s{i % 3}", 1, "x") for i in range(40)]
    rows += [(50, prose(3, 200), "en", "s0", 1, "x"), (51, prose(700, 90) + " " + leak, "en", "s1", 1, "x"),
             (52, prose(800, 200).replace(" ", "### "), "en", "s2", 1, "x"), (53, None, None, None, 1, None), (54, "", "en", "s0", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    folder = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    junk = [(100 + i, 0) for i in range(5)]
    spark.createDataFrame([(i, 1) for i in range(40)] + [(52, 0)] + junk, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, folder)
        assert result.columns == docs.columns
        result.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        left.append({row["doc_id"] for row in docs.collect()})
    clean = set(range(40))
    assert left[:3] == [clean | {50, 51}, clean | {51}, clean]
    assert left[3] <= clean
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packing.unpack(packed).count() == docs.count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, data, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_named_like_the_operators_own(spark, tmp_path):
    """Columns that stages make for themselves, in documents with repeated rows, without labels or items."""
    names = ["again_id", "again_key", "gone_id", "copies", "content", "component_id", "size", "score", "Kept"]
    rows = [(i, prose(i // 2, 120), "en", "s0", 1, *"abcdefghi") for i in (0, 1, 2, 3, 4, 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{name} string" for name in names)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, str(tmp_path))
        assert result.columns == docs.columns
        result.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append(sorted(row["doc_id"] for row in docs.collect()))
        assert all(tuple(row)[5:] == tuple("abcdefghi") for row in docs.collect())
    assert left[:3] == [[0, 1, 2, 3, 4, 4], [0, 2, 4], [0, 2, 4]]
    assert packing.unpack(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))).count() == docs.count()
