"""Tables the queries run on, derived from the given Parquet tables.

The SQL is written once for both engines: ``{S}`` is the name of the text type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SQL = """
SELECT event_id, user_id, ts, value,
  CASE event_id % 12 WHEN 0 THEN 'STARBUCKS #12' WHEN 1 THEN 'Uber Eats order'
    WHEN 2 THEN 'Uber trip' WHEN 3 THEN 'AT&T bill' WHEN 4 THEN 'Amazon Prime'
    WHEN 5 THEN 'Amazon.com' WHEN 6 THEN 'City Pharmacy' WHEN 7 THEN 'Salary deposit'
    WHEN 8 THEN 'misc' WHEN 9 THEN '   ' WHEN 10 THEN NULL
    ELSE 'Barcelona tapas' END AS raw_desc,
  CASE event_id % 5 WHEN 0 THEN '$' || cast(value AS {S}) WHEN 1 THEN cast(value AS {S})
    WHEN 2 THEN '(' || cast(value AS {S}) || ')' WHEN 3 THEN 'n/a'
    ELSE '-' || cast(value AS {S}) END AS raw_amt,
  CASE event_id % 240 WHEN 4 THEN m || '-' || d || '-' || y
    WHEN 5 THEN m || '/' || d || '/' || substr(y, 3, 2) WHEN 6 THEN y || '.' || m || '.' || d
    WHEN 17 THEN y || m || d || 'T' || replace(clock, ':', '')
    WHEN 18 THEN d || ' ' || name || ' ' || substr(y, 3, 2) WHEN 29 THEN 'Mon, ' || d || ' ' || name || ' ' || y
    WHEN 30 THEN name || ' ' || y WHEN 31 THEN m || '/' || d || '/' || y || ' ' || half
    WHEN 42 THEN day || 'T' || clock || '+02' WHEN 43 THEN y || '-' || m WHEN 56 THEN name || ' ' || d || ', ' || y
    ELSE CASE event_id % 4 WHEN 0 THEN day WHEN 1 THEN m || '/' || d || '/' || y
      WHEN 2 THEN day || ' ' || clock ELSE 'bad date' END
    END AS raw_date
FROM (SELECT *, substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * cast(m AS int) - 2, 3) AS name,
    cast((cast(substr(clock, 1, 2) AS int) + 11) % 12 + 1 AS {S}) || substr(clock, 3, 3) ||
      CASE WHEN substr(clock, 1, 2) < '12' THEN ' AM' ELSE ' PM' END AS half
  FROM (SELECT *, substr(cast(ts AS {S}), 1, 10) AS day, substr(cast(ts AS {S}), 1, 4) AS y,
      substr(cast(ts AS {S}), 6, 2) AS m, substr(cast(ts AS {S}), 9, 2) AS d, substr(cast(ts AS {S}), 12, 8) AS clock
    FROM events))
"""

INVENTORY_SQL = """
SELECT '/in/' || source || '/b' || cast(cast(floor(doc_id / 50) AS bigint) AS {S}) ||
  '/doc_' || cast(doc_id % 50 AS {S}) ||
  CASE doc_id % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.mp4'
    WHEN 3 THEN '.mp3' WHEN 4 THEN '.txt' WHEN 5 THEN '.tar.gz' ELSE '' END AS path,
  CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars * 1024 END AS length,
  doc_id AS modified, doc_id
FROM documents
"""

# Converted outputs whose clean names clash with each other and with numbered names.
OUTPUT_SQL = """
SELECT '/out/' || cast(doc_id AS {S}) AS path,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'converted_' END ||
  CASE WHEN doc_id % 5 = 0 THEN 'page_' || cast(doc_id % 40 AS {S})
    WHEN doc_id % 5 = 1 THEN 'page' ELSE 'scan_' || lang END ||
  CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.tar.gz' END AS name,
  CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars END AS length, doc_id
FROM documents
"""


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sql(spark: SparkSession, folder: str, table: str, text: str) -> DataFrame:
    return spark.sql(
        text.format(S="string").replace(f"FROM {table}", "FROM {given}"),
        given=_table(spark, folder, table),
    )


def raw_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, "events", LEDGER_SQL)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, "documents", INVENTORY_SQL)


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, "documents", OUTPUT_SQL)


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with Markdown prefixes, euro signs and a blank second line."""
    prefixes = F.array(*[F.lit(p) for p in ("# ", "## ", "### ", "- ", "* ", "")])

    def marked(line: Column, index: Column) -> Column:
        prefix = F.get(prefixes, ((F.col("doc_id") + index) % 6).cast("int"))
        euro = F.when(F.col("doc_id") % 3 == 0, F.lit("€")).otherwise(F.lit(""))
        blank = F.when(index == 0, F.lit("\n")).otherwise(F.lit(""))
        return F.concat(prefix, line, euro, blank)

    return _table(spark, folder, "documents").select(
        "doc_id",
        F.array_join(F.transform(F.split("text", "\n", -1), marked), "\n").alias("text"),
    )
