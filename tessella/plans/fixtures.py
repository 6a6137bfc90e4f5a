"""The tables that queries run on, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """part x flag: the summed quantity."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag")).agg(F.sum("l_quantity").alias("value"))


CELLS = "cells AS (SELECT l_partkey AS part, l_returnflag AS flag, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def holes(spark: SparkSession, d: str) -> DataFrame:
    """The same with missing cells: flag A of every seventh part."""
    return cells(spark, d).withColumn("value", F.when(~((F.col("part") % 7 == 0) & (F.col("flag") == "A")), F.col("value")))


HOLES = CELLS + ", holes AS (SELECT part, flag, CASE WHEN NOT (part % 7 = 0 AND flag = 'A') THEN value END AS value FROM cells)"


def pvalues(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), ((F.col("o_orderkey") * 7919 % 9973 + 1) / 9974.0).alias("p"))


PVALUES = "pv AS (SELECT o_orderkey AS key, (o_orderkey * 7919 % 9973 + 1) / 9974.0::DOUBLE AS p FROM orders)"


def intervals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders (a) and their shipments (b) as intervals of days, on 100 sequences named by priority and customer."""
    chrom = F.concat_ws("-", "o_orderpriority", F.col("o_custkey") % 20).alias("chrom")
    o = table(spark, d, "orders").select("o_orderkey", chrom, F.unix_date(F.to_date("o_orderdate")).cast("long").alias("start"))
    a = o.select(F.col("o_orderkey").alias("id"), "chrom", "start", (F.col("start") + 1 + F.col("o_orderkey") % 30).alias("end"))
    s = F.unix_date(F.to_date("l_shipdate")).cast("long")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(s).alias("start"), F.max(F.col("l_quantity").cast("long")).alias("q"))  # before the join: one row an order is shuffled
    met = li.join(o.select(F.col("o_orderkey").alias("id"), "chrom"), "id").groupBy("id", "chrom").agg(F.min("start").alias("start"), F.max("q").alias("q"))
    b = met.select("id", "chrom", "start", (F.col("start") + 1 + F.col("q")).alias("end"))
    return a, b


INTERVALS = """o AS (SELECT o_orderkey, o_orderpriority || '-' || o_custkey % 20 AS chrom, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders),
a AS (SELECT o_orderkey AS id, chrom, s, s + 1 + o_orderkey % 30 AS e FROM o),
b AS (SELECT l_orderkey AS id, chrom, min(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS s,
    min(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) + 1 + max(CAST(l_quantity AS BIGINT)) AS e
  FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def dosages(spark: SparkSession, d: str) -> DataFrame:
    """variant (part number modulo 100), sample (customer), dosage 0 to 2."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.groupBy((F.col("l_partkey") % 100).alias("variant"), (F.col("o_custkey") % 200).alias("sample")).agg((F.sum("l_linenumber") % 3).alias("dosage"))


DOSAGES = "dosages AS (SELECT l_partkey % 100 AS variant, o_custkey % 200 AS sample, sum(l_linenumber) % 3 AS dosage FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def lives(spark: SparkSession, d: str) -> DataFrame:
    """Days from order to shipping as survival times: event if the item was returned, grouped by priority."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    li = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(F.abs(F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))).cast("long").alias("time"), (F.col("l_returnflag") == "R").cast("long").alias("event"), F.col("o_orderpriority").alias("grp"))


LIVES = "lives AS (SELECT abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS time, CAST(l_returnflag = 'R' AS BIGINT) AS event, o_orderpriority AS grp FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents: quality against length, and a risk from it."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "quality", "toxic", F.col("n_chars").cast("double").alias("score"), (F.least(F.col("n_chars"), F.lit(8000)) / 8001.0).alias("risk"))


SCORED = "scored AS (SELECT l.doc_id, quality, toxic, CAST(n_chars AS DOUBLE) AS score, least(n_chars, 8000) / 8001.0::DOUBLE AS risk FROM labels l JOIN documents USING (doc_id))"


def dna(spark: SparkSession, d: str) -> DataFrame:
    """Texts as sequences: the letters A, C, G, T and N of every document, whole."""
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(F.translate(F.upper("text"), "EIO", "CGT"), "[^ACGTN]", "").alias("seq"))


DNA = "dna AS (SELECT doc_id, regexp_replace(translate(upper(text), 'EIO', 'CGT'), '[^ACGTN]', '', 'g') AS seq FROM documents)"
