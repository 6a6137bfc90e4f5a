"""The corpus pipeline: judge, near-dedup, cut repeats, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last give the columns of `documents`; rows in any other column stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import written
from tessella.llm.decontaminate import decontaminate
from tessella.llm.jaccard_join import jaccard_join
from tessella.llm.packing import pack_documents
from tessella.llm.queries import table, tokenizer
from tessella.llm.substring_dedup import substring_dedup
from tessella.llm.weak_labels import judge


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: no prose, or insulting."""
    return judge(docs, table(spark, sf_dir, "labels")).where("_quality.keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at 0.75 the document with the smallest id stays; rows without an id stay.

    Rows that share an id are documents of their own if their texts differ: of a group the row of the least (id, hash of
    the text) stays. Of rows that agree in id and text the first by their other columns stays.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    again = written(ids)
    if again.isEmpty():
        placed = jaccard_join(docs.select("doc_id", "text"), 5, 75)
        gone = placed.where("component_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    keyed = docs.withColumn("_row", row)
    placed = written(jaccard_join(keyed.select("_row", "text"), 5, 75, id_col="_row").where("_row is not null").distinct().join(keyed.select("_row", "doc_id").distinct(), "_row"))
    groups = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = placed.join(groups, "component_id").where("_row <> first._row").select("_row")
    kept = keyed.join(gone, "_row", "left_anti")
    twins = kept.join(again, "doc_id", "left_semi")
    order = F.row_number().over(Window.partitionBy("_row").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")]))
    twins = twins.withColumn("_n", order).where("_n = 1")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(twins.select(*docs.columns))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words that an earlier document has are cut out; n_chars follows. A text that loses nothing stays as it is."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    slim = docs.select("doc_id", "text", F.col("text").alias("_text"), *rest)
    out = substring_dedup(slim, 50)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("rest._text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("rest.n_chars"))
    values = {"doc_id": F.col("doc_id"), "text": text, "n_chars": chars}
    return out.select(*[values.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 10 consecutive words of a benchmark item go."""
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    values = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return out.where("n_hit = 0").select(*[values.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"), 2048, 1)


STAGES = [("quality_classifier", quality), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", repeats), ("benchmark_decontamination", benchmark), ("packing", packing)]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
