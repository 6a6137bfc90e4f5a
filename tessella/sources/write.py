"""Results as files of common formats. All tasks write their parts into a folder beside the target, which takes the target's
name when the last one is done, so a reader never sees half a result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv", "tsv", "bed", "bedgraph", "fasta")
_BED = ("chrom", "start", "end", "name", "score", "strand")


def _lines(df: DataFrame, kind: str, width: int) -> DataFrame:
    if kind == "fasta":
        name = F.concat(F.lit(">"), F.coalesce(F.col("name").cast("string"), F.lit("")))
        wrapped = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
        return df.where("sequence is not null").select(F.concat(name, F.lit("\n"), wrapped).alias("value"))
    if kind == "bedgraph":
        cols = ["chrom", "start", "end", "value"]
    else:  # optional columns as far as they follow one another
        cols = list(_BED[:3])
        for c in _BED[3:]:
            if c not in df.columns:
                break
            cols.append(c)
    filler = {"score": "0"}
    ordered = df.where("chrom is not null and start is not null and end is not null").repartitionByRange("chrom", "start", "end").sortWithinPartitions("chrom", "start", "end")
    return ordered.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(filler.get(c, "."))) for c in cols]).alias("value"))


def export_results(df: DataFrame, path: str, kind: str, overwrite: bool = False, width: int = 60) -> str:
    """Writes `df` to the folder `path`, on any file system that Spark knows, and returns it.

    csv and tsv have a header in each part; bed takes chrom, start, end and, as far as they are there, name, score, strand, sorted
    by place; bedgraph chrom, start, end, value; fasta name and sequence, in lines of `width`. Rows without a place or a sequence are
    left out. A target that exists raises FileExistsError unless overwrite, which drops it only when the new result is complete.
    """
    if kind not in FORMATS:
        raise ValueError(f"{kind!r} is none of {FORMATS}")
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path.rstrip("/"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    pending = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    try:
        if kind in ("parquet", "json"):
            getattr(df.write, kind)(pending)
        elif kind in ("csv", "tsv"):
            df.write.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(pending)
        else:
            _lines(df, kind, width).write.text(pending)
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(hadoop.Path(pending), target):
            raise OSError(f"could not rename {pending} to {path}")
    finally:
        if fs.exists(hadoop.Path(pending)):
            fs.delete(hadoop.Path(pending), True)
    return path
