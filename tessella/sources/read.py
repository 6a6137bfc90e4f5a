"""One entry for all readers: `read(spark, path)` picks by extension (compression aside), or by name.

Fixed-column text formats are Spark CSV scans with an explicit schema, so they split, prune columns and push filters
down; record formats are text scans with the record separator as line separator. Gzip and bzip2 go through Hadoop's
codecs, so every path that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of the fixed-column formats, as DDL. Fixed values.
TABLES = {
    "bed": "chrom string, chromStart long, chromEnd long, name string, score double, strand string, thickStart long, thickEnd long, itemRgb string, blockCount int, blockSizes string, blockStarts string",
    "bedgraph": "chrom string, chromStart long, chromEnd long, value double",
    "narrowpeak": "chrom string, chromStart long, chromEnd long, name string, score double, strand string, signalValue double, pValue double, qValue double, peak long",
    "broadpeak": "chrom string, chromStart long, chromEnd long, name string, score double, strand string, signalValue double, pValue double, qValue double",
    "bedpe": "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long, name string, score double, strand1 string, strand2 string",
    "gff": "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string",
    "gaf": "db string, db_object_id string, db_object_symbol string, qualifier string, go_id string, db_reference string, evidence_code string, with_or_from string, aspect string, db_object_name string, db_object_synonym string, db_object_type string, taxon string, date string, assigned_by string, annotation_extension string, gene_product_form_id string",
    "fai": "name string, length long, offset long, linebases long, linewidth long",
    "chromsizes": "chrom string, size long",
    "blast6": "qseqid string, sseqid string, pident double, length long, mismatch long, gapopen long, qstart long, qend long, sstart long, send long, evalue double, bitscore double",
    "paf": "query string, query_length long, query_start long, query_end long, strand string, target string, target_length long, target_start long, target_end long, matches long, block long, mapq int",
    "genepred": "name string, chrom string, strand string, txStart long, txEnd long, cdsStart long, cdsEnd long, exonCount int, exonStarts string, exonEnds string",
    "cytoband": "chrom string, chromStart long, chromEnd long, name string, gieStain string",
    "bim": "chrom string, id string, cm double, pos long, a1 string, a2 string",
    "fam": "fid string, iid string, father string, mother string, sex int, phenotype double",
}
#: Extensions and the reader each goes to. Fixed values.
EXTENSIONS = {
    "bed": "bed", "bedgraph": "bedgraph", "bdg": "bedgraph", "narrowpeak": "narrowpeak", "broadpeak": "broadpeak", "bedpe": "bedpe", "gff": "gff", "gff2": "gff", "gff3": "gff", "gtf": "gff", "gaf": "gaf",
    "fai": "fai", "sizes": "chromsizes", "blast6": "blast6", "b6": "blast6", "blasttab": "blast6", "paf": "paf", "genepred": "genepred", "cytoband": "cytoband", "bim": "bim", "fam": "fam", "vcf": "vcf",
    "sam": "sam", "fasta": "fasta", "fa": "fasta", "fna": "fasta", "faa": "fasta", "fastq": "fastq", "fq": "fastq", "gmt": "gmt", "gct": "gct", "csv": "csv", "tsv": "tsv", "txt": "tsv", "tab": "tsv",
    "parquet": "parquet", "orc": "orc", "json": "json", "jsonl": "json", "ndjson": "json",
}
_BLANKS = ("bim", "fam")


def fixed_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a fixed-column format: comments, and track and browser lines left out; missing trailing columns are null."""
    names, types = zip(*(c.strip().split() for c in TABLES[kind].split(",")), strict=True)
    lines = spark.read.text(path).where(~F.col("value").rlike("^(#|track |browser |!|$)"))
    parts = F.split("value", "\\s+" if kind in _BLANKS else "\t")
    at = lambda i: F.try_element_at(parts, F.lit(i + 1))
    return lines.select(*[at(i).try_cast(t).alias(n) for i, (n, t) in enumerate(zip(names, types, strict=True))])


def attributes(df: DataFrame, column: str = "attributes") -> DataFrame:
    """Adds a map of GFF3 (key=value) or GTF (key "value") attributes; of a repeated key the first counts."""
    pairs = F.filter(F.transform(F.split(column, ";(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda x: F.trim(x)), lambda x: x != "")
    key = lambda x: F.regexp_extract(x, r"^([^\s=]+)", 1)
    value = lambda x: F.regexp_extract(x, r"^[^\s=]+[\s=]+\"?(.*?)\"?$", 1)
    entries = F.transform(pairs, lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))
    seen = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(F.map_concat(m, F.create_map(e["k"], e["v"]))))
    return df.withColumn("attribute_map", seen)


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Records of a VCF, one row for each alternative allele: site columns, alt_index, and samples as an array of fields in file order."""
    lines = spark.read.text(path)
    p = F.split("value", "\t")
    base = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(p.alias("p"))
    g = lambda i: F.try_element_at("p", F.lit(i))
    site = base.select(g(1).alias("chrom"), g(2).cast("long").alias("pos"), g(3).alias("id"), g(4).alias("ref"), F.posexplode(F.split(g(5), ",")).alias("alt_index", "alt"), g(6).try_cast("double").alias("qual"), g(7).alias("filter"), g(8).alias("info"), g(9).alias("format"), F.when(F.size("p") > 9, F.slice("p", 10, F.size("p") - 9)).alias("samples"))
    return site.withColumn("alt_index", F.col("alt_index") + 1)


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the header line."""
    row = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    return row["value"].split("\t")[9:] if row else []


def vcf_dosages(spark: SparkSession, path: str) -> DataFrame:
    """Long dosages: chrom, pos, ref, alt, sample, dosage (copies of this alternative; null if any allele is missing)."""
    names = vcf_samples(spark, path)
    rows = vcf(spark, path).select("chrom", "pos", "ref", "alt", "alt_index", F.posexplode("samples").alias("i", "field"))
    alleles = F.split(F.split_part("field", F.lit(":"), F.lit(1)), "[/|]")
    count = F.aggregate(alleles, F.lit(0), lambda n, x: n + (x == F.col("alt_index").cast("string")).cast("int"))
    known = ~F.exists(alleles, lambda x: x == ".")
    return rows.select("chrom", "pos", "ref", "alt", F.element_at(F.lit(names), F.col("i") + 1).alias("sample"), F.when(known, count).alias("dosage"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records with the eleven fixed fields and the flags that statistics need."""
    p = F.split("value", "\t")
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    kinds = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    out = rows.select(*[F.try_element_at(p, F.lit(i + 1)).try_cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(names)])
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    return out.withColumns({"paired": bit(1), "unmapped": bit(4), "reverse": bit(16), "secondary": bit(256), "duplicate": bit(1024), "supplementary": bit(2048)})


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, description, sequence. Records part at `>` at the start of a line."""
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    head = F.regexp_replace(F.regexp_replace(F.substring_index("value", "\n", 1), "^>", ""), "\r$", "")
    body = F.regexp_replace(F.when(F.instr("value", "\n") > 0, F.substr("value", F.instr("value", "\n"))).otherwise(""), "\\s", "")
    return rows.select(F.split(head, "\\s+")[0].alias("id"), F.regexp_extract(head, "^\\S+\\s+(.*)$", 1).alias("description"), body.alias("sequence"))


def fastq(spark: SparkSession, path: str, phred_offset: int = 33) -> DataFrame:
    """id, sequence, quality, mean_quality of four-line records.

    Records part at a line end with `@` behind, so the scan splits. Where a quality line begins with `@` that is wrong; if
    any piece is not a whole record, all lines are numbered by file and block instead and put together by fours.
    """
    rows = spark.read.option("lineSep", "\n@").text(path).where(F.trim("value") != "")
    p = F.split(F.regexp_replace(F.regexp_replace("value", "^@", ""), "\\s+$", ""), "\r?\n")
    pieces = rows.select(p.alias("p"))
    odd = (F.size("p") != 4) & ~((F.size("p") == 3) & (F.col("p")[1] == ""))
    whole = pieces if pieces.where(odd).isEmpty() else _numbered_fours(spark, path)
    codes = F.transform(F.sequence(F.lit(1), F.length("quality")), lambda i: F.ascii(F.substr("quality", i, F.lit(1))) - phred_offset)
    at = lambda i: F.coalesce(F.try_element_at("p", F.lit(i)), F.lit(""))
    out = whole.select(F.split(at(1), "\\s+")[0].alias("id"), at(2).alias("sequence"), at(4).alias("quality"))
    return out.withColumn("mean_quality", F.when(F.length("quality") > 0, F.aggregate(codes, F.lit(0), lambda s, x: s + x) / F.length("quality")))


def _numbered_fours(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    counts = lines.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = lines.withColumn("k", F.row_number().over(Window.partitionBy("f", "b").orderBy("m")) - 1).join(before, ["f", "b"]).withColumn("k", F.col("k") + F.col("before"))
    fours = numbered.groupBy("f", F.floor(F.col("k") / 4).alias("r")).agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("x")).where(F.size("x") == 4)
    return fours.select(F.transform("x", lambda x: F.regexp_replace(x["value"], "^@", "")).alias("p"), F.col("x")[3]["value"].alias("q")).select(F.concat(F.slice("p", 1, 3), F.array("q")).alias("p"))


def gmt(spark: SparkSession, path: str) -> DataFrame:
    """(term, gene) pairs of gene sets."""
    p = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(p[0].alias("term"), p[1].alias("description"), F.explode(F.slice(p, 3, 1 << 20)).alias("gene")).where("gene <> ''")


def gct(spark: SparkSession, path: str) -> DataFrame:
    """Long cells of an expression matrix: gene, sample, value."""
    lines = spark.read.text(path)
    names = next(r["value"].split("\t")[2:] for r in lines.where(F.lower("value").startswith("name\t")).limit(1).collect())
    p = F.split("value", "\t")
    body = lines.where((F.size(p) == len(names) + 2) & ~F.lower("value").startswith("name\t"))
    return body.select(p[0].alias("gene"), F.posexplode(F.slice(p, 3, len(names))).alias("i", "v")).select("gene", F.element_at(F.lit(names), F.col("i") + 1).alias("sample"), F.col("v").try_cast("double").alias("value"))


def matrix(df: DataFrame, label: str, value_name: str = "value", axis: str = "feature") -> DataFrame:
    """Wide to long: every column but the label as a feature; values as numbers, what is none is missing."""
    rest = [c for c in df.columns if c != label]
    return df.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias(axis), F.col(f"`{c}`").cast("string").try_cast("double").alias(value_name)) for c in rest])).alias("x")).select(label, f"x.{axis}", f"x.{value_name}")


def _csv(sep: str) -> Callable[..., DataFrame]:
    return lambda spark, path, schema=None: (spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)).csv(path, header=True, sep=sep)


READERS: dict[str, Callable[..., DataFrame]] = {k: (lambda spark, path, kind=k: fixed_table(spark, path, kind)) for k in TABLES} | {
    "vcf": vcf, "sam": sam, "fasta": fasta, "fastq": fastq, "gmt": gmt, "gct": gct, "csv": _csv(","), "tsv": _csv("\t"),
    "parquet": lambda spark, path: spark.read.parquet(path), "orc": lambda spark, path: spark.read.orc(path), "json": lambda spark, path: spark.read.json(path),
}


def pick_reader(path: str, reader: str | None = None) -> str:
    if reader:
        if reader not in READERS:
            raise ValueError(f"no reader {reader}")
        return reader
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")
    if parts[-1] in ("gz", "bz2", "zst"):
        parts = parts[:-1]
    if len(parts) < 2 or parts[-1] not in EXTENSIONS:
        raise ValueError(f"no reader for {path}; name one")
    return EXTENSIONS[parts[-1]]


def read(spark: SparkSession, path: str, reader: str | None = None, **options) -> DataFrame:
    return READERS[pick_reader(path, reader)](spark, path, **options)
