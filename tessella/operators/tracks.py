"""Features along sequences, contacts between places, call sets side by side, count tables, and the numbers behind plots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import clean, materialized, null_safe_join, quantiles, running
from tessella.operators.intervals import gaps, merge


def peak_merge(peaks: DataFrame, max_gap: int = 50, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """Peaks that overlap or lie within `max_gap` as one: chrom, start, end, n, width."""
    return merge(peaks, chrom, start, end, max_gap).withColumn("width", F.col("end") - F.col("start"))


def intergenic(genes: DataFrame, min_length: int = 0) -> DataFrame:
    """Regions between merged genes of a sequence, at least `min_length` long; the ends of the sequence are left out."""
    return gaps(genes).where(F.col("length") >= min_length)


def gene_density(genes: DataFrame, window: int) -> DataFrame:
    """All windows of a sequence up to the end of its last gene: start, end, n_features that overlap it, their number per 1,000
    positions, the positions that genes cover and their share. Genes without length are left out; the last window may be shorter."""
    genes = genes.where(F.col("end") > F.col("start"))
    limit = genes.groupBy("chrom").agg(F.max("end").alias("_limit"))
    every = limit.select("chrom", "_limit", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_limit") - 1) / window))).alias("window"))
    at = lambda c: F.floor(c / window)
    # a gene counts from the window of its start to that of its last position: steps up and down, summed along the windows
    step = F.explode(F.array(F.struct(at(F.col("start")).alias("window"), F.lit(1).alias("step")), F.struct((at(F.col("end") - 1) + 1).alias("window"), F.lit(-1).alias("step"))))
    steps = genes.select("chrom", step.alias("e")).groupBy("chrom", F.col("e.window").alias("window")).agg(F.sum("e.step").alias("step"))
    runs = merge(genes).withColumn("window", F.explode(F.sequence(at(F.col("start")), at(F.col("end") - 1))))
    inside = F.least(F.col("end"), (F.col("window") + 1) * window) - F.greatest(F.col("start"), F.col("window") * window)
    covered = runs.groupBy("chrom", "window").agg(F.sum(inside).alias("covered"))
    t = every.join(steps, ["chrom", "window"], "left").join(covered, ["chrom", "window"], "left").na.fill(0, ["step", "covered"])
    t = running(t, ["window"], ["chrom"], n_features=("sum", F.col("step")))
    start, end = F.col("window") * window, F.least((F.col("window") + 1) * window, F.col("_limit"))
    return t.select("chrom", start.alias("start"), end.alias("end"), "n_features", (F.col("n_features") * 1000.0 / (end - start)).alias("per_kb"), "covered", (F.col("covered") / (end - start)).alias("fraction"))


def vcf_merge(a: DataFrame, b: DataFrame, genotype: str = "gt", site: tuple[str, ...] = ("chrom", "pos", "ref", "alt")) -> DataFrame:
    """Sites of either call set with both genotypes, `./.` where a set has none. Sites are taken to be unique in a set."""
    left, right = (t.select(*site, F.col(genotype).alias(name)) for t, name in ((a, "gt_a"), (b, "gt_b")))
    return left.join(right, list(site), "full").select(*site, *[F.coalesce(c, F.lit("./.")).alias(c) for c in ("gt_a", "gt_b")])


def vcf_concordance(query: DataFrame, truth: DataFrame, genotype: str = "gt", site: tuple[str, ...] = ("chrom", "pos", "ref", "alt")) -> DataFrame:
    """Shared and private sites, precision, recall and F1 of the query's sites, and the share of shared sites of equal genotype."""
    left, right = (t.select(*site, F.col(genotype).alias(name), F.lit(True).alias(f"in_{name}")) for t, name in ((query, "q"), (truth, "t")))
    both = F.col("in_q") & F.col("in_t")
    s = left.join(right, list(site), "full").agg(F.count_if(both).alias("shared"), F.count_if(F.col("in_t").isNull()).alias("only_query"), F.count_if(F.col("in_q").isNull()).alias("only_truth"), F.count_if(both & F.col("q").eqNullSafe(F.col("t"))).alias("equal"))
    part = lambda x, y: F.when(y > 0, x / y)
    k, q, t = F.col("shared"), F.col("shared") + F.col("only_query"), F.col("shared") + F.col("only_truth")
    return s.select("shared", "only_query", "only_truth", part(k, q).alias("precision"), part(k, t).alias("recall"), part(2 * k, q + t).alias("f1"), part(F.col("equal"), k).alias("genotype_concordance"))


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Contacts within a sequence (cis) and between two (trans), and the share of cis."""
    cis = F.col("chrom1") == F.col("chrom2")
    return pairs.agg(F.count_if(cis).alias("cis"), F.count_if(~cis).alias("trans")).withColumn("total", F.col("cis") + F.col("trans")).withColumn("cis_fraction", F.when(F.col("total") > 0, F.col("cis") / F.col("total")))


def contact_matrix(pairs: DataFrame, resolution: int, trans: bool = False) -> DataFrame:
    """Counts of contacts by pair of bins, the lower end first; pairs between sequences only if asked for."""
    one, other = (F.struct(F.col(f"chrom{i}").alias("c"), F.floor(F.col(f"pos{i}") / resolution).alias("b")) for i in (1, 2))
    t = pairs if trans else pairs.where("chrom1 = chrom2")
    t = t.select(F.least(one, other).alias("x"), F.greatest(one, other).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    return t.select(F.col("x.c").alias("chrom1"), F.col("x.b").alias("bin1"), F.col("y.c").alias("chrom2"), F.col("y.b").alias("bin2"), "n")


def distance_decay(contacts: DataFrame, start1: str, start2: str, count: str, bins: int = 20, max_distance: float = 0) -> DataFrame:
    """All bins of growing width (equal ratios) between the least distance above zero and the largest, or `max_distance`: bin,
    low, high, contacts (rows), pairs (sum of counts), mean_count, share (of the pairs at any distance above zero)."""
    d, c = F.abs(clean(start2) - clean(start1)), F.floor(clean(count))
    t = contacts.select(d.alias("d"), c.alias("c")).where("d > 0 and c is not null")
    # one row for each distance, written once: the contacts are read once, the rest comes from their sums
    t = materialized(t.groupBy("d").agg(F.count(F.lit(1)).alias("contacts"), F.sum("c").alias("pairs")))
    low, high, grand = t.agg(F.min("d"), F.max("d"), F.sum("pairs")).first()
    if low is None:
        return contacts.sparkSession.createDataFrame([], "bin int, low double, high double, contacts long, pairs long, mean_count double, share double")
    high = max(float(max_distance or high), low + 1)
    low = max(1.0, low)
    edges = [low, *[10 ** (math.log10(low) + (math.log10(high) - math.log10(low)) * k / bins) for k in range(1, bins)], high]
    every = contacts.sparkSession.createDataFrame([(k, edges[k], edges[k + 1]) for k in range(bins)], "bin int, low double, high double")
    at = sum((F.col("d") >= e).cast("int") for e in edges[1:-1])
    inside = (F.col("d") >= edges[0]) & (F.col("d") <= edges[-1])
    n = t.groupBy(F.when(inside, at).alias("bin")).agg(F.sum("contacts").alias("contacts"), F.sum("pairs").alias("pairs"))
    out = every.join(n, "bin", "left").na.fill(0, ["contacts", "pairs"])
    return out.select("bin", "low", "high", "contacts", "pairs", F.when(F.col("contacts") > 0, F.col("pairs") / F.col("contacts")).otherwise(0.0).alias("mean_count"), (F.col("pairs") / F.lit(grand)).alias("share"))


def counts_normalize(rows: DataFrame, key: str, count: str, length: str) -> DataFrame:
    """CPM, FPKM and TPM of counts over features of some length."""
    c, size = clean(count), clean(length)
    t = rows.select(F.col(key).alias("key"), c.alias("_c"), F.when(size > 0, size / 1000).alias("_kb"))
    sums = t.agg(F.sum("_c").alias("_total"), F.sum(F.col("_c") / F.col("_kb")).alias("_rates"))
    t = t.crossJoin(F.broadcast(sums))  # one row
    part = lambda x, y: F.when(y > 0, x / y)
    return t.select("key", (part(F.col("_c"), F.col("_total")) * 1e6).alias("cpm"), (part(F.col("_c") / F.col("_kb"), F.col("_total")) * 1e6).alias("fpkm"), (part(F.col("_c") / F.col("_kb"), F.col("_rates")) * 1e6).alias("tpm"))


def highly_variable(cells: DataFrame, gene: str, value: str, n_top: int, min_mean: float = float("-inf"), max_mean: float = float("inf")) -> DataFrame:
    """The `n_top` genes of largest dispersion (sample variance over mean, 0 where that is no number); ties by gene."""
    v = clean(value)
    s = cells.groupBy(F.col(gene).alias("key")).agg(F.avg(v).alias("mean"), F.var_samp(v).alias("variance")).where(F.col("mean").between(min_mean, max_mean))
    ratio = F.when(F.col("mean") != 0, F.col("variance") / F.col("mean"))
    return s.withColumn("dispersion", F.coalesce(ratio, F.lit(0.0))).orderBy(F.desc("dispersion"), "key").limit(n_top)


def box_cox(cells: DataFrame, value: str = "value", lam: float = 0.0, shift: float = 0.0) -> DataFrame:
    """Box and Cox's transform with a given lambda; values not above 0 after the shift are missing."""
    v = clean(value) + shift
    return cells.withColumn(value, F.when(v > 0, F.log(v) if lam == 0 else (F.pow(v, F.lit(lam)) - 1) / lam))


def rarefaction(cells: DataFrame, sample: str, value: str, depth: int) -> DataFrame:
    """Expected species among `depth` individuals of a sample, missing where it has fewer."""
    v = clean(value)
    t = cells.where(v > 0).select(F.col(sample).alias("key"), v.alias("x"))
    t = t.join(t.groupBy("key").agg(F.sum("x").alias("n")), "key")
    none = F.aggregate(F.sequence(F.lit(0), F.lit(depth - 1)), F.lit(1.0), lambda p, i: p * F.greatest(F.col("n") - F.col("x") - i, F.lit(0.0)) / F.greatest(F.col("n") - i, F.lit(1.0)))
    return t.groupBy("key").agg(F.when(F.first("n") >= depth, F.sum(1 - none)).alias("expected"), F.count(F.lit(1)).alias("observed"))


def balance(rows: DataFrame, treated: str, matched: str, covariates: list[str]) -> DataFrame:
    """By covariate: the difference of the means of treated (1) and others (0) over the root of the mean of both variances,
    and the ratio of the variances, over all rows (before) and over the matched ones (after). Groups of one row, or without
    spread, give no number; missing values are left out."""
    long = rows.select(F.col(treated).alias("t"), F.coalesce(F.col(matched).cast("boolean"), F.lit(False)).alias("m"), F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), clean(c).alias("v")) for c in covariates])).alias("e")).select("t", "m", "e.*")
    aggregates, out = [], []
    for when, which in (("before", F.lit(True)), ("after", F.col("m"))):
        for t in (0, 1):
            v = F.when(which & (F.col("t") == t), F.col("v"))
            aggregates += [F.avg(v).alias(f"m{t}_{when}"), F.var_samp(v).alias(f"v{t}_{when}")]
        pooled = F.sqrt((F.col(f"v1_{when}") + F.col(f"v0_{when}")) / 2)
        out += [F.when(pooled > 0, (F.col(f"m1_{when}") - F.col(f"m0_{when}")) / pooled).alias(f"smd_{when}"), F.when(F.col(f"v0_{when}") > 0, F.col(f"v1_{when}") / F.col(f"v0_{when}")).alias(f"vr_{when}")]
    return long.groupBy("covariate").agg(*aggregates).select("covariate", *out)


def histogram(rows: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """All bins of equal width between the least and the largest value: bin, low, n."""
    v = clean(value)
    low, high = rows.agg(F.min(v), F.max(v)).first()
    every = rows.sparkSession.range(bins if low is not None else 0).select(F.col("id").cast("int").alias("bin"))
    if low is None:
        return every.select("bin", F.lit(None).cast("double").alias("low"), F.lit(0).cast("long").alias("n"))
    span = (high - low) or 1.0
    n = rows.where(v.isNotNull()).groupBy(F.least(F.floor((v - low) / span * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "bin", "left").select("bin", (low + span * F.col("bin") / bins).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def boxplot(rows: DataFrame, group: str, value: str) -> DataFrame:
    """By group: quartiles, whiskers (the furthest values within 1.5 IQR of the box) and how many values lie beyond."""
    t = rows.select(F.col(group).alias("key"), clean(value).alias("v")).where("v is not null")
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    inside = F.col("v").between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    t = null_safe_join(t, quantiles(t, ["key"], "v", [0.25, 0.5, 0.75]), ["key"])
    held = F.when(inside, F.col("v"))
    return t.groupBy("key", "q").agg(F.min(held).alias("low"), F.max(held).alias("high"), F.count_if(~inside).alias("outliers")).select("key", "low", q1.alias("q1"), q2.alias("median"), q3.alias("q3"), "high", "outliers")
