"""Curves of a binary target against a score. Work goes over distinct scores, counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import clean, global_row_number, running_sum


def roc_points(rows: DataFrame, target: str, score: str) -> DataFrame:
    """For each distinct score, from the top: threshold, tp, fp, and the totals."""
    s = clean(score)
    tally = rows.where(s.isNotNull() & F.col(target).isNotNull()).groupBy(s.alias("threshold")).agg(F.sum(F.col(target).cast("long")).alias("p"), F.sum(1 - F.col(target).cast("long")).alias("q"))
    ranked = global_row_number(tally.withColumn("_s", -F.col("threshold")), "_s", name="_k")
    tp = running_sum(ranked, "_k", "p", "tp")
    both = running_sum(tp, "_k", "q", "fp")
    total = tally.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    return both.crossJoin(total).select("threshold", "tp", "fp", "p", "q", "positives", "negatives")


def roc_curve(rows: DataFrame, target: str, score: str) -> DataFrame:
    return roc_points(rows, target, score).select("threshold", (F.col("tp") / F.col("positives")).alias("tpr"), (F.col("fp") / F.col("negatives")).alias("fpr"))


def precision_recall_curve(rows: DataFrame, target: str, score: str) -> DataFrame:
    return roc_points(rows, target, score).select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("positives")).alias("recall"))


def auc(rows: DataFrame, target: str, score: str) -> DataFrame:
    """Area under the ROC curve (ties by half) and average precision."""
    p = roc_points(rows, target, score)
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)) / F.max(F.col("positives") * F.col("negatives"))
    return p.agg(area.alias("roc_auc"), F.sum(F.col("p") / F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def youden(rows: DataFrame, target: str, score: str) -> DataFrame:
    """The threshold of the largest tpr - fpr; of several the largest threshold."""
    p = roc_curve(rows, target, score).withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 12))
    return p.orderBy(F.desc("j"), F.desc("threshold")).limit(1)


def confusion(rows: DataFrame, target: str, score: str, threshold: float) -> DataFrame:
    """Counts and accuracy, precision, recall, specificity, f1, mcc of score >= threshold."""
    t, p = F.col(target) == 1, clean(score) >= threshold
    c = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    mcc = (tp * tn - fp * fn) / F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select("tp", "fp", "fn", "tn", ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), (tp / (tp + fp)).alias("precision"), (tp / (tp + fn)).alias("recall"), (tn / (tn + fp)).alias("specificity"), (2 * tp / (2 * tp + fp + fn)).alias("f1"), mcc.alias("mcc"))


def decision_curve(rows: DataFrame, target: str, risk: str, thresholds: list[float]) -> DataFrame:
    """Net benefit of treating by risk, and of treating all, at each threshold."""
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target)).alias("pos"), *[x for i, t in enumerate(thresholds) for x in (F.count_if((F.col(target) == 1) & (clean(risk) >= t)).alias(f"tp{i}"), F.count_if((F.col(target) == 0) & (clean(risk) >= t)).alias(f"fp{i}"))])
    rows_ = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), ((F.col(f"tp{i}") - F.col(f"fp{i}") * (t / (1 - t))) / F.col("n")).alias("net_benefit"), ((F.col("pos") - (F.col("n") - F.col("pos")) * (t / (1 - t))) / F.col("n")).alias("treat_all")) for i, t in enumerate(thresholds)]))
    return out.select(rows_.alias("x")).select("x.*")


def calibration(rows: DataFrame, target: str, risk: str, bins: int = 10) -> DataFrame:
    """Mean risk and share of cases in equal-width bins of risk."""
    r = clean(risk)
    return rows.where(r.isNotNull()).groupBy(F.least(F.floor(r * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean_risk"), F.avg(F.col(target).cast("double")).alias("observed"))
