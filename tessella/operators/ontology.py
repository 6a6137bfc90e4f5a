"""Terms of a directed graph: ancestors by frontier joins, annotations carried up, information content and similarity.

edges: (child, parent) pairs. A term that is no child has no parents; a term is an ancestor of itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import materialized


def _edges(edges: DataFrame, child: str, parent: str) -> DataFrame:
    return materialized(edges.select(F.col(child).alias("term"), F.col(parent).alias("parent")).dropna().distinct())


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """term, ancestor: all pairs, each once, every term with itself. Cycles end, as only new pairs are carried on."""
    pairs = _edges(edges, child, parent)
    terms = pairs.select("term").union(pairs.select("parent")).distinct()
    known = [terms.select("term", F.col("term").alias("ancestor"))]
    frontier = materialized(pairs.where("term <> parent").select("term", F.col("parent").alias("ancestor")))
    up = pairs.select(F.col("term").alias("ancestor"), F.col("parent").alias("next"))
    while not frontier.isEmpty():
        known.append(frontier)
        reached = frontier.join(up, "ancestor").select("term", F.col("next").alias("ancestor")).distinct()
        for old in known:
            reached = reached.join(old, ["term", "ancestor"], "left_anti")
        frontier = materialized(reached)
        if len(known) > 6:  # one table of what is known, so that a round joins few
            merged = known[0]
            for old in known[1:]:
                merged = merged.union(old)
            known = [materialized(merged)]
    out = known[0]
    for more in known[1:]:
        out = out.union(more)
    return out


def depths(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """term, depth (edges on the longest way up to a term without parents; missing on and below cycles), n_parents."""
    pairs = _edges(edges, child, parent)
    terms = pairs.select("term").union(pairs.select("parent")).distinct()
    counts = materialized(terms.join(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n_parents")), "term", "left").na.fill(0, ["n_parents"]))
    done = materialized(counts.where("n_parents = 0").select("term", F.lit(0).alias("depth")))
    left = counts.where("n_parents > 0")
    while True:
        ready = pairs.join(done.withColumnRenamed("term", "parent"), "parent").groupBy("term").agg(F.count(F.lit(1)).alias("n"), (F.max("depth") + 1).alias("depth"))
        now = materialized(left.join(ready, "term").where("n = n_parents").select("term", "depth"))
        if now.isEmpty():
            break
        left = materialized(left.join(now, "term", "left_anti"))
        done = materialized(done.union(now))
    return counts.join(done, "term", "left").select("term", "depth", "n_parents")


def _sets(pairs: DataFrame) -> DataFrame:
    """term and the sorted array of its ancestors."""
    return materialized(pairs.groupBy("term").agg(F.sort_array(F.collect_list("ancestor")).alias("ancestors")))


def expand(annotations: DataFrame, pairs: DataFrame, gene: str, term: str, each: int = 1 << 23, hot: int = 1 << 16) -> DataFrame:
    """gene, term: the annotations and those of all ancestors, each once.

    An annotation travels to its gene with its ancestors as one array, and repeats go there, in tasks of about `each`
    pairs. Pairs of genes with more than `hot` terms are spread by gene and ancestor instead."""
    known = materialized(annotations.select(F.col(gene).alias("gene"), F.col(term).alias("term")).dropna().distinct())
    sets = _sets(pairs)
    n_terms, n_pairs = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ancestors")), F.lit(0))).first()
    parts = max(known.sparkSession.sparkContext.defaultParallelism, -(-known.count() * (n_pairs // (n_terms or 1) + 1) // each))
    large = materialized(known.groupBy("gene").count().where(F.col("count") > hot).select("gene"))
    up = lambda rows: rows.join(sets, "term", "left").select("gene", F.coalesce("ancestors", F.array("term")).alias("terms"))
    flat = lambda rows: rows.select("gene", F.explode("terms").alias("term")).distinct()
    out = flat(up(known.join(large, "gene", "left_anti")).repartition(parts, "gene"))
    if not large.isEmpty():
        out = out.union(flat(up(known.join(large, "gene", "left_semi"))))
    return out.select(F.col("gene").alias(gene), F.col("term").alias(term))


def information_content(annotations: DataFrame, pairs: DataFrame, gene: str, term: str) -> DataFrame:
    """term, n_genes annotated with it or below it, and ic = -log2 of their share of all annotated genes."""
    total = annotations.select(gene, term).dropna().select(gene).distinct().agg(F.count(F.lit(1)).alias("total"))
    counts = materialized(expand(annotations, pairs, gene, term).groupBy(F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("n_genes")))
    return counts.crossJoin(F.broadcast(total)).select("term", "n_genes", (-F.log2(F.col("n_genes") / F.col("total"))).alias("ic"))  # one row


def term_similarity(asked: DataFrame, pairs: DataFrame, ic: DataFrame, a: str, b: str) -> DataFrame:
    """For pairs of terms: resnik (the highest ic of a shared ancestor), lin (twice that over both ics' sum), jaccard (of
    the ancestors), ic_a, ic_b. Terms without genes have ic 0; without a shared ancestor all but the ics are 0.

    A term's ancestors are one array, by falling ic, so a pair is one row and its first shared ancestor the best."""
    want = asked.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    value = materialized(ic.select("term", "ic"))
    rated = pairs.join(value.withColumnRenamed("term", "ancestor"), "ancestor", "left").na.fill(0.0, ["ic"])
    falling = F.reverse(F.array_sort(F.collect_list(F.struct("ic", "ancestor"))))
    sets = rated.groupBy("term").agg(falling.alias("s")).select("term", F.col("s.ancestor").alias("s"), F.col("s.ic").alias("v"))
    sets = materialized(sets.join(value, "term", "full"))
    out = want.join(sets.select(F.col("term").alias("a"), F.col("s").alias("s_a"), "v", F.col("ic").alias("ic_a")), "a", "left")
    out = out.join(sets.select(F.col("term").alias("b"), F.col("s").alias("s_b"), F.col("ic").alias("ic_b")), "b", "left")
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    out = out.withColumn("_both", F.array_intersect("s_a", "s_b")).na.fill(0.0, ["ic_a", "ic_b"])
    best = F.element_at("v", F.array_position("s_a", F.get("_both", F.lit(0))).cast("int"))
    n, resnik = size("_both"), F.coalesce(best, F.lit(0.0))
    either = size("s_a") + size("s_b") - n
    ics = F.col("ic_a") + F.col("ic_b")
    lin, jaccard = F.when(ics > 0, 2 * resnik / ics).otherwise(0.0), F.when(either > 0, n / either).otherwise(0.0)
    return out.select(F.col("a").alias(a), F.col("b").alias(b), resnik.alias("resnik"), lin.alias("lin"), jaccard.alias("jaccard"), "ic_a", "ic_b")


def gene_similarity(asked: DataFrame, annotations: DataFrame, pairs: DataFrame, ic: DataFrame, gene: str, term: str, a: str, b: str) -> DataFrame:
    """For pairs of genes: best_match_average of their terms' resnik similarity, max_similarity, shared_terms; 0 without terms."""
    want = asked.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    known = annotations.select(gene, term).dropna().distinct()
    of = lambda side: known.select(F.col(gene).alias(side), F.col(term).alias(f"t{side}"))
    cross = want.join(of("a"), "a").join(of("b"), "b")
    s = term_similarity(cross, pairs, ic, "ta", "tb").select("ta", "tb", "resnik")
    rated = materialized(cross.join(s, ["ta", "tb"]))
    best = lambda side: rated.groupBy("a", "b", f"t{side}").agg(F.max("resnik").alias("m")).groupBy("a", "b").agg(F.avg("m").alias(f"m{side}"), F.max("m").alias("top"))
    shared = rated.groupBy("a", "b").agg(F.count_if(F.col("ta") == F.col("tb")).alias("shared_terms"))
    out = want.join(best("a"), ["a", "b"], "left").join(best("b").drop("top"), ["a", "b"], "left").join(shared, ["a", "b"], "left").na.fill(0)
    return out.select(F.col("a").alias(a), F.col("b").alias(b), ((F.col("ma") + F.col("mb")) / 2).alias("best_match_average"), F.col("top").alias("max_similarity"), "shared_terms")
