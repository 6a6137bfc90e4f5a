"""Coding and protein sequences."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.sequence import windows

#: The standard genetic code in the order of bases T, C, A, G. Fixed value.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Average residue masses in dalton. Fixed values.
MASSES = {"A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "E": 129.1155, "Q": 128.1307, "G": 57.0519, "H": 137.1411, "I": 113.1594, "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766, "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.1760, "V": 99.1326}
#: Kyte-Doolittle hydropathy. Fixed values.
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "E": -3.5, "Q": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
#: Recognition sites. Fixed values.
SITES = {"EcoRI": "GAATTC", "BamHI": "GGATCC", "HindIII": "AAGCTT", "AluI": "AGCT", "HaeIII": "GGCC", "TaqI": "TCGA"}


def genetic_code() -> dict[str, str]:
    return {"".join(c): a for c, a in zip(product("TCAG", repeat=3), _CODE, strict=True)}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def codons(seq: Column, frame: int = 0) -> Column:
    s = F.upper(F.translate(seq, "Uu", "TT"))
    return windows(F.substr(s, F.lit(frame + 1)) if frame else s, 3, 3)


def translate(rows: DataFrame, seq: str, frame: int = 0, name: str = "protein") -> DataFrame:
    """Whole codons by the standard code; stops are `*`, codons with other letters `X`."""
    return rows.withColumn(name, F.array_join(F.transform(codons(F.col(seq), frame), lambda c: F.coalesce(F.element_at(_map(genetic_code()), c), F.lit("X"))), ""))


def codon_usage(rows: DataFrame, key: str, seq: str, frame: int = 0) -> DataFrame:
    """Counts, share and relative synonymous usage of each codon."""
    from pyspark.sql import Window

    c = rows.select(F.col(key).alias("key"), F.explode(codons(F.col(seq), frame)).alias("codon")).where(F.col("codon").rlike("^[ACGT]{3}$"))
    t = c.groupBy("key", "codon").agg(F.count(F.lit(1)).alias("n")).withColumn("amino", F.element_at(_map(genetic_code()), F.col("codon")))
    kinds = {}
    for a in genetic_code().values():
        kinds[a] = kinds.get(a, 0) + 1
    family = F.sum("n").over(Window.partitionBy("key", "amino"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("key"))).withColumn("rscu", F.col("n") * F.element_at(_map(kinds), F.col("amino")) / family)


def _tallies(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """key and n: how often each ASCII letter is in a sequence, whatever its case; missing for a missing one."""
    code = np.full(256, 26, np.uint8)
    for i in range(26):
        code[[ord("A") + i, ord("a") + i]] = i

    def count(batches):
        for batch in (b for b in batches if b.num_rows):
            text = batch.column(1).cast(pa.large_binary())
            at, held = (np.frombuffer(b, t) for b, t in zip((text.buffers()[1], text.buffers()[2] or b""), (np.int64, np.uint8), strict=True))
            at = at[text.offset : text.offset + len(text) + 1]
            n = [np.bincount(code[held[x:y]], minlength=27)[:26] if sure else None for x, y, sure in zip(at[:-1], at[1:], text.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.list_(pa.int32()))], ["key", "n"])

    t = rows.select(F.col(key).alias("key"), F.col(seq).cast("string").alias("seq"))
    return t.mapInArrow(count, T.StructType([T.StructField("key", t.schema["key"].dataType), T.StructField("n", T.ArrayType(T.IntegerType()))]))


def protein_properties(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Length, mass (residues and one water), mean hydropathy (GRAVY), aromaticity, extinction at 280 nm, simple charge (K + R - D - E). Only ASCII letters count."""
    n = lambda letters: reduce(add, [F.col("n")[ord(a) - ord("A")] for a in letters])
    weighed = lambda table: sum((n(a) * v for a, v in table.items()), F.lit(0.0))
    size = n("ACDEFGHIKLMNPQRSTVWY")
    return _tallies(rows, key, seq).select("key", size.alias("length"), (weighed(MASSES) + 18.0153).alias("mass"), F.when(size > 0, weighed(HYDROPATHY) / size).alias("gravy"), F.when(size > 0, n("FWY") / size).alias("aromaticity"), (n("W") * 5500 + n("Y") * 1490 + F.floor(n("C") / 2) * 125).cast("long").alias("extinction"), (n("KR") - n("DE")).alias("charge"))


def restriction_sites(rows: DataFrame, key: str, seq: str, enzymes: list[str]) -> DataFrame:
    """Overlapping occurrences of each enzyme's (palindromic) site."""
    from tessella.operators.sequence import motif_scan

    return motif_scan(rows, key, seq, {e: SITES[e] for e in enzymes})


def gc_skew_profile(rows: DataFrame, key: str, seq: str, window: int, step: int | None = None) -> DataFrame:
    """GC share and skew (G - C) / (G + C) of whole windows, and the running sum of skews."""
    from pyspark.sql import Window

    step = step or window
    t = rows.select(F.col(key).alias("key"), F.posexplode(windows(F.upper(F.col(seq)), window, step)).alias("start", "w")).withColumn("start", F.col("start") * step)
    g, c, at = (F.regexp_count("w", F.lit(p)) for p in ("G", "C", "[AT]"))
    t = t.select("key", "start", F.when(g + c + at > 0, (g + c) / (g + c + at)).alias("gc"), F.when(g + c > 0, (g - c) / (g + c)).otherwise(0.0).alias("skew"))
    return t.withColumn("cumulative", F.sum("skew").over(Window.partitionBy("key").orderBy("start")))


def alignment_columns(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Of aligned sequences, by column: gaps, the consensus letter (least of ties), its share, and entropy in bits."""
    c = rows.select(F.posexplode(F.split(F.upper(F.col(seq)), "")).alias("pos", "letter")).where("letter <> ''")
    n = c.groupBy("pos", "letter").agg(F.count(F.lit(1)).alias("n"))
    t = n.groupBy("pos").agg(F.sum("n").alias("total"), F.coalesce(F.max(F.when(F.col("letter") == "-", F.col("n"))), F.lit(0)).alias("gaps"), F.min(F.when(F.col("letter") != "-", F.struct((-F.col("n")).alias("n"), "letter"))).alias("best"))
    h = n.join(t.select("pos", (F.col("total") - F.col("gaps")).alias("m")), "pos").where("letter <> '-'").groupBy("pos").agg(F.sum(-(F.col("n") / F.col("m")) * F.log2(F.col("n") / F.col("m"))).alias("entropy"))
    return t.join(h, "pos", "left").select("pos", "total", "gaps", F.col("best.letter").alias("consensus"), (-F.col("best.n") / (F.col("total") - F.col("gaps"))).alias("share"), "entropy")


def pwm_scan(rows: DataFrame, key: str, seq: str, counts: list[dict[str, float]], min_score: float, pseudocount: float = 0.5) -> DataFrame:
    """Windows whose log2-odds score against equal bases is at least `min_score`."""
    import math

    k = len(counts)
    score = []
    for column in counts:
        total = sum(column.values()) + 4 * pseudocount
        score.append({b: math.log2((column.get(b, 0) + pseudocount) / total / 0.25) for b in "ACGT"})
    w = rows.select(F.col(key).alias("key"), F.posexplode(windows(F.upper(F.col(seq)), k)).alias("start", "w")).where(F.col("w").rlike(f"^[ACGT]{{{k}}}$"))
    total = sum((F.element_at(_map(m), F.substr("w", F.lit(i + 1), F.lit(1))) for i, m in enumerate(score)), F.lit(0.0))
    return w.select("key", "start", "w", total.alias("score")).where(F.col("score") >= min_score)


def mash_distance(rows: DataFrame, key: str, seq: str, k: int = 5, most: int | None = None) -> DataFrame:
    """Jaccard of k-mer sets and the Mash distance for pairs that share a k-mer."""
    import math

    from tessella.operators.sequence import kmer_count

    t = kmer_count(rows, key, seq, k).select("key", "kmer")
    sizes = t.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    if most is not None and sizes.count() > most:
        raise ValueError(f"more than {most} sequences")
    both = t.alias("a").join(t.alias("b"), (F.col("a.kmer") == F.col("b.kmer")) & (F.col("a.key") < F.col("b.key"))).groupBy(F.col("a.key").alias("a"), F.col("b.key").alias("b")).agg(F.count(F.lit(1)).alias("common"))
    j = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    out = both.join(sizes.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "common", j.alias("jaccard"), (F.log(2 * j / (1 + j)) / -k).alias("distance"))
