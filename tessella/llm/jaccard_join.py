"""N-gram Jaccard join with adaptive multi-match prefixes.

1. Document frequencies: each group of documents sends the fingerprints of its distinct shingles with their counts to
   buckets, which answer with the frequency class (log2) of those in two documents or more.
2. Each document orders its shingles by class, rare first, then hash. With overlap bound o = ceil(t * n), two linked
   documents share l shingles in their first n - o + l. Each document picks its own l by estimated cost: postings read
   plus expected candidates (postings / l) times the cost of a check; a pair must share min(l) of the prefix shingles
   of level min(l) or less before it is verified. Documents with too few shingles that anyone else has cannot link.
3. Equal sets are one node. Of each prefix shingle's holders the one with the commonest shingles is the hub; a node joins
   the hub that it meets most (or that one's own), and in a large group is verified against it first.
   The nodes of a hub of bounded size are one task, which counts common shingles over an inverted list.
4. Of a larger hub, whoever is left outside its main component is compared with all of its nodes, in blocks of bounded
   size; pairs of different hubs go through the prefix test and are
   verified one by one. Pairs within one component are not looked at: no link between different components is missed,
   and no group is expanded into all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACES, Splitter, in_sorted, inside, one_group, origin, pack, parts, tally, text_bytes, tune, two_groups, unpack, volume, wide_grams, written
from tessella.llm.graph import components

_COUNTS = "bucket int, origin int, prints binary, counts binary"
_CLASSES = "origin int, prints binary, classes binary"
_SETS = "id long, n long, a long, b long, need int, ell int, unique int, score double, prefix array<long>, tokens array<long>"

#: Sets sent to all tasks at most (40 MB).
_BROADCAST = 1_000_000


class _Shingles:
    """Distinct shingles of each text of a table: row and hash, ascending by both."""

    def __init__(self, texts, k: int):
        data, bounds = text_bytes(texts)
        h, _, _, first, second = Splitter(SPACES, True, both=True)(data, bounds)
        lens = np.diff(first)
        at = np.flatnonzero(inside(first, k))
        owner, run = [np.searchsorted(first, at, "right") - 1], [wide_grams(h, second, k)[at]]
        for n in np.unique(lens[(lens > 0) & (lens < k)]):  # fewer words: the whole sequence, apart from longer ones
            rows = np.flatnonzero(lens == n)
            owner.append(rows)
            run.append(wide_grams(h, second, int(n))[first[rows]] ^ np.uint64(0x5851F42D4C957F2D * int(n) % 2**64))
        owner, run = np.concatenate(owner), np.concatenate(run)
        order = np.lexsort((run, owner))
        owner, run = owner[order], run[order]
        keep = np.ones(len(run), bool)
        keep[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
        self.row, self.hash = owner[keep], run[keep]
        self.first = np.searchsorted(self.row, np.arange(len(lens) + 1))


def _count_rows(s: _Shingles, where: int, bits: int, bucket_bits: int) -> pa.Table:
    prints, counts = tally(s.hash >> np.uint64(64 - bits))
    cuts = np.searchsorted(prints, np.arange(1, 1 << bucket_bits, dtype=np.uint64) << np.uint64(bits - bucket_bits))
    rows = [(b, p, c) for b, (p, c) in enumerate(zip(np.split(prints, cuts), np.split(counts, cuts), strict=True)) if len(p)]
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([where] * len(rows), pa.int32()), pa.array([pack(r[1], True) for r in rows], pa.binary()), pa.array([pack(r[2]) for r in rows], pa.binary())], ["bucket", "origin", "prints", "counts"])


def _classes(rows: pa.Table) -> pa.Table:
    """Of a bucket: log2 of the frequency of what is in two documents or more, told to each group that has it."""
    prints = [unpack(x) for x in rows["prints"].to_pylist()]
    every, counts = np.concatenate(prints), np.concatenate([unpack(x) for x in rows["counts"].to_pylist()]).astype(np.int64)
    order = np.argsort(every)
    every, counts = every[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    totals = np.add.reduceat(counts, heads)
    table, kind = every[heads][totals > 1], np.floor(np.log2(totals[totals > 1])).astype(np.uint64)
    found = []
    for p, o in zip(prints, rows["origin"].to_pylist(), strict=True):
        place, hit = in_sorted(table, p)
        if hit.any():
            found.append((o, pack(p[hit], True), pack(kind[place[hit]])))
    return pa.table([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())], ["origin", "prints", "classes"])


def _choose(n: int, need: int, unique: int, cost: np.ndarray, most: int, check: float) -> int:
    """The l of least estimated cost. cost: cumulated frequencies of the repeated shingles in their order."""
    ells = np.arange(1, min(most, need) + 1)
    ends = np.clip(n - need + ells - unique, 1, len(cost))
    postings = cost[ends - 1]
    return int(ells[np.argmin(postings * (1 + check * n / ells))])


def shingle_sets(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", longest: int = 8, check: float = 1 / 16, group_bytes: int = 6 << 20) -> DataFrame:
    """One row for each document: id, n (distinct shingles), a and b (a 128-bit sum of the set; null if nothing can link),
    need, ell, unique, score (mean frequency class), prefix and tokens (the shingles that others have, rare first)."""
    spark = docs.sparkSession
    tune(spark)
    _, size = volume(docs, text_col)
    groups = parts(spark, size, group_bytes)
    bucket_bits = max(1, size // 6 >> 20, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    bits = min(52, max(24, max(size, 1).bit_length() + 5))
    base = origin(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), groups, "id", "text")

    def count(rows: pa.Table) -> pa.Table:
        return _count_rows(_Shingles(rows["text"], k), rows["origin"][0].as_py(), bits, bucket_bits)

    def order(rows: pa.Table, told: pa.Table) -> pa.Table:
        s = _Shingles(rows["text"], k)
        kind = np.zeros(len(s.hash), np.int64)
        if told.num_rows:
            prints = np.concatenate([unpack(x) for x in told["prints"].to_pylist()])
            kinds = np.concatenate([unpack(x) for x in told["classes"].to_pylist()]).astype(np.int64)
            by = np.argsort(prints)
            place, hit = in_sorted(prints[by], s.hash >> np.uint64(64 - bits))
            kind[hit] = kinds[by][place[hit]]
        n = np.diff(s.first)
        total = np.concatenate([[np.uint64(0)], np.cumsum(s.hash)])
        other = np.concatenate([[np.uint64(0)], np.cumsum((s.hash ^ (s.hash >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25))])
        repeated = np.concatenate([[0], np.cumsum(kind > 0)])
        repeated = repeated[s.first[1:]] - repeated[s.first[:-1]]
        need = -(-percent * n // 100)
        links = (n > 0) & (repeated >= need)
        ell, prefix, tokens = [], [], []
        for d in range(len(n)):
            if not links[d]:
                ell.append(None), prefix.append(None), tokens.append(None)
                continue
            part = slice(s.first[d], s.first[d + 1])
            have = kind[part] > 0
            h, c = s.hash[part][have], kind[part][have]
            by = np.lexsort((h, c))
            h, c = h[by], c[by]
            unique = int(n[d] - repeated[d])
            best = _choose(int(n[d]), int(need[d]), unique, np.cumsum(np.exp2(c)), longest, check)
            ell.append(best)
            prefix.append(h[: max(0, int(n[d] - need[d]) + best - unique)].view(np.int64))
            tokens.append(h.view(np.int64))
        gone = ~links
        common = np.concatenate([[0], np.cumsum(kind)])
        score = (common[s.first[1:]] - common[s.first[:-1]]) / np.maximum(n, 1)
        return pa.table(
            [rows["id"], pa.array(n, pa.int64()), pa.array((total[s.first[1:]] - total[s.first[:-1]]).view(np.int64), mask=gone), pa.array((other[s.first[1:]] - other[s.first[:-1]]).view(np.int64), mask=gone), pa.array(need, pa.int32()), pa.array(ell, pa.int32()), pa.array(n - repeated, pa.int32()), pa.array(score), pa.array(prefix, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64()))],
            [c.split()[0] for c in _SETS.split(", ")],
        )

    told = base.groupBy("origin").applyInArrow(one_group(count), _COUNTS).groupBy("bucket").applyInArrow(one_group(_classes), _CLASSES)
    return base.groupBy("origin").cogroup(told.groupBy("origin")).applyInArrow(two_groups(order), _SETS)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y) of nodes those whose sets link."""
    x = sets.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    y = sets.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    both = pairs.select("x", "y").join(y, "y").join(x, "x")
    common = F.size(F.array_intersect("tx", "ty"))
    return both.where(100 * common >= percent * (F.col("nx") + F.col("ny") - common)).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _fits(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _join_components(left: pa.Table, right: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between left and right nodes, enough to join all components that they join."""
    flat = right["tokens"].combine_chunks()
    tokens = flat.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(right.num_rows), flat.value_lengths().to_numpy(zero_copy_only=False))
    by = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[by], owner[by]
    n, ids, comps = (right[c].to_numpy() for c in ("n", "id", "component"))
    out, up = [], {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x] = up.get(up[x], up[x])
        return x

    for row in left.to_pylist():
        own = np.array(row["tokens"], np.int64)
        a, b = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        count = b - a
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
        common = np.bincount(owner[at], minlength=right.num_rows)
        for k in np.flatnonzero((100 * common >= percent * (row["n"] + n - common)) & (comps != row["component"]) & (ids != row["id"])):
            x, y = find(row["component"]), find(int(comps[k]))
            if x != y:
                up[x] = y
                out.append((row["id"], int(ids[k])))
    return out


def _edges(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def _small_hubs(nodes: DataFrame, hub: DataFrame, percent: int) -> DataFrame:
    """All links that count within hubs of bounded size: a group each."""

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.append_column("component", rows["id"])
        return _edges(_join_components(rows, rows, percent))

    return nodes.select("id", "n", "tokens").join(hub.where("nodes > 1 and blocks = 1").select("id", "hub"), "id").groupBy("hub").applyInArrow(compare, "a long, b long")


def _large_hubs(nodes: DataFrame, state: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between nodes of one large hub that are not in one component yet: those outside the hub's main component
    against all, in blocks."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return _edges(_join_components(left, right.rename_columns([c.removesuffix("_r") for c in right.column_names]), percent) if left.num_rows and right.num_rows else [])

    main = state.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("hub").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("hub", "main")
    state = state.join(main, "hub")
    blocks = lambda of: F.ceil(F.greatest(F.sum(F.when(of, 1).otherwise(0)) / block, F.sum(F.when(of, F.col("held")).otherwise(0)) / (block * 800))).cast("int")
    state = state.join(state.groupBy("hub").agg(blocks(F.col("component") != F.col("main")).alias("lefts"), blocks(F.lit(True)).alias("rights")), "hub")
    members = nodes.select("id", "n", "tokens").join(state, "id")
    own = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    other = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    rows = ["id", "n", "component", "tokens"]
    left = members.where("component <> main").select("hub", own("lefts").alias("i"), other("rights").alias("j"), *rows)
    right = members.select(F.col("hub").alias("hub_r"), own("rights").alias("j_r"), other("lefts").alias("i_r"), *[F.col(c).alias(f"{c}_r") for c in rows])
    return left.groupBy("hub", "i", "j").cogroup(right.groupBy("hub_r", "i_r", "j_r")).applyInArrow(compare, "a long, b long")


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", block: int = 512, **sizes) -> DataFrame:
    """Links documents whose sets of distinct k-word shingles have Jaccard similarity >= percent / 100, exactly.

    Words are runs of non-space bytes, A-Z as lower case. Returns for each input row id_col, n_shingles and component_id:
    the smallest id reachable by links, itself included. Fewer than k words are one shingle; without words, or with a null
    text, the set is empty and links with nothing. Rows without an id keep a null component and link with nothing. Rows
    that share an id are one node. An empty table gives an empty result. Other columns are not returned.
    """
    sets = written(shingle_sets(docs, k, percent, id_col, text_col, **sizes))
    able = sets.where(F.col("a").isNotNull() & F.col("id").isNotNull())
    copies = written(able.groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    # a set with very many copies is sent to its rows, not its rows to one task: at most _BROADCAST sets can pass the bound
    many = max(256, able.count() // _BROADCAST)
    hot, slim = F.broadcast(copies.where(F.col("copies") > many)), able.select("id", "n", "a", "b")
    rest = slim.join(hot, ["n", "a", "b"], "left_anti").join(copies.where(F.col("copies") <= many), ["n", "a", "b"])
    member = slim.join(hot, ["n", "a", "b"]).select("id", "rep").union(rest.select("id", "rep")).distinct()
    nodes = written(able.join(copies.select("n", "a", "b", F.col("rep").alias("id")), ["n", "a", "b", "id"], "left_semi").dropDuplicates(["n", "a", "b", "id"]))
    level = F.greatest(F.lit(1), F.col("unique") + F.col("pos") - F.col("n") + F.col("need") + 1).cast("int")
    postings = nodes.select("id", "n", "need", "ell", "unique", "score", F.posexplode("prefix").alias("pos", "token")).select("token", "id", "n", "ell", "score", level.alias("level"))

    # one hub for each node: of those of its size class, the one with the commonest shingles that it meets most
    size = F.floor(F.log("n") / F.log(F.lit(100 / percent + 1e-9)) + 1e-9) if percent < 100 else F.col("n")
    sized = postings.withColumn("size", size)
    hubs = sized.groupBy("token", "size").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("x"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    met = sized.join(hubs, ["token", "size"]).groupBy("id", "x").agg(F.count(F.lit(1)).alias("c"))
    hub = met.groupBy("id").agg(F.max_by("x", F.struct("c", F.col("x") == F.col("id"), -F.col("x"))).alias("hub"))
    hub = written(hub.join(nodes.groupBy("id").agg(F.max(F.size("tokens")).alias("held")), "id"))
    for _ in range(2):  # a hub's own hub takes its nodes over
        above = hub.select(F.col("id").alias("hub"), F.col("hub").alias("above"))
        hub = written(hub.join(above, "hub", "left").select("id", F.coalesce("above", "hub").alias("hub"), "held"))
    sized = hub.groupBy("hub").agg(F.count(F.lit(1)).alias("nodes"), F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("held") / (block * 800))).cast("int").alias("blocks"))
    hub = written(hub.join(sized, "hub"))
    stars = _verified(hub.where("id <> hub and blocks > 1").select(F.col("hub").alias("x"), F.col("id").alias("y")), nodes, percent)
    links = written(_small_hubs(nodes, hub, percent).union(stars))
    state = written(hub.join(components(links), "id", "left").select("id", "hub", "held", "blocks", F.coalesce("component", "id").alias("component")))
    links = links.union(_large_hubs(nodes, state.where("blocks > 1").drop("blocks"), percent, block))

    # pairs of different hubs that pass the prefix test; a shingle's main hub is not joined with itself
    placed = written(postings.join(state.select("id", "hub", "component"), "id", "left").withColumn("hub", F.coalesce("hub", "id")).withColumn("component", F.coalesce("component", "id")))
    shared = placed.groupBy("token", "hub").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max_by("hub", F.struct("c", "hub")).alias("major"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("token", "major")
    placed = placed.join(shared, "token")
    left = placed.where("hub <> major").select("token", *[F.col(c).alias(f"{c}_l") for c in ("id", "n", "ell", "level", "component", "hub")])
    ell = F.least("ell", "ell_l")
    pairs = left.join(placed, "token").where((F.col("hub") != F.col("hub_l")) & (F.col("component") != F.col("component_l")) & ((F.col("hub") == F.col("major")) | (F.col("id") > F.col("id_l"))) & _fits("n", "n_l", percent) & (F.greatest("level", "level_l") <= ell))
    pairs = pairs.groupBy(F.least("id", "id_l").alias("x"), F.greatest("id", "id_l").alias("y")).agg(F.count(F.lit(1)).alias("c"), F.max(ell).alias("ell")).where("c >= ell")
    links = links.union(_verified(pairs, nodes, percent))

    final = components(links)
    placed = member.join(final, member["rep"] == final["id"], "left").select(member["id"], F.coalesce("component", "rep").alias("component"))
    placed = placed.groupBy("id").agg(F.min("component").alias("component_id"))
    return sets.select("id", "n").join(placed, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
