"""Embedding near-dedup over a robust-pruned flat graph.

1. Vectors are normalised in double precision; equal ones of one label become one node with a weight. Centres of each
   label come from a bounded sample; every node joins the shards of its `overlap` nearest centres, and a shard above
   `part_size` is dealt to parts of bounded size.
2. Each part builds adjacency lists: the nearest nodes of the part, robust-pruned (a neighbour that is much nearer to a
   kept neighbour than to the node is left out). Lists of one node from all its parts are united.
3. Search: in each part every member is a query, in a pair of parts of a split shard each side's members query the other.
   A greedy beam starts at the medoid, and whatever lies in range of the query is expanded until no new node is.
4. Pairs found are verified by their cosine in double precision. A pair counts in the first shard that both share. A
   part tells each node its number of links and only as many links as hold its components together.
5. Audit: a bounded sample of nodes is compared with all nodes; below `least_recall` the whole is built anew with twice the
   overlap and the beam, and after `rounds` of that every part is compared with every part of its label exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import tune, written
from tessella.llm.graph import components

_NODE = "id long, label string, weight long, vector array<double>"


def unit_nodes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (equal directions of one label, under their least id), and members (id, node). Others are left out: without
    a label, null, empty, zero, or with a null or non-finite component."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where("id is not null and label is not null and vector is not null")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, units, keys = [], [], []
            for k, v in enumerate(batch["vector"].to_pylist()):
                if not v or None in v:
                    continue
                x = np.array(v, float)
                most = np.abs(x).max()
                if not 0 < most < np.inf:  # false for NaN, too
                    continue
                x = x / most
                x = x / np.sqrt(x @ x) + 0.0  # no negative zeros
                keep.append(k), units.append(x), keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"].take(at), batch["label"].take(at), pa.array(units, pa.list_(pa.float64())), pa.array(keys, pa.string())], ["id", "label", "vector", "key"])

    keyed = written(rows.mapInArrow(unit, "id long, label string, vector array<double>, key string"))
    nodes = keyed.groupBy("label", "key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight"))
    members = keyed.join(nodes, ["label", "key"])
    return members.where("id = node").dropDuplicates(["id", "label", "key"]).select("id", "label", "weight", "vector"), members.select("id", "node", "weight")


def centres(nodes: DataFrame, share: int, sample: int) -> dict[tuple[str, int], np.ndarray]:
    """For each label and dimension: centres, one for `share` nodes, by a few rounds of k-means over at most `sample` of its nodes."""
    sizes = nodes.groupBy("label", F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each label
    out = {}
    for r in sizes:
        mine = nodes.where((F.col("label") == r["label"]) & (F.size("vector") == r["dim"]))
        rate = min(1.0, 1.2 * sample / r["n"])
        drawn = mine.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()["vector"].to_pylist()
        x = np.array(drawn, float).reshape(-1, r["dim"])
        k = max(1, min(math.ceil(r["n"] / share), len(x) // 2))
        rng = np.random.default_rng(11)
        c = x[rng.choice(len(x), k, replace=False)] if len(x) else np.zeros((1, r["dim"]))
        for _ in range(6 if k > 1 else 0):
            near = (x @ c.T).argmax(1)
            for j in np.unique(near):
                m = x[near == j].sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
        out[r["label"], r["dim"]] = c
    return out


def robust_prune(sims: np.ndarray, degree: int, alpha: float, pool: int) -> np.ndarray:
    """Adjacency lists (-1: none) of all nodes of a part from their similarities: candidates in order of nearness, each kept
    one puts out those it is `alpha` times nearer to than the node is."""
    n = len(sims)
    size = min(pool, n - 1)
    own = sims.copy()
    np.fill_diagonal(own, -2)
    cand = np.argpartition(-own, size - 1, 1)[:, :size] if size > 0 else np.zeros((n, 0), np.int64)
    order = np.argsort(-np.take_along_axis(own, cand, 1), 1)
    cand = np.take_along_axis(cand, order, 1)
    dist = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(own, cand, 1)))
    alive = np.ones(cand.shape, bool)
    kept = np.full((n, degree), -1)
    rows = np.arange(n)
    for k in range(degree if size > 0 else 0):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        pick = cand[rows, first]
        kept[some, k] = pick[some]
        alive[rows, first] = False
        among = np.sqrt(np.maximum(0, 2 - 2 * sims[pick[:, None], cand]))
        alive &= alpha * among > dist
    return kept


def greedy_range(vectors: np.ndarray, lists: np.ndarray, start: int, queries: np.ndarray, beam: int, reach: float, most: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of queries: from and to, and the pairs (query, node) visited that are within `reach`. All queries of a
    block step together: each expands its best unexpanded node of the beam, and every node in reach."""
    n = len(vectors)
    step = max(1, most // max(n, 1))
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        sim = np.full((len(q), n), -2.0)
        done = np.zeros((len(q), n), bool)
        sim[:, start] = q @ vectors[start]
        while True:
            open_ = np.where(done, -2.0, sim)
            kth = np.partition(sim, n - min(beam, n), 1)[:, n - min(beam, n)]
            best = open_.argmax(1)
            value = open_[np.arange(len(q)), best]
            go = (value > -2) & (value >= kth)
            rows, nodes = np.nonzero(open_ >= reach)
            rows, nodes = np.append(rows, np.flatnonzero(go)), np.append(nodes, best[go])
            if not len(rows):
                break
            done[rows, nodes] = True
            nxt = lists[nodes]
            rows, nxt = np.repeat(rows, nxt.shape[1]), nxt.ravel()
            ok = nxt >= 0
            rows, nxt = rows[ok], nxt[ok]
            fresh = sim[rows, nxt] == -2.0
            code = np.unique(rows[fresh] * n + nxt[fresh])
            rows, nxt = code // n, code % n
            for s in range(0, len(rows), 1 << 16):
                r, m = rows[s : s + (1 << 16)], nxt[s : s + (1 << 16)]
                sim[r, m] = np.einsum("ij,ij->i", q[r], vectors[m])
        found = np.nonzero(sim >= reach)
        yield a, a + len(q), found[0] + a, found[1]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _shared_first(mine: np.ndarray, theirs: np.ndarray, shard: int) -> np.ndarray:
    """Whether `shard` is the least shard that each pair of rows has in common. Rows: shard numbers, -1 for none."""
    common = (mine[:, :, None] == theirs[:, None, :]).any(2) & (mine >= 0)
    return np.where(common, mine, np.iinfo(np.int64).max).min(1) == shard


def _search(nodes: DataFrame, overlap: int, beam: int, threshold: float, share: int, part_size: int, degree: int, alpha: float, sample: int, slack: float, exact: bool = False) -> DataFrame:
    """One build and search: rows (id, n, other): links of a node counted in a part, or a link that joins components.
    If exact, all pairs of a shard are looked at, block by block."""
    middle = centres(nodes, share, sample)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = []
            for label, vector in zip(batch["label"].to_pylist(), batch["vector"].to_numpy(zero_copy_only=False), strict=True):
                c = middle[label, len(vector)]
                near = np.argsort(-(c @ vector), kind="stable")[:overlap]
                shards.append(np.sort(near).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.list_(pa.int32()))], [*batch.schema.names, "shards"])

    placed = written(nodes.mapInArrow(assign, f"{_NODE}, shards array<int>"))
    rows = placed.withColumn("dim", F.size("vector")).withColumn("shard", F.explode("shards"))
    keys = ["label", "dim", "shard"]
    many = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / part_size).cast("int").alias("parts"))
    rows = written(rows.join(many, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))

    def build(part: pa.Table) -> pa.Table:
        x, ids = _matrix(part["vector"]), part["id"].to_numpy()
        kept = robust_prune(x @ x.T, degree, alpha, 4 * degree)
        lists = [ids[k[k >= 0]] for k in kept]
        return pa.table([part["id"], part["label"], pa.array(lists, pa.list_(pa.int64()))], ["id", "label", "near"])

    lists = rows.groupBy(*keys, "part").applyInArrow(build, "id long, label string, near array<long>")
    united = lists.groupBy("id", "label").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # `degree` for each shard and part of one node
    whole = written(rows.join(united, ["id", "label"]))
    # each pair of parts of a shard is a task; a side is sent once for each part it meets
    one = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    sides = whole.select("*", one).select(*keys, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "weight", "vector", "shards", "near")

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        x, ids, part, weight, shard = _matrix(rows["vector"]), rows["id"].to_numpy(), rows["part"].to_numpy(), rows["weight"].to_numpy(), rows["shard"][0].as_py()
        width = max(len(s) for s in rows["shards"].to_pylist())
        shards = np.array([s + [-1] * (width - len(s)) for s in rows["shards"].to_pylist()], np.int64)
        near = rows["near"].to_pylist()
        counts, up, links = np.zeros(len(ids), np.int64), np.arange(len(ids)), []

        def find(k):
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        kinds = np.unique(part)
        jobs = [(kinds[0], kinds[0])] if len(kinds) == 1 and rows["i"][0] == rows["j"][0] else ([(kinds[0], kinds[1]), (kinds[1], kinds[0])] if len(kinds) == 2 else [])
        pairs = []
        for mine, theirs in jobs:
            ask, at = np.flatnonzero(part == mine), np.flatnonzero(part == theirs)
            width = max((len(near[k]) for k in at), default=0)
            place = np.full((len(at), max(width, 1)), -1)
            for r, k in enumerate(at):
                targets = np.searchsorted(ids[at], near[k])
                ok = (targets < len(at)) & (ids[at][np.minimum(targets, len(at) - 1)] == near[k])
                place[r, : ok.sum()] = targets[ok]
            y = x[at]
            if exact:
                for s in range(0, len(ask), 512):
                    q, n = np.nonzero(x[ask[s : s + 512]] @ y.T >= threshold)
                    ok = ask[q + s] != at[n]
                    pairs.append(np.unique(np.sort(np.stack([ask[q[ok] + s], at[n[ok]]], 1), 1), axis=0))
                continue
            medoid = int((y @ y.mean(0)).argmax())
            for _, _, q, n in greedy_range(y, place, medoid, x[ask], beam, threshold - slack):
                cosine = np.concatenate([np.einsum("ij,ij->i", x[ask[q[s : s + 65536]]], y[n[s : s + 65536]]) for s in range(0, len(q), 65536)]) if len(q) else np.zeros(0)
                ok = (cosine >= threshold) & (ask[q] != at[n])
                pairs.append(np.unique(np.sort(np.stack([ask[q[ok]], at[n[ok]]], 1), 1), axis=0))
        both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        for s in range(0, len(both), 1 << 18):
            a, b = both[s : s + (1 << 18)].T
            first = _shared_first(shards[a], shards[b], shard)
            np.add.at(counts, a[first], weight[b[first]])
            np.add.at(counts, b[first], weight[a[first]])
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                r, t = find(p), find(q)
                if r != t:
                    up[max(r, t)] = min(r, t)
                    links.append((p, q))
        some = np.flatnonzero(counts)
        return pa.table([pa.array(np.append(ids[some], [ids[p] for p, _ in links]).astype(np.int64)), pa.array(np.append(counts[some], np.zeros(len(links), np.int64)).astype(np.int64)), pa.array([None] * len(some) + [int(ids[q]) for _, q in links], pa.int64())], ["id", "n", "other"])

    return sides.groupBy(*keys, "i", "j").applyInArrow(search, "id long, n long, other long")


def audit(nodes: DataFrame, found: DataFrame, threshold: float, sample: int = 256) -> tuple[int, int]:
    """Links that brute force finds for at most `sample` nodes (those with the least hashes) against all nodes, and how many
    of them the search found."""
    drawn = nodes.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    by: dict[tuple[str, int], tuple[list[int], list[list[float]]]] = {}
    for r in drawn:
        ids, x = by.setdefault((r["label"], len(r["vector"])), ([], []))
        ids.append(r["id"]), x.append(r["vector"])
    held = {k: (np.array(i), np.array(x)) for k, (i, x) in by.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = [], []
            for key, own, weight, vector in zip(batch["label"].to_pylist(), batch["id"].to_pylist(), batch["weight"].to_pylist(), batch["vector"].to_numpy(zero_copy_only=False), strict=True):
                q = held.get((key, len(vector)))
                if q is not None:
                    hit = q[0][(q[1] @ vector >= threshold) & (q[0] != own)]
                    ids += hit.tolist()
                    n += [weight] * len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["id", "n"])

    want = {r["id"]: r["n"] for r in nodes.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    got = {r["id"]: r["n"] for r in found.where(F.col("id").isin([r["id"] for r in drawn])).groupBy("id").agg(F.sum("n").alias("n")).collect()}
    return sum(want.values()), sum(min(n, got.get(i, 0)) for i, n in want.items())


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", overlap: int = 3, beam: int = 16, share: int = 256, part_size: int = 1024, degree: int = 16, alpha: float = 1.2, sample: int = 8192, slack: float = 0.02, least_recall: float = 0.9, rounds: int = 3) -> DataFrame:
    """Links vectors of one label with cosine >= threshold. Returns for each input row id_col, n_links (other vectors found
    linked directly), component_id (the smallest id reachable by links, itself included), kept (id = component_id) and
    recall (of the audit: the share of a sample's links that was found; the same in all rows).

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without a label, link with nothing
    and are kept. Labels may be of any type that has a text form; vectors of different length never link. Rows without an id have null component and are not kept. Equal
    vectors link by themselves. `sample` bounds the vectors of a label that centres are fitted on; all are indexed.
    Nodes within threshold - slack of a query are expanded, too. Other
    columns are not returned. An empty table gives an empty result.
    """
    tune(vectors.sparkSession)
    nodes, members = unit_nodes(vectors, id_col, vector_col, label_col)
    nodes, members = written(nodes), written(members)
    for k in range(rounds + 1):
        if k < rounds:
            found = written(_search(nodes, overlap << k, beam << k, threshold, share, part_size, degree, alpha, sample, slack))
        else:  # one shard for each label
            found = written(_search(nodes, 1, beam, threshold, 1 << 62, part_size, degree, alpha, sample, slack, exact=True))
        want, got = audit(nodes, found, threshold)
        if got >= least_recall * want:
            break
    counts = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "node")
    joined = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "node")
    placed = members.join(counts, "node", "left").join(joined, "node", "left").groupBy("id").agg(F.max(F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.min(F.coalesce("component", "node")).alias("component"))
    base = vectors.select(F.col(id_col).cast("long").alias("id"))
    out = base.join(placed, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"), F.lit(got / want if want else 1.0).alias("recall"))
