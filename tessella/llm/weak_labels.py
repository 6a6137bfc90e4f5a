"""Quality classifier from weak labels.

Two questions are asked of a document: is it running prose (quality), and does it insult (toxic)? For each, overlapping
heuristic labellers vote yes, no or abstain. Expectation-maximisation estimates the labellers' accuracies from how often
each pattern of votes occurs, counted over all documents; a pattern's posterior is its label. Posterior labels of a
bounded sample train a linear scorer on hashed features (words, and each labeller's measure in steps), which judges all.

Passes over the documents: one that counts patterns (at most 3 ** labellers, known beforehand), one over the sample,
one that scores. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import SPACES, Splitter, batches_of, in_sorted, slices, text_bytes, tune, written

#: Insults, in two overlapping lists as two labellers would keep them. Fixed values.
INSULTS_A = ["bastard", "bitch", "clown", "crap", "dumb", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "scum", "stupid", "trash"]
INSULTS_B = ["ass", "damn", "disgusting", "garbage", "hate", "idiot", "loser", "moron", "pathetic", "shit", "stupid", "trash", "ugly", "worthless"]
#: Bytes of ordinary prose besides letters, digits and white space.
_PLAIN = b".,;:'\"!?()-"
_BITS = 18
_CLEAN, _BAD, _ABSTAIN = 1, -1, 0
#: Of a stem: uses that count in one text, odds of toxic against other use, and odds of a sure one; counts a task holds before it gives them on.
_USES, _ODDS, _SURE_ODDS, _HELD = 8, 4, 40, 1 << 20


@dataclass(frozen=True)
class Labeller:
    """Votes no (the document is bad) above `bad`, yes up to `good`, else abstains. trust: how its no weighs against a yes
    of 0.3 in the labels that expectation-maximisation starts from."""

    name: str
    question: str
    good: float
    bad: float
    trust: float


LABELLERS = [
    Labeller("symbols", "quality", 0.02, 0.06, 3),
    Labeller("marked_words", "quality", 0.02, 0.2, 3),
    Labeller("capitals", "quality", 0.2, 0.4, 3),
    Labeller("stutter", "quality", 0.02, 0.15, 3),
    Labeller("same_lines", "quality", 0.05, 0.4, 1),
    Labeller("sameness", "quality", 0.6, 0.8, 1),
    Labeller("lone_symbols", "quality", 0.01, 0.1, 3),
    Labeller("insults_a", "toxic", 0.5, 0.5, 3),
    Labeller("insults_b", "toxic", 0.5, 0.5, 3),
    Labeller("insult_kinds", "toxic", 0.5, 1.5, 1),
    Labeller("stems", "toxic", 0.5, 1.5, 2),
    Labeller("stem_share", "toxic", 0.001, 0.004, 0.5),
    Labeller("sure_stems", "toxic", 0.5, 0.5, 3),
]
QUESTIONS = ["quality", "toxic"]
_ASKED = np.array([QUESTIONS.index(lab.question) for lab in LABELLERS])


def _classes() -> np.ndarray:
    kind = np.zeros((5, 256), np.uint8)
    kind[0, [b for b in range(33, 128) if not chr(b).isalnum() and b not in _PLAIN]] = 1
    kind[1, 65:91] = 1
    kind[2, 65:91] = kind[2, 97:123] = 1
    kind[3, [b for b in range(33, 128) if not chr(b).isalnum()]] = 1
    kind[4, [b for b in range(256) if b >= 128 or chr(b).isalnum()]] = 1
    return kind


_KIND = _classes()
_WORDS, _LINES = Splitter(SPACES, True), Splitter(b"\n")
_HEADS = (4, 5, 6, 7)
#: Labels up to this number (32 MB) are sent to all tasks.
_BROADCAST = 2_000_000
_TRIMMED = Splitter(bytes(b for b in range(128) if not chr(b).isalpha()), True, _HEADS)


def _hashes(words: list[str]) -> np.ndarray:
    data, bounds = text_bytes(pa.array(words))
    return np.sort(_TRIMMED(data, bounds)[0])


_LISTS = [_hashes(INSULTS_A), _hashes(INSULTS_B)]


@dataclass(frozen=True)
class Stems:
    """Hashes of word beginnings that are typical of toxic documents, and of those that stand nowhere else; ascending."""

    likely: np.ndarray
    sure: np.ndarray


NO_STEMS = Stems(np.zeros(0, np.uint64), np.zeros(0, np.uint64))


class Measures:
    """Of each text of a batch, one number for each labeller, and its distinct words."""

    def __init__(self, texts, stems: Stems = NO_STEMS):
        data, bounds = text_bytes(texts)
        n = len(bounds) - 1
        sums = lambda of, at: np.diff(np.concatenate([[0], np.cumsum(of, dtype=np.int64)])[at])
        base = int(bounds[0])
        seg = data[base : bounds[-1]]
        symbols, upper, letters = (sums(_KIND[k][seg], bounds - base) for k in range(3))
        size = np.maximum(np.diff(bounds), 1)
        h, begin, end, first = _WORDS(data, bounds)
        words = np.maximum(np.diff(first), 1)
        owner = np.repeat(np.arange(n), np.diff(first))
        tail = (_KIND[3][data[end - 1]] & _KIND[3][data[np.maximum(end - 2, 0)]]) if len(end) else np.zeros(0)
        ordinary = np.concatenate([[0], np.cumsum(_KIND[4][seg], dtype=np.int64)])
        lone = (ordinary[end - base] == ordinary[begin - base]).astype(np.int64)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        own = self._distinct(h, owner)
        lines = _LINES(data, bounds)
        line_owner = np.repeat(np.arange(n), np.diff(lines[3]))
        distinct_lines = np.bincount(self._distinct(lines[0], line_owner)[0], minlength=n)
        n_lines = np.diff(lines[3])
        t, _, _, at, heads = _TRIMMED(data, bounds)
        t_owner = np.repeat(np.arange(n), np.diff(at))
        self.row, self.word = self._distinct(t, t_owner)
        hits = [in_sorted(x, self.word)[1] for x in _LISTS]
        likely, sure = (sums(np.any([in_sorted(table, x)[1] for x in heads], axis=0), at) if len(t) else np.zeros(n) for table in (stems.likely, stems.sure))
        either = hits[0] | hits[1]
        distinct = np.bincount(own[0], minlength=n)
        self.values = np.stack(
            [
                symbols / size,
                sums(tail, first) / words,
                upper / np.maximum(letters, 1),
                sums(again, first) / words,
                np.where(n_lines > 2, 1 - distinct_lines / np.maximum(n_lines, 1), 0),
                np.where(words > 30, 1 - distinct / words ** 0.85, 0),
                sums(lone, first) / words,
                np.bincount(self.row[hits[0]], minlength=n),
                np.bincount(self.row[hits[1]], minlength=n),
                np.bincount(self.row[either], minlength=n),
                likely,
                likely / words,
                sure,
            ]
        )
        self.empty = np.diff(first) == 0
        self.n = n

    @staticmethod
    def _distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((h, owner)) if len(h) else np.zeros(0, np.int64)
        h, owner = h[order], owner[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        return owner[keep], h[keep]

    def votes(self) -> np.ndarray:
        v = np.stack([np.where(x > lab.bad, _BAD, np.where(x <= lab.good, _CLEAN, _ABSTAIN)) for lab, x in zip(LABELLERS, self.values, strict=True)])
        v[np.ix_(_ASKED == 0, self.empty)] = _BAD
        return v

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and hashed feature: distinct words, and the step of each measure."""
        steps = []
        for k, (lab, x) in enumerate(zip(LABELLERS, self.values, strict=True)):
            low = max(lab.good, 0)
            step = np.digitize(x, [low / 2, low, (low + lab.bad) / 2, lab.bad, 2 * lab.bad], right=True)
            step[self.empty] = 6
            steps.append(np.uint64(k * 8) + step.astype(np.uint64))
        rows = np.concatenate([np.tile(np.arange(self.n), len(steps)), self.row])
        feats = np.concatenate([np.concatenate(steps), np.uint64(128) + self.word % np.uint64((1 << _BITS) - 128)])
        return rows, feats.astype(np.int64)


def _pattern(votes: np.ndarray) -> list[str]:
    return ["".join("-0+"[v + 1] for v in column) for column in votes.T]


@dataclass
class LabelModel:
    """A question's prior of `good` and each labeller's chance of no and yes, if it votes, for bad and for good documents."""

    prior: float
    chance: np.ndarray  # labeller, class, vote; abstaining says nothing

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """votes: pattern, labeller, from -1 to 1. The probability that a document is good."""
        log = np.log([1 - self.prior, self.prior])[None, :].repeat(len(votes), 0)
        for k in range(votes.shape[1]):
            says = np.log(self.chance[k][:, (votes[:, k] > 0).astype(int)].T)
            log += np.where(votes[:, k, None] == _ABSTAIN, 0, says)
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, trust: np.ndarray, rounds: int = 100, prior_strength: float = 5.0) -> LabelModel:
    """From vote patterns and how many documents show each. Starts from the weighted majority; a labeller is assumed, with
    the weight of `prior_strength` documents, to be right rather than wrong."""
    wins = np.where(votes == _BAD, -trust, 0.3 * votes).sum(1)
    good = np.clip(0.5 + 0.4 * np.sign(wins), 0.01, 0.99)
    model = LabelModel(0.5, np.zeros((votes.shape[1], 2, 2)))
    hope = np.array([[0.8, 0.2], [0.2, 0.8]])
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        model.prior = float(np.clip((weight[1].sum() + 1) / (weight.sum() + 2), 1e-6, 1 - 1e-6))
        for k in range(votes.shape[1]):
            seen = np.stack([np.bincount(votes[:, k] + 1, w, 3)[[0, 2]] for w in weight]) + prior_strength * hope
            model.chance[k] = seen / seen.sum(1, keepdims=True)
        last, good = good, model.posterior(votes)
        if not len(good) or np.abs(good - last).max() < 1e-9:
            break
    return model


def train(rows: list[np.ndarray], targets: np.ndarray, rounds: int = 12, rate: float = 0.2, shrink: float = 2e-4) -> np.ndarray:
    """Logistic regression on hashed features by mini-batches (Adagrad), weights shrunk towards zero so that rare words count for nothing."""
    weights, seen = np.zeros(1 << _BITS), np.full(1 << _BITS, 1e-6)
    heads = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    order = np.random.default_rng(7)
    share = np.sqrt(np.clip(np.array([1 - targets.mean(), targets.mean()]), 0.02, 1) * 2) if len(targets) else np.ones(2)
    for _ in range(rounds if len(rows) else 0):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 128)):
            at = np.concatenate([flat[heads[i] : heads[i + 1]] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights[at], len(batch)), -30, 30)))
            y = targets[batch]
            slope = (p - y) * (y / share[1] + (1 - y) / share[0])
            used, of = np.unique(at, return_inverse=True)
            grad = np.bincount(of, slope[owner], len(used)) / len(batch)
            seen[used] += grad**2
            step = rate / np.sqrt(seen[used])
            new = weights[used] - step * grad
            weights[used] = np.sign(new) * np.maximum(np.abs(new) - step * shrink, 0)
    return weights


def _summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Stems, ascending and each once, with the sums of their counts."""
    stems, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    stems, of = np.unique(stems, return_inverse=True)
    return [stems, *[np.bincount(of, c, len(stems)).astype(np.int64) for c in counts]]


def stem_counts(texts: pa.Array, toxic: np.ndarray) -> list[np.ndarray]:
    """Of each word beginning of 4 to 7 bytes: its hash, uses in toxic and in other texts (a text counts `_USES` at most), toxic texts."""
    _, _, _, at, heads = _TRIMMED(*text_bytes(texts))
    owner = np.repeat(np.arange(len(toxic)), np.diff(at))
    out = [[np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]]
    for x in heads:
        keys, of = np.unique(x[x > 0], return_inverse=True)
        pairs, uses = np.unique(of * len(toxic) + owner[x > 0], return_counts=True)
        stem, bad, uses = pairs // max(len(toxic), 1), toxic[pairs % max(len(toxic), 1)], np.minimum(uses, _USES)
        out.append([keys, *[np.bincount(stem, c, len(keys)).astype(np.int64) for c in (uses * bad, uses * ~bad, bad)]])
    return _summed(out)


def mine_stems(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Stems:
    """From all labelled documents (equal texts count once, toxic if one of them is): word beginnings of 4 to 7 bytes whose
    smoothed odds of use in toxic against other documents are `_ODDS` at least, with `_USES` uses in two toxic texts or
    more; sure ones have the odds `_SURE_ODDS` and stand in four. No bound depends on how many labels there are, so a
    stem of few documents, such as one of a rare language, is judged by its own use alone."""
    marks = labels.select(F.col(id_col).alias("key"), F.col("toxic").alias("toxic")).where("key is not null and toxic is not null").groupBy("key").agg((F.max("toxic") > 0).alias("toxic"))
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).where("key is not null and text is not null").withColumn("hash", F.xxhash64("text"))
    marks = written(marks)
    small = F.broadcast if marks.count() <= _BROADCAST else lambda x: x  # beyond it, by a shuffle of keys and texts
    # without the rows of no label, which are most of them, before anything moves
    labelled = written(texts.join(small(marks), "key"))
    chosen = labelled.groupBy("hash").agg(F.min("key").alias("key"), F.max("toxic").alias("toxic"))
    again = F.row_number().over(Window.partitionBy("key", "hash").orderBy("hash"))
    once = labelled.drop("toxic").join(chosen, ["key", "hash"]).withColumn("again", again).where("again = 1").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), *map(pa.array, x[1:])], ["stem", "bad", "good", "spread"])
        held, size = [], 0
        for batch in slices(batches, "text"):
            held.append(stem_counts(batch["text"], np.array(batch["toxic"].to_pylist(), bool)))
            size += len(held[-1][0])
            if size > _HELD:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > _HELD // 2:
                    yield give(held[0])
                    held, size = [], 0
        if held:
            yield give(_summed(held))

    counts = once.mapInArrow(batches_of(count), "stem long, bad long, good long, spread long").groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("bad", "good", "spread")])
    odds = (F.col("bad") + 0.5) / (F.col("good") + 0.5)
    found = counts.where((F.col("spread") >= 2) & (F.col("bad") >= _USES) & (odds >= _ODDS)).select("stem", ((odds >= _SURE_ODDS) & (F.col("spread") >= 4)).alias("sure")).collect()
    table = lambda x: np.sort(np.array(x, np.int64).view(np.uint64))
    return Stems(table([r["stem"] for r in found]), table([r["stem"] for r in found if r["sure"]]))


def judge(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = 8192, threshold: float = 0.5) -> DataFrame:
    """Adds _quality: struct(votes, quality_posterior, clean_posterior, quality, clean, keep): the label model's and the
    scorer's probabilities that the document is prose and that it does not insult; keep if both of the scorer's are at
    least `threshold`.

    labels (id_col, toxic; optional): three labellers look for word stems mined from all of them; without labels, or with none
    toxic, these vote clean always. The scorer is fitted on at most `sample` documents, those with the least hashes of id
    and text; votes are counted over all. Null and empty texts, and texts of white space alone, are no prose and are not kept. Repeated rows are judged
    alike, ids may be null, other columns stay. An empty table stays empty.
    """
    tune(docs.sparkSession)
    k = len(LABELLERS)
    stems = mine_stems(docs, labels, id_col, text_col) if labels is not None else NO_STEMS

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names, counts = np.unique(np.array(_pattern(Measures(batch["text"], stems).votes()), dtype=object).astype(str), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(counts, pa.int64())], ["votes", "n"])

    texts = docs.select(F.col(text_col).alias("text"))
    counted = texts.mapInArrow(batches_of(patterns), "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()  # 3 ** labellers rows at most
    votes = np.array([["-0+".index(c) - 1 for c in r["votes"]] for r in counted], np.int64).reshape(-1, k)
    counts = np.array([r["n"] for r in counted], float)
    of = {q: [i for i, lab in enumerate(LABELLERS) if lab.question == q] for q in QUESTIONS}
    models = {q: expectation_maximisation(votes[:, at], counts, np.array([LABELLERS[i].trust for i in at])) for q, at in of.items()}
    posterior = {r["votes"]: [float(models[q].posterior(votes[i : i + 1, of[q]])[0]) for q in QUESTIONS] for i, r in enumerate(counted)}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            m = Measures(batch["text"], stems)
            row, feature = m.features()
            by = np.argsort(row, kind="stable")
            parts = np.split(feature[by].astype(np.int32), np.cumsum(np.bincount(row, minlength=m.n))[:-1]) if m.n else []
            yield pa.RecordBatch.from_arrays([batch["o"], pa.array(_pattern(m.votes()), pa.string()), pa.array(parts, pa.list_(pa.int32()))], ["o", "votes", "features"])

    order = F.xxhash64(F.col(id_col), F.col(text_col))
    total, drawn = int(counts.sum()), []
    share = min(1.0, 1.5 * sample / max(total, 1))
    while total:  # one round, unless many rows are equal
        bound = F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))
        near = docs.select(order.alias("o"), F.col(text_col).alias("text")).where(F.col("o") <= bound)
        drawn = near.mapInArrow(batches_of(featured), "o long, votes string, features array<int>").orderBy("o").limit(sample).collect()
        if len(drawn) >= min(sample, total) or share == 1:
            break
        share = min(1.0, 4 * share)
    rows = [np.array(r["features"], np.int64) for r in drawn]
    weights = [train(rows, np.array([posterior[r["votes"]][i] for r in drawn])) for i in range(len(QUESTIONS))]
    kinds = T.StructType([T.StructField("votes", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("quality_posterior", "clean_posterior", "quality", "clean")], T.StructField("keep", T.BooleanType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("_quality", kinds)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            m = Measures(batch[text_col], stems)
            row, feature = m.features()
            p = [1 / (1 + np.exp(-np.clip(np.bincount(row, w[feature], m.n), -30, 30))) for w in weights]
            names = _pattern(m.votes())
            keep = (p[0] >= threshold) & (p[1] >= threshold) & ~m.empty
            fields = [pa.array(names, pa.string()), *[pa.array([posterior[v][i] for v in names], pa.float64()) for i in range(2)], pa.array(p[0]), pa.array(p[1]), pa.array(keep)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(fields, kinds.names)], schema.names)

    return docs.mapInArrow(batches_of(score), schema)
