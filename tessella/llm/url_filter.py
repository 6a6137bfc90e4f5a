"""URL filters: pattern rules indexed by their rarest literal token.

A rule is two regular expressions, over host and path, with the literal tokens (runs of a-z and 0-9 between separators)
that every match must contain. How often each of those tokens stands in the URLs is counted first, over all of them; a
rule is then filed under its rarest. A URL's tokens fetch the rules filed under them, and only those run their
expressions. Rules without a literal token are filed under the empty one, which every URL has.

The index is a hash table of buckets. Up to `index_bytes` it is one constant of the plan: a token looks into one bucket,
and the whole is a narrow pass. A larger list of rules is a table, joined with the tokens of the distinct hosts and
paths (broadcast up to `broadcast_bytes`, else by a shuffle of tokens), and the best rule comes back by a join on host
and path. Both give the same rows. All of it is DataFrame code.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENTRY = "struct<t: string, o: int, h: string, p: string, e: boolean, n: string, v: string, l: boolean>"


@dataclass(frozen=True)
class Rule:
    """name, verdict (allow or block), pattern over the host, the tokens every match contains, rank (largest wins), and
    pattern over the path. A listed rule fits if both patterns are found in host and path as they are; an unlisted one
    (a word) if its pattern is found in either, lower-cased."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool = True
    path: str = ""


def host_path_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and all subdomains, if the path starts with `path`, in its letter case. Of several the longest wins."""
    text = f".{host} {path}"
    # a token counts if what ends it is in the rule, too
    tokens = tuple(dict.fromkeys(t for t in re.findall(r"(?<![a-z0-9])[a-z0-9]+(?=[^a-z0-9])", text.lower())))
    return Rule(f"{host}{path}", verdict, rf"(^|\.){_quoted(host)}\z", tokens, len(host) + len(path), path=f"^{_quoted(path)}")


def word_rule(verdict: str, word: str) -> Rule:
    """The method's own: fits a URL with this run of tokens, in any case, anywhere in host or path; ranks below all listed rules."""
    parts = word.lower().split("-")
    return Rule(word, verdict, r"(^|[^a-z0-9])" + r"[^a-z0-9]".join(map(_quoted, parts)) + r"([^a-z0-9]|$)", tuple(parts), -1, listed=False)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/ -])", r"\\\1", text)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end.
    Null, or without `://`: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1)).otherwise(F.lit(""))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substr(rest, F.length(host) + 1)


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.concat(host, F.lit(" "), path)), "[^a-z0-9]+"), lambda t: t != ""))


def _filed(rules: list[Rule], often: dict[str, int]) -> list[dict]:
    """Each rule under its rarest token, with its place in the order of precedence: listed ones first, by rank, block before allow."""
    order = sorted(rules, key=lambda r: (not r.listed, -r.rank, r.verdict == "allow", r.name))
    return [{"t": min(r.tokens, key=lambda t: (often.get(t, 0), t), default=""), "o": o, "h": r.pattern, "p": r.path, "e": not r.listed, "n": r.name, "v": r.verdict, "l": r.listed} for o, r in enumerate(order)]


def _fits(e: Column, host: Column, path: Column) -> Column:
    either = F.rlike(F.lower(host), e["h"]) | F.rlike(F.lower(path), e["h"])
    return F.when(e["e"], either).otherwise(F.rlike(host, e["h"]) & F.rlike(path, e["p"]))


def url_filter(pages: DataFrame, rules: list[Rule], default: str = "allow", url_col: str = "url", index_bytes: int = 16 << 20, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """Adds _url: struct(host, path, rule, verdict, matched). Of the listed rules that fit, the one of largest rank gives
    `rule` and `verdict`; without one the verdict is that of an unlisted rule that fits (block before allow), else `default`.

    Listed rules heed the letter case of paths, words do not; hosts are lower-cased. Null urls and urls without `://` have
    an empty host and path and fit no listed rule but one that fits those. Repeated urls are judged alike; all columns
    stay as they are (one named `_url` is replaced). Without rules every verdict is `default`. Any number of rules will do.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c != "_url"]
    host, path = host_and_path(F.col(url_col))
    work = pages.select(*kept, F.struct(host.alias("host"), path.alias("path")).alias("_url"))
    host, path = F.col("_url.host"), F.col("_url.path")
    wanted = sorted({t for r in rules for t in r.tokens})
    often: dict[str, int] = {}
    if wanted:
        asked = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "t string"))  # the rules' own tokens
        found = work.select(F.explode(_tokens(host, path)).alias("t")).join(asked, "t").groupBy("t").count().collect()
        often = {r["t"]: r["count"] for r in found}
    entries = _filed(rules, often)
    size = sum(len(e["h"]) + len(e["p"]) + len(e["n"]) + len(e["t"]) + 64 for e in entries)
    if size <= index_bytes:
        work = work.withColumn("_best", _looked_up(entries, host, path))
    else:
        work = _joined(work, entries, size <= broadcast_bytes)
    best = F.col("_best")
    return work.select(*kept, F.struct("_url.host", "_url.path", F.when(best["l"], best["n"]).alias("rule"), F.coalesce(best["v"], F.lit(default)).alias("verdict"), best["n"].alias("matched")).alias("_url"))


def _looked_up(entries: list[dict], host: Column, path: Column) -> Column:
    """The first entry that fits, from an index that is a constant of the plan."""
    if not entries:
        return F.lit(None).cast("struct<o: int, n: string, v: string, l: boolean>")
    n = 2 * len({e["t"] for e in entries})
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for e in entries:
        buckets[zlib.crc32(e["t"].encode()) % n].append(e)
    index = F.from_json(F.lit(json.dumps({"b": buckets})), f"b array<array<{_ENTRY}>>")["b"]
    tokens = F.concat(_tokens(host, path), F.array(F.lit("")))

    def fetched(token: Column) -> Column:
        bucket = F.element_at(index, (F.crc32(token.cast("binary")) % n + 1).cast("int"))
        return F.filter(bucket, lambda e: (e["t"] == token) & _fits(e, host, path))

    return F.array_min(F.transform(F.flatten(F.transform(tokens, fetched)), lambda e: F.struct(e["o"].alias("o"), e["n"].alias("n"), e["v"].alias("v"), e["l"].alias("l"))))


def _joined(work: DataFrame, entries: list[dict], small: bool) -> DataFrame:
    """The same by joins: tokens of the distinct hosts and paths with the entries, then the best entry back to the rows."""
    fields = ["t", "o", "h", "p", "e", "n", "v", "l"]
    index = work.sparkSession.createDataFrame([tuple(e[f] for f in fields) for e in entries], "t string, o int, h string, p string, e boolean, n string, v string, l boolean")
    host, path = F.col("_host"), F.col("_path")
    seen = work.select(F.col("_url.host").alias("_host"), F.col("_url.path").alias("_path")).distinct()
    tokens = seen.select("*", F.explode(F.concat(_tokens(host, path), F.array(F.lit("")))).alias("t"))
    fitting = tokens.join(F.broadcast(index) if small else index, "t").where(_fits(F.struct(*fields), host, path))
    best = fitting.groupBy("_host", "_path").agg(F.min(F.struct("o", "n", "v", "l")).alias("_best"))
    return work.join(best, (work["_url.host"] == best["_host"]) & (work["_url.path"] == best["_path"]), "left").drop("_host", "_path")


#: Words of spam and adult hosts and paths, blocked by the method itself.
SPAM_WORDS = [
    "spam-farm", "cheap-pills", "casino", "poker", "viagra", "porn", "xxx", "payday-loans", "free-money", "adult", "free-bets", "ads-track", "betting", "gambling", "jackpot", "cialis", "escorts",
    "sexcam", "malware", "phishing", "link-farm", "click-bait", "replica-watches", "weight-loss-pills",
]
