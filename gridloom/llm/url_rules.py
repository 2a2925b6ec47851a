"""URL filter: fixed host and path rules, and association rules mined from labelled URLs.

A URL is a set of tokens (scheme, host suffixes and labels, path words, extension, query keys). A search
level by level finds the token sets that are frequent among all labelled URLs together with their label. A rule stays if its label is more frequent
with its tokens than among all labelled URLs, by lift and beyond chance, so that the rarer label has its rules too. A
URL matches a rule if it has all its tokens, found through an inverted index from tokens to rules; the greatest lift
decides. Fixed rules come first: the longest that fits decides.

A page's label is that of the row of ``labels`` with its id: bad if its quality is 0 or it is toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import own_columns, stored, table

#: (host, path, verdict), given by contract.
FIXED_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BLOCK, ALLOW = "block", "allow"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = FIXED_RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, rule_verdict).otherwise(verdict)
    return name, verdict


def tokens_of(url: str | None) -> list[str]:
    """Distinct tokens of a URL in a fixed order; numbers count as one token by their place."""
    if not url or "://" not in url:
        return ["none"]
    scheme, _, rest = url.partition("://")
    host, rest = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
    path, rest = re.match(r"([^?#]*)(.*)", rest, re.S).groups()
    out = ["scheme:" + scheme.lower()]
    labels = [x for x in host.lower().split(".") if x]
    out += ["suffix:" + ".".join(labels[-k:]) for k in range(1, min(3, len(labels)) + 1)]
    out += ["label:" + x for x in labels[:-1]]
    for piece in labels[:-1]:
        out += ["part:" + x for x in piece.split("-") if "-" in piece and x]
    for i, segment in enumerate(x for x in path.split("/") if x):
        stem, dot, extension = segment.rpartition(".")
        word = stem if dot else segment
        out.append(f"path{min(i, 3)}:" + ("#" if word.isdigit() else word.lower()))
        if dot:
            out.append("extension:" + extension.lower())
    if rest.startswith("?"):
        out += ["query:" + x.partition("=")[0] for x in rest[1:].partition("#")[0].split("&") if x]
    if "#" in rest:
        out.append("fragment")
    return list(dict.fromkeys(out))


@dataclass
class MinedRules:
    """Rules of two verdicts and the inverted index from tokens to them."""

    rules: list[tuple[frozenset[str], str, float]] = field(default_factory=list)
    index: dict[str, list[int]] = field(default_factory=dict)

    @classmethod
    def of(cls, rules: list[tuple[frozenset[str], str, float]]) -> MinedRules:
        index: dict[str, list[int]] = {}
        for i, (tokens, _, _) in enumerate(rules):
            for t in tokens:
                index.setdefault(t, []).append(i)
        return cls(rules, index)

    def verdict(self, tokens: list[str]) -> str:
        """That of the rule with the greatest lift all of whose tokens are there; a tie and no rule at all allow."""
        hits = Counter(i for t in tokens for i in self.index.get(t, ()))
        sure = {BLOCK: 0.0, ALLOW: 0.0}
        for i, n in hits.items():
            own, verdict, lift = self.rules[i]
            if n == len(own):
                sure[verdict] = max(sure[verdict], lift)
        return BLOCK if sure[BLOCK] > sure[ALLOW] else ALLOW


def _tokenized(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [[*tokens_of(u), "is:" + (BLOCK if bad else ALLOW)] for u, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], names=["items"])

    return pages.select("url", "bad").mapInArrow(run, "items array<string>")


def _counted(rows: DataFrame, sets: list[tuple[str, ...]], marked: str) -> dict[tuple[str, ...], tuple[int, int]]:
    """In how many rows each set of tokens lies, and in how many of those with the item ``marked``; over all rows."""
    index = {t: i for i, t in enumerate(sorted({t for own in sets for t in own} | {marked}))}
    places = [[index[t] for t in own] for own in sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sets), 2), np.int64)
        for batch in batches:
            items = batch.column(0)
            has = np.zeros((len(index), batch.num_rows), bool)
            at = np.array([index.get(t, -1) for t in items.flatten().to_pylist()], np.int64)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(items).to_numpy(zero_copy_only=False))
            has[at[at >= 0], row[at >= 0]] = True
            for i, own in enumerate(places):
                met = np.logical_and.reduce(has[own])
                total[i] += np.count_nonzero(met), np.count_nonzero(met & has[index[marked]])
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(sets)), pa.int64()), "n": pa.array(total[:, 0]), "hits": pa.array(total[:, 1])})

    found = rows.select("items").mapInArrow(run, "i long, n long, hits long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return {sets[r["i"]]: (r["n"], r["hits"]) for r in found.orderBy("i").collect()}  # one row a set


def _joined(sets: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Sets of one more token all of whose parts are there; each set is sorted."""
    known, by_head = set(sets), {}
    for own in sorted(sets):
        by_head.setdefault(own[:-1], []).append(own[-1])
    more = ((*head, x, y) for head, last in by_head.items() for i, x in enumerate(last) for y in last[i + 1 :])
    return [own for own in more if all(own[:i] + own[i + 1 :] in known for i in range(len(own)))]


def mine(pages: DataFrame, labels: DataFrame, min_support: float = 0.005, min_rows: int = 8, min_lift: float = 1.3, min_sigma: float = 4.0) -> MinedRules:
    """Rules from all labelled pages and all their frequent tokens; none without labels.

    A rule stays if its tokens and verdict come together in ``min_support`` of the rows and in ``min_rows``, if the
    verdict's share among them is ``min_lift`` times that among all rows and ``min_sigma`` standard errors above it,
    and if no rule on fewer of its tokens has as much lift. Of labels that an id has more than once the worst counts;
    repeated pages all count. Null ids aren't used.
    """
    marked = own_columns(labels, "doc_id", "quality", "toxic").where("doc_id is not null")
    marked = marked.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    rows = stored(_tokenized(own_columns(pages, "page_id", "url").join(marked, "page_id")), "url-tokens")
    n = rows.count()
    if not n:
        return MinedRules()
    verdicts = ["is:" + BLOCK, "is:" + ALLOW]
    least = max(min_support, min_rows / n)
    # tokens that lie in the very same rows say the same: one of them stays
    row = F.monotonically_increasing_id().alias("row")
    each = rows.select(row, F.explode("items").alias("token")).where(~F.col("token").isin(verdicts))
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("where")).where(F.col("n") >= least * n)
    frequent = seen.groupBy("n", "where").agg(F.min("token").alias("token")).select("n", "token").collect()  # bounded by the support
    bad = rows.where(F.array_contains("items", verdicts[0])).count()
    base = {verdicts[0]: bad / n, verdicts[1]: 1 - bad / n}
    counts: dict[tuple[str, ...], int] = {(): n}
    best: dict[tuple[tuple[str, ...], str], float] = {}
    kept = []
    # Level by level: a set of tokens that lies in the very rows of a part of it has that part's lifts, so neither it nor
    # any larger set is a rule; nor is one whose verdict is too rare, or one beyond a set that has a single verdict.
    level = sorted((r["token"],) for r in frequent)
    while level:
        following = []
        for tokens, (all_, hits) in _counted(rows, level, verdicts[0]).items():
            parts = [tokens[:i] + tokens[i + 1 :] for i in range(len(tokens))]
            if any(counts[part] == all_ for part in parts if part):
                continue
            alive = False
            for v, h in zip(verdicts, (hits, all_ - hits)):
                fewer = max((best.get((part, v), 0.0) for part in parts), default=0.0)
                share, b = h / max(all_, 1), base[v]
                lift = 0.0
                if 0 < b < 1 and h >= least * n:
                    if share >= min_lift * b and share - b >= min_sigma * (b * (1 - b) / all_) ** 0.5:
                        lift = share / b
                    alive |= share < 1 and h * (1 - b) >= min_sigma**2 * b
                best[tokens, v] = max(lift, fewer)
                if lift > fewer:
                    kept.append((frozenset(tokens), v[3:], lift))
            if alive:
                counts[tokens] = all_
                following.append(tokens)
        level = _joined(following)
    return MinedRules.of(kept)


def judge(pages: DataFrame, mined: MinedRules, rules: tuple[tuple[str, str, str], ...] = FIXED_RULES) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row; a null URL has an empty host and path, repeated pages
    are judged one by one, and URLs of any length are read in whole."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(1).to_pylist()
            verdicts = [mined.verdict(tokens_of(u)) for u in urls] if mined.rules else [ALLOW] * len(urls)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts, pa.string())], names=["page_id", "url", "mined"])

    judged = own_columns(pages, "page_id", "url").mapInArrow(run, f"page_id {kind}, url string, mined string")
    judged = judged.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "url", "host", "path", name.alias("rule"), F.coalesce(verdict, F.col("mined")).alias("verdict"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages``, with rules mined from those that ``labels`` speaks of."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, mine(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")
