"""URL filter: path rules first, then naive Bayes over segmented host names.

A rule names a host and the start of a path; it fits the host and its
subdomains, and the longest fitting rule decides. Other URLs are judged by
tokens: host labels are split into words by the likeliest sequence of unigrams
(Viterbi), path parts are cut at signs, numbers count as one token. Unigram counts
come from all page texts, token counts of both classes from all URLs that
rules decide, and from nothing else. Letters that no known word covers are one word per run.
Tokens that the rules name themselves are no evidence, classes weigh alike, and
blocking takes odds of ``BLOCK_ODDS`` or more. All words and tokens count: those
of a share of 1 / ``MOST_WORDS`` or more (``MOST_WORDS`` at most) are given to
every task, the rest stay in Spark tables and are joined.

Defined results: a null url, or one without ``://``, has an empty host and path, no
rule and the verdict allow, as has any url without known tokens; ties allow;
labels of hosts that are too long to be host names are words as they are; repeated rows each get a result; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .lines import lower_ascii

MOST_WORDS = 100_000
LONGEST_WORD = 24
#: Longer names are no host names (the limits of the name system), so their labels are words as they are.
LONGEST_HOST, LONGEST_LABEL = 253, 63
BLOCK_ODDS = 10
PARTS = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7F]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"\A[^/?#]*", 0)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; ``rules`` are (verdict, ``host/path``)."""

    def first(value):
        chosen = F.lit(None).cast("string")
        for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
            name, _, start = rule.partition("/")
            fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
            chosen = F.when(fits, value(verdict, rule)).otherwise(chosen)
        return chosen

    return first(lambda v, r: F.lit(r)), first(lambda v, r: F.lit(v))


class Segmenter:
    """Splits a name into the likeliest words under unigram counts."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total``: of all words, where ``counts`` has the frequent ones only."""
        total = max(total or 0, sum(counts.values())) + 1
        self.total = total
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        # An unknown run costs more per letter than any known word.
        self.unknown = math.log(total) + 2

    def split(self, name: str, rare: dict[str, int] | None = None) -> list[str]:
        """``rare``: counts of further words that lie in the name."""
        costs = self.cost if not rare else ChainMap({w: math.log(self.total / n) for w, n in rare.items()}, self.cost)
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            cost, start = best[end - 1] + self.unknown, end - 1
            for a in range(max(0, end - LONGEST_WORD), end):
                known = costs.get(name[a:end])
                if known is not None and best[a] + known < cost:
                    cost, start = best[a] + known, a
            best.append(cost)
            back.append(start)
        words, end, unknown = [], len(name), False
        while end:
            word = name[back[end] : end]
            if unknown and word not in costs:
                words[-1] = word + words[-1]
            else:
                words.append(word)
            end, unknown = back[end], word not in costs
        return words[::-1]

    def host_tokens(self, host: str, rare: dict[str, int] | None = None) -> list[str]:
        return [f"host:{w}" for part in PARTS.findall(host) for w in (["#"] if part.isdigit() else self.split(part, rare) if splits(host, part) else [part])]


def splits(host: str, part: str) -> bool:
    return len(host) <= LONGEST_HOST and len(part) <= LONGEST_LABEL


def path_tokens(path: str) -> list[str]:
    return [f"path:{'#' if p.isdigit() else p}" for p in PARTS.findall(path.lower())]


def _words(pages: DataFrame) -> DataFrame:
    """``word`` and ``n`` of all page texts (tags removed)."""
    text = F.lower(F.regexp_replace(F.col("html").cast("string"), "<[^>]*>", " "))
    words = pages.select(F.explode(F.split(text, "[^a-z]+", -1)).alias("word"))
    words = words.where((F.char_length("word") > 1) & (F.char_length("word") <= LONGEST_WORD))
    return materialize(words.groupBy("word").agg(F.count("*").alias("n")), "url-words")


def host_words(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``host`` and its words as tokens per distinct host.

    Words of at least 1 / ``MOST_WORDS`` of all are given to every task; the
    others come to a host by joining all substrings of its names.
    """
    counts = _words(pages)
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = {r["word"]: r["n"] for r in counts.where(F.col("n") * MOST_WORDS >= total).collect()} if total else {}
    segmenter = Segmenter(often, total)

    def others(hosts: pa.Array) -> pa.Array:
        found = []
        for host in hosts.to_pylist():
            names = {p for p in PARTS.findall(host) if p.isascii() and not p.isdigit() and splits(host, p)}
            spans = {p[a:b] for p in names for a in range(len(p)) for b in range(a + 2, min(len(p), a + LONGEST_WORD) + 1)}
            found.append(sorted(spans - segmenter.cost.keys()))
        return pa.array(found, pa.list_(pa.string()))

    spans = hosts.select("host", F.explode(F.arrow_udf(others, "array<string>")("host")).alias("word"))
    rare = spans.join(counts, "word").groupBy("host").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"))

    def run(hosts: pa.Array, words: pa.Array, ns: pa.Array) -> pa.Array:
        own = (dict(zip(w or [], n or [])) for w, n in zip(words.to_pylist(), ns.to_pylist()))
        return pa.array([segmenter.host_tokens(h, o) for h, o in zip(hosts.to_pylist(), own)], pa.list_(pa.string()))

    split = F.arrow_udf(run, "array<string>")("host", "words", "ns")
    return materialize(hosts.join(rare, "host", "left").select("host", split.alias("words")), "url-hosts")


def weights(urls: DataFrame, named: list[str]) -> DataFrame:
    """``token``, ``n`` and ``weight`` (log odds of block against allow) of all tokens of the URLs that rules decide.

    ``urls``: ``decided``, ``tokens`` and ``n`` (rows) per URL. Smoothing adds one to
    the smaller class and as much more to the larger as it is larger, so a token
    without evidence weighs nothing at any size.
    """
    tokens = urls.where("decided is not null").select("decided", "n", F.explode("tokens").alias("token"))
    of = lambda kind: F.sum(F.when(F.col("decided") == kind, F.col("n")).otherwise(0))
    counts = tokens.groupBy("token").agg(of("allow").alias("allow"), of("block").alias("block")).where(~F.col("token").isin(named))
    counts = materialize(counts, "url-tokens")
    kinds, a, b = counts.agg(F.count("*"), F.sum("allow"), F.sum("block")).first()
    a, b = max(a or 0, 1), max(b or 0, 1)
    more_a, more_b = a / min(a, b), b / min(a, b)
    block = F.log((F.col("block") + more_b) / (b + kinds * more_b))
    allow = F.log((F.col("allow") + more_a) / (a + kinds * more_a))
    return counts.select("token", (F.col("allow") + F.col("block")).alias("n"), (block - allow).alias("weight"))


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``tokens`` and ``score`` per row of ``pages``."""
    host, path = host_and_path(F.col("url").cast("string"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    distinct = materialize(parsed.groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    # The rules' hosts are split like those of pages.
    rule_hosts = sorted({r.split("/", 1)[0] for _, r in rules})
    named_hosts = pages.sparkSession.createDataFrame([(h,) for h in rule_hosts], "host string")
    split = host_words(pages, distinct.select("host").unionByName(named_hosts).distinct())
    of_rules = {r["host"]: r["words"] for r in split.where(F.col("host").isin(rule_hosts)).collect()}
    named = sorted({t for _, r in rules for t in [*of_rules[r.split("/", 1)[0]], *path_tokens(r.split("/", 1)[1])]})

    def path_lists(paths: pa.Array) -> pa.Array:
        return pa.array([path_tokens(p) for p in paths.to_pylist()], pa.list_(pa.string()))

    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    tokens = F.concat("words", F.arrow_udf(path_lists, "array<string>")("path"))
    marked = distinct.join(split, "host").select("host", "path", "n", rule.alias("rule"), decided.alias("decided"), tokens.alias("tokens"))
    marked = materialize(marked, "url-marked")

    learned = materialize(weights(marked, named), "url-weights")
    total = learned.agg(F.sum("n")).first()[0] or 0
    often = {r["token"]: r["weight"] for r in learned.where(F.col("n") * MOST_WORDS >= total).collect()}
    known = often.keys() | set(named)

    # Frequent tokens' weights are given to every task; the others come by a join, as they may be too many for one.
    def others(lists: pa.Array) -> pa.Array:
        return pa.array([sorted(set(t) - known) for t in lists.to_pylist()], pa.list_(pa.string()))

    rare = marked.select("host", "path", F.explode(F.arrow_udf(others, "array<string>")("tokens")).alias("token")).join(learned, "token")
    rare = rare.groupBy("host", "path").agg(F.collect_list("token").alias("others"), F.collect_list("weight").alias("weights"))

    def score(lists: pa.Array, others: pa.Array, weights: pa.Array) -> pa.Array:
        out = []
        for tokens, o, w in zip(lists.to_pylist(), others.to_pylist(), weights.to_pylist()):
            own = dict(zip(o or [], w or []))
            out.append(float(sum(often[t] if t in often else own.get(t, 0.0) for t in tokens)))
        return pa.array(out, pa.float64())

    scored = marked.join(rare, ["host", "path"], "left").select("host", "path", "rule", "decided", "tokens", F.arrow_udf(score, "double")("tokens", "others", "weights").alias("score"))
    verdict = F.coalesce("decided", F.when(F.col("score") >= math.log(BLOCK_ODDS), "block").otherwise("allow"))
    return parsed.join(scored, ["host", "path"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "tokens", "score")
