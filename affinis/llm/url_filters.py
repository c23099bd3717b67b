"""Verdicts on urls: rules first, then naive Bayes over words of host and path.

Host names run words together. A unigram model of the words on the pages splits
them: of all ways to cut a name into known words and single unknown stretches,
the one with the largest product of probabilities is taken (Viterbi). The words
of the host and the tokens of the path are then scored by a multinomial naive
Bayes model, learned from the distinct urls that a rule decides.

The unigram model keeps the ``VOCABULARY`` most frequent words; all others
together are the probability of an unknown stretch, which falls with its length.

Defined cases: a url that is null or has no ``://`` has empty host and path, no
rule and no tokens; urls without tokens are allowed; equal scores allow; where
no rule of one of the verdicts decides any url, all others are allowed; an
input column named like an output column is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.frames import broadcast_if, fits, without_clashes
from affinis.runtime import cut_lineage

VOCABULARY = 200_000
#: Longest word of the unigram model, in code points.
WORD_LENGTH = 24
BROADCAST_TOKENS = 500_000
#: Names remembered by a task.
MEMO = 100_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def decide(rules: list[tuple[str, str]], host_name: Column, path_name: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules are (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda one: len(one[1])):
        name, _, rest = text.partition("/")
        fits_host = (host_name == name) | host_name.endswith(f".{name}")
        fitting = fits_host & path_name.startswith(f"/{rest}")
        rule, verdict = F.when(fitting, F.lit(text)).otherwise(rule), F.when(fitting, F.lit(action)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over the visible text of all ``pages`` (html)."""
    text = F.translate(F.regexp_replace("html", r"<[^>]*>", " "), _UPPER, _UPPER.lower())
    return (
        pages.select(F.explode(F.split(text, r"[\x00-\x60\x7B-\x7F]+")).alias("word"))
        .filter((F.col("word") != "") & (F.length("word") <= WORD_LENGTH))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


class Segmenter:
    """Splits a name of letters into its most probable words."""

    def __init__(self, counts: dict[str, int], others: int):
        total = sum(counts.values()) + others + 1
        self._log = {word: math.log(n / total) for word, n in counts.items()}
        self._unknown = math.log((others + 1) / total)

    def _weight(self, piece: str) -> float:
        # An unknown stretch costs about one letter's choice per letter.
        return self._log.get(piece, self._unknown - math.log(26) * len(piece))

    def split(self, name: str) -> list[str]:
        best, cut = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - WORD_LENGTH), end):
                value = best[start] + self._weight(name[start:end])
                if value > best[end]:
                    best[end], cut[end] = value, start
        words, end = [], len(name)
        while end:
            words.append(name[cut[end] : end])
            end = cut[end]
        return words[::-1]


def fit_segmenter(pages: DataFrame, vocabulary: int = VOCABULARY) -> Segmenter:
    counts = cut_lineage(word_counts(pages))
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = {row["word"]: row["n"] for row in counts.orderBy(F.desc("n"), "word").limit(vocabulary).toLocalIterator()}
    return Segmenter(known, total - sum(known.values()))


def url_tokens(urls: DataFrame, segmenter: Segmenter) -> DataFrame:
    """``urls`` (host, path) with ``tokens``: ``h:`` words of the host, ``p:`` tokens of the path; numbers are one token."""
    sent = urls.sparkSession.sparkContext.broadcast(segmenter)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = sent.value, {}
        names = re.compile("[0-9]+|[^\x00-\x60\x7b-\x7f]+")

        def words(name: str) -> list[str]:
            if name[0].isdigit():
                return ["0"]
            if name not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[name] = model.split(name)
            return memo[name]

        for batch in batches:
            tokens = [
                [f"h:{word}" for part in names.findall(host_name) for word in words(part)]
                + [f"p:{'0' if part[0].isdigit() else part}" for part in names.findall(path_name.lower())]
                for host_name, path_name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.list_(pa.string()))], names=["host", "path", "tokens"])

    return urls.select("host", "path").mapInArrow(split, "host string, path string, tokens array<string>")


def token_weights(labelled: DataFrame) -> tuple[DataFrame, float] | None:
    """(token, weight) and the prior, as log ratios of block to allow; ``labelled`` has tokens and verdict."""
    sides = {name: (F.col("verdict") == name).cast("long") for name in ("block", "allow")}
    urls = labelled.agg(*(F.sum(side).alias(name) for name, side in sides.items())).first()
    if not urls["block"] or not urls["allow"]:
        return None
    counts = cut_lineage(
        labelled.select(F.explode("tokens").alias("token"), "verdict").groupBy("token").agg(*(F.sum(side).alias(name) for name, side in sides.items()))
    )
    totals = counts.agg(F.count(F.lit(1)).alias("kinds"), F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    share = {name: (F.col(name) + 1.0) / F.lit(float((totals[name] or 0) + totals["kinds"] + 1)) for name in sides}
    weights = counts.select("token", (F.log(share["block"]) - F.log(share["allow"])).alias("weight"))
    return weights, math.log(urls["block"] / urls["allow"])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], vocabulary: int = VOCABULARY) -> DataFrame:
    """All columns of ``pages`` (url, html), host, path, rule, verdict, score (null if a rule decides) and tokens."""
    made = ("host", "path", "rule", "verdict", "score", "tokens", "by_rule", "host_key", "path_key")
    rows = without_clashes(pages, ("url", "html"), made)
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    distinct = rows.select("host", "path").distinct()
    rule, by_rule = decide(rules, F.col("host"), F.col("path"))
    tokens = url_tokens(distinct, fit_segmenter(rows, vocabulary)).withColumn("rule", rule).withColumn("verdict", by_rule)
    tokens = cut_lineage(tokens)
    learned = token_weights(tokens.filter(F.col("rule").isNotNull()))
    if learned is None:
        scores = tokens.select("host", "path", F.lit(0.0).alias("score"))
    else:
        weights, prior = learned
        # Tokens that no labelled url has count for neither side.
        scores = (
            tokens.filter(F.col("rule").isNull())
            .select("host", "path", F.explode("tokens").alias("token"))
            .join(broadcast_if(weights, fits(weights, BROADCAST_TOKENS)), "token", "left")
            .groupBy("host", "path")
            .agg((F.sum(F.coalesce("weight", F.lit(0.0))) + F.lit(prior)).alias("score"))
        )
    judged = tokens.join(scores, ["host", "path"], "left").select(
        F.col("host").alias("host_key"),
        F.col("path").alias("path_key"),
        "rule",
        F.when(F.col("rule").isNull(), F.coalesce("score", F.lit(0.0))).alias("score"),
        F.coalesce("verdict", F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "tokens",
    )
    judged = cut_lineage(judged)
    same = (rows["host"] == F.col("host_key")) & (rows["path"] == F.col("path_key"))
    return rows.join(judged, same).drop("host_key", "path_key")
