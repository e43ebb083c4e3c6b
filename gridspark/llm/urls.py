"""URL filters: host rules first, then a ratio of two character language models.

Both models are Markov models of variable order over a reduced alphabet: the probability of a
character given the longest context is smoothed by that of the next shorter one, down to the
uniform one.  One is counted on accepted, the other on rejected URLs.  A URL is judged by the
difference of its log-likelihoods per character, against a threshold that balances the errors
on labelled URLs which the counts have not seen.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
#: Fixed alphabet: 0 pads the beginning; any other character is 1.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&#:%"
SYMBOLS = len(ALPHABET) + 2
ORDER = 3  # longest context: SYMBOLS ** (ORDER + 1) cells bound each model
SMOOTHING = 2.0
#: Cells of the histogram that calibrates the threshold, over differences of -LIMIT to LIMIT.
BINS, LIMIT = 2000, 10.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


@functools.lru_cache(1)
def _codes() -> np.ndarray:
    table = np.ones(256, np.int64)
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = table[ord(c.upper())] = i + 2
    return table


def _grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Full-order cell of every character of all URLs, and the end of each URL."""
    lengths = np.array([len(u) for u in urls], np.int64)
    gap = np.zeros(ORDER, np.int64)
    parts = [x for u in urls for x in (gap, _codes()[np.frombuffer(u, np.uint8)])]
    flat = np.concatenate([*parts, gap[:0]])
    cell = np.zeros(len(flat), np.int64)
    for back in range(ORDER, -1, -1):
        cell = cell * SYMBOLS + (np.concatenate((np.zeros(back, np.int64), flat[: len(flat) - back])) if back else flat)
    real = np.ones(len(flat), bool)
    starts = np.cumsum(lengths + ORDER) - lengths - ORDER
    for i in range(ORDER):
        real[starts + i] = False
    return cell[real], np.cumsum(lengths)


def count_grams(urls: DataFrame) -> DataFrame:
    """(accepted, cell, n) from (url, accepted); each task sums before anything is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for label, part in pdf.groupby("accepted"):
                cells, n = np.unique(_grams([u.encode() for u in part["url"]])[0], return_counts=True)
                yield pd.DataFrame({"accepted": bool(label), "cell": cells, "n": n})

    return urls.mapInPandas(run, "accepted boolean, cell long, n long").groupBy("accepted", "cell").agg(F.sum("n").alias("n"))


def log_model(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log p(character | context) of every cell: interpolated from no context to the longest."""
    full = np.bincount(cells, n, SYMBOLS ** (ORDER + 1))
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(ORDER + 1):
        count = full.reshape(-1, SYMBOLS ** (order + 1)).sum(axis=0).reshape(-1, SYMBOLS)
        total, kinds = count.sum(axis=1, keepdims=True), (count > 0).sum(axis=1, keepdims=True)
        weight = SMOOTHING + kinds  # mass of the shorter context grows with the kinds seen
        shorter = p.reshape(-1, SYMBOLS)
        shorter = np.tile(shorter, (len(count) // len(shorter), 1))
        p = (count + weight * shorter) / (total + weight)
    return np.log(p).ravel().astype(np.float32)


def train(urls: DataFrame) -> np.ndarray:
    """Log ratio (accepted / rejected) of every cell; its size is fixed by the alphabet and the order."""
    counted = count_grams(urls).toPandas()  # at most 2 * SYMBOLS ** (ORDER + 1) rows
    models = [log_model(*(counted.loc[counted["accepted"] == a, c].to_numpy(np.int64) for c in ("cell", "n"))) for a in (True, False)]
    return models[0] - models[1]


def scorer(ratio):
    """Column function: mean log ratio per character; an empty URL scores 0."""

    @F.pandas_udf("double")
    def score(urls: pd.Series) -> pd.Series:
        cells, ends = _grams([u.encode() for u in urls])
        total = np.concatenate(([0.0], np.cumsum(ratio.value[cells].astype(np.float64))))
        starts = np.concatenate(([0], ends[:-1]))
        return pd.Series((total[ends] - total[starts]) / np.maximum(ends - starts, 1))

    return score


def calibrate(scored: DataFrame) -> float:
    """Threshold with the smallest sum of the two error rates on (score, accepted); 0 if a class is empty."""
    at = F.least(F.greatest(F.floor((F.col("score") + LIMIT) / (2 * LIMIT) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    rows = scored.groupBy("accepted", at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # 2 * BINS at most
    counts = np.zeros((2, BINS))
    for r in rows:
        counts[int(r["accepted"]), r["bin"]] = r["n"]
    if not counts.sum(axis=1).all():
        return 0.0
    share = np.concatenate((np.zeros((2, 1)), np.cumsum(counts / counts.sum(axis=1, keepdims=True), axis=1)), axis=1)
    cost = share[1] + 1 - share[0]  # accepted below the threshold, rejected above it
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float((best[0] + best[-1]) / 2 / BINS * 2 * LIMIT - LIMIT)


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    Labelled URLs are those that a rule decides; of them one fold in five (crc32 of the URL) is
    held back for the threshold.  Where the rules decide URLs of one kind only, or none, the
    models have nothing to tell apart and the threshold is 0 (a score of 0 is allowed).  Null
    URLs count as empty.  Repeated rows are judged alike.
    """
    url = F.col(url_col)
    text = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    rule, verdict = rule_of(host, path, rules)
    parsed = pages.select(
        F.col(id_col), text.alias("url"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("ruled")
    )
    labelled = parsed.filter(F.col("ruled").isNotNull()).select("url", (F.col("ruled") == "allow").alias("accepted"))
    held = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0
    ratio = pages.sparkSession.sparkContext.broadcast(train(labelled.filter(~held)))
    score = scorer(ratio)
    threshold = calibrate(labelled.filter(held).select("accepted", score("url").alias("score")))
    judged = parsed.withColumn("score", score("url"))
    learned = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score")
