"""URL filters: rules of host and path first, a logistic regression for the rest.

The regression reads hashed character n-grams of host and path and is trained
from a small labelled table of URLs (below; larger ones can be passed).

Cases. A null URL, or one without "://", has an empty host and path and gets the
regression's verdict on them. Repeated rows each get their row.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS, SIZES = 14, (3, 4, 5)
#: (verdict, host, path); the longest rule that fits wins.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Words of hosts and paths of the labelled table.
UNWANTED = ("cheap-pills", "casino-win", "free-bets", "adult-x", "spam-farm", "ads-track", "poker-bonus", "xxx-cams", "pills-online", "win-prizes", "click-ads", "payday-loans", "bet-casino", "adult-dating", "viagra-shop", "free-spins", "track-pixel", "spam-links", "porn-tube", "crypto-doubler")
WANTED = ("library", "garden", "weather", "recipes", "history", "school", "city-news", "museum", "science", "travel", "music", "open-data", "health", "sports", "books", "cooking", "art-house", "old-town", "research", "farming")
SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "or", "ti", "ou", "sh", "ble", "ly", "tion")


def labelled_urls() -> list[tuple[str, int]]:
    """The training table, 1 for unwanted: every name under several endings, prefixes and paths."""
    tails = ("example.com", "example.net", "example.org", "test.info", "site.io")
    heads, paths = ("", "www.", "m.", "blog."), ("/en/12", "/de/345/", "/fr/67.html", "/es/890?page=2", "/index.html", "/")
    plain = WANTED + tuple(a + b for i, a in enumerate(SYLLABLES) for b in SYLLABLES[i % 4 :: 4]) + tuple("th" + a + b for a in SYLLABLES for b in SYLLABLES[::5])
    out = []
    for label, names in ((1, UNWANTED), (0, plain)):
        for i, name in enumerate(names):
            for k, tail in enumerate(tails if label else tails[i % 5 : i % 5 + 1]):
                out.append((f"http{'s' * (k % 2)}://{heads[(i + k) % 4]}{name}.{tail}{paths[(i + 2 * k) % 6]}", label))
    return out


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def features(host: str, path: str) -> np.ndarray:
    """Indices of the n-grams, each once."""
    texts = (f"h^{host}$".encode(), f"p^{path}$".encode())
    grams = {t[:1] + t[i : i + n] for t in texts for n in SIZES for i in range(1, len(t) - n + 1)}
    return np.fromiter({zlib.crc32(g) & ((1 << BITS) - 1) for g in grams}, np.int64)


def parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end].lower(), rest[end:]
    return host, reduce(lambda s, c: s.partition(c)[0], "?#", rest)


def train(labelled: list[tuple[str, int]], steps: int = 300, rate: float = 2.0, ridge: float = 1e-4) -> np.ndarray:
    """Weights of the n-grams, the bias last; gradient descent, the same each time. Classes count alike."""
    rows = [(features(*parts(u)), y) for u, y in labelled]
    index = np.concatenate([f for f, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    norm = 1 / np.sqrt(np.maximum(1, [len(f) for f, _ in rows]))
    y = np.array([y for _, y in rows], float)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = np.zeros((1 << BITS) + 1)
    for _ in range(steps):
        z = np.bincount(row, w[index], len(rows)) * norm + w[-1]
        g = share * (1 / (1 + np.exp(-z)) - y)
        w[:-1] -= rate * 8 * (np.bincount(index, (g * norm)[row], 1 << BITS) + ridge * w[:-1])
        w[-1] -= rate * g.sum()
    return w


def judge(pages: DataFrame, rules=RULES, labelled: list[tuple[str, int]] | None = None, keep: tuple[str, ...] = ("page_id",), cut: float = 0.5) -> DataFrame:
    """keep, host, path, rule, verdict and the regression's score of every row of pages (url)."""
    weights = train(labelled_urls() if labelled is None else labelled)
    src = pages.select(*keep, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def run(batches):
        for batch in batches:
            hosts, paths = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            got = []
            for h, p in zip(hosts, paths, strict=True):
                f = features(h, p)
                z = weights[f].sum() / max(1, len(f)) ** 0.5 + weights[-1]
                got.append(float(1 / (1 + np.exp(-z))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, "score"])

    scored = src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("score", T.DoubleType())]))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select(*keep, "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= cut, "block").otherwise("allow")).alias("verdict"), "score")
