"""Quality rules as a ledger of bits.

Each text is measured once; each rule is a predicate on the measurements and owns
one bit. The ledger keeps the measurements and the bits of the rules that failed.
A policy is a named, versioned mask: a document is kept if no bit of the mask is
set. What each rule removes, alone or beside the others, comes from the ledger
by bitwise aggregation, without reading a text again.

Cases. Null and empty texts have no words and no lines; they fail the rule on the
number of words and no rule that is a ratio to it. Long texts are measured whole.
Repeated rows each get their row; columns named as a measurement are an error.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps_words", "n_shouts", "top_word")
WINDOW = 8


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII white-space characters
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeat = 0
    if n > WINDOW:
        grams = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(grams)) < len(grams):
            count = Counter(grams)
            twice = np.fromiter((count[g] > 1 for g in grams), bool, len(grams))
            edge = np.zeros(n + 1, np.int64)
            starts = np.flatnonzero(twice)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + WINDOW, -1)
            repeat = int((np.cumsum(edge)[:n] > 0).sum())
    caps = sum(w.isupper() and len(w) > 3 for w in words)
    top = max(Counter(words).values(), default=0)
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines), caps, text.count("!"), top)


def rules() -> dict[str, tuple[int, Column]]:
    """Name -> its bit and the predicate that is true where it fails."""
    c = F.col
    return {
        "too_few_words": (0, c("n_words") < 20),
        "repeated_windows": (1, 100 * c("n_repeat_words") > 30 * c("n_words")),
        "symbols": (2, 100 * c("n_symbols") > 10 * c("word_chars")),
        "repeated_lines": (3, (100 * c("n_dup_lines") > 30 * c("n_lines")) & (c("n_dup_lines") > 1)),
        "short_words": (4, c("word_chars") < 2 * c("n_words")),
        "long_words": (5, c("word_chars") > 16 * c("n_words")),
        "capitals": (6, 100 * c("n_caps_words") > 30 * c("n_words")),
        "shouting": (7, 100 * c("n_shouts") > 30 * c("n_words")),
        "one_word": (8, 100 * c("top_word") > 30 * c("n_words")),
    }


BASE = ("too_few_words", "repeated_windows")
#: Version -> rules that it enforces. A version is never changed, only followed by another.
POLICIES = {"base-1": BASE, "strict-1": (*BASE, "symbols", "repeated_lines", "short_words", "long_words", "capitals", "shouting", "one_word")}
CURRENT = "strict-1"


def mask(names: tuple[str, ...]) -> int:
    bits = rules()
    return sum(1 << bits[n][0] for n in names)


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the measurements and failed_bits of every row of docs."""
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*src.drop("__text").schema.fields, *(T.StructField(name, T.LongType()) for name in MEASURES)])

    def run(batches):
        for batch in batches:
            got = np.array([measure_text(t) for t in batch.column(batch.num_columns - 1).to_pylist()], np.int64).reshape(batch.num_rows, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(got[:, i]) for i in range(len(MEASURES)))], names=[*batch.schema.names[:-1], *MEASURES])

    measured = src.mapInArrow(run, schema)
    failed = sum((F.when(test, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, test in rules().values()), F.lit(0).cast("long"))
    return measured.withColumn("failed_bits", failed)


def apply_policy(book: DataFrame, version: str = CURRENT, out: str = "kept") -> DataFrame:
    return book.withColumn(out, F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0)


def ablations(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it fails, those only it fails, and those kept without it."""
    names, whole = POLICIES[version], mask(POLICIES[version])
    bits = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))  # at most 2 ** rules groups
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).cast("long").alias("bit")) for n in names))).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        bits.select("bits", "n", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )
