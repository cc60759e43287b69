"""Line dedup with a suffix array over sequences of line ids.

Each document is the sequence of its lines with a word; a line's id is its rank among
all lines that occur twice or more (others end every repeated run, so suffixes stop
there). Prefix doubling ranks suffixes by their first 1, 2, 4, ... lines: a round pairs
the rank at a place with the one 2^k lines on, and ranks the pairs that occur twice or
more. Equal ranks are an interval of the suffix array with a longest common prefix of 2^k lines or
more; two overlapping ranks name the interval for any other number of lines.

A run of lines counts as copied if it holds MIN_WORDS words (runs of anything but
ASCII white space). Every maximal repeated run with so many is the union of the shortest windows with so
many words that start, or end, at one of its lines; so for each such window the
interval's first place (smallest doc_id, then text hash, then line) stays and the lines of later ones
are deleted.

Only DataFrame functions are used. Cases: null and empty texts have no lines and stay
as they are; blank lines stay and do not break a run; a null doc_id comes last in
the order; rows that repeat doc_id and text count as one document and get the same
result; long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from ..scratch import Scratch, bounded
from .common import fresh, n_words

MIN_WORDS = 8
_LAST = 2**63 - 1


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _places(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """A document's place in the order of copies."""
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST)), F.xxhash64(F.coalesce(text, F.lit("")))


def line_rows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, th (the document), i (place among lines with a word), p (place among all lines), two hashes and words w (min_words at most) of each line."""
    d, th = _places(F.col("doc_id"), F.col("text"))
    numbered = F.transform(split_lines(F.col("text")), lambda x, p: F.struct(p.alias("p"), x.alias("x")))
    full = F.filter(numbered, lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(d.alias("d"), th.alias("th"), F.posexplode(full).alias("i", "s"))
    line = F.col("s.x")
    return rows.select("d", "th", "i", F.col("s.p").alias("p"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), F.least(n_words(line), F.lit(min_words)).cast("int").alias("w"))


def _at(offset: int, order: str = "i"):
    return Window.partitionBy("d", "th").orderBy(order).rangeBetween(offset, offset)


def _spans(places: DataFrame, most: int, least_words: int) -> DataFrame:
    """places with f, the lines of the shortest run with enough words that starts there, and b0, b1, ...: of the one that ends 2^k - 1 lines on."""
    over = lambda a, b: Window.partitionBy("d", "th").orderBy("i").rangeBetween(a, b)
    pick = lambda windows: F.coalesce(*(F.when((F.count("*").over(w) == n) & (F.sum("w").over(w) >= least_words), n) for n, w in windows))
    both = places.withColumns({"f": pick([(n, over(0, n - 1)) for n in range(1, most + 1)]), "b": pick([(n, over(1 - n, 0)) for n in range(1, most + 1)])})
    return both.withColumns({f"b{k}": F.max("b").over(_at(2**k - 1)) for k in range(most.bit_length())}).drop("b")


def _windows(ranked: DataFrame, k: int, most: int) -> DataFrame:
    """Windows of 2^k to 2^(k+1) - 1 lines: their start, lines and the two ranks that name them."""
    half, top = 2**k, min(2 ** (k + 1) - 1, most)
    at = lambda o: F.max("rank").over(_at(o))
    choose = lambda n, make: F.coalesce(*(F.when(F.col(n) == m, make(m)) for m in range(half, top + 1)))
    t = ranked.withColumns({"fy": choose("f", lambda m: at(m - half)), "bx": choose(f"b{k}", lambda m: at(half - m))})
    ahead = t.filter("fy is not null").select("d", "th", F.col("i").alias("start"), F.col("f").alias("n"), F.col("rank").alias("x"), F.col("fy").alias("y"))
    behind = t.filter("bx is not null").select("d", "th", (F.col("i") - F.col(f"b{k}") + half).alias("start"), F.col(f"b{k}").alias("n"), F.col("bx").alias("x"), F.col("rank").alias("y"))
    return ahead.unionByName(behind)


def copied_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """d, th and gone (places among all lines) of each document that loses lines."""
    lines = line_rows(docs, min_words)
    ids = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    ids = global_rank(ids, ["h1", "h2"], scratch)
    places = scratch.save(lines.join(ids, ["h1", "h2"]).select("d", "th", "i", "p", "w", "rank").distinct(), "places")
    ranked = scratch.save(_spans(places, min_words, min_words), "level")
    windows, k = None, 0
    while True:
        found = scratch.save(_windows(ranked, k, min_words), "windows")
        windows = found if windows is None else windows.unionByName(found)
        if 2 ** (k + 1) > min_words:
            break
        twos = ranked.withColumn("next", F.max("rank").over(_at(2**k))).filter("next is not null")
        pairs = twos.groupBy("rank", "next").agg(F.count("*").alias("n")).filter("n > 1").select("rank", "next")
        pairs = global_rank(pairs, ["rank", "next"], scratch, "longer")
        level = scratch.save(twos.join(pairs, ["rank", "next"]).drop("rank", "next").withColumnRenamed("longer", "rank"), "level")
        scratch.drop(ranked)
        ranked, k = level, k + 1
        if ranked.isEmpty():
            break
    place = F.struct("d", "th", "start")
    windows = windows.distinct()
    first = windows.groupBy("n", "x", "y").agg(F.min(place).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    first = scratch.save(first.drop("copies"), "intervals")  # joined apart from its aggregation, so that a frequent interval's windows can be split
    later = windows.join(bounded(first), ["n", "x", "y"]).filter(place != F.col("first"))
    gone = later.select("d", "th", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("i")).distinct()
    gone = gone.join(places.select("d", "th", "i", "p"), ["d", "th", "i"])
    return scratch.save(gone.groupBy("d", "th").agg(F.collect_list("p").alias("gone")), "gone")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """docs with the lines that are later copies deleted from text; removed: a column for their number."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = copied_lines(docs.select("doc_id", "text"), scratch, min_words)
    names = [fresh(docs, x) for x in ("gone_d", "gone_th", "gone_p")]
    d, th = _places(F.col("doc_id"), F.col("text"))
    found = gone.select(F.col("d").alias(names[0]), F.col("th").alias(names[1]), F.col("gone").alias(names[2]))
    joined = docs.withColumns({names[0]: d, names[1]: th}).join(bounded(found, gone), names[:2], "left")  # where few documents lose lines no text is shuffled
    lines, p = split_lines(F.col("text")), F.col(names[2])
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), p)
    text = F.when(p.isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    more = [F.coalesce(F.size(p), F.lit(0)).alias(removed)] if removed else []
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns), *more)
