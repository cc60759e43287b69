"""The queries of the corpus operators, one each, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import ann, clustering, html_extract, language_id, line_dedup, mixing, near_duplicates, quality, runs, sentencepiece_codec, sql, token_rollup, toxicity, urls
from .common import table, words


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.fit(docs, toxicity.learnt_from(table(spark, sf_dir, "labels"))))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents"))
    base = F.lit(quality.mask(quality.BASE)).cast("long")
    out = quality.apply_policy(book).withColumn("base_failed", F.col("failed_bits").bitwiseAND(base) != 0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.rates(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed")
    kept = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), F.length(kept).cast("long").alias("n_chars"), F.md5(kept).alias("text_md5"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document comes in, under words, chars and two versions of BPE; words are revised to another version; documents of fewer than 20 words go; a batch comes twice."""
    scratch = Scratch(spark, "tokens")
    seen = scratch.save(token_rollup.counted(table(spark, sf_dir, "documents")), "counts")  # numbers only; texts are tokenized once

    def event(op, counts, old=None):  # counts: a column, named tokenizer and version
        name, old = F.lit(counts[:-1]), old or counts
        return F.struct(F.lit(op).alias("op"), name.alias("tokenizer"), F.lit(counts[-1]).alias("version"), F.col(counts).alias("tokens"), F.lit(old[-1]).alias("old_version"), F.col(old).alias("old_tokens"))

    batch = lambda docs, *events: docs.select("source", "lang", F.explode(F.array(*events)).alias("e")).select("source", "lang", "e.*")
    book = token_rollup.Ledger(spark, scratch.root)
    load = batch(seen, *(event("insert", x) for x in ("words1", "chars1", *token_rollup.BPE)))
    book.commit("load", load)
    book.commit("revise", batch(seen, event("revise", "words2", "words1")))
    book.commit("load", load)
    book.commit("delete", batch(seen.filter("words1 < 20"), *(event("delete", x) for x in ("words2", "chars1", *token_rollup.BPE))))
    return book.totals()


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces=False)
    return out.drop("text")


#: The contract's rules of op10 (verdict, host, path), in its order.
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("score")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~toxicity.held_out()))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", toxicity.held_out().alias("held_out"), "lang_pred", "score", "bits")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustering.sort_means(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return clustering.with_inertia(found, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, by the crc of doc_id, is given a run first; then the digests of what periodic_runs finds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h, w = F.crc32(F.col("doc_id").cast("string").cast("binary")), words(F.col("text"))
    docs = docs.withColumn("g", F.floor(h / 10)).withColumn("w", F.when(h % 10 == 0, w))  # only where a run is planted
    docs = docs.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    block, times = F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    planted = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), F.col("n") - F.col("a")))
    docs = docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))

    found = runs.periodic_runs(docs).select("doc_id", "runs", "collapsed")
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    length, sha = -F.col("best.less"), lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", length.alias("length"), "best.period", F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_source_mixing, op4_html_extraction, op5_nearest_neighbours, op6_line_dedup, op7_token_counts, op8_jaccard_join, op9_sentencepiece, op10_url_filter, op11_language_id, op12_centroid_clusters, op13_word_runs)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
