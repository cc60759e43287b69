"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch of events is summed to one row a group before anything is stored, so the
ledger grows with groups and batches, not with documents. A batch has an id and is committed by the
success marker of its own folder: one that is committed already is left alone, one
that broke off is written anew. Totals are the sums over committed batches.

Events: op ("insert", "delete" or "revise"), source, lang, tokenizer, version, tokens and, of a
revision, old_tokens and old_version. A revision takes a document's old count from the old version and puts the new
one under the version; without old_version the version stays. Events may lack both columns of versions. Cases. A null count is 0; null source, lang, tokenizer and version are
groups of their own; an unknown or null op changes nothing; repeated rows count each; an empty batch is
committed and changes nothing; groups that come to no documents and no tokens are not listed.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import n_words, words

KEYS = ("source", "lang", "tokenizer", "version")
SCHEMA = "source string, lang string, tokenizer string, version string, docs long, tokens long"
#: The vocabularies of the byte-level BPE, two versions of it: their columns of counts and rank files.
BPE = {"bpe1": "byte_bpe_50k.tiktoken", "bpe2": "byte_bpe_multi_50k.tiktoken"}


def deltas(events: DataFrame) -> DataFrame:
    """The signed sums of a batch, by group."""
    op, new, old = F.col("op"), F.coalesce(F.col("tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0))
    version = F.col("version") if "version" in events.columns else F.lit(None).cast("string")
    before = F.col("old_version") if "old_version" in events.columns else version
    part = lambda v, docs, tokens: F.struct(v.cast("string").alias("version"), F.lit(docs).cast("long").alias("docs"), tokens.cast("long").alias("tokens"))
    parts = F.when(op == "insert", F.array(part(version, 1, new))).when(op == "delete", F.array(part(version, -1, -new))).when(op == "revise", F.array(part(version, 1, new), part(before, -1, -old)))
    rows = events.select("source", "lang", "tokenizer", F.explode(parts).alias("d")).select("source", "lang", "tokenizer", "d.*")
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Ledger:
    """Committed batches below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        return f"{self.root}/batch-{base64.urlsafe_b64encode(batch.encode()).decode().rstrip('=')}"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(self._folder(batch) + "/_SUCCESS"))

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Whether the batch was new."""
        if self.committed(batch):
            return False
        deltas(events).coalesce(1).write.mode("overwrite").parquet(self._folder(batch))  # a row a group
        return True

    def totals(self) -> DataFrame:
        there = self._fs.listStatus(self._path(self.root)) if self._fs.exists(self._path(self.root)) else []
        paths = [p for p in (s.getPath().toString() for s in there) if "/batch-" in p and self._fs.exists(self._path(p + "/_SUCCESS"))]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")


def counted(docs: DataFrame) -> DataFrame:
    """source, lang and counts of each document: words 1, words 2 (words with a letter a-z, A-Z), chars 1, and the tokens of both vocabularies of BPE."""
    import public_tokenizers

    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("source", "lang", "text")
    for name, ranks in BPE.items():
        docs = bpe_counts(docs, public_tokenizers.path(ranks), public_tokenizers.PATTERN, name)
    return docs.select("source", "lang", n_words(text).alias("words1"), F.size(F.filter(words(text), lambda w: w.rlike("[A-Za-z]"))).cast("long").alias("words2"), F.length(text).cast("long").alias("chars1"), *BPE)


def bpe_counts(docs: DataFrame, ranks_path: str, pattern: str, out: str = "tokens") -> DataFrame:
    """docs with the number of tokens of a byte-level BPE whose ranks are in a tiktoken file; of null, 0."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    at = docs.columns.index("text")

    def run(batches):
        import tiktoken

        coder = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))
