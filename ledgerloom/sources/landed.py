"""Blocks that a fetcher has landed, as a Spark source: read in partitions of blocks, or streamed with the next block as the cursor.

Pages lie below a folder as page=<first block>/ with JSON lines, each page covering `span` blocks. A chain's own fetcher only has to land pages; what has been
read is in Spark's offset log, so a restart goes on at the block after.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "block bigint, tx_hash string, account_id string, direction string, amount string"
COLUMNS = ("block", "tx_hash", "account_id", "direction", "amount")


class Blocks(InputPartition):
    """Blocks from start on, before end."""

    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class _Pages:
    def __init__(self, options: dict):
        self.root = urlparse(options["path"]).path
        self.span, self.per = int(options.get("span", 3600)), int(options.get("pages", 24))
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", 2**62))

    def firsts(self) -> list[int]:
        """The first blocks of the pages that have landed."""
        return sorted(int(d[5:]) for d in os.listdir(self.root) if d.startswith("page=")) if os.path.isdir(self.root) else []

    def cut(self, start: int, end: int) -> list[Blocks]:
        """The landed pages between two blocks, some of them a partition."""
        pages = [p for p in self.firsts() if p + self.span > start and p < end]
        groups = [pages[i : i + self.per] for i in range(0, len(pages), self.per)]
        return [Blocks(max(start, g[0]), min(end, g[-1] + self.span)) for g in groups]

    def read(self, part: Blocks) -> Iterator[tuple]:
        for first in self.firsts():
            if first + self.span <= part.start or first >= part.end:
                continue
            folder = f"{self.root}/page={first}"
            for name in sorted(os.listdir(folder)):
                if not name.endswith(".json"):
                    continue
                with open(f"{folder}/{name}", encoding="utf-8") as lines:
                    for line in lines:
                        row = json.loads(line)
                        if part.start <= row["block"] < part.end:
                            yield tuple(row.get(c) for c in COLUMNS)


class LandedReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Blocks]:
        return self.cut(self.start, self.end) or [Blocks(0, 0)]


class LandedStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"block": self.start}

    def latestOffset(self) -> dict:
        pages = self.firsts()
        return {"block": min(self.end, pages[-1] + self.span) if pages else self.start}

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        return self.cut(start["block"], end["block"])

    def commit(self, end: dict) -> None:
        pass


class LandedBlocks(DataSource):
    """spark.read.format("landed_blocks").option("path", ...), also readStream; options start, end (blocks), span (blocks a page), pages (a partition)."""

    @classmethod
    def name(cls) -> str:
        return "landed_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LandedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LandedStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedBlocks)
