"""Batches of a stream committed once each, read again from a block on, and pools that take late movements."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import ONE, Pool, scaled
from ..operators.joins import latest

#: Rows that a replay gives a wallet at most, as the interface has it.
REPLAY_ROWS = 100
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Commits:
    """A table of notifications below root, a folder a batch: a batch that comes again replaces itself."""

    root: str
    transform: Callable[[DataFrame], DataFrame] = lambda df: df

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch. transform (such as the classification of the affected rows) runs once a batch."""
        self.transform(batch).write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", self.root).parquet(f"{self.root}/batch=*")

    def replay(self, spark: SparkSession, since: int, keys: tuple[str, ...] = ("wallet_id",), block: str = "block", order: tuple[str, ...] = ("block", "tx_hash"), rows: int = REPLAY_ROWS) -> DataFrame:
        """Of each wallet the first rows after a block, in order."""
        after = self.read(spark).drop("batch").filter(F.col(block) > since)
        return latest(after, list(keys), [F.col(c) for c in order], rows)


def run_now(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Everything that has landed since the checkpoint, in batches, then stop."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: What moves a pool, by the code that its state has; any other kind leaves it as it is.
KINDS = ("acquire", "dispose", "in", "out", "other")
#: Movements from one snapshot of a pool to the next, about.
SNAPSHOT_EACH = 64
AMOUNTS = ("units", "value", "fee")


class LatePools(StatefulProcessor):
    """The pools of one bucket. A pool's movements are kept in order, with snapshots of the pool; a late one is put in its place, and what follows is replayed from the snapshot before it.

    What is older than keep_seconds before the pool's latest movement is dropped, but for its last snapshot; a movement from before that is counted as too late. Movements of equal
    times go by order, columns of whole numbers; those of AMOUNTS may be among them."""

    KIND = T.StructType([T.StructField("size", T.LongType()), T.StructField("data", T.BinaryType())])  # one state row a bucket, as _pack has it

    def __init__(self, keep_seconds: int, order: tuple[str, ...]):
        self.keep, self.order = keep_seconds * 1_000_000, order
        self.whole = ["at", *(c for c in order if c not in AMOUNTS)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pools = handle.getValueState("pools", self.KIND)

    def _pack(self, pools: list[dict], moves: dict[str, np.ndarray]) -> tuple[int, bytes]:
        """A list of the pools as JSON text, then the columns of their movements as they lie in memory, compressed. Amounts beyond 64 bits make all amounts of the bucket part of the text."""
        wide = any(moves[c].dtype == object for c in AMOUNTS)
        text = json.dumps([pools, [moves[c].tolist() for c in AMOUNTS] if wide else None], separators=(",", ":")).encode()
        plain = [*self.whole, *(() if wide else AMOUNTS)]
        data = b"".join([len(text).to_bytes(8, "little"), text, moves["kind"].tobytes(), *(moves[c].tobytes() for c in plain)])
        return len(data), pa.compress(data, "zstd", asbytes=True)

    def _unpack(self, size: int, data: bytes) -> tuple[list[dict], dict[str, np.ndarray]]:
        data = pa.decompress(data, size, "zstd", asbytes=True)
        at = 8 + int.from_bytes(data[:8], "little")
        pools, wide = json.loads(data[8:at])
        n = sum(p["n"] for p in pools)
        moves = {"kind": np.frombuffer(data, np.int8, n, at)}
        for i, c in enumerate([*self.whole, *(() if wide else AMOUNTS)]):
            moves[c] = np.frombuffer(data, np.int64, n, at + n + 8 * n * i)
        return pools, moves | ({c: np.array(x, object) for c, x in zip(AMOUNTS, wide, strict=True)} if wide else {})

    def _read(self, rows: Iterator[pd.DataFrame]) -> tuple[list[str], dict[str, np.ndarray]]:
        """The pool of each new movement, and the movements' columns."""
        names, values, moves = [], [], {}
        for df in rows:
            names += df["pool"].tolist()
            values += map(int, " ".join(df["move"].tolist()).split())
        columns = [*self.whole, "kind", *AMOUNTS]
        for i, c in enumerate(columns):
            try:
                moves[c] = np.array(values[i :: len(columns)], np.int8 if c == "kind" else np.int64)
            except OverflowError:  # some need more than 64 bits
                moves[c] = np.array(values[i :: len(columns)], object)
        return names, moves

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.pools.get()
        pools, held = self._unpack(*kept) if kept else ([], None)
        number = {p["pool"]: i for i, p in enumerate(pools)}
        names, new = self._read(rows)
        for x in dict.fromkeys(names):
            if x not in number:
                number[x] = len(pools)
                pools.append({"pool": x, "late": 0, "base": None, "n": 0, "after": []})  # after: of some movements by their number, the first being 1, the pool after them: units, cost, gain
        of = np.array([number[x] for x in names])
        touched = np.unique(of).tolist()
        if any(pools[i]["base"] for i in touched):  # older movements are gone
            place = list(zip(*(new[c].tolist() for c in ("at", *self.order)), strict=True))
            base = [(b := pools[i]["base"]) and tuple(b["place"]) for i in range(len(pools))]
            fits = np.array([base[i] is None or m > base[i] for i, m in zip(of.tolist(), place, strict=True)])
            for i in of[~fits].tolist():
                pools[i]["late"] += 1
            of, new = of[fits], {c: x[fits] for c, x in new.items()}
        moves = new
        if held:
            of = np.concatenate([np.repeat(np.arange(len(pools)), [p["n"] for p in pools]), of])
            moves = {c: np.concatenate([held[c], x]) for c, x in new.items()}
        sort = np.lexsort([*(moves[c] for c in reversed(("at", *self.order))), of])
        of, moves, fresh = of[sort], {c: x[sort] for c, x in moves.items()}, sort >= len(of) - len(new["at"])
        starts = np.searchsorted(of, np.arange(len(pools) + 1)).tolist()
        first = dict(zip(*(x.tolist() for x in np.unique(of[fresh], return_index=True)), strict=True))
        fresh = np.flatnonzero(fresh).tolist()
        steps, drop = [[KINDS[k] for k in moves["kind"].tolist()], *(moves[c].tolist() for c in AMOUNTS)], []
        for i in touched:
            p, begin, end = pools[i], starts[i], starts[i + 1]
            p["n"] = end - begin
            if i in first:
                drop.append((begin, self._replay(p, [x[begin:end] for x in steps], moves, begin, fresh[first[i]] - begin)))
        if any(gone for _, gone in drop):
            stay = np.ones(len(of), bool)
            for begin, gone in drop:
                stay[begin : begin + gone] = False
            moves = {c: x[stay] for c, x in moves.items()}
        self.pools.update(self._pack(pools, moves))
        last = [(p["after"][-1][1:] if p["after"] else p["base"]["after"] if p["base"] else (0, 0, 0)) for p in (pools[i] for i in touched)]
        ends = dict(zip([p["pool"] for p in pools], np.cumsum([p["n"] for p in pools]).tolist(), strict=True))
        at = [moves["at"][ends[p["pool"]] - 1].item() if p["n"] else p["base"]["place"][0] for p in (pools[i] for i in touched)]
        out = {"pool": [pools[i]["pool"] for i in touched], **{c: [x[j] / ONE for x in last] for j, c in enumerate(("units_after", "cost_after", "gain"))}}
        yield pd.DataFrame(out | {"too_late": [pools[i]["late"] for i in touched], "at": at})

    def _replay(self, p: dict, steps: list[list], moves: dict[str, np.ndarray], begin: int, first: int) -> int:
        """Brings the snapshots of a pool up to date, from its movement number first (from 0) on; gives how many movements are too old to be kept."""
        size = len(steps[0])
        at = moves["at"][begin : begin + size]
        gone = int(np.searchsorted(at, at[-1] - self.keep))
        known = [x for x in p["after"] if x[0] <= (min(first, gone) if gone else first)]
        done, units, cost, gain = known[-1] if known else (0, *(p["base"]["after"] if p["base"] else (0, 0, 0)))
        pool = Pool()
        pool.units, pool.cost = units, cost
        marks = {*range(done + SNAPSHOT_EACH, size, SNAPSHOT_EACH), gone, size}
        for n, step in enumerate(zip(*(x[done:] for x in steps), strict=True), done + 1):
            gain += pool.move(*step)[2]
            if n in marks:
                known.append([n, pool.units, pool.cost, gain])
        if gone:
            p["base"] = {"place": [int(moves[c][begin + gone - 1]) for c in ("at", *self.order)], "after": next(x[1:] for x in known if x[0] == gone)}
            known = [[n - gone, *x] for n, *x in known if n > gone]
        p["n"], p["after"] = size - gone, []
        for x in known:  # those of former ends lie closer than is of use
            if x is known[-1] or x[0] >= SNAPSHOT_EACH + (p["after"][-1][0] if p["after"] else 0):
                p["after"].append(x)
        return gone

    def close(self) -> None:
        pass


def late_pools(stream: DataFrame, keep_seconds: int, order: tuple[str, ...] = ("seq",), buckets: int = 1 << 13) -> DataFrame:
    """stream: user_id, token, ts, kind, units, value, fee and the columns of order (of equal times, the order). Each pool after each batch, as if all movements had come in order.

    State is kept and grouped by buckets of pools: what a group costs is then paid for many pools, but a movement rewrites the state of its bucket."""
    user, token = F.coalesce(F.col("user_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit(":"), F.col("token")), F.lit(""))
    kind = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS[:-1])) + f" ELSE {len(KINDS) - 1} END")
    times = [F.unix_micros(F.col("ts").cast("timestamp")), *(F.col(c).cast("long") for c in order if c not in AMOUNTS)]
    whole = [*(F.coalesce(c, F.lit(-(1 << 62))) for c in times), kind, *(scaled(F.col(c)) for c in AMOUNTS)]  # null comes first, as in a sort
    # a movement is one text: what a row costs on its way to Python grows with the columns
    rows = stream.select(F.pmod(F.xxhash64("user_id", "token"), F.lit(buckets)).cast("int").alias("bucket"), F.concat(user, token).alias("pool"), F.concat_ws(" ", *(c.cast("string") for c in whole)).alias("move"))
    out = "pool string, units_after double, cost_after double, gain double, too_late long, at long"
    after = rows.groupBy("bucket").transformWithStateInPandas(LatePools(keep_seconds, order), out, "Update", "None")
    user, colon = F.substring_index("pool", ":", 1), F.locate(":", F.col("pool"))
    return after.select(F.when(user != "-", user).cast("long").alias("user_id"), F.when(colon > 0, F.substr("pool", colon + 1)).alias("token"), "units_after", "cost_after", "gain", "too_late", "at")
