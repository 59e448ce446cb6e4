"""Documents packed into sequences of fixed length: dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so an instance of any size is a table of at most ``capacity``
counts. On that table, sets of up to three lengths that provably dominate every alternative for their
first length are fixed for good (Martello and Toth), as often as the counts allow. The rest is packed in
falling order into the fullest bin that still has room. The plan is a list of runs: "so many pieces of
this length, from this rank on, go to these sequences at this offset". Pieces learn their rank within
their length from a sort by range and one small table of counts; no task or driver sees all pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.bpe import codec_of, slices
from panelwright.llm.store import Workspace
from panelwright.session import ship_package

CAPACITY = 2048
SEPARATOR = 0


class Plan:
    """Runs (length, first rank, per bin, first bin, offset, bins) for a table of counts by length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.bins = capacity, 0
        self.left = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.left)
        self.rank: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _take(self, size: int, per_bin: int, first_bin: int, offset: int, bins: int) -> None:
        self.runs.append((size, self.rank[size], per_bin, first_bin, offset, bins))
        self.rank[size] += per_bin * bins
        self.left[size] -= per_bin * bins
        if not self.left[size]:
            del self.left[size]
            self.sizes.remove(size)

    def _largest(self, most: int, used: dict[int, int]) -> int:
        """The largest length up to ``most`` with a piece left besides ``used``; 0 if none."""
        i = bisect_right(self.sizes, most)
        while i:
            i -= 1
            if self.left[self.sizes[i]] > used.get(self.sizes[i], 0):
                return self.sizes[i]
        return 0

    def _smallest(self, n: int, used: dict[int, int]) -> int:
        """The sum of the ``n`` smallest pieces besides ``used``; more than any capacity if there are fewer."""
        total = 0
        for size in self.sizes:
            k = min(n, self.left[size] - used.get(size, 0))
            total, n = total + k * size, n - k
            if not n:
                return total
        return self.capacity + 1

    def _dominating(self, size: int) -> tuple[int, ...] | None:
        """Lengths that with ``size`` dominate every other set holding it, or None if that isn't proved."""
        room, own = self.capacity - size, {size: 1}
        best = self._largest(room, own)
        if not best or best == room:
            return (best,) if best else ()
        if self._smallest(2, own) > room:
            return (best,)
        if self._smallest(3, own) > room:
            second = self._largest(room - best, {size: 1, best: 1 + (best == size)})
            # Each pair (x, y) with y above `second` must itself be no more than `best`.
            i = bisect_right(self.sizes, second)
            while i < len(self.sizes) and 2 * self.sizes[i] <= room:
                y = self.sizes[i]
                if self.left[y] > own.get(y, 0):
                    x = self._largest(room - y, {size: 1, y: 1 + (y == size)})
                    if x >= y and x + y > best:
                        return None
                i += 1
            return (best, second) if second else (best,)
        return None

    def _reduce(self) -> None:
        for size in self.sizes[::-1]:
            while self.left.get(size) and (others := self._dominating(size)) is not None:
                need: dict[int, int] = defaultdict(int)
                for s in (size, *others):
                    need[s] += 1
                bins = min(self.left[s] // k for s, k in need.items())
                offset = 0
                for s, k in need.items():
                    self._take(s, k, self.bins, offset, bins)
                    offset += k * s
                self.bins += bins
                self.fixed += bins

    def _best_fit(self) -> None:
        rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
        order: list[int] = []

        def put(room: int, first_bin: int, bins: int) -> None:
            if bins and room:
                if not rooms[room]:
                    insort(order, room)
                rooms[room].append((first_bin, bins))

        for size in self.sizes[::-1]:
            while n := self.left.get(size, 0):
                i = bisect_left(order, size)
                if i == len(order):
                    new = -(-n // (self.capacity // size))
                    put(self.capacity, self.bins, new)
                    self.bins += new
                    continue
                room = order[i]
                first_bin, bins = rooms[room].pop()
                if not rooms[room]:
                    order.pop(i)
                per_bin = room // size
                full = min(bins, n // per_bin)
                if not full:
                    full, per_bin = 1, n
                self._take(size, per_bin, first_bin, self.capacity - room, full)
                put(room - per_bin * size, first_bin, full)
                put(room, first_bin + full, bins - full)


def _pieces(capacity: int, shared):
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        end = np.asarray([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            for first, texts in slices(batch, "text"):
                rows: list[tuple[int, int, int, int, int]] = []
                for i, packed in enumerate(codec.encode(texts), first):
                    packed += end
                    for piece, at in enumerate(range(0, len(packed), 4 * capacity)):
                        part = packed[at : at + 4 * capacity]
                        rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                row, piece, start, length, crc = (np.asarray(c) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names,
                )

    return run


def _placed(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, begin, per_bin, first_bin, offset = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            at = base[length] + batch.column("nth").to_numpy()
            r = np.searchsorted(begin, at, "right") - 1
            k = at - begin[r]
            out = batch.drop_columns(["nth"])
            out = out.append_column("sequence_id", pa.array(first_bin[r] + k // per_bin[r]))
            yield out.append_column("offset", pa.array(offset[r] + k % per_bin[r] * length))

    return run


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A document is its ids and one separator, so NULL and empty texts are one token. Documents longer than
    ``capacity`` are cut into full pieces and a rest. Repeated rows are packed each. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    spark = df.sparkSession
    ship_package(spark)
    ws = Workspace(spark, "packing")
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    columns = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = ws.table(texts.mapInArrow(_pieces(capacity, spec), columns))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = Plan(counts, capacity)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ws.table(
        pieces.repartitionByRange(parts, "length", "id", "start", "ids_crc32")
        .sortWithinPartitions("length", "id", "start", "ids_crc32")
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.spark_partition_id())
    )
    ws.drop(pieces)
    # A length's pieces lie in consecutive parts; there are at most `parts` + `capacity` rows here.
    ranges = ordered.groupBy("length", "part").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = ordered.join(F.broadcast(ranges), ["length", "part"]).withColumn("nth", F.col("before") + F.col("place") - F.col("low"))

    sizes = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        sizes[size] = n
    base = np.cumsum(sizes) - sizes
    runs = np.asarray(sorted(plan.runs), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast((base, base[runs[:, 0]] + runs[:, 1], runs[:, 2], runs[:, 3], runs[:, 4]))
    names = ["id", "piece", "start", "length", "ids_crc32"]
    out = ranked.select(*names, "nth").mapInArrow(_placed(shared), f"{columns}, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
