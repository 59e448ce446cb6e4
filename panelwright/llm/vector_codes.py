"""Short codes for vectors: one small codebook for each part of a vector, fitted by active-entry Lloyd rounds.

A vector is cut into equal parts, and each part is coded by the nearest entry of its position's codebook. The
fit keeps, for each part, its entry and the exact distance to it. When entries have been replaced, a part
whose own entry stayed as it was compares that distance with the moved entries alone: it was the least over
all entries, those that stayed included. Any other part scans its whole codebook. Of equal distances the lower
index wins, so the result is that of a full scan in every round.

Components are whole numbers and all sums are exact, so results depend on neither order nor partitions.
Vectors are neither shuffled nor collected: a round reads the last round's table and writes the next one. What
parts that changed their entry add to and take from the entries' sums is summed over the tasks; the driver
holds the codebooks, whose size is ``entries`` times the vector's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from panelwright.llm.store import Workspace
from panelwright.session import ship_package

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
SLICE = 4096
# Whole components up to here: squares of differences, summed over a vector, stay far within 64 bits.
LARGEST = 1 << 26


def whole(rows: np.ndarray) -> np.ndarray:
    return np.floor(rows.astype(np.float64) * SCALE).astype(np.int64)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equals) and its squared distance, both exact."""
    largest = int(max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * (largest + 1) ** 2 < 1 << 53 else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    apart = (p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)
    best = apart.argmin(1)
    return best, apart[np.arange(len(p)), best].astype(np.int64)


def rescan(points: np.ndarray, code: np.ndarray, apart: np.ndarray, book: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entries after ``moved`` ones were replaced, from the ones before and their distances."""
    code, apart = code.copy(), apart.copy()
    lost = moved[code]
    if lost.any():
        code[lost], apart[lost] = nearest(points[lost], book)
    active = np.flatnonzero(moved)
    kept = np.flatnonzero(~lost)
    if active.size and kept.size:
        best, d = nearest(points[kept], book[active])
        best = active[best]
        closer = (d < apart[kept]) | (d == apart[kept]) & (best < code[kept])
        code[kept[closer]], apart[kept[closer]] = best[closer], d[closer]
    return code, apart


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind))


def _assigned(shared, parts: int, width: int):
    """Rows with their codes and distances under the given codebooks; ``was`` holds the codes before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                v = _matrix(part.column("v"), parts * width, np.int64)
                was = _matrix(part.column("code"), parts, np.int64)
                apart = _matrix(part.column("apart"), parts, np.int64)
                code, far = np.empty_like(was), np.empty_like(apart)
                for k in range(parts):
                    points = v[:, k * width : (k + 1) * width]
                    if moved is None:
                        code[:, k], far[:, k] = nearest(points, books[k])
                    else:
                        code[:, k], far[:, k] = rescan(points, was[:, k], apart[:, k], books[k], moved[k])
                columns = [part.column("id"), part.column("label"), part.column("v"), _lists(code, pa.int64()), _lists(far, pa.int64()), _lists(was, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "v", "code", "apart", "was"])

    return run


def _changes(parts: int, width: int, entries: int):
    """What the rows add to the count and sums of (part, entry), as one row each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), parts * width, np.int64)
            code, was = (_matrix(batch.column(c), parts, np.int64) for c in ("code", "was"))
            for k in range(parts):
                changed = np.flatnonzero(code[:, k] != was[:, k])
                points = np.column_stack([np.ones(len(changed), np.int64), v[changed, k * width : (k + 1) * width]])
                np.add.at(total[k], code[changed, k], points)
                old = was[changed, k]
                np.subtract.at(total[k], old[old >= 0], points[old >= 0])
        part, entry = np.nonzero(total.any(2))
        if part.size:
            rows = total[part, entry]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), _lists(rows, pa.int64())], ["part", "entry", "sums"])

    return run


def encode(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, apart) for each vector that counts, and the codebook of each part.

    ``code`` and ``apart`` are arrays over the parts. Rows whose vector is NULL or holds a NULL, NaN or infinite
    component don't count; nor do those that aren't as long as the vector of the least id, whose length must be
    a multiple of ``parts``. The codebooks start from the ``entries`` least ids; of rows with one id the
    one whose vector comes first in order, and NULL ids last. Fewer vectors make smaller codebooks, none make
    empty ones and an empty result. Repeated rows are coded each. A component beyond 65,536 either way raises
    an error, as sums might leave 64 bits. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ship_package(spark)
    ws = Workspace(spark, "vector-codes")
    raw = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = raw.where(F.col("x").isNotNull() & finite & (F.size("x") > 0))
    schema = StructType(
        [StructField("id", raw.schema["id"].dataType), StructField("label", raw.schema["label"].dataType)]
        + [StructField(name, ArrayType(LongType())) for name in ("v", "code", "apart", "was")]
    )
    order = [F.col("id").asc_nulls_last(), F.col("x")]
    # The ids alone first: each task then sends whole vectors of few rows only.
    least = ws.table(kept.select("id").orderBy(order[0]).limit(entries)).agg(F.max("id"), F.count("id"), F.count(F.lit(1))).first()
    first = kept.where(F.col("id") <= F.lit(least[0])) if least[1] == least[2] > 0 else kept
    start = ws.table(first.orderBy(*order).limit(entries)).orderBy(*order).collect()  # `entries` rows at most
    if not start:
        return spark.createDataFrame([], schema).drop("v", "was"), [np.zeros((0, 0), np.int64)] * parts
    length = len(start[0]["x"])
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    width = length // parts
    kept = kept.where(F.size("x") == length)
    if any(len(r["x"]) != length for r in start):
        start = ws.table(kept.orderBy(*order).limit(entries)).orderBy(*order).collect()
    largest = kept.agg(F.max(F.array_max(F.transform("x", lambda x: F.abs(x))))).first()[0]
    if largest * SCALE >= LARGEST:
        raise ValueError(f"a component of {largest} is beyond {LARGEST // SCALE}")
    points = whole(np.asarray([r["x"] for r in start], np.float64))
    books = [points[:, k * width : (k + 1) * width] for k in range(parts)]

    v = F.transform("x", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    none = F.array_repeat(F.lit(-1).cast("long"), parts)
    state = kept.select("id", "label", v.alias("v"), none.alias("code"), none.alias("apart"))
    sums = np.zeros((parts, len(points), width + 1), np.int64)
    moved = None
    for n in range(rounds + 1):
        shared = spark.sparkContext.broadcast((books, moved))
        before, state = state, ws.table(state.drop("was").mapInArrow(_assigned(shared, parts, width), schema))
        if n:
            ws.drop(before)
        if n == rounds:
            break
        columns = "part long, entry long, sums array<long>"
        changes = state.where("code <> was").select("v", "code", "was").mapInArrow(_changes(parts, width, len(points)), columns)
        total = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width + 1)]
        for row in changes.groupBy("part", "entry").agg(*total).collect():  # parts * entries rows at most
            sums[row["part"], row["entry"]] += np.asarray(row[2:], np.int64)
        fresh = []
        for k in range(parts):
            used = sums[k, :, 0] > 0
            book = books[k].copy()
            book[used] = sums[k, used, 1:] // sums[k, used, :1]
            fresh.append(book)
        moved = [(new != old).any(1) for new, old in zip(fresh, books, strict=True)]
        books = fresh
    return state.drop("v", "was"), books


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **fit: int) -> DataFrame:
    """One row per vector that counts (see :func:`encode`): the id, ``code`` as hex digits, ``error``,
    ``label_error`` (over all rows of the label; NULL labels are one) and the digest of the final codebooks.
    """
    coded, books = encode(df, id_col, vector_col, label_col, **fit)
    ws = Workspace(df.sparkSession, "vector-labels")
    numbers = ",".join(str(x) for book in books for x in book.ravel().tolist())
    digest = hashlib.sha256(numbers.encode()).hexdigest()
    error = F.aggregate("apart", F.lit(0).cast("long"), lambda a, b: a + b)
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    rows = coded.select("id", "label", code.alias("code"), error.alias("error"))
    # Written, so that its size is known: one row per label, sent to all tasks only if that is small.
    labels = ws.table(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same"))
    out = rows.join(labels, F.col("label").eqNullSafe(F.col("same")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
