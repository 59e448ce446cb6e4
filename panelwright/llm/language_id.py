"""Languages of texts by bit-sliced Bloom filters of byte n-grams.

One filter per language would be asked one by one; here the filters lie side by side. A slot has one bit
for each language, in as many 64-bit words as that takes, and an n-gram sets its languages' bits in
``HASHES`` slots. The AND of these slots returns, at once, all languages that contain the n-gram. A text's n-grams are counted per
language; the n-grams that a filter of its fill would accept by chance are taken off; the largest count
decides. The filters have a fixed size at any number of texts.

They are learned from a bounded sample of labelled texts per language: an n-gram belongs to the languages
in which its share is at least ``SHARE`` of its largest share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import grams
from panelwright.llm.store import Workspace
from panelwright.session import ship_package

TRAINING_TEXTS = 2_000
WORD = 64
SLOTS, HASHES = 1 << 19, 3
GRAM = 4
LEAST_COUNT, SHARE = 3, 0.5
UNKNOWN = "und"

# Letters in lower case, bytes of other scripts as they are, all else as a blank.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = _PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_letter = regex.compile(r"\p{L}").search


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def byte_grams(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each row with at least two bytes other than blanks, as numbers, and their rows."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    plain = _PLAIN[data]
    value, full = np.zeros(n, np.uint32), np.zeros(n, np.uint8)
    for j in range(GRAM):
        part = plain[j : j + n]
        value = value << np.uint32(8) | part
        full += part != 32
    whole = full >= 2
    for cut in begins[1:-1]:
        whole[max(0, cut - GRAM + 1) : cut] = False
    return value[whole], np.repeat(np.arange(len(begins) - 1), np.diff(begins))[:n][whole]


def slots_of(value: np.ndarray) -> list[np.ndarray]:
    h = grams.mix(value.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    bits = SLOTS.bit_length() - 1
    return [(h >> np.uint64(j * bits) & np.uint64(SLOTS - 1)).astype(np.int64) for j in range(HASHES)]


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = batch.column("language").to_numpy()
        for lo, _, data, begins in grams.groups(batch.column("text")):
            value, row = byte_grams(data, begins)
            both = numbers[lo + row].astype(np.uint64) << np.uint64(32) | value
            key, times = np.unique(both, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array((key >> np.uint64(32)).astype(np.int32)), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(times)],
                ["language", "gram", "times"],
            )


def _filled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, mask = batch.column("word"), batch.column("mask")
        for slot in slots_of(batch.column("gram").to_numpy()):
            yield pa.RecordBatch.from_arrays([word, pa.array(slot), mask], ["word", "slot", "mask"])


class Filters:
    """The learned languages (by falling number of texts, then name), and the slots: one row of them for each ``WORD`` languages."""

    def __init__(self, languages: list[str], slots: np.ndarray):
        self.languages, self.slots = languages, slots
        bits = [(slots[j // WORD] >> np.uint64(j % WORD) & np.uint64(1)).sum() / SLOTS for j in range(len(languages))]
        self.chance = np.asarray(bits) ** HASHES

    def counts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Per row and language: n-grams found, less those expected by chance."""
        value, row = byte_grams(data, begins)
        first, second, third = slots_of(value)
        masks = [word[first] & word[second] & word[third] for word in self.slots]
        rows = len(begins) - 1
        total = np.bincount(row, minlength=rows)
        out = np.zeros((rows, len(self.languages)))
        for j, chance in enumerate(self.chance):
            seen = np.bincount(row[(masks[j // WORD] >> np.uint64(j % WORD) & np.uint64(1)).astype(bool)], minlength=rows)
            out[:, j] = np.maximum(0, (seen - total * chance) / (1 - chance)) if chance < 1 else 0
        return out

    def decide(self, column: pa.Array) -> Iterator[tuple[str, float]]:
        for lo, hi, data, begins in grams.groups(column):
            found = self.counts(data, begins) if self.languages else np.zeros((hi - lo, 1))
            ascii_letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
            plain = ascii_letters[begins[1:]] > ascii_letters[begins[:-1]]
            for i in range(hi - lo):
                text = column[lo + i]
                if not self.languages or not text.is_valid or not (plain[i] or _letter(text.as_py())):
                    yield UNKNOWN, 0.0
                    continue
                best, total = int(found[i].argmax()), found[i].sum()
                yield self.languages[best], float(found[i][best] / total) if total else 0.0


def learn(ws: Workspace, df: DataFrame, id_col: str, text_col: str, lang_col: str) -> Filters:
    """From at most ``TRAINING_TEXTS`` texts of each labelled language, by hashed id."""
    spark = df.sparkSession
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    named = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("name"))
    ranked = named.groupBy("name").count().orderBy(F.desc("count"), "name")
    languages = [r["name"] for r in ranked.collect()]
    if not languages:
        return Filters([], np.zeros((1, SLOTS), np.uint64))
    numbers = spark.createDataFrame(list(enumerate(languages)), "language int, name string")
    order = Window.partitionBy("name").orderBy(F.xxhash64("id"), "id")
    chosen = named.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= TRAINING_TEXTS)
    chosen = ws.table(chosen.join(F.broadcast(numbers), "name").select("id", "language").distinct())
    texts = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    counts = texts.select("language", "text").mapInArrow(_counted, "language int, gram long, times long")
    counts = ws.table(counts.groupBy("language", "gram").agg(F.sum("times").alias("times")))
    sizes = counts.groupBy("language").agg(F.sum("times").alias("size"))
    shares = counts.where(F.col("times") >= LEAST_COUNT).join(F.broadcast(sizes), "language").withColumn("share", F.col("times") / F.col("size"))
    largest = shares.groupBy("gram").agg(F.max("share").alias("largest"))
    member = shares.join(largest, "gram").where(F.col("share") >= SHARE * F.col("largest"))
    word = F.floor(F.col("language") / WORD).cast("int").alias("word")
    masks = member.groupBy("gram", word).agg(F.bit_or(F.expr(f"shiftleft(1L, language % {WORD})")).alias("mask"))
    filled = masks.mapInArrow(_filled, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    slots = np.zeros((-(-len(languages) // WORD), SLOTS), np.uint64)  # at most SLOTS rows a word come here
    slots[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    return Filters(languages, slots)


def identify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per input row: id, ``held_out``, ``lang_pred``, ``score`` (the winner's part of all counts).

    Texts whose id's crc32 leaves 2 modulo 4 are never learned from. NULL text and text without a letter is
    ``und`` with score 0, as is all text if nothing was learned. A text none of whose n-grams is known gets
    the most frequent language, with score 0; of equal counts the more frequent language wins. Repeated rows are
    judged each; other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ship_package(spark)
    filters = learn(Workspace(spark, "language"), df, id_col, text_col, lang_col)
    shared = spark.sparkContext.broadcast((filters.languages, filters.slots.tobytes()))
    rows = df.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, slots = shared.value
        known = Filters(languages, np.frombuffer(slots, np.uint64).reshape(-1, SLOTS))
        for batch in batches:
            found = list(known.decide(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("held_out"),
                    pa.array([name for name, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                ["id", "held_out", "lang_pred", "score"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(judged, f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
