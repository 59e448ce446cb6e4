"""Passages of ``k`` words that occur anywhere else in the corpus, found with suffix automata of its shards.

Here the corpus is its own reference, so it has no size bound and its automata can't be sent to every
executor whole. They are cut into shards by content, and each shard meets only the text that can match it:

1. Each window of ``k`` words is represented by its anchor, the least hash of its ``ANCHOR_WORDS``-word
   runs. Equal windows have equal anchors. Windows in a row with one anchor form a passage.
2. Anchors that occur once in the corpus are dropped. What is left is a few percent of the text and all
   copied passages; each distinct passage of an anchor is kept once, with its number of occurrences.
3. All passages of an anchor make one reference shard: a generalised suffix automaton over words, whose
   states carry numbers of occurrences. Passages are streamed through it for matching statistics cut at
   ``k``: a window is repeated if the state reached has two occurrences or more. This compares words, so
   equal hashes of different texts do no harm.
4. An anchor with more than ``SHARD_WORDS`` words of distinct passages (the edges of a passage that very
   many documents embed) isn't gathered in one task: its windows are counted by a 128-bit digest instead.

The words covered by repeated windows are then removed from the documents that have any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import grams
from panelwright.llm.store import Workspace
from panelwright.session import ship_package

WINDOW_WORDS = 35
ANCHOR_WORDS = 8
SHARD_WORDS = 200_000
REMEMBERED = 200_000


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; each adds ``times`` occurrences of its factors."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, out: dict[bytes, int]) -> int:
        self.next.append(out)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state that ``p`` reaches by ``word``, split off if it also stands for longer contexts."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes], times: int) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
            else:
                p, new = last, self._state(self.length[last] + 1, 0, {})
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word)
                last = new
            self.count[last] += times

    def finish(self) -> None:
        """Carries occurrences from longer contexts to their suffixes."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def repeated(self, words: list[bytes], k: int) -> list[int]:
        """Starts of the windows of ``k`` words of an added sequence that occur twice or more."""
        v, out = 0, []
        for i, word in enumerate(words):
            v = self.next[v][word]
            while self.length[self.link[v]] >= k:
                v = self.link[v]
            if i + 1 >= k and self.count[v] > 1:
                out.append(i + 1 - k)
        return out


def anchors(h: np.ndarray, at: np.ndarray, k: int, a: int) -> tuple[np.ndarray, ...]:
    """(anchor, row, first window, last window, occurs again within) of each passage; windows count from their row's start."""
    run = grams.runs(h, a)
    span = k - a + 1
    n = len(h) - k + 1
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, bool))
    if n <= 0:
        return none
    least, width = run, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    row = grams.row_of(at)
    whole = np.flatnonzero(row[:n] == row[k - 1 :])
    if not whole.size:
        return none
    value, owner = least[whole], row[whole]
    opens = np.ones(len(whole), bool)
    opens[1:] = (value[1:] != value[:-1]) | (whole[1:] != whole[:-1] + 1) | (owner[1:] != owner[:-1])
    first = whole[opens]
    last = whole[np.append(np.flatnonzero(opens)[1:], len(whole)) - 1]
    value, owner = value[opens], owner[opens]
    seen = np.zeros(len(first), np.int64)
    for j in range(2 * span - 1):  # a longer passage holds its anchor twice in any case
        place = first + j
        inside = place < last + span
        seen += inside & (run[np.where(inside, place, 0)] == value)
    again = (seen > 1) | (last - first + 1 > span)
    return value, owner, first - at[owner], last - at[owner], again


def _facts(k: int, a: int):
    """Per document: number of words, digest of all words, and its passages."""
    kinds = pa.list_(pa.struct([("anchor", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("again", pa.bool_())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, hi, data, begins in grams.groups(column):
                h, _, _, at = grams.words(data, begins)
                value, owner, first, last, again = anchors(h, at, k, a)
                raw = data.tobytes()
                digests = [hashlib.sha256(b" ".join(raw[b:e].split())).hexdigest() for b, e in zip(begins, begins[1:])]  # noqa: B905
                rows = pa.StructArray.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(again)],
                    fields=list(kinds.value_type),
                )
                cuts = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo),
                        batch.column("hash").slice(lo, hi - lo),
                        pa.array(np.diff(at)),
                        pa.array(digests),
                        pa.ListArray.from_arrays(pa.array(cuts), rows, type=kinds),
                    ],
                    ["id", "hash", "n_words", "all_sha256", "passages"],
                )

    return run


def _passages(k: int):
    """Occurrences of passages; a passage's words come along unless this task has just given them."""
    kinds = {"row": pa.int64(), "first": pa.int32(), "anchor": pa.int64(), "key": pa.binary(), "words": pa.binary()}

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()
        for batch in batches:
            out: list[tuple] = []
            for row, text, found in zip(batch.column("row"), batch.column("text"), batch.column("found"), strict=True):
                words, row = text.as_py().encode().split(), row.as_py()
                for p in found.as_py():
                    passage = b" ".join(words[p["first"] : p["last"] + k])
                    key = hashlib.blake2b(passage, digest_size=16).digest()
                    known = (p["anchor"], key) in seen
                    if not known:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add((p["anchor"], key))
                    out.append((row, p["first"], p["anchor"], key, None if known else passage))
                if len(out) > 20_000:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    return run


def _shards(k: int):
    """From distinct passages sorted by anchor: the repeated windows of each, by its shard's automaton."""

    def judged(shard: list[tuple[int, bytes, bytes, int]]) -> Iterator[tuple[int, bytes, list[int]]]:
        sequences = [words.split() for _, _, words, _ in shard]
        automaton = SuffixAutomaton()
        for (_, _, _, times), words in zip(shard, sequences, strict=True):
            automaton.add(words, times)
        automaton.finish()
        for (anchor, key, _, _), words in zip(shard, sequences, strict=True):
            if starts := automaton.repeated(words, k):
                yield anchor, key, starts

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["anchor", "key", "starts"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "words", "times")), strict=True):
                if shard and shard[0][0] != row[0]:
                    out += judged(shard)
                    shard = []
                shard.append(row)
            if out:
                yield packed(out)
                out = []
        if shard:
            out += judged(shard)
        yield packed(out)

    return run


def _windows(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "key", "times", "start", "digest"]
        for batch in batches:
            for anchor, key, words, times in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "words", "times")), strict=True):
                w = words.split()
                digests = [hashlib.blake2b(b" ".join(w[i : i + k]), digest_size=16).digest() for i in range(len(w) - k + 1)]
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * n, pa.int64()), pa.array([key] * n, pa.binary()), pa.array([times] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(digests, pa.binary())],
                    names,
                )

    return run


def _cut(k: int):
    """Documents with the starts of their repeated windows: what is left of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text, starts in zip(batch.column("row"), batch.column("text"), batch.column("starts"), strict=True):
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.unique(starts.values.to_numpy())
                edge[at] += 1
                edge[at + k] -= 1
                kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()
                rows.append((row.as_py(), len(words) - len(kept), b" ".join(map(words.__getitem__, kept)).decode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["row", "n_removed", "kept_text"])

    return run


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW_WORDS, anchor_words: int = ANCHOR_WORDS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed``, ``kept_text`` (NULL if nothing was removed), ``kept_sha256``.

    Words are maximal runs without ASCII white space; ``kept_text`` joins those left by one space. NULL and
    empty texts have no words. Repeated rows are copies of each other, so their windows all repeat. A text
    of fewer than ``k`` words stays as it is. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ship_package(spark)
    ws = Workspace(spark, "repeats")
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    kind = texts.schema["id"].dataType.simpleString()
    passage = "array<struct<anchor:bigint,first:int,last:int,again:boolean>>"
    facts = texts.select("id", "hash", "text").mapInArrow(
        _facts(k, anchor_words), f"id {kind}, hash long, n_words long, all_sha256 string, passages {passage}"
    )
    facts = ws.table(facts.withColumn("row", F.monotonically_increasing_id()))

    at = facts.select("row", F.inline("passages"))
    often = at.groupBy("anchor").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("n")).where("n > 1")
    found = (
        at.join(often.select("anchor"), "anchor", "left_semi")
        .groupBy("row")
        .agg(F.collect_list(F.struct("anchor", "first", "last")).alias("found"))
    )
    # Repeated rows are found under one id and hash; each of them gets its own passages.
    places = facts.select("row", "id", "hash").join(found, "row")
    wanted = places.groupBy("id", "hash").agg(F.collect_list(F.struct("row", "found")).alias("rows"))
    key = F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.hash") == F.col("w.hash"))
    distinct_texts = texts.alias("t").join(wanted.alias("w"), key).select("text", F.col("t.id").alias("id"), F.col("t.hash").alias("hash"), "rows")
    one_each = distinct_texts.where(F.size("rows") == 1).unionByName(
        distinct_texts.where(F.size("rows") > 1).dropDuplicates(["id", "hash"])
    )
    held = ws.table(one_each.select("text", F.inline("rows")))

    spots = ws.table(held.mapInArrow(_passages(k), "row long, first int, anchor long, key binary, words binary"))
    times = spots.groupBy("anchor", "key").agg(F.count(F.lit(1)).alias("times"), F.max("words").alias("words"))
    times = ws.table(times.withColumn("n_words", F.octet_length("words")))
    size = times.groupBy("anchor").agg(F.sum("n_words").alias("bytes"), F.sum("times").alias("all"))
    sized = times.join(size, "anchor")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["anchor", "key", "words", "times"]
    by_shard = (
        sized.where(F.col("bytes") <= 6 * shard_words)
        .select(*columns)
        .repartition(parts, "anchor")
        .sortWithinPartitions("anchor", "key")
        .mapInArrow(_shards(k), "anchor long, key binary, starts array<int>")
    )
    large = sized.where(F.col("bytes") > 6 * shard_words).select(*columns)
    windows = ws.table(large.mapInArrow(_windows(k), "anchor long, key binary, times long, start int, digest binary"))
    again = windows.groupBy("digest").agg(F.sum("times").alias("n")).where("n > 1").select("digest")
    by_window = windows.join(again, "digest", "left_semi").groupBy("anchor", "key").agg(F.collect_list("start").alias("starts"))
    marks = ws.table(by_shard.union(by_window))

    starts = (
        spots.select("row", "first", "anchor", "key")
        .join(marks, ["anchor", "key"])
        .groupBy("row")
        .agg(F.flatten(F.collect_list(F.transform("starts", lambda s: s + F.col("first")))).alias("starts"))
    )
    cut = held.select("row", "text").join(starts, "row").mapInArrow(_cut(k), "row long, n_removed long, kept_text string")
    done = facts.select("row", "id", "n_words", "all_sha256").join(cut, "row", "left")
    return done.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        "kept_text",
        F.coalesce(F.sha2("kept_text", 256), "all_sha256").alias("kept_sha256"),
    )
