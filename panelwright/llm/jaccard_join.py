"""Documents linked by the Jaccard similarity of their word n-grams, joined on rare-first prefixes.

Two documents of threshold similarity share many n-grams among the first ones of any fixed order, so two
orders are used in turn. By hash, the first ``n - ceil(t n) + EXTRA n`` n-grams of a document (its sample)
are shuffled, and each gets its exact document frequency. Then the sample is put in rare-first order, and
``prefix_size`` of it is enough to meet every partner. N-grams that occur once come first and join with
nothing: a document that isn't mostly repeated elsewhere leaves here.

Join. The prefixes are joined by n-gram in two steps. First each document is paired with one hub: of the
documents that lead its n-grams, those with the least share of unrepeated n-grams, the one it meets most.
That connects groups of near copies by one pair for each member. Documents like the same hub then form blocks
of about ``BLOCK``, by size, and apart for those already connected with it and the others; any other
document is a block by itself. Blocks that share an n-gram and aren't one component make a pair of blocks, whose sets
are compared in one task. So no link between different texts is lost, no group is expanded into all its
pairs, and a text is moved once for each block it meets, not for each document.

Filters. Length: the smaller has at least ``t`` of the larger. Position and suffix: the repeated n-grams
before and after the shared one bound what both samples share, which must reach ``least_shared``; for a
block its members' extremes are taken. Each pair that is left is verified on both texts. Identical sets are
one node from the start.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import grams
from panelwright.llm.components import components
from panelwright.llm.store import Workspace
from panelwright.session import ship_package

WORDS, PERCENT = 5, 75
# Percent of a set's size by which the sample exceeds a prefix, and the cut of document frequencies.
EXTRA, FREQUENT = 12, 1_000
# Documents a block, and the percent of similarity with a hub that puts a document into its blocks.
BLOCK, ALIKE = 64, 25
REMEMBERED = 200_000
REMEMBERED_GRAMS = 4_000_000
COLUMNS = 100_000


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each row; a text of fewer than ``k`` words has one n-gram."""
    for first, last, data, begins in grams.groups(column):
        h, _, _, at = grams.words(data, begins, lower=True)
        run = grams.runs(h, k)
        for i in range(last - first):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= k:
                yield first + i, np.unique(run[a : b - k + 1])
            elif b > a:
                yield first + i, grams.mix(grams.runs(h[a:b], b - a) + np.uint64(b - a))
            else:
                yield first + i, np.zeros(0, np.uint64)


def least_partner(n, percent: int):
    return -(-percent * n // 100)


def extra(n: int) -> int:
    return max(1, EXTRA * n // 100)


def sample_size(n: int, percent: int) -> int:
    """So many n-grams, by hash: two linked documents share at least ``extra`` of the smaller one's size there."""
    return n - least_partner(n, percent) + extra(n)


def _sample_size(n: Column, percent: int) -> Column:
    return n - F.ceil(percent * n / 100) + F.greatest(F.lit(1), F.floor(EXTRA * n / 100))


def _prefix_size(n: Column, percent: int) -> Column:
    """So many of the sample, rarest first: linked documents share one of them, whatever the partner's size."""
    partner = F.ceil(percent * n / 100)
    return _sample_size(n, percent) - F.greatest(F.lit(1), F.floor(EXTRA * partner / 100)) + 1


def _possible(a: str, b: str, percent: int) -> Column:
    """Can documents of two rows of one n-gram still be linked? ``n``, ``pos`` and ``after`` may be ranges of a block.

    ``unsampled`` is the most n-grams that one of the documents has outside its sample; it doesn't always rise with ``n``.
    """
    lo_a, lo_b, hi_a, hi_b = (F.col(f"{x}.{c}") for c in ("n_low", "n_high") for x in (a, b))
    overlap = F.ceil(percent * (lo_a + lo_b) / (100 + percent))
    least_shared = overlap - F.greatest(f"{a}.unsampled", f"{b}.unsampled")
    most = F.least(f"{a}.pos", f"{b}.pos") + F.least(f"{a}.after", f"{b}.after")
    return (100 * F.least(hi_a, hi_b) >= percent * F.greatest(lo_a, lo_b)) & (most >= least_shared)


def _block_rows(postings: DataFrame, percent: int) -> DataFrame:
    """One row for each n-gram and block: the extremes of its documents, which ``_possible`` needs."""
    return postings.groupBy("token", "block").agg(
        F.min("n").alias("n_low"),
        F.max("n").alias("n_high"),
        F.max(F.col("n") - _sample_size(F.col("n"), percent)).alias("unsampled"),
        F.max("pos").alias("pos"),
        F.max(F.col("repeated") - F.col("pos")).alias("after"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
    )


def _facts(k: int):
    """Size and identity of each document's set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for _, h in sets_of(batch.column("text"), k):
                sizes.append(len(h))
                keys.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], ["id", "n", "key"])

    return run


def _samples(k: int, percent: int):
    """The sample of each document; a set that this task has just seen adds none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids, tokens, rows = batch.column("id"), [], []

            def out() -> pa.RecordBatch:
                row = np.repeat(rows, [len(t) for t in tokens])
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), ids.take(pa.array(row))], ["token", "id"])

            held = 0
            for i, h in sets_of(batch.column("text"), k):
                if not len(h):
                    continue
                key = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                if key in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                tokens.append(h[: sample_size(len(h), percent)])
                rows.append(i)
                held += len(tokens[-1])
                if held > 200_000:
                    yield out()
                    tokens, rows, held = [], [], 0
            if tokens:
                yield out()

    return run


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token: those of tokens with several rows, with that number, cut at ``FREQUENT``.

    Of the group at the end of a batch no more than ``FREQUENT`` rows are held back.
    """
    token, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    frequent = None  # the token whose rows have been given out already, as it reached the cut

    def rated(t: np.ndarray, i: np.ndarray, all_of: np.ndarray) -> pa.RecordBatch:
        keep = all_of > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(t[keep]), pa.array(i[keep]), pa.array(np.minimum(all_of[keep], FREQUENT).astype(np.int32))], ["token", "id", "frequency"]
        )

    for batch in batches:
        token = np.concatenate([token, batch.column("token").to_numpy()])
        ids = np.concatenate([ids, batch.column("id").to_numpy()])
        if not len(token):
            continue
        begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        sizes = np.diff(np.append(begins, len(token)))
        if frequent is not None and token[0] == frequent:
            sizes[0] = FREQUENT
        all_of = np.repeat(sizes, np.diff(np.append(begins, len(token))))
        if sizes[-1] >= FREQUENT:
            frequent, cut = token[-1], len(token)
        else:
            frequent, cut = None, begins[-1]
        yield rated(token[:cut], ids[:cut], all_of[:cut])
        token, ids = token[cut:], ids[cut:]
    if len(token):
        yield rated(token, ids, np.full(len(token), len(token)))


def _similarity(k: int):
    """Pairs with both texts: shared n-grams and n-grams of either."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, either = [], []
            for (_, x), (_, y) in zip(sets_of(batch.column("text_a"), k), sets_of(batch.column("text_b"), k), strict=True):
                both.append(len(np.intersect1d(x, y, assume_unique=True)))
                either.append(len(x) + len(y) - both[-1])
            counts = [pa.array(both, pa.int64()), pa.array(either, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *counts], ["a", "b", "both", "either"])

    return run


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of each of the first ``left`` sets with each of the others."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    out = np.zeros((left, len(sets) - left))
    for lo in range(0, len(shared), COLUMNS):
        at = (column >= lo) & (column < lo + COLUMNS)
        present = np.zeros((len(sets), min(COLUMNS, len(shared) - lo)), np.float32)
        present[owner[at], column[at] - lo] = 1
        out += present[:left] @ present[left:].T
    return out


def _between(k: int, percent: int):
    """Pairs of blocks with their documents: links that connect components, one for each that is connected."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[list[dict], list[np.ndarray]]] = {}
        held = 0

        def read(name: tuple, block: pa.ListScalar) -> tuple[list[dict], list[np.ndarray]]:
            """A block's documents and their sets; those of the blocks seen last stay, up to a number of n-grams."""
            nonlocal held
            if name not in known:
                docs = block.as_py()
                sets = [h for _, h in sets_of(pa.array([d.pop("text") for d in docs]), k)]
                held += sum(map(len, sets))
                if held > REMEMBERED_GRAMS:
                    known.clear()
                    held = sum(map(len, sets))
                known[name] = docs, sets
            return known[name]

        for batch in batches:
            found: list[tuple[int, int]] = []
            names = ([tuple(v.values()) for v in batch.column(c).to_pylist()] for c in ("x", "y"))
            for name_x, name_y, docs_x, docs_y in zip(*names, batch.column("docs_x"), batch.column("docs_y"), strict=True):
                (x, sets_x), (y, sets_y) = read(name_x, docs_x), read(name_y, docs_y)
                docs, sets = [*x, *y], [*sets_x, *sets_y]
                size = np.asarray([len(h) for h in sets])
                both = overlaps(sets, len(x))
                good = (both > 0) & (100 * both >= percent * (size[: len(x), None] + size[None, len(x) :] - both))
                root = {d["component"]: d["component"] for d in docs}

                def find(c: int, root: dict = root) -> int:
                    while root[c] != c:
                        c = root[c] = root[root[c]]
                    return c

                for i, j in zip(*np.nonzero(good), strict=True):
                    a, b = x[i], y[j]
                    if (p := find(a["component"])) != (q := find(b["component"])):
                        root[p] = q
                        found.append((a["rep"], b["rep"]))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def linked_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per input row: the id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Words are lower-cased in A to Z. NULL, empty and blank texts have no n-grams and link with nothing: their
    component is their own id. Rows that repeat an id are one node. A NULL id has a NULL component. Ids are
    integers; other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ship_package(spark)
    ws = Workspace(spark, "jaccard")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    facts = ws.table(texts.mapInArrow(_facts(k), "id long, n long, key binary"))
    known = facts.where("key is not null and id is not null")
    reps = ws.table(known.groupBy("key").agg(F.min("id").alias("rep")))  # written, so a hot key's join can be split
    classes = ws.table(known.join(reps, "key").select("id", "rep", "n").distinct())

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    repeated = (
        texts.where("id is not null")
        .mapInArrow(_samples(k, percent), "token long, id long")
        .repartition(parts, "token")
        .sortWithinPartitions("token")
        .mapInArrow(_repeated, "token long, id long, frequency int")
    )
    by_doc = repeated.join(classes, "id").groupBy("rep", "n").agg(F.sort_array(F.collect_set(F.struct("frequency", "token"))).alias("list"))
    n, held_back = F.col("n"), F.size("list")
    wanted = _prefix_size(n, percent) - (_sample_size(n, percent) - held_back)
    prefix = F.slice("list", F.lit(1), F.least(wanted, held_back).cast("int"))
    postings = ws.table(
        by_doc.where(wanted > 0)
        .select("rep", "n", held_back.alias("repeated"), F.posexplode(prefix).alias("pos", "gram"))
        .select("gram.token", "rep", "n", "repeated", "pos")
    )
    held = ws.table(texts.join(postings.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))

    row = F.struct("rep", F.col("n").alias("n_low"), F.col("n").alias("n_high"), "pos", (F.col("repeated") - F.col("pos")).alias("after"))
    unrepeated = (_sample_size(n, percent) - F.col("repeated")) / n
    leader = F.first(row).over(Window.partitionBy("token").orderBy(unrepeated, "n", "rep"))
    met = postings.select(row.alias("y"), leader.alias("x")).where("x.rep <> y.rep")
    hubs = met.groupBy(F.col("y.rep").alias("a"), F.col("x.rep").alias("b")).count().groupBy("a").agg(F.max(F.struct("count", -F.col("b"))).alias("best"))
    hubs = hubs.select("a", (-F.col("best.col2")).alias("b"))
    text_a = held.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    text_b = held.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    compared = ws.table(hubs.join(text_a, "a").join(text_b, "b").mapInArrow(_similarity(k), "a long, b long, both long, either long"))
    same = classes.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = ws.table(same.union(compared.where(100 * F.col("both") >= percent * F.col("either")).select("a", "b")))
    joined = components(ws, links)

    # Blocks of what is like a hub: kind 0 in the hub's component, kind 1 not, kind 2 documents without a hub.
    alike = compared.where(100 * F.col("both") >= ALIKE * F.col("either")).select(F.col("a").alias("rep"), F.col("b").alias("hub"))
    alike = alike.union(alike.select(F.col("hub").alias("rep"), "hub")).groupBy("rep").agg(F.min("hub").alias("hub"))
    of_doc, of_hub = joined.withColumnRenamed("node", "rep"), joined.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) * 2).cast("int")
    docs = postings.select("rep", step.alias("step")).distinct().join(of_doc, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    docs = docs.join(alike, "rep", "left").join(of_hub, "hub", "left")
    kind = F.when(F.col("hub").isNull(), 2).when(F.col("component") == F.coalesce("hub_component", "hub"), 0).otherwise(1)
    docs = ws.table(docs.select("rep", "component", F.coalesce("hub", "rep").alias("hub"), kind.alias("kind"), "step"))
    sizes = docs.groupBy("hub", "kind", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    block = F.struct("hub", "kind", "step", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part")).alias("block")
    docs = ws.table(docs.join(sizes, ["hub", "kind", "step"]).select("rep", "component", block))

    at = ws.table(_block_rows(postings.join(docs, "rep"), percent))
    split = at.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("token")
    open_rows = at.join(split, "token", "left_semi")
    several = (F.least("x.low", "y.low") < F.greatest("x.high", "y.high")) & _possible("x", "y", percent)
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.block") <= F.col("y.block")) & several
    pairs = open_rows.alias("x").join(open_rows.alias("y"), meet).select(F.col("x.block").alias("x"), F.col("y.block").alias("y"))
    pairs = ws.table(pairs.distinct().where((F.col("x") < F.col("y")) | (F.col("x.kind") == 1)))
    texts_of = docs.join(held.withColumnRenamed("id", "rep"), "rep").groupBy("block").agg(F.collect_list(F.struct("rep", "component", "text")).alias("docs"))
    texts_of = ws.table(texts_of)
    full = pairs.join(texts_of.select(F.col("block").alias("x"), F.col("docs").alias("docs_x")), "x")
    full = full.join(texts_of.select(F.col("block").alias("y"), F.col("docs").alias("docs_y")), "y")
    more = ws.table(full.select("x", "y", "docs_x", "docs_y").mapInArrow(_between(k, percent), "a long, b long"))
    if not more.isEmpty():
        joined = components(ws, ws.table(links.union(more)))
    found = facts.select("id", "n").join(joined.withColumnRenamed("node", "id"), "id", "left")
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
