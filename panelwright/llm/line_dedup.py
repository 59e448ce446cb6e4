"""Near-equal lines across documents by a segment-partition edit join.

Two lines are linked if they are within ``allowed`` edits of each other: one for each ``EDIT_CHARS`` characters of the
shorter line, up to ``tau``. Shorter lines are linked with nothing but their copies.

A line of ``n`` characters is cut into ``tau`` + 1 even segments. If another line is within ``tau`` edits, one
of these segments occurs in it unchanged, close to its own place. So each distinct line is indexed under
(segment number, segment), and probes the lengths from its own down to ``tau`` less with the few
substrings that can be an unchanged segment there; a substring that serves several lengths is one probe. Pairs that
meet are verified once, without their common beginning and end, by a banded
bit-parallel edit distance: one word of ``2 tau + 2`` bits holds a column of the band.

A segment that many lines share, as those made from one pattern do, isn't a reason to compare them all. What is left of
two such lines without the shared piece is within ``tau`` edits too, so it is cut again in the same way, and
lines meet only where a second piece is the same, and so on. A key is split up while its lines outnumber ``GROUP``
times ``tau`` + 1 to the power of the pieces so far: each piece has so many of the next level, so this never costs
more than comparing the lines would, and no pair is lost. Lines that do meet there are put out as a pair only if their
counts of characters are close enough.

Linked lines form classes; the first line of a class, by document and line number, stays. Copies of a line
are one row before anything is joined. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from panelwright.llm.components import components
from panelwright.llm.store import Workspace

TAU = 2
EDIT_CHARS = 8
GROUP = 16
# Any disjoint sets of characters will do; these are frequent in many languages.
BAGS = ("eE", "tT", "nN", "aA", "hH", "oOuU", "rRsS", "iIlL", "dDcC", "0123456789")


def _span(n: Column, i: Column, tau: int) -> tuple[Column, Column]:
    """Where segment ``i`` of a line of ``n`` characters begins, and its length. The last segments are one character longer."""
    longer = n % (tau + 1)
    short = F.call_function("div", n - longer, F.lit(tau + 1)).cast("int")
    return short * (i - 1) + F.greatest(F.lit(0), i - (tau + 2) + longer) + 1, short + F.when(i > tau + 1 - longer, 1).otherwise(0)


def _places(tau: int, moved: bool) -> list[list[tuple[int, int, int]]]:
    """For each remainder of a line's length by ``tau`` + 1, where its own segments are; with ``moved``, the other
    substrings of it that can be a segment of a line that is as long or up to ``tau`` shorter, each of them once.

    A place is (segment, start, size). The quotient is to be added to the size, and to the start once for each segment before.
    """

    def place(rest: int, less: int, i: int, shift: int) -> tuple[int, int, int]:
        quotient, longer = divmod(rest - less, tau + 1)
        return i, quotient * (i - 1) + max(0, i - (tau + 2) + longer) + 1 + shift, quotient + (i > tau + 1 - longer)

    own = [[place(rest, *p) for p in _index_places(tau)] for rest in range(tau + 1)]
    return [sorted({place(rest, *p) for p in _probe_places(tau)} - set(own[rest])) for rest in range(tau + 1)] if moved else own


def _keys(texts: DataFrame, tau: int, moved: bool) -> DataFrame:
    """(key, h): hash of segment number and substring, for each of the ``_places`` of ``line``."""
    rest = F.col("n") % (tau + 1)
    quotient = F.call_function("div", F.col("n") - rest, F.lit(tau + 1)).cast("int")
    names = ("i", "start", "size")
    each = F.array(*(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(names, p, strict=True))) for p in places)) for places in _places(tau, moved)))
    rows = texts.select("h", "line", "n", quotient.alias("quotient"), F.inline(F.get(each, rest)))
    start, size = F.col("quotient") * (F.col("i") - 1) + F.col("start"), F.col("quotient") + F.col("size")
    # The filter is on the place alone, so that no substring is made and hashed for it.
    fits = rows.where((size >= 0) & (start >= 1) & (start + size <= F.col("n") + 1))
    return fits.select(F.xxhash64("i", F.substring("line", start, size)).alias("key"), "h")


def _pieces(rows: DataFrame, tau: int, places: list[tuple[int, int, int]]) -> DataFrame:
    """Keys as those of ``_keys``, for each of ``places`` that fits ``line``, with what is left of the line without the piece.

    A place is (characters less, segment from 1, shift): the segment of a line that is so much shorter, in
    this line, moved by the shift. Rows that have a ``key`` already keep to their difference in length, ``gap``, and
    the new key goes on from theirs and holds the length. ``passed`` gets the hashes of the line's own segments before this one.
    """
    each = F.array(*(F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in places))
    chained = "key" in rows.columns
    if chained:
        each = F.filter(each, lambda p: p["less"] == F.col("gap"))
    own = [F.xxhash64(F.substring("line", *_span(F.col("n"), F.lit(i), tau))) for i in range(1, tau + 1)]
    rows = rows.withColumn("own", F.array(*own))
    rows = rows.select("*", F.inline(each)).withColumn("other", F.col("n") - F.col("less"))
    start, size = _span(F.col("other"), F.col("i"), tau)
    start = start + F.col("shift")
    rows = rows.where((F.col("other") >= 0) & (start >= 1) & (start + size <= F.col("n") + 1))
    key = F.xxhash64(*(["key", "other"] if chained else []), "i", F.substring("line", start, size))
    left = F.concat(F.substring("line", F.lit(1), start - 1), F.substring("line", start + size, F.col("n")))
    before = F.when(F.col("less") == 0, F.slice("own", F.lit(1), F.col("i") - 1)).otherwise(F.array().cast("array<bigint>"))
    passed = F.concat("passed", before) if chained else before
    bags = [c for c in rows.columns if c.startswith("bag_")]
    out = rows.select(key.alias("key"), "h", left.alias("line"), F.col("less").alias("gap"), passed.alias("passed"), *bags)
    return out.withColumn("n", F.length("line"))


def _index_places(tau: int) -> list[tuple[int, int, int]]:
    return [(0, i, 0) for i in range(1, tau + 2)]


def _probe_places(tau: int) -> list[tuple[int, int, int]]:
    """For each shorter length and segment, the shifts that both the left and the right part allow."""
    out = []
    for less in range(tau + 1):
        for i in range(1, tau + 2):
            right = tau + 1 - i
            out += [(less, i, shift) for shift in range(max(1 - i, less - right), min(i - 1, less + right) + 1)]
    return out


def _alike(part: Callable[[str, Column], Column], least: Column) -> Column:
    """The largest count of characters, up to ``least``, for which ``part`` gives the same of both texts: found bit by bit."""

    def grown(found: Column, bit: Column) -> Column:
        tried = found + F.call_function("shiftleft", F.lit(1), bit)
        same = (tried <= least) & (part("longer", tried) == part("shorter", tried))
        return F.when(same, tried).otherwise(found)

    return F.aggregate(F.sequence(F.length(F.bin(least)) - 1, F.lit(0), F.lit(-1)), F.lit(0), grown)


def edit_distance(longer: Column, shorter: Column, tau: int) -> Column:
    """Edit distance of two texts if it is at most ``tau``, else more than ``tau``.

    What both begin and end with is left out, as far as the longer one keeps ``tau`` characters. Bit ``top`` of a word
    belongs to the cell ``tau`` below the diagonal. The score follows that cell down to
    the last row and then along it. The longer text must have ``tau`` or more characters, and no more
    than ``tau`` more than the other. The texts are split once, into the only element of an array.
    """
    both = F.array(F.struct(longer.alias("longer"), shorter.alias("shorter"), F.length(longer).alias("n"), F.length(shorter).alias("m")))

    def ends(s: Column) -> Column:
        head, tail = _alike(lambda x, k: F.left(s[x], k), s["m"]), _alike(lambda x, k: F.right(s[x], k), s["m"])
        return F.struct(*(s[c].alias(c) for c in ("longer", "shorter", "n", "m")), head.alias("head"), F.least(tail, s["n"] - tau).alias("tail"))

    def inner(s: Column) -> Column:
        head = F.least(s["head"], s["m"] - s["tail"], s["n"] - s["tail"] - tau)
        cut = [F.substring(s[x], head + 1, s[size] - s["tail"] - head) for x, size in (("longer", "n"), ("shorter", "m"))]
        return F.struct(F.split(cut[0], "").alias("longer"), F.split(cut[1], "").alias("shorter"))

    for step in (ends, inner, lambda s: _array_distance(s["longer"], s["shorter"], tau)):
        both = F.transform(both, step)
    return F.get(both, F.lit(0))


def _array_distance(longer: Column, shorter: Column, tau: int) -> Column:
    width = 2 * tau + 2
    top, every = width - 1, (1 << width) - 1
    start = F.struct(
        F.lit(((1 << (tau + 1)) - 1) << (width - tau - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(tau).cast("long").alias("dist")
    )
    down = F.size(longer) - tau

    def bits(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(every))

    def step(acc: Column, i: Column) -> Column:
        char = F.get(shorter, i)
        match = F.lit(0).cast("long")
        for b in range(width):
            match = match + F.when(F.get(longer, i + (tau - top + b)).eqNullSafe(char), 1 << b).otherwise(0)
        return F.struct(acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["dist"].alias("dist"), match.alias("x"), i.alias("i"))

    def diagonal(s: Column) -> Column:
        vp, vn, x = s["vp"], s["vn"], s["x"]
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(every))
        return F.struct(vp.alias("vp"), vn.alias("vn"), s["dist"].alias("dist"), s["i"].alias("i"), d0.alias("d0"))

    def moved(s: Column) -> Column:
        vp, vn, d0 = s["vp"], s["vn"], s["d0"]
        hp, hn = vn.bitwiseOR(bits(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
        half = F.shiftrightunsigned(d0, 1)
        mask = F.expr(f"shiftleft(1L, {top - 1})")
        at = F.call_function("shiftrightunsigned", mask, (s["i"] - down).cast("int"))
        along = F.when(hp.bitwiseAND(at) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(at) != 0, 1).otherwise(0)
        below = F.when(d0.bitwiseAND(F.lit(1 << top)) == 0, 1).otherwise(0)
        return F.struct(
            hn.bitwiseOR(bits(half.bitwiseOR(hp))).alias("vp"),
            half.bitwiseAND(hp).alias("vn"),
            (s["dist"] + F.when(s["i"] < down, below).otherwise(along)).alias("dist"),
        )

    def once(acc: Column, i: Column) -> Column:
        # One-element arrays give names to intermediate words, which an expression would otherwise repeat.
        first = F.transform(F.array(step(acc, i)), diagonal)
        # The score falls by no more than `tau` at the end, so from 2 tau + 1 on it can't come back.
        return F.when(acc["dist"] > 2 * tau, acc).otherwise(F.get(F.transform(first, moved), F.lit(0)))

    n = F.size(shorter)
    over = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(over, start, once, lambda acc: acc["dist"])


def _lines(text: Column) -> Column:
    """Lines with a character other than ASCII white space, and their numbers, counted over all lines from 0."""
    every = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("nth"), x.alias("line")))
    return F.filter(every, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))


def _counted(lines: DataFrame) -> DataFrame:
    """How many characters of each of ``BAGS`` a line has. One edit moves one character from one set to another at most."""
    return lines.withColumns({f"bag_{i}": F.length("line") - F.length(F.translate("line", chars, "")) for i, chars in enumerate(BAGS)})


def _met(index: DataFrame, probe: DataFrame, tau: int | None = None) -> DataFrame:
    """Pairs with an equal key; with ``tau``, those whose characters allow so many edits.

    Two lines of one length that share a segment before the one that they met by are left to that one.
    """
    more = ["passed", *(f"bag_{i}" for i in range(len(BAGS)))] if tau is not None else []
    x = index.select("key", F.col("h").alias("x"), *(F.col(c).alias(f"x_{c}") for c in more))
    y = probe.select("key", F.col("h").alias("y"), *(F.col(c).alias(f"y_{c}") for c in more))
    # No key has many lines in the index here, so its part of a task's keys fits a hash table.
    met = x.hint("shuffle_hash").join(y, "key").where("x <> y")
    if more:
        apart = sum((F.abs(F.col(f"x_{c}") - F.col(f"y_{c}")) for c in more[1:]), F.lit(0))
        earlier = F.exists(F.zip_with("x_passed", "y_passed", lambda a, b: a == b), lambda e: F.coalesce(e, F.lit(False)))
        met = met.where((apart <= 2 * tau) & ~earlier)
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def candidate_pairs(ws: Workspace, texts: DataFrame, tau: int) -> DataFrame:
    """(x, y), x < y, for the hashes of lines of ``texts`` (line, h, n) that share enough pieces to be within ``tau`` edits."""
    index, probe = ws.table(_keys(texts, tau, False)), _keys(texts, tau, True)
    # Lines that share a segment in its own place have one key in the index.
    shared = ws.table(index.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    many = ws.table(shared.where(F.col("size") > GROUP).select("key"))
    same = ws.table(index.join(shared.where(F.col("size") <= GROUP).select("key"), "key", "left_semi"))
    crowded = not many.isEmpty()
    pairs = [_met(same, same)]
    if not crowded:
        pairs.append(_met(index, probe))
    else:
        # One row stands for all lines of a key that many share: it tells which lines probe that key.
        few = index.join(many, "key", "left_anti").union(many.select("key", F.lit(None).cast("long").alias("h")))
        met = few.select("key", F.col("h").alias("x")).hint("shuffle_hash").join(probe.select("key", F.col("h").alias("y")), "key")
        met = ws.table(met.where("x IS NULL OR x <> y").select("x", "y"))
        pairs.append(met.where("x IS NOT NULL").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
        reached = met.where("x IS NULL").select(F.col("y").alias("h")).union(index.join(many, "key", "left_semi").select("h"))
        lines = _counted(texts.join(ws.table(reached.distinct()), "h", "left_semi"))
        both = [_pieces(lines, tau, p).join(many, "key", "left_semi") for p in (_index_places(tau), _probe_places(tau))]
        level = 1
        while crowded:
            both = [ws.table(_pieces(rows, tau, p)) for rows, p in zip(both, (_index_places(tau), _probe_places(tau)), strict=True)]
            sizes = both[0].groupBy("key").agg(F.count(F.lit(1)).alias("size"))
            many = ws.table(sizes.where(F.col("size") > GROUP * (tau + 1) ** level).select("key"))
            crowded = not many.isEmpty()
            pairs.append(_met(both[0].join(many, "key", "left_anti") if crowded else both[0], both[1], tau))
            both = [rows.join(many, "key", "left_semi") for rows in both]
            level += 1
    met = pairs[0]
    for more in pairs[1:]:
        met = met.union(more)
    return ws.table(met.distinct())


def line_links(ws: Workspace, lines: DataFrame, tau: int = TAU) -> DataFrame:
    """(a, b) for each two distinct linked lines, by the 128-bit digests of the lines, a < b."""
    n = F.length("line")
    texts = ws.table(lines.where(n >= EDIT_CHARS).groupBy("line").agg(F.lit(1).alias("one")).select("line", F.xxhash64("line").alias("h"), n.alias("n")))
    near = []
    for edits in range(1, tau + 1):
        # Of a pair with so many edits, the shorter line has less than `above` characters.
        above = EDIT_CHARS * (edits + 1)
        part = texts.where(F.col("n") >= EDIT_CHARS * edits)
        if edits < tau:
            part = part.where(F.col("n") < above + edits)
        x = part.select(F.col("h").alias("x"), F.col("line").alias("line_x"), F.col("n").alias("n_x"))
        y = part.select(F.col("h").alias("y"), F.col("line").alias("line_y"), F.col("n").alias("n_y"))
        full = candidate_pairs(ws, part, edits).join(x, "x").join(y, "y").where(F.abs(F.col("n_x") - F.col("n_y")) <= edits)
        if edits < tau:
            full = full.where(F.least("n_x", "n_y") < above)
        swap = F.col("n_x") >= F.col("n_y")
        full = full.select(
            "line_x",
            "line_y",
            F.when(swap, F.col("line_x")).otherwise(F.col("line_y")).alias("longer"),
            F.when(swap, F.col("line_y")).otherwise(F.col("line_x")).alias("shorter"),
        )
        near.append(full.where(edit_distance(F.col("longer"), F.col("shorter"), edits) <= edits).select("line_x", "line_y"))
    every = near[0]
    for more in near[1:]:
        every = every.union(more)
    a, b = F.unhex(F.md5(F.col("line_x").cast("binary"))), F.unhex(F.md5(F.col("line_y").cast("binary")))
    return ws.table(every.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct())


def line_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """One row per input row: id, ``n_lines``, ``n_links``, ``n_removed``, ``removed`` and ``first_ids``.

    ``n_lines`` counts the lines that aren't blank. ``n_links`` counts the links of its lines with different
    lines. ``removed`` has the numbers, from 0, of the lines of whose class another line comes first in the order of
    (id, line number); ``first_ids`` the distinct ids of those first lines. NULL and empty texts have no
    lines. Repeated rows hold the same lines twice: those of the row read later are removed. NULL ids come
    first. Other columns are ignored, whatever their names.
    """
    ws = Workspace(df.sparkSession, "lines")
    found = _lines(F.col(text_col))
    digests = F.transform(found, lambda x: F.struct(x["nth"].alias("nth"), F.unhex(F.md5(x["line"].cast("binary"))).alias("node")))
    rows = ws.table(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), digests.alias("lines")))
    spots = rows.select("row", "id", F.inline("lines"))
    links = line_links(ws, df.select(F.inline(found)).select("line"), tau)
    joined = components(ws, links)
    degree = links.union(links.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    linked = ws.table(joined.join(degree, "node"))
    classes = spots.join(linked, "node", "left").select(
        "row", "id", "nth", F.coalesce("component", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links")
    )
    first = classes.groupBy("class").agg(F.min(F.struct("id", "row", "nth")).alias("first"), F.count(F.lit(1)).alias("size"))
    later = classes.join(first.where("size > 1"), "class", "left")
    gone = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.struct("id", "row", "nth"))
    by_row = later.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("links").alias("n_links"),
        F.sort_array(F.collect_list(F.when(gone, F.col("nth")))).alias("removed"),
        F.sort_array(F.collect_set(F.when(gone, F.col("first.id")))).alias("first_ids"),
    )
    zero, none = F.lit(0).cast("long"), F.array()
    ids = ArrayType(df.schema[id_col].dataType)
    return rows.select("id", "row").join(by_row, "row", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_lines", zero).alias("n_lines"),
        F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce(F.size("removed"), zero).cast("long").alias("n_removed"),
        F.coalesce("removed", none.cast("array<int>")).alias("removed"),
        F.coalesce("first_ids", none.cast(ids)).alias("first_ids"),
    )
