"""Quality of texts: fixed base rules, then a hashed n-gram log-likelihood ratio.

Words and pairs of adjacent words are hashed to ``BUCKETS`` buckets. Two multinomials are counted over the
buckets: the target, from the trusted labelled texts, and the raw corpus, from every text.
A text's score is the mean, over its n-grams, of the logarithm of target over raw probability. It is held
in whole millionths, so sums don't depend on their order and a text always gets the same verdict.

Rare n-grams lower the score of any text outside the target, more so in a small corpus. The threshold is
therefore set on labelled texts that the target leaves out: where it best parts good ones from bad ones. Every
labelled text counts, either in the target or toward a threshold; thresholds are found by running sums over scores.

A few insults hardly move a mean. So the n-grams of labelled toxic texts are held against the raw corpus in the
same way, and once more, by other buckets, against the trusted ones; the lesser ratio counts. A text's largest one
has a threshold of its own, which has to keep nearly all good texts.

Texts move once at most, to meet their labels if those are too many to be sent to every task; labelled ones are
written with their roles. The first pass over the corpus is a scan, an explode and a partial aggregation, of which only
bucket counts are shuffled; the second sums a text's ratios inside its row. The table of ratios is one row with
an array of ``BUCKETS`` numbers at any size, which every task gets.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.store import Workspace, words_of
from panelwright.operators.ordered import running_sums

BUCKETS = 1 << 16
# The target is smoothed by so much of its own size of the raw distribution.
SMOOTHING = 0.3
# Occurrences that a toxic ratio takes for granted on either side, and the part of good texts that its threshold must keep.
TOXIC_PRIOR, CLEAN_KEPT = 20, 0.995
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50


def _with_grams(texts: DataFrame) -> DataFrame:
    """Adds ``pairs`` (hash of each two adjacent words) and ``grams`` (hash of each word and pair)."""
    n = F.size("words")
    out = texts.withColumn(
        "pairs",
        F.zip_with(
            F.slice("words", F.lit(1), F.greatest(n - 1, F.lit(0))),
            F.slice("words", F.lit(2), F.greatest(n - 1, F.lit(0))),
            lambda a, b: F.xxhash64(a, b),
        ),
    )
    return out.withColumn("grams", F.concat(F.transform("words", lambda w: F.xxhash64(w)), "pairs"))


def _n_words() -> Column:
    return F.size("words").cast("long").alias("n_words")


def _bucket(gram: Column) -> Column:
    return F.pmod(gram, F.lit(BUCKETS)).cast("int")


def _other_bucket(gram: Column) -> Column:
    return F.pmod(F.shiftright(gram, 24), F.lit(BUCKETS)).cast("int")


def _base(texts: DataFrame) -> DataFrame:
    """The base columns. Windows of three words are compared by 64-bit hashes within one text."""
    n = F.size("words")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    triples = F.zip_with(
        F.slice("pairs", F.lit(1), F.greatest(n - 2, F.lit(0))),
        F.slice("words", F.lit(3), F.greatest(n - 2, F.lit(0))),
        lambda h, w: F.xxhash64(h, w),
    )
    at = texts.withColumn("lines", lines).withColumn("triples", triples)
    some = F.size(F.array_distinct("triples")) < F.size("triples")
    placed = F.sort_array(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = at.withColumn("placed", F.when(some, placed))
    again = F.filter(
        "placed",
        lambda x, i: x["h"].eqNullSafe(F.get("placed", i - 1)["h"]) | x["h"].eqNullSafe(F.get("placed", i + 1)["h"]),
    )
    at = at.withColumn("again", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.zip_with(
        "again", F.slice("again", F.lit(2), F.size("again")), lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3)))
    )
    return at.select(
        "row",
        "id",
        "grams",
        _n_words(),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _texts(df: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    text, row = F.coalesce(F.col(text_col), F.lit("")), F.col(row_col) if row_col else F.monotonically_increasing_id()
    return df.select(
        row.alias("row"), F.col(id_col).alias("id"), text.alias("text"), words_of(F.col(text_col)).alias("words")
    )


def samples(ws: Workspace, labels: DataFrame) -> DataFrame:
    """(labelled_id, role) for every labelled id that isn't contradicted; role is target, good, bad, toxic or insult.

    A text is trusted if all its labels say quality 1 and not toxic, bad if they say quality 0 and not toxic, and toxic
    if one says so. Of the trusted and toxic ones a quarter, by hash, is left to set the thresholds (good, insult).
    """
    by_id = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("labelled_id"))
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .where("toxic > 0 or low = high")
    )
    apart = F.pmod(F.xxhash64("labelled_id"), F.lit(4)) == 0
    role = (
        F.when(F.col("toxic") > 0, F.when(apart, "insult").otherwise("toxic"))
        .when(F.col("low") == 1, F.when(apart, "good").otherwise("target"))
        .when(F.col("low") == 0, "bad")
    )
    return ws.table(by_id.select("labelled_id", role.alias("role")).where("role IS NOT NULL"))


def log_ratios(ws: Workspace, texts: DataFrame, labelled: DataFrame) -> list[DataFrame]:
    """For each bucket that occurs: (``bucket``, ``ratio``, ``toxic_ratio``), and (``bucket``, ``second_ratio``), in millionths.

    Without a target all ratios are 0, without toxic texts all toxic ones. The toxic ratio is that of the labelled toxic
    texts over what the raw corpus lets expect in them, held near 0 by ``TOXIC_PRIOR`` more on either side. The second
    one is that of toxic over trusted labelled texts, by other buckets of the same hashes: a long text meets the bucket
    of some insult by chance; it hardly meets both buckets of one.
    """
    # Not a plain explode: the filter that would be put before it computes the n-grams a second time.
    grams = _with_grams(texts).select(F.explode_outer("grams").alias("gram")).where("gram IS NOT NULL")
    every = ws.table(grams.groupBy(_bucket(F.col("gram")).alias("bucket")).agg(F.count(F.lit(1)).alias("raw")))
    # The other buckets come after the first ones. There an n-gram of a text counts once: one that a single toxic text repeats is no insult.
    slots = F.concat(
        F.transform("grams", _bucket), F.transform(F.array_distinct("grams"), lambda g: _other_bucket(g) + F.lit(BUCKETS))
    )
    counted = _with_grams(labelled.where("role IN ('target', 'toxic')")).select("role", F.explode_outer(slots).alias("slot"))
    marked = ws.table(
        counted.where("slot IS NOT NULL").groupBy("slot").agg(
            F.count_if(F.col("role") == "target").alias("target"), F.count_if(F.col("role") == "toxic").alias("toxic")
        )
    )
    first = marked.where(F.col("slot") < BUCKETS).withColumnRenamed("slot", "bucket")
    second = marked.where(F.col("slot") >= BUCKETS).select((F.col("slot") - BUCKETS).alias("bucket"), "target", "toxic")

    def totals(counts: DataFrame, *names: str) -> list[int]:
        return [n or 0 for n in counts.agg(*(F.sum(n) for n in names)).first()]

    def millionths(x: Column, name: str) -> Column:
        return F.round(x * 1e6).cast("long").alias(name)

    (raw,), (target, toxic), (target_once, toxic_once) = totals(every, "raw"), totals(first, "target", "toxic"), totals(second, "target", "toxic")
    counts = every.join(F.broadcast(first), "bucket", "left").fillna(0, ["target", "toxic"])  # BUCKETS rows at most
    share, prior = F.col("raw") / raw, TOXIC_PRIOR
    ratio = F.log((F.col("target") + SMOOTHING * target * share) / ((1 + SMOOTHING) * target * share)) if target else F.lit(0.0)
    insult = F.log((F.col("toxic") + prior) / (toxic * share + prior)) if toxic else F.lit(0.0)
    again = F.log((F.col("toxic") + prior) / (toxic_once * F.col("target") / target_once + prior)) if target_once and toxic_once else F.lit(0.0)
    return [
        counts.select("bucket", millionths(ratio, "ratio"), millionths(insult, "toxic_ratio")),
        second.select("bucket", millionths(again, "second_ratio")),
    ]


def ratio_table(ws: Workspace, ratios: list[DataFrame]) -> DataFrame:
    """One row with the ratios of all buckets in order, 0 for those that don't occur."""
    every = ws.spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    for part in ratios:
        every = every.join(F.broadcast(part), "bucket", "left")
    names = every.columns[1:]
    rows = F.sort_array(F.collect_list(F.struct("bucket", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))))  # BUCKETS of them
    return ws.table(every.agg(rows.alias("rows")).select(*(F.col(f"rows.{n}").alias(n) for n in names)))


def best_threshold(good: list[float], bad: list[float], least_kept: float = 0.0) -> float:
    """The cut that keeps most good and drops most bad texts, in equal weight; of equal ones the widest gap's middle.

    The definition, on plain lists; ``thresholds`` finds the same cut for scores of any number.

    Without bad texts it is the lowest good score, without good ones every text passes. Cuts that keep less than
    ``least_kept`` of the good texts aren't looked at; if there is no other, every text passes.
    """
    if not good:
        return float("-inf")
    marks, good, bad = sorted({*good, *bad}), sorted(good), sorted(bad)
    best = (0.0, 0.0, float("-inf") if least_kept else marks[0])
    for low, high in zip([marks[0], *marks], marks):  # noqa: B905
        kept = 1 - bisect_left(good, high) / len(good)
        dropped = bisect_left(bad, high) / len(bad) if bad else 0.0
        if kept >= least_kept:
            best = max(best, (kept + dropped, high - low, (low + high) / 2))
    return best[2]


def thresholds(ws: Workspace, scores: DataFrame, least_kept: dict[str, float]) -> dict[str, float]:
    """``best_threshold`` of each ``kind`` that has good texts, from rows (kind, value, ``good``: whether it is a good text).

    Running sums over distinct values count what lies below each. A value's neighbour below is the one up to which as
    many texts lie as below the value. One row for each kind comes back.
    """
    marks = ws.table(
        running_sums(scores, ["kind"], "value", {"good": F.col("good").cast("long"), "bad": (~F.col("good")).cast("long")}).where("good_total > 0")
    )
    kept = 1 - F.col("good_below") / F.col("good_total")
    dropped = F.coalesce(F.try_divide("bad_below", "bad_total"), F.lit(0.0))
    enough = F.lit(False)
    for kind, least in least_kept.items():
        enough = enough | ((F.col("kind") == kind) & (kept >= least))
    below = F.col("good_below") + F.col("bad_below")
    cuts = marks.where(enough).select("kind", "value", below.alias("below"), (kept + dropped).alias("worth"))
    lower = marks.select("kind", F.col("value").alias("low"), (below + F.col("good") + F.col("bad")).alias("below"))
    found = cuts.join(lower, ["kind", "below"], "left").withColumn("low", F.coalesce("low", "value"))
    best = F.max(F.struct("worth", (F.col("value") - F.col("low")).alias("gap"), ((F.col("low") + F.col("value")) / 2).alias("cut")))
    return {r["kind"]: r["cut"] for r in found.groupBy("kind").agg(best["cut"].alias("cut")).collect()}


def _scored(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The mean ratio and the largest toxic ratio of each row's n-grams, both found inside the row."""
    rows = rows.select(*keys, "grams", *(table.select(n).scalar().alias(n) for n in ("ratio", "toxic_ratio", "second_ratio")))

    total = F.aggregate("grams", F.lit(0).cast("long"), lambda a, g: a + F.get("ratio", _bucket(g)))
    worst = F.aggregate(
        "grams", F.lit(None).cast("long"), lambda a, g: F.greatest(a, F.least(F.get("toxic_ratio", _bucket(g)), F.get("second_ratio", _other_bucket(g))))
    )
    return rows.select(*keys, F.try_divide(total, F.size("grams") * 1e6).alias("score"), (worst / 1e6).alias("toxic_score"))


def judge(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """One row per input row: the base columns, ``base_failed``, ``kept``, ``score`` (mean log ratio), ``toxic_score`` (the largest one).

    NULL text has no words. A text without n-grams has a NULL score and fails the base rules. Without
    labelled texts the base rules alone decide. Rows that repeat an id, or whole rows, are each counted and
    judged. ``row_col``, distinct numbers written with the rows, comes back too if it is given. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    ws = Workspace(df.sparkSession, "quality")
    texts = _texts(df, id_col, text_col, row_col)
    roles = samples(ws, labels)
    labelled = ws.table(texts.join(roles, F.col("id") == F.col("labelled_id")).select("role", "text"))
    labelled = labelled.withColumn("words", words_of(F.col("text")))
    ratios = ratio_table(ws, log_ratios(ws, texts, labelled))
    aside = _with_grams(labelled.where("role IN ('good', 'bad', 'insult')")).withColumn("n_words", _n_words())
    tried = ws.table(_scored(aside, ratios, ["role", "n_words"]).where(F.col("n_words") >= LEAST_WORDS).drop("n_words"))
    good = (F.col("role") == "good").alias("good")
    clean = tried.where("role IN ('good', 'bad')").select(F.lit("clean").alias("kind"), F.col("score").alias("value"), good)
    # The largest toxic scores are to be dropped, so they are looked at the other way round.
    insults = tried.where("role IN ('good', 'insult')").select(F.lit("toxic").alias("kind"), (-F.col("toxic_score")).alias("value"), good)
    cuts = thresholds(ws, clean.union(insults), {"clean": 0.0, "toxic": CLEAN_KEPT})
    threshold = cuts.get("clean", float("-inf"))
    # Without toxic texts to tell from good ones, no score is toxic.
    toxic_from = -cuts["toxic"] if "toxic" in cuts and not tried.where("role = 'insult'").isEmpty() else float("inf")

    keys = ["row", "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scored = _scored(_base(_with_grams(texts)), ratios, keys)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = F.coalesce((F.col("score") >= threshold) & (F.col("toxic_score") <= toxic_from), F.lit(False))
    carried = [F.col("row").alias(row_col)] if row_col else []
    # Written: a filter on the verdict would otherwise be put below it, with all that it is made of in its place, many times over.
    return ws.table(scored.select(
        *carried, F.col("id").alias(id_col), *keys[2:], failed.alias("base_failed"), (~failed & good).alias("kept"), "score", "toxic_score"
    ))
