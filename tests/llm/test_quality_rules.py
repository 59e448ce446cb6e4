import random
import re

from conftest import messy

from panelwright.llm import quality_rules as q


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 50 or 100 * len(again) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_base_rules(spark, texts):
    df = messy(spark, [(r[0], r[1]) for r in texts], "doc_id long, text string")
    got = q.judge(df, no_labels(spark)).drop("score", "toxic_score").collect()
    want = [(i, *base(t), not base(t)[-1]) for i, t, *_ in texts]
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))


def corpus(n):
    draw = random.Random(9)
    good = ["".join(draw.choice("aeioulnrst") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        junk = i % 5 == 0
        words = [draw.choice(good) + ("###" if junk and draw.random() < 0.7 else "") for _ in range(80)]
        rows.append((i, " ".join(words)))
        if i % 2 or junk:
            labels.append((i, 0 if junk else 1, 0))
    return rows, labels


def test_ratio_parts_junk_from_clean_texts(spark):
    rows, labels = corpus(400)
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in q.judge(df, marks).collect()}
    assert all(kept[i] == (i % 5 != 0) for i in kept)
    again = {r.doc_id: r.kept for r in q.judge(df.repartition(7), marks).collect()}
    assert kept == again


def test_contradicting_and_repeated_labels_are_left_out(spark):
    from panelwright.llm.store import Workspace

    labels = [(1, 1, 0), (1, 1, 0), (2, 1, 0), (2, 0, 0), (3, 1, 1), (4, 0, 0), (None, 1, 0), (5, None, 0)]
    found = q.samples(Workspace(spark, "t"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kinds = {"target": "clean", "good": "clean", "bad": "bad", "toxic": "toxic", "insult": "toxic"}
    assert {(r.labelled_id, kinds[r.role]) for r in found.collect()} == {(1, "clean"), (3, "toxic"), (4, "bad")}


def test_scores_are_means_and_maxima_of_bucket_ratios(spark):
    import math

    rows, labels = corpus(60)
    labels += [(i, 1, 1) for i in range(2, 40, 4)]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from panelwright.llm.store import Workspace

    from pyspark.sql import functions as F

    role = {r.labelled_id: r.role for r in q.samples(Workspace(spark, "t"), marks).collect()}
    whole = {r.id: r.grams for r in q._with_grams(q._texts(df, "doc_id", "text", None)).select("id", "grams").collect()}
    grams = {i: [g % q.BUCKETS for g in gs] for i, gs in whole.items()}
    other = {i: [(g >> 24) % q.BUCKETS for g in gs] for i, gs in whole.items()}
    raw, target, toxic = {}, {}, {}
    for i, buckets in grams.items():
        for b in buckets:
            raw[b] = raw.get(b, 0) + 1
            for name, counts in (("target", target), ("toxic", toxic)):
                counts[b] = counts.get(b, 0) + (role.get(i) == name)
    n, n_target, n_toxic = sum(raw.values()), sum(target.values()), sum(toxic.values())
    assert n_target and n_toxic
    ratio = {b: round(math.log((target[b] + 0.3 * n_target * raw[b] / n) / (1.3 * n_target * raw[b] / n)) * 1e6) for b in raw}
    worst = {b: round(math.log((toxic[b] + 20) / (n_toxic * raw[b] / n + 20)) * 1e6) for b in raw}
    seconds = {"target": {}, "toxic": {}}
    for i, gs in whole.items():
        for b in [(g >> 24) % q.BUCKETS for g in set(gs)]:
            for name, counts in seconds.items():
                counts[b] = counts.get(b, 0) + (role.get(i) == name)
    once = sum(seconds["toxic"].values()) / sum(seconds["target"].values())
    second = {b: round(math.log((seconds["toxic"][b] + 20) / (once * seconds["target"][b] + 20)) * 1e6) for b in seconds["toxic"]}
    for r in q.judge(df, marks).collect():
        lesser = max(min(worst[b], second[c]) for b, c in zip(grams[r.doc_id], other[r.doc_id], strict=True))
        assert abs(r.score - sum(ratio[b] for b in grams[r.doc_id]) / len(grams[r.doc_id]) / 1e6) < 2e-6
        assert abs(r.toxic_score - lesser / 1e6) < 2e-6


def test_a_few_insults_are_seen_and_clean_texts_stay(spark):
    draw = random.Random(21)
    words = ["".join(draw.choice("aeioulnrst") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = [draw.choice(words) for _ in range(90)]
        if i % 9 == 0:
            for _ in range(3):
                text[draw.randrange(90)] = draw.choice(["grrk", "blarg", "snorf"])
        rows.append((i, " ".join(text)))
        if i % 2:
            labels.append((i, 1, int(i % 9 == 0)))
    kept = q.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    toxic = [r.kept for r in kept if r.doc_id % 9 == 0]
    clean = [r.kept for r in kept if r.doc_id % 9]
    assert sum(toxic) <= 0.1 * len(toxic) and sum(clean) >= 0.97 * len(clean)


def test_threshold():
    assert q.best_threshold([0.1, 0.2], [-1.0, -0.5]) == (0.1 - 0.5) / 2
    assert q.best_threshold([0.3, 0.1], []) == 0.1
    assert q.best_threshold([], [0.1]) == float("-inf")
    assert q.best_threshold([0.1, 0.9], [0.2, 0.3, 0.4], least_kept=1.0) <= 0.1
    assert q.best_threshold([0.8, 0.9], [0.2], least_kept=1.0) == 0.5


def test_empty_table(spark):
    assert q.judge(spark.createDataFrame([], "doc_id long, text string"), no_labels(spark)).count() == 0


def test_every_labelled_text_has_a_role(spark):
    from panelwright.llm.store import Workspace

    labels = spark.range(60_000).selectExpr("id AS doc_id", "IF(id % 6 = 0, 0, 1) AS quality", "IF(id % 2 = 0 AND id % 6 <> 0, 1, 0) AS toxic")
    found = {r["role"]: r["count"] for r in q.samples(Workspace(spark, "t"), labels).groupBy("role").count().collect()}
    assert found["bad"] == 10_000 and found["target"] + found["good"] == 30_000 and found["toxic"] + found["insult"] == 20_000
    assert abs(found["good"] - 7_500) < 500 and abs(found["insult"] - 5_000) < 500


def test_thresholds_of_tables_are_those_of_lists(spark):
    from panelwright.llm.store import Workspace

    draw = random.Random(31)
    for least in (0.0, 0.9, 1.0):
        lists = {
            "mixed": ([draw.gauss(0.5, 1) for _ in range(300)], [draw.gauss(-0.5, 1) for _ in range(200)]),
            "ties": ([draw.randint(0, 9) / 10 for _ in range(200)], [draw.randint(-4, 6) / 10 for _ in range(150)]),
            "no bad": ([0.3, 0.1], []),
            "no good": ([], [0.2, 0.4]),
            "apart": ([0.8, 0.9], [0.2, -0.0, 0.0]),
        }
        rows = [(kind, x, is_good) for kind, both in lists.items() for is_good, xs in zip((True, False), both, strict=True) for x in xs]
        found = q.thresholds(Workspace(spark, "t"), spark.createDataFrame(rows, "kind string, value double, good boolean"), dict.fromkeys(lists, least))
        assert found == {kind: q.best_threshold(*both, least) for kind, both in lists.items() if both[0]}
