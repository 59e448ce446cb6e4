import random
import zlib

from conftest import messy

from panelwright.llm import language_id


def corpus(n):
    draw = random.Random(2)
    parts = {"en": "th er an the ing on".split(), "fr": "é eau ou tion è que".split(), "el": "αλ ος και την".split()}
    out = []
    for i in range(n):
        lang = draw.choice(list(parts))
        out.append((i, " ".join("".join(draw.choice(parts[lang]) for _ in range(3)) for _ in range(draw.randint(4, 60))), lang))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    odd = [(900, None, "en"), (901, "", "fr"), (902, "123 --- ٣", None), (903, "q", None), (904, "thethe the", None), (904, "thethe the", None), (None, "ου και", None)]
    df = messy(spark, [*corpus(300), *odd], "doc_id long, text string, lang string")
    rows = language_id.identify(df).collect()
    assert len(rows) == 307 and all(0 <= r.score <= 1 for r in rows)
    truth = {i: lang for i, _, lang in corpus(300)}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert by_id[904].lang_pred == "en" and by_id[903].lang_pred in truth.values()


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = corpus(200)
    turned = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (spark.createDataFrame(r, "doc_id long, text string, lang string") for r in (rows, turned))
    assert sorted(map(tuple, language_id.identify(a).collect())) == sorted(map(tuple, language_id.identify(b).collect()))


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language_id.identify(df).collect()] == [(1, zlib.crc32(b"1") % 4 == 2, "und", 0.0)]
    assert language_id.identify(df.limit(0)).count() == 0


def test_more_languages_than_bits_of_a_word(spark):
    draw = random.Random(3)
    rows = []
    for k in range(70):
        words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(draw.choice(words) for _ in range(40)), f"l{k:02}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df).collect()}
    assert {i: got[i] for i, _, _ in rows} == {i: lang for i, _, lang in rows}
