import hashlib
import random

import numpy as np
import public_tokenizers
import tokenizers
from conftest import messy

from panelwright.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)


def codec(lexicon=None):
    with open(PATH, encoding="utf-8") as f:
        return bpe.Codec(f.read(), lexicon)


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_equals_library_on_odd_texts():
    draw = random.Random(3)
    letters = "abthe AİıßΣσς'sdlrvem12½²٣ \t\n\x0b\x1c\x85\xa0 　éÉéがが<|endoftext|>##&‍😀中ǅﬁ\x00"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, "the" * 900, "ab" * 40 + "c", "", None, "x<|startoftext|>y <|endoftext|>", "we're I'LL 'd"]
    reader = codec()
    for text, packed in zip(texts, reader.encode(texts), strict=True):
        assert (np.frombuffer(packed, "<u4").tolist(), reader.decode(packed)) == expected(text)


def test_words_merged_together_equal_words_merged_alone():
    draw = random.Random(4)
    words = [bytes(draw.choice(b"thearndosti\xc3\xa9") for _ in range(draw.randint(1, 47))) for _ in range(2000)]
    reader = codec()
    assert reader.merge_many(words) == [reader.merge(w) for w in words]


def test_transducer_holds_its_words_and_no_others():
    draw = random.Random(5)
    words = {bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 8))): np.asarray([i, i + 1][: 1 + i % 2], "<u4").tobytes() for i in range(900)}
    machine = bpe.Transducer.mapped(bpe.Transducer.compile(words))
    others = [w + b"a" for w in words if w + b"a" not in words] + [b"", b"z", b"abz"]
    assert machine.look_up([*words, *others]) == [*words.values(), *[None] * len(others)]
    assert len(machine.final) < sum(map(len, words))  # endings are shared
    assert bpe.Transducer.mapped(bpe.Transducer.compile({})).look_up([b"a"]) == [None]


def test_operator(spark, texts):
    df = messy(spark, [(r[0], r[1]) for r in texts], "doc_id long, text string")
    want = []
    for i, t, *_ in texts:
        ids, decoded = expected(t)
        want.append((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    for n_words in (50, 0):
        got = [tuple(r) for r in bpe.digest_texts(df, PATH, n_words=n_words).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    whole = {r.doc_id: r for r in bpe.encode_texts(df, PATH, n_words=50).collect()}
    assert (np.frombuffer(whole[78]["ids"], "<u4").tolist(), whole[78]["decoded"]) == expected(dict((r[0], r[1]) for r in texts)[78])


def test_empty_table(spark):
    assert bpe.digest_texts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_lexicon_takes_whole_counts_only(spark):
    rows = [("the cat the dog",), ("the cat a b c d",), (None,)]
    df = spark.createDataFrame(rows, "text string")
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()

    def words(n):
        machine = bpe.Transducer.mapped(bpe.compile_lexicon(df, "text", spec, n))
        return {w for w, ids in zip(known, machine.look_up(known), strict=True) if ids is not None}

    known = [b"the", b"cat", b"dog", b"a", b"b", b"c", b"d"]
    assert words(100) == set(known)
    assert words(6) == words(2) == {b"the", b"cat"}  # the other five occur once each
    assert words(1) == {b"the"} and words(0) == set()
    assert bpe.compile_lexicon(df.limit(0), "text", spec, 5)
