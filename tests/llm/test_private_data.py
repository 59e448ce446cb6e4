import hashlib
import itertools
import random
import re

import numpy as np
from conftest import messy

from panelwright.llm import private_data as pd
from panelwright.llm.crf import Chain

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == 2:
                double = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
                if not 12 <= len(digits) <= 19 or sum(d // 10 + d % 10 for d in double) % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    draw = random.Random(3)
    for alphabet in ("a1@.", "1.25 ", "+1() .-@", "a@.b_-%+", "4 -1", "é1@a. \n"):
        for _ in range(3000):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40)))
            assert pd.base_spans(text) == brute(text), text
    assert pd.base_spans("4111 1111-11111111 and +1 (974) 555-3436") == [(0, 2, 18), (23, 3, 40)]


def test_hostile_texts_are_read_in_linear_time():
    for part in ("a", "9", "1.", "+1", "a@", "1 ", "@", "+1-"):
        pd.base_spans(part * 200_000)


def test_decoding_takes_the_best_path_and_fit_follows_the_gradient():
    draw = np.random.default_rng(5)
    chain = Chain(draw.normal(size=(6, 3)), draw.normal(size=(3, 3)), draw.normal(size=3))
    rows = [draw.integers(0, 6, (int(n), 2)) for n in draw.integers(0, 6, 40)]
    for x, got in zip(rows, chain.decode(rows, batch=7), strict=True):
        def score(tags, x=x):
            return sum(chain.emit[f, t] for f_t, t in zip(x, tags, strict=True) for f in f_t) + (chain.begin[tags[0]] if tags else 0) + sum(chain.move[a, b] for a, b in itertools.pairwise(tags))

        best = max(itertools.product(range(3), repeat=len(x)), key=score)
        assert tuple(got) == best
    x, y = draw.integers(0, 6, (4, 5, 2)), draw.integers(0, 3, (4, 5))
    own = np.arange(5) < np.array([5, 3, 1, 4])[:, None]
    base, places, pairs, begin = chain.gradient(x, y, own)
    for weight, at, want in ((chain.move, (1, 2), pairs[1, 2]), (chain.begin, (1,), begin[1]), (chain.emit, (3, 1), sum(places[i, j, 1] for i, j, k in np.argwhere(x == 3)))):
        weight[at] += 1e-6
        assert abs((chain.gradient(x, y, own)[0] - base) / 1e-6 - want) < 1e-3
        weight[at] -= 1e-6


def private_text(draw, words, spelled=None):
    """A text with one datum; ``spelled`` picks another spelling. (text, datum)"""
    kind = draw.randrange(4)
    while True:
        digits = str(draw.randint(4 * 10**15, 5 * 10**15))
        if pd.passes_check_digit(digits):
            break
    datum = [
        f"{draw.choice(words)}.{draw.randint(10, 99)}@mail{draw.randint(1, 9)}.example.com",
        ".".join(str(draw.randint(1, 255)) for _ in range(4)),
        digits,
        f"+1 ({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)}",
    ][kind]
    if spelled is not None:
        datum = " ".join(pd.respelled(kind, datum, spelled))
    before, after = (" ".join(draw.choice(words) for _ in range(draw.randint(3, 30))) for _ in range(2))
    return f"{before} {datum} {after}", datum


def corpus(draw, n=300):
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(300)]
    rows = [(i, private_text(draw, words)[0]) for i in range(n)]
    while len(rows) < 2 * n:  # numbers that are no one's
        number = draw.choice([str(draw.randint(10**15, 10**16)), "2024-01-31", "3.14", "100,000", str(draw.randint(1, 9999)), "v1.2.3", "0f3a9c1d2e4b5a6"])
        if not (len(number) == 16 and pd.passes_check_digit(number)):
            rows.append((len(rows), " ".join(draw.choice(words) for _ in range(9)) + f" {number} " + " ".join(draw.choice(words) for _ in range(9))))
    return words, rows


def test_other_spellings_are_found_and_clean_texts_left(spark):
    draw = random.Random(9)
    words, rows = corpus(draw)
    tagger = pd.train(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    hits = tried = 0
    for turn in range(400):
        text, datum = private_text(draw, words, turn)
        base = pd.base_spans(text)
        if not base:
            tried += 1
            at = text.index(datum)
            hits += any(a <= at + 1 and b >= at + len(datum) - 1 for a, _, b in tagger.more_spans([text], [base])[0])
    assert tried > 150 and hits / tried >= 0.9
    _, clean = corpus(random.Random(10))
    texts = [t for _, t in clean[300:]]
    assert sum(map(len, tagger.more_spans(texts, [pd.base_spans(t) for t in texts]))) <= len(texts) // 50


def test_rows_of_every_kind(spark, texts):
    draw = random.Random(4)
    _, rows = corpus(draw, 40)
    odd = [(i, t) for i, t, *_ in texts] + [(900, "é a@b.c +12 345 678 90 10.0.0.1 4111111111111111"), (901, ", ".join(["a@b.c"] * 2000)), (902, "7 " * 3000)]
    rows = rows + odd + [rows[0], (None, None)]
    got = pd.find_private(messy(spark, rows, "doc_id long, text string")).collect()
    want = []
    for i, text in rows:
        base = brute(text)
        label = ",".join(f"{pd.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((str(i), *(sum(k == kind for _, k, _ in base) for kind in range(4)), hashlib.sha256(label.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:6]) for r in got) == sorted(want)
    for r in got:
        spans = r["spans"].split(",") if r["spans"] else []
        assert len(spans) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"]
    assert pd.find_private(spark.createDataFrame([], "doc_id long, text string")).collect() == []
