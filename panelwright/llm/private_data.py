"""Personal data in texts: exact patterns, and a conditional random field for other spellings.

The patterns find addresses, numbers of hosts, cards and phones as written by the book. The field reads the
shapes of words (letters, digits and marks, with short runs of digits as long as they are) around each word that
holds a digit or a sign of an address, and finds the same data in other spellings: `name (at) host.org`,
`10[.]0[.]0[.]1`, phone numbers without a plus, cards with other separators. What it adds has to pass the kind's
own test (parts up to 255, check digit, number of digits) and never touches a span of the patterns.

It is trained on the driver from a small labelled table: at most ``LABELLED`` windows of words with data and as
many without (their first ``LABELLED_WORDS`` words), from about ``TEXTS`` texts by hash, labelled by the patterns, and each one with data once more in
another spelling. Texts are scanned whole, row by row; words far from any sign are no one's data and aren't decoded.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.bpe import slices
from panelwright.llm.crf import Chain
from panelwright.llm.store import Workspace
from panelwright.session import ship_package

KINDS = ("email", "ip", "card", "phone")
TEXTS = 20_000
LABELLED, LABELLED_WORDS = 800, 48
# Words on each side of a sign that are read with it; a chain is cut into runs of CHAIN words that share SHARED.
REACH, CHAIN, SHARED = 3, 512, 16

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Matches of these never begin inside a run of digits, and digits are never given back.
_HOST = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SIGN = re.compile(r"[0-9@]|[(\[](?:at|AT)[)\]]")
_DIGIT = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"A+|a+")
_LONG_RUN = re.compile(r"0{5,}")
_PLAIN = {**{c: "A" for c in range(65, 91)}, **{c: "a" for c in range(97, 123)}, **{c: "0" for c in range(48, 58)}}


def passes_check_digit(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d <<= i & 1
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small_parts(parts: Iterable[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def is_card(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and passes_check_digit(digits)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each sign is met once, with the characters since the last match or sign, so this is linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        local = _LOCAL.match(text[free:at][::-1])
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local.end(), domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order, in code points."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _HOST.finditer(text) if small_parts(m.group().split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37 and is_card("".join(_DIGIT.findall(m.group()))):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGIT.findall(m.group()))) <= 15]
    return sorted(found)


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of words, as places in the text, that lie within ``REACH`` words of a sign."""
    signs = [m.start() for m in _SIGN.finditer(text)]
    if not signs:
        return
    words = [m.span() for m in _WORD.finditer(text)]
    starts = np.fromiter((a for a, _ in words), np.int64, len(words))
    near = np.unique(np.searchsorted(starts, signs, "right") - 1)
    runs = np.split(near, np.flatnonzero(np.diff(near) > 2 * REACH) + 1)
    for run in runs:
        yield words[max(0, run[0] - REACH) : run[-1] + REACH + 1]


def shape(word: str) -> tuple[str, str, str]:
    """Shape of the word, number of its digits by size, and the tests that its digits pass."""
    digits = _DIGIT.findall(word)
    n = sum(map(len, digits))
    marks = word.translate(_PLAIN) if word.isascii() else "".join("a" if c.isalpha() else c for c in word.translate(_PLAIN))
    marks = _LONG_RUN.sub("00000", _LETTERS.sub(lambda m: m.group()[0], marks))[:32]
    tests = "card" * (12 <= n <= 19 and passes_check_digit("".join(digits))) + "host" * (len(digits) == 4 and small_parts(digits))
    return marks, str(n if n < 5 else 5 if n < 9 else 9 if n < 12 else 12 if n < 20 else 20), tests


def features(words: list[str], known: dict[str, int], shapes: dict[str, tuple[str, str, str]]) -> np.ndarray:
    """Numbers of the features at each word: shapes up to two words away, digits up to one, and its own tests."""
    for word in words:
        if word not in shapes:
            shapes[word] = shape(word)
    edge = ("|", "", "")
    found = [edge, edge, *(shapes[w] for w in words), edge, edge]
    out = np.zeros((len(words), 9), np.int64)
    get = known.get
    for i in range(len(words)):
        near = found[i : i + 5]
        names = [f"{o}s{s[0]}" for o, s in enumerate(near)] + [f"{o}d{near[o][1]}" for o in (1, 2, 3)] + [f"t{near[2][2]}"]
        out[i] = [get(name, 0) for name in names]
    return out


class _Names(dict):
    """Gives each new feature the next number."""

    def get(self, name, default=None):
        return self.setdefault(name, len(self) + 1)


def respelled(kind: int, word: str, turn: int) -> list[str]:
    """The datum in another spelling, as words."""
    if kind == 0:
        local, _, host = word.rpartition("@")
        return [[local, "(at)", host], [f"{local}[at]{host.replace('.', '[dot]')}"], [local, "@", host], [f"{local}(at){host}"]][turn % 4]
    numbers = _DIGIT.findall(word)
    if kind == 1:
        return [["[.]".join(numbers)], ["(.)".join(numbers)]][turn % 2]
    digits = "".join(numbers)
    if kind == 2:
        return [["._/"[turn % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))], [digits[:4] + "."] + [digits[4:]]][turn % 4 == 3]
    country, area, first, last = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
    return [[f"({area})", f"{first}-{last}"], [f"{area}-{first}-{last}"], [f"{country}-{area}-{first}-{last}"], [f"00{country}", area, f"{first}{last}"]][turn % 4]


def labelled(text: str) -> Iterator[tuple[list[str], list[int]]]:
    """Words and tags of each window: 0 outside, then 1 + 2 * kind for a first word and one more for others."""
    spans = base_spans(text)
    for run in windows(text):
        tags = [0] * len(run)
        for start, kind, end in spans:
            first = bisect_left(run, start + 1, key=lambda w: w[1])
            for i in range(first, len(run)):
                if run[i][0] >= end:
                    break
                tags[i] = 1 + 2 * kind + (i > first)
        yield [text[a:b] for a, b in run], tags


def otherwise(words: list[str], tags: list[int], turn: int) -> tuple[list[str], list[int]]:
    """The window with its data spelled in another way."""
    out_words, out_tags, i = [], [], 0
    while i < len(words):
        j = i + 1
        if tags[i]:
            kind = (tags[i] - 1) // 2
            while j < len(words) and tags[j] == 2 + 2 * kind:
                j += 1
            fresh = respelled(kind, " ".join(words[i:j]), turn)
            out_words += fresh
            out_tags += [1 + 2 * kind + (k > 0) for k in range(len(fresh))]
        else:
            out_words.append(words[i])
            out_tags.append(0)
        i = j
    return out_words, out_tags


def _labelled_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in slices(batch, "text"):
            rows = [(w[:LABELLED_WORDS], t[:LABELLED_WORDS]) for text in texts if text for w, t in labelled(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in rows], pa.list_(pa.string())), pa.array([t for _, t in rows], pa.list_(pa.int64()))], ["words", "tags"]
            )


def labelled_windows(ws: Workspace, df: DataFrame, id_col: str, text_col: str, texts: int = TEXTS, most: int = LABELLED) -> list[tuple[list[str], list[int]]]:
    """The small labelled table: distinct windows by hash, ``most`` with data and ``most`` without."""
    every = max(1, df.count() // texts)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    rows = rows.where(F.pmod(F.xxhash64("id", F.substring("text", 1, 64)), F.lit(every)) == 0)
    found = rows.select("text").mapInArrow(_labelled_rows, "words array<string>, tags array<long>").distinct()
    found = ws.table(found.withColumn("at", F.xxhash64("words")).withColumn("data", F.array_max("tags") > 0))
    out = []
    for data in (True, False):
        part = found.where(F.col("data") == data).orderBy("at", "words", "tags").limit(most)
        out += [(list(r["words"]), list(r["tags"])) for r in ws.table(part).orderBy("at", "words", "tags").collect()]  # `most` rows at most
    return out


class Tagger:
    """A fitted chain with the numbers of its features."""

    def __init__(self, known: dict[str, int], chain: Chain):
        self.known, self.chain = known, chain
        self._shapes: dict[str, tuple[str, str, str]] = {}

    @classmethod
    def fit(cls, rows: list[tuple[list[str], list[int]]]) -> Tagger:
        table = list(rows)
        for turn, (words, tags) in enumerate(rows):
            if any(tags):
                table.append(otherwise(words, tags, turn))
        names, shapes = _Names(), {}
        x = [features(words, names, shapes) for words, _ in table]
        y = [np.asarray(tags) for _, tags in table]
        return cls(dict(names), Chain.fit(x, y, len(names) + 1, 1 + 2 * len(KINDS)))

    def tags(self, rows: list[list[str]]) -> list[np.ndarray]:
        """Tags of each window; long ones are read in runs of ``CHAIN`` words with ``SHARED`` more on each side."""
        cut, owner = [], []
        for i, words in enumerate(rows):
            for at in range(0, len(words), CHAIN):
                lo = max(0, at - SHARED)
                cut.append(features(words[lo : at + CHAIN + SHARED], self.known, self._shapes))
                owner.append((i, at - lo))
            if len(self._shapes) > 200_000:
                self._shapes.clear()
        out: list[list[np.ndarray]] = [[] for _ in rows]
        for (i, skip), found in zip(owner, self.chain.decode(cut), strict=True):
            out[i].append(found[skip : skip + CHAIN])
        return [np.concatenate(parts) if parts else np.zeros(0, np.int64) for parts in out]

    def more_spans(self, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """Spans of the chain that pass their kind's test and touch no base span."""
        places = [(i, run) for i, text in enumerate(texts) for run in windows(text)]
        tags = self.tags([[texts[i][a:b] for a, b in run] for i, run in places])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for (i, run), found in zip(places, tags, strict=True):
            for j in np.flatnonzero(found).tolist():
                kind = (int(found[j]) - 1) // 2
                if j and found[j] == 2 + 2 * kind and found[j - 1] in (1 + 2 * kind, 2 + 2 * kind):
                    continue  # goes on from the word before
                last = j
                while last + 1 < len(run) and found[last + 1] == 2 + 2 * kind:
                    last += 1
                start, end = trimmed(texts[i], run[j][0], run[last][1])
                if genuine(kind, texts[i][start:end]) and all(b <= start or a >= end for a, _, b in base[i]):
                    out[i].append((start, kind, end))
        return out


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without marks at either end that belong to no number or name."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def genuine(kind: int, found: str) -> bool:
    numbers = _DIGIT.findall(found)
    if kind == 0:
        return bool(re.search(r"[A-Za-z0-9]\s*(?:@|[(\[](?:at|AT)[)\]])\s*[A-Za-z0-9-]+\s*(?:\.|[(\[](?:dot|DOT)[)\]])\s*[A-Za-z0-9]", found))
    if kind == 1:
        return len(numbers) == 4 and small_parts(numbers)
    if kind == 2:
        return is_card("".join(numbers))
    return 9 <= sum(map(len, numbers)) <= 15 and not re.search(r"[A-Za-z]", found)


def train(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    return Tagger.fit(labelled_windows(Workspace(spark, "private"), df, id_col, text_col))


def _label(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _found(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, emit, move, begin = shared.value
        tagger = Tagger(known, Chain(emit, move, begin))
        for batch in batches:
            for first, part in slices(batch, "text"):
                texts = [t or "" for t in part]
                base = [base_spans(t) for t in texts]
                more = tagger.more_spans(texts, base)
                counts = [[sum(k == kind for _, k, _ in b) for b in base] for kind in range(len(KINDS))]
                digests = [hashlib.sha256(_label(b).encode()).hexdigest() for b in base]
                spans = [_label(sorted(b + m)) for b, m in zip(base, more, strict=True)]
                columns = [batch.column("id").slice(first, len(texts)), *(pa.array(c, pa.int64()) for c in counts)]
                columns += [pa.array(digests), pa.array(spans), pa.array([len(m) for m in more], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return run


def find_private(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """One row per input row: the id, spans by kind, ``base_sha256``, ``spans`` and ``n_added`` (those of the chain).

    A span is (kind, start, end) in code points, end exclusive, ordered by start and then by kind. Without
    ``tagger``, one is trained on ``df``. NULL and empty texts have no spans; without any labelled window
    the chain adds none. Repeated rows are judged each; other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ship_package(spark)
    tagger = tagger or train(spark, df, id_col, text_col)
    shared = spark.sparkContext.broadcast((tagger.known, tagger.chain.emit, tagger.chain.move, tagger.chain.begin))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    out = rows.mapInArrow(_found(shared), f"id {kind}, {counts}, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", id_col)
