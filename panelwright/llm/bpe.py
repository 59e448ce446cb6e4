"""BPE encoding and decoding with a transducer of frequent words.

The corpus is read once to count its words (after normalisation and splitting, as the tokenizer's file
states them). The most frequent ones, up to a fixed number, are compiled with their ids into a minimal acyclic
transducer: a deterministic automaton over UTF-8 bytes in which equal endings are shared, whose transitions
add up to a word's place in a flat table of ids. It is sent to the workers, which map it into memory from
a file without a name. Words that it doesn't hold are merged exactly, pair by pair.

Both passes over the texts are per-row work inside Arrow batches; texts are not shuffled. What a worker
remembers of words is bounded and only saves time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.store import Workspace
from panelwright.session import ship_package

LEXICON_WORDS = 1 << 16
REMEMBERED = 900_000
SLICE_CHARS = 2_000_000
# Texts of these characters need no normalisation beyond lower case; others go through the library's normaliser.
PLAIN = re.compile("[!-~¡-ʯ]*")
PLAIN_TEXT = re.compile("[ \t\n\r\x0b\x0c!-~¡-ʯ]*")
HEAP_FROM = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Transducer:
    """Minimal acyclic automaton from words (bytes) to id sequences, as five flat arrays in one buffer."""

    PARTS = (("keys", "<i8"), ("target", "<i4"), ("add", "<i4"), ("final", "|u1"), ("start", "<i8"), ("ids", "<u4"))

    def __init__(self, buffer):
        heads = np.frombuffer(buffer, "<i8", len(self.PARTS))
        at = 8 * len(self.PARTS)
        for (name, kind), n in zip(self.PARTS, heads, strict=True):
            setattr(self, name, np.frombuffer(buffer, kind, int(n), at))
            at += -(-int(n) * np.dtype(kind).itemsize // 8) * 8

    @classmethod
    def compile(cls, words: dict[bytes, bytes]) -> bytes:
        """Words in sorted order are added one by one; finished endings are looked up among equal ones.

        A state is (final, ((byte, state), ...)). States are numbered as they finish, children first.
        """
        known: dict[tuple, int] = {}
        states: list[tuple] = []
        counts: list[int] = []
        path: list[list] = [[False, []]]  # states still open: final, finished transitions
        last = b""
        ordered = sorted(words)

        def finish(depth: int) -> None:
            while len(path) > depth + 1:
                final, out = path.pop()
                state = (final, tuple(out))
                if state not in known:
                    known[state] = len(states)
                    states.append(state)
                    counts.append(final + sum(counts[s] for _, s in out))
                path[-1][1].append((last[len(path) - 1], known[state]))

        for word in ordered:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            finish(common)
            path.extend([False, []] for _ in word[common:])
            path[-1][0] = True
            last = word
        finish(0)
        states.append((path[0][0], tuple(path[0][1])))
        keys, target, add = [], [], []
        for number, (final, out) in enumerate(states):
            before = int(final)
            for byte, s in out:
                keys.append(number << 8 | byte)
                target.append(s)
                add.append(before)
                before += counts[s]
        packed = [words[w] for w in ordered]
        start = np.cumsum([0, *(len(p) // 4 for p in packed)])
        parts = {
            "keys": keys, "target": target, "add": add, "final": [s[0] for s in states],
            "start": start, "ids": np.frombuffer(b"".join(packed), "<u4"),
        }
        arrays = [np.asarray(parts[name], kind) for name, kind in cls.PARTS]
        body = b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)
        return np.asarray([a.size for a in arrays], "<i8").tobytes() + body

    @classmethod
    def mapped(cls, raw: bytes) -> Transducer:
        """From a mapped file that has no name, so nothing is left behind however the worker ends."""
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def look_up(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word, packed, or None; all words advance together, one byte a step."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.keys) or not words:
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        text = np.frombuffer(b"".join(words), np.uint8)
        who = np.arange(len(words))
        state = np.full(len(words), len(self.final) - 1, np.int64)
        place = np.zeros(len(words), np.int64)
        step = 0
        while who.size:
            for i in np.flatnonzero((size[who] == step) & (self.final[state] == 1)):
                k = place[i]
                out[who[i]] = self.ids[self.start[k] : self.start[k + 1]].tobytes()
            on = size[who] > step
            who, state, place = who[on], state[on], place[on]
            key = state << 8 | text[begin[who] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            who, at = who[on], at[on]
            state, place = self.target[at].astype(np.int64), place[on] + self.add[at]
            step += 1
        return out


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encodes and decodes as the tokenizer's file states; ``lexicon`` is a compiled transducer or None."""

    def __init__(self, tokenizer_json: str, lexicon: bytes | None = None):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self._library = tokenizers.Tokenizer.from_str(tokenizer_json)
        shapes = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self._split = regex.compile(shapes[0]["pattern"]["Regex"]).findall
        symbols = byte_symbols()
        self._byte_of = {s: b for b, s in enumerate(symbols)}
        self._inner = [vocab[s] for s in symbols]
        self._final = [vocab[s + end] for s in symbols]
        self._rank = {}
        self._merged = []
        for rank, (a, b) in enumerate(model["merges"]):
            self._rank.setdefault(vocab[a] << 20 | vocab[b], rank)
            self._merged.append(vocab[a + b])
        self._special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self._special_split = re.compile(b"(" + b"|".join(map(re.escape, self._special)) + b")").split if self._special else None
        self._special_mark = next(iter(self._special), b"\x00")[:2]
        self._special_text = self._special_mark.decode()
        self.tokens = [""] * (max([*vocab.values(), *self._special.values()]) + 1)
        for token, i in [*vocab.items(), *((t.decode(), i) for t, i in self._special.items())]:
            self.tokens[i] = token
        self._lexicon = Transducer.mapped(lexicon) if lexicon else None
        self._marks = {m.encode() for m in ".,;:!?" if self._split(f"ab{m}") == ["ab", m]}
        # A mark between a letter and a space is a word of its own, so a space before it changes nothing.
        self._mark_off = re.compile(f"(?<=[a-z])[{re.escape(b''.join(sorted(self._marks)).decode())}](?=[ \n])").sub if self._marks else None
        self._byte_ids = np.asarray([self._inner, self._final], np.int64)
        self._joined = np.asarray([*self._merged, 0], np.int64)
        self._fill_pairs()
        self._ids: dict[bytes, bytes] = {}  # of words and of runs that hold several; a word alone is a run

    def words(self, chunk: bytes) -> list[bytes]:
        """Normalised words of a run without ASCII white space and without special tokens."""
        if chunk.isalpha():
            return [chunk.lower()]
        if chunk[-1:] in self._marks and chunk[:-1].isalpha():
            return [chunk[:-1].lower(), chunk[-1:]]
        text = chunk.decode()
        if PLAIN.fullmatch(text):
            text = text.lower()
            return [text.encode()] if text.isalpha() else [w.encode() for w in self._split(text)]
        text = self._library.normalizer.normalize_str(text)
        return [bytes(map(self._byte_of.__getitem__, w)) for w, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def merge(self, word: bytes) -> bytes:
        """Packed ids of one word: always joins the pair of least rank, the leftmost of several."""
        ids = [self._inner[b] for b in word[:-1]] + [self._final[word[-1]]]
        get, none = self._rank.get, len(self._merged)
        if len(ids) > HEAP_FROM:
            ids = self._merge_long(ids)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = self._merged[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
        return pack(ids)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a queue of pairs, for words too long to be searched again after each join."""
        get = self._rank.get
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue = [(r, i) for i in range(len(ids) - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or get(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j] = self._merged[rank], -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (r := get(ids[i] << 20 | ids[after[i]])) is not None:
                    heapq.heappush(queue, (r, i))
            if before[i] >= 0 and (r := get(ids[before[i]] << 20 | ids[i])) is not None:
                heapq.heappush(queue, (r, before[i]))
        return [i for i in ids if i >= 0]

    def _fill_pairs(self) -> None:
        """The pairs once more, as a sparse hash table that numpy can search for many pairs at once."""
        size = 1 << max(10, 3 + len(self._rank).bit_length())
        self._pair_keys, self._pair_ranks = np.full(size, -1, np.int64), np.full(size, len(self._merged), np.int64)
        keys, ranks = np.fromiter(self._rank.keys(), np.int64), np.fromiter(self._rank.values(), np.int64)
        at = self._pair_slot(keys)
        while keys.size:
            free = self._pair_keys[at] < 0
            self._pair_keys[at[free]] = keys[free]
            mine = self._pair_keys[at] == keys
            self._pair_ranks[at[mine]] = ranks[mine]
            keys, ranks, at = keys[~mine], ranks[~mine], (at[~mine] + 1) % size

    def _pair_slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - len(self._pair_keys).bit_length())).astype(np.int64)

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges if it has none."""
        keys = left << 20 | right
        at = self._pair_slot(keys)
        out = self._pair_ranks[at]
        found = self._pair_keys[at]
        odd = np.flatnonzero((found != keys) & (found >= 0))
        out[found < 0] = len(self._merged)
        while odd.size:
            at[odd] = (at[odd] + 1) % len(self._pair_keys)
            found = self._pair_keys[at[odd]]
            out[odd] = np.where(found == keys[odd], self._pair_ranks[at[odd]], len(self._merged))
            odd = odd[(found != keys[odd]) & (found >= 0)]
        return out

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """As :meth:`merge` for each word; words of like length advance together, one join a round."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_width.setdefault(-(-len(word) // 8), []).append(i)
        for eighths, members in by_width.items():
            if eighths * 8 > HEAP_FROM:
                for i in members:
                    out[i] = self.merge(words[i])
                continue
            for lo in range(0, len(members), 20_000):
                part = members[lo : lo + 20_000]
                for i, ids in zip(part, self._merge_block([words[i] for i in part], 8 * eighths), strict=True):
                    out[i] = ids
        return out

    def _merge_block(self, words: list[bytes], width: int) -> list[bytes]:
        none = len(self._merged)
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        place = np.arange(width)
        ids = self._byte_ids[0][text]
        ids[place >= size[:, None]] = -1
        every = np.arange(len(words))
        ids[every, size - 1] = self._byte_ids[1][text[every, size - 1]]
        rank = np.full((len(words), width), none, np.int64)
        inner = place[:-1] < size[:, None] - 1
        rank[:, :-1][inner] = self._pair_rank(ids[:, :-1][inner], ids[:, 1:][inner])
        after, before = np.tile(place + 1, (len(words), 1)), np.tile(place - 1, (len(words), 1))
        who = every
        while who.size:
            here = rank[who]
            p = here.argmin(1)
            best = here[np.arange(len(who)), p]
            on = best < none
            who, p, best = who[on], p[on], best[on]
            q = after[who, p]
            new = self._joined[best]
            ids[who, p], ids[who, q], rank[who, q], rank[who, p] = new, -1, none, none
            follows = after[who, q]
            after[who, p] = follows
            more = follows < size[who]
            w, a, b = who[more], p[more], follows[more]
            before[w, b] = a
            rank[w, a] = self._pair_rank(new[more], ids[w, b])
            leads = before[who, p]
            more = leads >= 0
            w, a = who[more], leads[more]
            rank[w, a] = self._pair_rank(ids[w, a], new[more])
        kept = ids >= 0
        packed = ids[kept].astype("<u4").tobytes()
        ends = np.cumsum(4 * kept.sum(1)).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def _learn(self, chunks: list[bytes]) -> None:
        known = self._ids
        single = list(filter(bytes.isalpha, chunks))
        words = [chunk.lower() for chunk in single]
        parts: list[tuple[bytes, list]] = []
        if len(single) < len(chunks):
            rest = [chunk for chunk in chunks if not chunk.isalpha()]
            text = b"\n".join(rest).decode()
            if PLAIN_TEXT.fullmatch(text) and self._special_text not in text:
                lower = text.lower()
                for chunk, word, packed in zip(rest, lower.split("\n"), lower.encode().split(b"\n"), strict=True):
                    if word.isalpha():
                        single.append(chunk)
                        words.append(packed)
                    else:
                        parts.append((chunk, [w.encode() for w in self._split(word)]))
            else:
                for chunk in rest:
                    found: list = []
                    for piece in self._special_split(chunk) if self._special_mark in chunk and self._special else (chunk,):
                        found += [self._special[piece]] if piece in self._special else self.words(piece)
                    parts.append((chunk, found))
        fresh = list(({w for _, found in parts for w in found if type(w) is bytes} | set(words)) - known.keys())
        ids = self._lexicon.look_up(fresh) if self._lexicon else [None] * len(fresh)
        unseen = [word for word, found in zip(fresh, ids, strict=True) if found is None]
        known.update((word, found) for word, found in zip(fresh, ids, strict=True) if found is not None)
        known.update(zip(unseen, self.merge_many(unseen), strict=True))
        known.update(zip(single, map(known.__getitem__, words), strict=True))
        known.update([(chunk, b"".join([known[w] if type(w) is bytes else pack([w]) for w in found])) for chunk, found in parts])

    def _cut(self, text: str) -> list[bytes]:
        """Runs without ASCII white space that hold whole words; in plain texts in lower case, with marks cut off, so that fewer differ."""
        if self._mark_off and self._special_text not in text and PLAIN_TEXT.fullmatch(text):
            text = self._mark_off(r" \g<0>", text.lower())
        return text.encode().split()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers; None counts as empty."""
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size < SLICE_CHARS):
                part.append(self._cut(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            now: set[bytes] = set().union(*part)
            fresh = now - self._ids.keys()
            if len(self._ids) + len(fresh) > REMEMBERED:  # what these texts use stays, so frequent words do
                self._ids = {w: self._ids[w] for w in now - fresh}
            if fresh:
                self._learn(list(fresh))
            get = self._ids.__getitem__
            for words in part:
                yield b"".join(map(get, words))

    def decode(self, packed: bytes) -> str:
        """The tokens as their file spells them, between spaces; this tokenizer has no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_ready: dict[tuple, Codec] = {}


def codec_of(tokenizer_json: str, lexicon: bytes | None = None) -> Codec:
    """The worker's codec for these contents; a worker keeps the last one from task to task."""
    key = (hashlib.sha256(tokenizer_json.encode()).digest(), hashlib.sha256(lexicon or b"").digest())
    if key not in _ready:
        _ready.clear()
        _ready[key] = Codec(tokenizer_json, lexicon)
    return _ready[key]


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of a batch's rows with about so many characters, as (first row, texts)."""
    texts = batch.column(column)
    at = 0
    while at < len(texts):
        part, size, first = [], 0, at
        while at < len(texts) and size < chars:
            part.append(texts[at].as_py())
            size += len(part[-1] or "")
            at += 1
        yield first, part


def compile_lexicon(df: DataFrame, text_col: str, tokenizer_json: str, n_words: int = LEXICON_WORDS) -> bytes:
    """Counts the words of every text and compiles the most frequent: those that occur so often that there are ``n_words`` or fewer.

    Where the line is drawn is read from how many words occur how often, so no more than the chosen words come
    to the driver, however many tasks have counted.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        chunks: Counter = Counter()

        def counted() -> pa.RecordBatch:
            words: Counter = Counter()
            for chunk, n in chunks.items():
                pieces = codec._special_split(chunk) if codec._special_mark in chunk else (chunk,)
                for piece in pieces:
                    if piece not in codec._special:
                        for word in codec.words(piece):
                            words[word] += n
            chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "times"])

        for batch in batches:
            for _, texts in slices(batch, "text"):
                for text in texts:
                    if text:
                        chunks.update(text.encode().split())
                if len(chunks) > REMEMBERED:
                    yield counted()
        yield counted()

    ws = Workspace(df.sparkSession, "lexicon")
    words = df.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, times long")
    counts = ws.table(words.groupBy("word").agg(F.sum("times").alias("times")))
    histogram = ws.table(counts.groupBy("times").agg(F.count(F.lit(1)).alias("words")))
    room, least = n_words, None
    for row in histogram.orderBy(F.desc("times")).limit(n_words).collect():  # each has a word at least
        room -= row["words"]
        if room < 0:
            break
        least = row["times"]
    top = counts.where(F.col("times") >= least).select("word") if least else counts.select("word").limit(0)
    found = [bytes(r["word"]) for r in top.collect()]  # `n_words` at most
    codec = Codec(tokenizer_json)
    return Transducer.compile(dict(zip(found, codec.merge_many(list(found)), strict=True)))


def encode_texts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", n_words: int = LEXICON_WORDS) -> DataFrame:
    """One row per input row: the id, ``n_tokens``, ``ids`` (packed 32-bit, little-endian) and ``decoded``.

    ``tokenizer`` is the path of the tokenizer's file on the driver. NULL and empty texts have no ids and
    decode to the empty text. Special tokens spelled out in a text become their ids, as in the library.
    Repeated rows are encoded each; other columns are ignored, whatever their names.
    """
    return _map_encoded(
        df, tokenizer, id_col, text_col, n_words, "ids binary, decoded string", lambda codec, packed: (packed, codec.decode(packed))
    )


def digest_texts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", n_words: int = LEXICON_WORDS) -> DataFrame:
    """As :func:`encode_texts`, with SHA-256 digests in place of ids and decoded texts."""

    def digests(codec: Codec, packed: bytes) -> tuple[str, str]:
        return hashlib.sha256(packed).hexdigest(), hashlib.sha256(codec.decode(packed).encode()).hexdigest()

    return _map_encoded(df, tokenizer, id_col, text_col, n_words, "ids_sha256 string, decoded_sha256 string", digests)


def _map_encoded(df, tokenizer, id_col, text_col, n_words, columns, outputs) -> DataFrame:
    spark = df.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    lexicon = compile_lexicon(df, text_col, spec, n_words)
    shared = spark.sparkContext.broadcast((spec, lexicon))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    names = ["id", "n_tokens", *(c.split()[0] for c in columns.split(", "))]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(*shared.value)
        for batch in batches:
            for first, part in slices(batch, "text"):
                rows = [(len(p) // 4, *outputs(codec, p)) for p in codec.encode(part)]
                values = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(part)), *values], names)

    return texts.mapInArrow(encode, f"id {kind}, n_tokens long, {columns}").withColumnRenamed("id", id_col)


