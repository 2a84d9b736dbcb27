"""Texts as ids of a sentence-piece model, and back.

Words with their leading mark are encoded once each: the distinct words of a batch are sorted, which
is a depth-first walk over their trie, and one table of forward scores serves all words with a common
prefix; going on from one word to the next keeps the table up to where they part.

A unigram model's forward score of a prefix is the best sum of its pieces' scores. A merge model's
is the one segmentation of the prefix that merging gives: its last piece is the one piece that ends
there and stays apart from the last piece before it. Both are filled in the same way, character by
character, and read back from the end.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import lean, long_rows

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
#: Encoded words, and pairs and ends of pieces, that a worker keeps from batch to batch. It keeps them
#: after its tasks too, beside what runs next, so they are few: some tens of megabytes together.
REMEMBERED, REMEMBERED_PAIRS = 200_000, 250_000
#: Characters whose words are sorted and walked together.
AT_ONCE = 1 << 21
#: Characters of the longest words that are kept from batch to batch.
LONG = 1000
#: Characters before a place that tell which pieces end there.
TAIL = 4
#: A word starts with its run of marks; marks at the end of a text are a word of their own.
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: What an unknown character costs beyond the worst piece of a unigram model.
UNKNOWN_COST = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialized message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """What a model file says; small, so that it is sent to every task."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    add_mark: bool = True
    trim: bool = True
    charsmap: bool = False

    @classmethod
    def read(cls, data: bytes) -> Model:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append(piece.get(1, b"").decode())
                model.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                model.types.append(piece.get(3, NORMAL))
            elif number == 2:
                model.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                model.add_mark, model.trim = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                model.charsmap = bool(spec.get(2))
        if model.kind not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and merge models are known")
        if model.charsmap:
            raise ValueError("models that rewrite characters are not supported: normalize texts before")
        if any(MARK in p.lstrip(MARK) for p, t in zip(model.pieces, model.types) if t in (NORMAL, USER)):
            raise ValueError("a piece goes over the start of a word")
        return model

    def encoder(self) -> Encoder:
        """One encoder per worker process, so that tasks go on with what earlier ones remember."""
        if "_encoder" not in self.__dict__:
            self._encoder = Encoder(self)
        return self._encoder


class Encoder:
    """Encodes sorted words over one table of forward scores."""

    def __init__(self, model: Model):
        self.model = model
        self.ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t in (NORMAL, USER)}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(model.types) if t == UNKNOWN), 0)
        self.floor = min((s for s, t in zip(model.scores, model.types) if t == NORMAL), default=0.0) - UNKNOWN_COST
        self.packed = [struct.pack("i", i) for i in range(len(model.pieces))]
        # place of each piece among the merges: equal scores have equal places
        place = {score: i for i, score in enumerate(sorted({model.scores[i] for i in self.ids.values()}, reverse=True))}
        self.order = {p: place[model.scores[i]] for p, i in self.ids.items() if len(p) > 1}
        self.halves: dict[str, tuple[str, str] | None] = {}
        # id of a piece (the last entry: none) -> id of the next -> whether both stay
        self.apart: list[dict[int, bool]] = [{} for _ in range(len(model.pieces) + 1)]
        self.pairs = 0
        self.known: dict[str | tuple[str], bytes] = {}
        # the last TAIL characters of longer pieces -> their lengths, longest first
        ends: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > TAIL:
                ends.setdefault(piece[-TAIL:], set()).add(len(piece))
        self.longer = {end: tuple(sorted(found, reverse=True)) for end, found in ends.items()}
        self.tails: dict[str, tuple] = {}

    def merges(self, text: str) -> list[tuple[str, str]]:
        """The merges of a text in their order: the pair with the best score first, then the leftmost."""
        parts = list(text)
        done = []
        while True:
            best = None
            for at in range(len(parts) - 1):
                order = self.order.get(parts[at] + parts[at + 1])
                if order is not None and (best is None or order < best[0]):
                    best = order, at
            if best is None:
                return done
            at = best[1]
            done.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def made_of(self, piece: str) -> tuple[str, str] | None:
        """The last merge that gives this piece; None where merging its characters gives another
        segmentation, and for single characters."""
        if piece not in self.halves:
            done = self.merges(piece)
            whole = bool(done) and done[-1][0] + done[-1][1] == piece
            self.halves[piece] = done[-1] if whole else None
        return self.halves[piece]

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether merging the text of two pieces leaves them as they are.

        Their merges are undone from the last one on. Whenever the two that then meet could have been
        merged before the merge just undone, they would have been: of equal scores the left goes first.
        """
        order, undone = self.order, float("inf")
        while True:
            if order.get(left + right, undone) < undone:
                return False
            first = order[left] if len(left) > 1 else -1
            second = order[right] if len(right) > 1 else -1
            if first < 0 and second < 0:
                return True
            if first > second:
                undone, left = first, self.made_of(left)[1]
            else:
                undone, right = second + 0.5, self.made_of(right)[0]

    def ending(self, tail: str) -> tuple[tuple[tuple[int, int], ...], tuple[int, ...]]:
        """(length, id) of the pieces of two characters and more that merging can give and that end
        `tail`, the longest first, and the lengths of even longer ones that end with all of it."""
        found = []
        for n in range(len(tail), 1, -1):
            own = self.ids.get(tail[-n:])
            if own is not None and self.made_of(tail[-n:]):
                found.append((n, own))
        return tuple(found), self.longer.get(tail, ())

    def alone(self, char: str) -> tuple[int, bytes]:
        """Id and packed ids of a character by itself; -1 where it has no piece and is never merged."""
        own = self.ids.get(char)
        if own is not None:
            return own, self.packed[own]
        if self.bytes:
            return -1, b"".join(self.packed[self.bytes[b]] for b in char.encode())
        return -1, self.packed[self.unknown]

    def walk(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Every word of a sorted list and its packed ids; the table goes on from the common prefix.

        The table has, for each prefix of the current word: the forward score, the id of the last
        piece (-1: none that merges), and where that piece starts. Ids are read back from the end, so
        the table grows with the length of a word and no faster.
        """
        fill = self._merge_fill if self.model.kind == MERGES else self._unigram_fill
        scores, pieces, starts = [0.0], [-1], [0]
        last = ""
        for word in words:
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            shared += 1
            del scores[shared:], pieces[shared:], starts[shared:]
            fill(word, shared, scores, pieces, starts)
            yield word, self._read_back(word, pieces, starts)
            last = word

    def _read_back(self, word: str, pieces: list, starts: list) -> bytes:
        found, end = [], len(word)
        while end:
            own = pieces[end]
            found.append(self.packed[own] if own >= 0 else self.alone(word[end - 1])[1])
            end = starts[end]
        return found[0] if len(found) == 1 else b"".join(reversed(found))

    def _merge_fill(self, word: str, start: int, scores: list, pieces: list, starts: list) -> None:
        """Merging has one segmentation of each prefix, so scores need no comparing."""
        tails, apart = self.tails, self.apart
        for end in range(start, len(word) + 1):
            tail = word[end - TAIL : end] if end > TAIL else word[:end]
            entry = tails.get(tail)
            if entry is None:
                if len(tails) >= REMEMBERED_PAIRS:
                    tails.clear()
                tails[tail] = entry = self.ending(tail)
            found, longer = entry
            if longer:
                more = [(n, self.ids.get(word[end - n : end])) for n in longer if n <= end]
                found = (*((n, own) for n, own in more if own is not None and self.made_of(word[end - n : end])), *found)
            for n, own in found:
                before = pieces[end - n]
                fits = apart[before].get(own)
                if fits is None:
                    fits = before < 0 or self.stay_apart(self.model.pieces[before], self.model.pieces[own])
                    self._remember(before, own, fits)
                if fits:
                    pieces.append(own)
                    starts.append(end - n)
                    break
            else:
                pieces.append(self.ids.get(word[end - 1], -1))
                starts.append(end - 1)

    def _remember(self, before: int, own: int, fits: bool) -> None:
        if self.pairs >= REMEMBERED_PAIRS:
            self.pairs = 0
            for known in self.apart:
                known.clear()
        self.pairs += 1
        self.apart[before][own] = fits

    def _unigram_fill(self, word: str, start: int, scores: list, pieces: list, starts: list) -> None:
        for end in range(start, len(word) + 1):
            own = self.ids.get(word[end - 1], -1)
            best, before = scores[end - 1] + self.floor, end - 1
            for at in range(max(0, end - self.longest), end):
                found = self.ids.get(word[at:end])
                if found is not None and scores[at] + self.model.scores[found] > best:
                    best, before, own = scores[at] + self.model.scores[found], at, found
            scores.append(best)
            pieces.append(own)
            starts.append(before)

    def marked(self, text: str) -> str:
        if self.model.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if self.model.add_mark and text:
            text = " " + text
        return text.replace(" ", MARK)

    def split(self, text: str) -> list[str | tuple[str]]:
        """The words of a text without their first mark; a word that has none is a tuple of its own."""
        if self.model.add_mark and text and MARK not in text and "  " not in text and text[0] != " " != text[-1]:
            return text.split(" ")
        return [w[1:] if w[0] == MARK else (w,) for w in WORD.findall(self.marked(text))]

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of the texts, some AT_ONCE characters of them at a time."""
        out, start, size = [], 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= AT_ONCE or end == len(texts):
                out += self._encode(texts[start:end])
                start, size = end, 0
        return out

    def _encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        split = [None if t is None else self.split(t) for t in texts]
        words = set().union(*filter(None, split))
        if len(self.known) > REMEMBERED:
            self.known = {w: self.known[w] for w in words if w in self.known}
        new = {w[0] if isinstance(w, tuple) else MARK + w: w for w in words - self.known.keys()}
        self.known.update((new[word], code) for word, code in self.walk(sorted(new)))
        look = self.known.__getitem__
        out = [None if words is None else np.frombuffer(b"".join(map(look, words)), np.int32) for words in split]
        for word, key in new.items():
            if len(word) > LONG:
                del self.known[key]
        return out


class Decoder:
    """Ids to texts: the pieces' bytes stand in one buffer, and a text's are picked out at once."""

    def __init__(self, model: Model):
        self.model = model
        shown = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode()
            for p, t in zip(model.pieces, model.types)
        ]
        self.buffer = np.frombuffer(b"".join(shown), np.uint8)
        self.lengths = np.array([len(x) for x in shown], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids) -> str | None:
        if ids is None:
            return None
        ids = np.asarray(ids, np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ids) else 0)
        text = self.buffer[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.model.add_mark and text.startswith(" ") else text


def read_model(spark: SparkSession, path: str) -> Model:
    """The model file at a path of the driver's disk. Tasks get it with the function that uses it, so
    its size is checked: a vocabulary of some hundred thousand pieces is a few megabytes."""
    with open(path, "rb") as file:
        data = file.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"the model is larger than {MAX_MODEL_BYTES} bytes")
    return Model.read(data)


MAX_MODEL_BYTES = 64 << 20


def encode(docs: DataFrame, model: Model, column: str = "text", into: str = "ids") -> DataFrame:
    """`docs` with the ids of `column` in a column `into`; other columns stay, one called `into` is
    replaced.

    Null texts have null ids, empty texts none. Repeated rows are encoded alike. Texts are encoded
    whole; a batch holds the distinct words of its texts.
    """
    long_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<int>")
    @lean
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = shared.value.encoder()
        for texts in batches:
            yield pd.Series(encoder.encode([t if isinstance(t, str) else None for t in texts]), dtype=object)

    return docs.withColumn(into, ids(F.col(column)))


def encode_checked(docs: DataFrame, model: Model, column: str = "text", into: str = "ids", check: str = "round_trip") -> DataFrame:
    """Like `encode`, with a column `check`: whether decoding the ids gives the text back. The ids are
    decoded where they are made, so neither they nor the texts travel twice."""
    long_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("ids array<int>, same boolean")
    @lean
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = shared.value.encoder(), Decoder(shared.value)
        for texts in batches:
            texts = [t if isinstance(t, str) else None for t in texts]
            ids = encoder.encode(texts)
            same = [decoder.decode(x) == t for x, t in zip(ids, texts)]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "same": pd.Series(same, dtype=bool)})

    names = [c for c in docs.columns if c not in (into, check)]
    done = docs.withColumn("__both", both(F.col(column)))
    return done.select(*names, F.col("__both.ids").alias(into), F.col("__both.same").alias(check))


def decode(docs: DataFrame, model: Model, column: str = "ids", into: str = "decoded") -> DataFrame:
    """The reverse of `encode`: spaces for marks, without the one that encoding puts first. A text
    that itself has the mark character comes back with a space there."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    @lean
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(shared.value)
        for ids in batches:
            yield pd.Series([decoder.decode(x) for x in ids], dtype=object)

    return docs.withColumn(into, text(F.col(column)))
