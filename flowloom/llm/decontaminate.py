"""Benchmark passages in documents, by a prefix-filtered set join.

A window of a benchmark item (13 consecutive words, or all words of a shorter item) occurs in a
document only if all of its shingles (pairs of neighbouring words) do. So one shingle per window is
enough to find it: the one that the fewest documents have. Documents are joined with these prefix
shingles alone; position and length tell where the window would lie, and it must fit in there; then
the words are compared.

The join goes block by block over the benchmark, `WINDOWS` windows at a time, each block broadcast
to the documents. Documents are never shuffled, and counts of shingles cover all of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import lean

SIZE = 13
#: Windows in a block of the benchmark: some 30 MB as a table of byte strings.
WINDOWS = 200_000
#: A document is contaminated if at least one word in SHARE is hit.
SHARE = 20
HITS = "__hits"
STATE = "n_words long, hits array<int>, items array<string>"
Windows = dict[tuple[bytes, ...], set[str]]

#: Bytes -> lower-cased letters, digits and bytes beyond ASCII; anything else parts words.
TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TO_WORDS).split() if text else []


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def shingles_of(window: tuple[bytes, ...]) -> list[bytes]:
    """Pairs of neighbouring words; the word itself where there is one only."""
    return [a + b" " + b for a, b in zip(window, window[1:])] or [window[0]]


def _frequencies(docs: DataFrame, shingles: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of a block's shingles stands, over all documents."""
    wanted = docs.sparkSession.sparkContext.broadcast((shingles, any(b" " not in s for s in shingles)))

    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, with_words = wanted.value
        found: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text)
                keys = {a + b" " + b for a, b in zip(words, words[1:])}
                if with_words:
                    keys.update(words)
                for shingle in shingles & keys:
                    found[shingle] += 1
        yield pd.DataFrame({"shingle": list(found), "n": list(found.values())}, columns=["shingle", "n"])

    counts = docs.select("text").mapInPandas(count, "shingle binary, n long")
    return {bytes(r["shingle"]): r["n"] for r in counts.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}


def _prefixes(windows: Windows, seen: dict[bytes, int]) -> dict[bytes, list[tuple[int, tuple[bytes, ...]]]]:
    """Rarest shingle -> (its place in the window, window). Windows with a shingle that no document
    has cannot occur and are left out."""
    prefix = defaultdict(list)
    for window in windows:
        shingles = shingles_of(window)
        if all(s in seen for s in shingles):
            at = min(range(len(shingles)), key=lambda i: (seen[shingles[i]], shingles[i], i))
            prefix[shingles[at]].append((at, window))
    return dict(prefix)


def _block_join(docs: DataFrame, windows: Windows):
    """A column function (text, state) -> state with one block's hits added."""
    prefix = _prefixes(windows, _frequencies(docs, {s for w in windows for s in shingles_of(w)}))
    with_words = any(b" " not in s for s in prefix)
    shared = docs.sparkSession.sparkContext.broadcast((prefix, windows if prefix else {}))

    @F.pandas_udf(STATE)
    def join(texts: pd.Series, state: pd.DataFrame) -> pd.DataFrame:
        prefix, windows = shared.value
        counts, hits, items = [], [], []
        for text, old_hits, old_items in zip(texts, state["hits"], state["items"]):
            words = words_of(text)
            hit, found = set(old_hits), set(old_items)
            pairs = [a + b" " + b for a, b in zip(words, words[1:])]
            for keys in (pairs, words) if with_words else (pairs,):
                if prefix.keys().isdisjoint(keys):
                    continue
                for position, key in enumerate(keys):
                    for at, window in prefix.get(key, ()):
                        start = position - at
                        end = start + len(window)
                        if start >= 0 and end <= len(words) and tuple(words[start:end]) == window:
                            hit.update(range(start, end))
                            found.update(windows[window])
            counts.append(len(words))
            hits.append(sorted(hit))
            items.append(sorted(found))
        return pd.DataFrame({"n_words": counts, "hits": hits, "items": items})

    return join


def _with_hits(docs: DataFrame, benchmark: DataFrame, size: int, block: int) -> DataFrame:
    """`docs` with a column of type STATE added, named HITS."""
    empty = F.struct(
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    texts, state = docs.select("text"), docs.withColumn(HITS, empty)
    for windows in _blocks(benchmark, size, block):
        state = state.withColumn(HITS, _block_join(texts, windows)("text", HITS))
    return state


def _contaminated(state: Column) -> Column:
    hit = F.size(state["hits"])
    return (hit > 0) & (hit * SHARE >= state["n_words"])


def find(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block: int = WINDOWS) -> DataFrame:
    """A row per row of `docs` (doc_id, text): doc_id, n_words, n_hit, n_items, items, contaminated.

    n_hit counts words inside any occurrence of an item's window, items are the ids, sorted, of items
    with such a window. Words are runs of ASCII letters and digits, A-Z lower-cased, and of characters
    beyond ASCII. Null and empty texts have no words and are clean; items without words have no
    windows, an item without an id is named "". Items that share a window are all reported, repeated
    rows are judged one by one. Without a benchmark all documents are clean; no documents give an
    empty result. Other columns are left out.
    """
    state = _with_hits(docs.select("doc_id", "text"), benchmark, size, block)
    return state.select(
        "doc_id",
        F.col(HITS)["n_words"].alias("n_words"),
        F.size(F.col(HITS)["hits"]).cast("long").alias("n_hit"),
        F.size(F.col(HITS)["items"]).cast("long").alias("n_items"),
        F.col(HITS)["items"].alias("items"),
        _contaminated(F.col(HITS)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block: int = WINDOWS) -> DataFrame:
    """The rows of `docs` that `find` does not call contaminated, with all their columns."""
    return _with_hits(docs, benchmark, size, block).where(~_contaminated(F.col(HITS))).drop(HITS)


def _blocks(benchmark: DataFrame, size: int, block: int) -> Iterator[Windows]:
    """Windows -> ids of items, `block` windows at a time; the driver holds one block. The last may be empty."""
    windows: Windows = defaultdict(set)
    for row in benchmark.select("item_id", "text").toLocalIterator():
        name = "" if row["item_id"] is None else str(row["item_id"])
        for window in windows_of(words_of(row["text"]), size):
            windows[window].add(name)
        if len(windows) >= block:
            yield dict(windows)
            windows.clear()
    yield dict(windows)
