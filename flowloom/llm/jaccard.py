"""Documents linked by the Jaccard similarity of their word shingles: a size-aware exact join.

Documents with equal sets are one class, and classes are joined. Two sets of sizes r and s are
similar if they share at least `overlap(r, s)` shingles.

Light: for small sets every subset of that fixed size is listed, for each partner size in reach. Two
sets that list the same subset are similar, with nothing left to compare, so each subset links its
holders to one of them.

Heavy: of a large set only its rarest shingles, as many as it may lack in a partner and one more, go
into inverted lists: similar sets meet in at least one. Lists are scanned in chunks of CHUNK sets.
Sizes, places in the lists and folded parity bitmaps bound the overlap; pairs that remain are compared
set by set. A list that fits one chunk is compared whole. Of a longer one, CENTERS sets are first
compared with all; sets that end up outside the list's largest component are then compared with the
sets of other components. So a group of thousands of copies costs some comparisons for each copy, not
one for each pair, and components are exact all the same.

The boundary between small and large is where listing subsets would cost more rows than scanning.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import BROADCAST_ROWS, discard, lean, long_rows, small_side, stored
from flowloom.llm.components import components

WIDTH = 3
#: Similarity in percent.
PERCENT = 90
#: Sets in a chunk of an inverted list, and the sets of a long list that all others meet first.
CHUNK, CENTERS = 64, 16
#: The sizes for which listing subsets is considered.
MAX_SMALL = 60
#: Counters of the sketch of document frequencies. They decide which shingles count as rare, so they
#: bear on cost and never on results.
COUNTERS = 1 << 18
#: Bits of a bitmap, at least and at most; about two for each shingle. Every entry of an inverted list
#: carries one of at most LIST_BITS, since long documents have many entries; pairs that pass are
#: compared by their whole bitmaps next, and only then by their sets.
MIN_BITS, MAX_BITS, LIST_BITS = 256, 1 << 16, 1024
#: Word hashes and classes a task remembers.
REMEMBERED = 200_000
NO_ID = (1 << 63) - 1

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
U32 = np.uint64(32)


def overlap(r: int, s: int, percent: int = PERCENT) -> int:
    """The least number of shared elements that makes sets of these sizes similar."""
    return -(-percent * (r + s) // (100 + percent))


def partners(s: int, percent: int = PERCENT) -> range:
    """Sizes that a set of size s can be similar to."""
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def prefix_length(s: int, percent: int = PERCENT) -> int:
    return s - -(-percent * s // 100) + 1


def subsets(s: int, small: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(lower size, upper size, size of the subsets) that a set of size s lists, for pairs in which
    the smaller set has at most `small` elements."""
    found = []
    for r in partners(s, percent):
        low, high = min(r, s), max(r, s)
        if 0 < low <= small and (size := overlap(low, high, percent)) <= low:
            found.append((low, high, size))
    return found


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U32)) * M1
    x = (x ^ (x >> U32)) * M2
    return x ^ (x >> U32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Texts to sorted arrays of 64-bit shingle hashes."""

    def __init__(self, width: int = WIDTH):
        self.width, self.words = width, WordHashes()

    def set_of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "replace").translate(ASCII_LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.width + 1
        out = np.zeros(n, np.uint64)
        for i in range(self.width):
            out = mix(out + hashes[i : i + n])
        return np.unique(out)


def class_of(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def bits_for(size: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (2 * size - 1).bit_length()))


def bitmap(elements: np.ndarray) -> bytes:
    """For each bit, whether an odd number of elements falls on it."""
    bits = bits_for(len(elements))
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(bits: bytes, size: int) -> int:
    """A bitmap's value with at most `size` bytes."""
    value, at = int.from_bytes(bits, "little"), len(bits)
    while at > size:
        at //= 2
        value = (value >> 8 * at) ^ (value & (1 << 8 * at) - 1)
    return value


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements in one set only. The larger bitmap is folded."""
    size = min(len(a), len(b))
    return (fold(a, size) ^ fold(b, size)).bit_count()


def _counter(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(40)).astype(np.int64) % COUNTERS


def frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """Counts of documents per counter, over all documents."""

    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, total = Shingler(width), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            waiting, held = [], 0
            for text in batch["text"]:
                waiting.append(_counter(shingler.set_of(text)))
                held += len(waiting[-1])
                if held >= COUNTERS:
                    total += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
                    waiting, held = [], 0
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"counter": used, "n": total[used]})

    counts = docs.select("text").mapInPandas(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    frame = counts.toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[frame["counter"].to_numpy(np.int64)] = frame["n"]
    return out


def rarest(elements: np.ndarray, count: int, frequency: np.ndarray) -> np.ndarray:
    """The first `count` elements in the order of frequency, then hash: one order for all sets."""
    return elements[np.lexsort((elements, frequency[_counter(elements)]))[:count]]


def describe(docs: DataFrame, width: int, percent: int, frequency: np.ndarray) -> DataFrame:
    """doc_id, text_hash, size and class of every row; prefix and bitmaps of every class at least once
    (a task leaves them out where it has given them)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)
    schema = "doc_id long, text_hash long, size int, class binary, prefix array<long>, bitmap binary, small binary"

    @lean
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, given, frequency = Shingler(width), set(), shared.value
        for batch in batches:
            rows = []
            for doc_id, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
                elements = shingler.set_of(text)
                size = len(elements)
                if not size:
                    rows.append((doc_id, text_hash, 0, None, None, None, None))
                    continue
                name, prefix, bits, small = class_of(elements), None, None, None
                if name not in given:
                    if len(given) >= REMEMBERED:
                        given.clear()
                    given.add(name)
                    prefix = rarest(elements, prefix_length(size, percent), frequency).view(np.int64)
                    bits = bitmap(elements)
                    length = min(len(bits), LIST_BITS // 8)
                    small = fold(bits, length).to_bytes(length, "little")
                rows.append((doc_id, text_hash, size, name, prefix, bits, small))
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "size", "class", "prefix", "bitmap", "small"])

    return stored(_keyed(docs).mapInPandas(describe, schema), "sets")


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    return docs.select(doc_id, F.xxhash64("text").alias("text_hash"), "text")


def boundary(prefixes: DataFrame, lists: DataFrame, percent: int) -> int:
    """The largest size that is small: sizes up to it cost least as subsets, measured in rows."""
    tokens = prefixes.where(F.col("size") <= MAX_SMALL).select("class", "size", F.explode("prefix").alias("token"))
    scanned = tokens.join(lists, "token", "left").groupBy("size").agg(F.sum(F.coalesce("n", F.lit(1))).alias("scan"))
    sizes = prefixes.where(F.col("size") <= MAX_SMALL).groupBy("size").agg(F.count("*").alias("sets"))
    rows = {r["size"]: r for r in sizes.join(scanned, "size").collect()}
    best, saved, at = 0, 0, 0
    for size in range(1, MAX_SMALL + 1):
        if size in rows:
            listed = sum(math.comb(size, k) for _, _, k in subsets(size, size, percent))
            saved += rows[size]["scan"] - rows[size]["sets"] * listed
        if saved > best:
            best, at = saved, size
    return at


def asked_sets(docs: DataFrame, rows: DataFrame, width: int, asked: DataFrame) -> DataFrame:
    """class, size, elements of the classes in `asked` (class).

    One document stands for each class. Where these are few enough to send, other texts are left out
    before they reach Python; else all sets are made, and the join picks them.
    """
    first = F.min(F.struct("doc_id", "text_hash")).alias("x")
    holders = rows.join(asked, "class").groupBy("class").agg(first).select("x.*")
    texts = _keyed(docs)
    if holders.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(holders), ["doc_id", "text_hash"], "left_semi")

    @lean
    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, given = Shingler(width), set()
        for batch in batches:
            found = []
            for text in batch["text"]:
                elements = shingler.set_of(text)
                name = class_of(elements)
                if not len(elements) or name in given:
                    continue
                if len(given) >= REMEMBERED:
                    given.clear()
                given.add(name)
                found.append((name, len(elements), elements.view(np.int64)))
            yield pd.DataFrame(found, columns=["class", "size", "elements"])

    sets = texts.select("text").mapInPandas(give, "class binary, size int, elements array<long>")
    return sets.join(asked, "class", "left_semi").dropDuplicates(["class"])


def light_links(sets: DataFrame, small: int, percent: int) -> DataFrame:
    """Links (a, b) of similar sets the smaller of which has at most `small` elements."""

    @lean
    def list_subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, size, raw in zip(batch["class"], batch["size"], batch["elements"]):
                elements = raw.view(np.uint64)
                # a subset is named by two sums over its elements, so leaving some out is a subtraction
                first, second = mix(elements * M1), mix(elements * M2 + U32)
                all_first, all_second = first.sum(), second.sum()
                for low, high, count in subsets(size, small, percent):
                    left_out = np.array(list(combinations(range(size), size - count)), np.int64)
                    left_out = left_out.reshape(math.comb(size, count), size - count)
                    yield pd.DataFrame(
                        {
                            "one": (all_first - first[left_out].sum(axis=1, dtype=np.uint64)).view(np.int64),
                            "two": (all_second - second[left_out].sum(axis=1, dtype=np.uint64)).view(np.int64),
                            "low": low,
                            "high": high,
                            "size": size,
                            "class": name,
                        }
                    )

    schema = "one long, two long, low int, high int, size int, class binary"
    listed = sets.where(F.col("size") <= 100 * small // percent).mapInPandas(list_subsets, schema)
    key = ["one", "two", "low", "high"]
    held = stored(listed, "subsets")
    # a set of the lower size stands for the subset: holders of the upper size need not be similar
    center = held.groupBy(*key).agg(F.min(F.when(F.col("size") == F.col("low"), F.col("class"))).alias("a"), F.count("*").alias("n"))
    return held.join(center.where("n > 1 and a is not null"), key).where("a <> class").select("a", F.col("class").alias("b"))


def chunks(prefixes: DataFrame, lists: DataFrame, small: int) -> DataFrame:
    """token, n, chunk, sets: the inverted lists of large sets that have at least two, by chunks."""
    posted = prefixes.where(F.col("size") > small).select("class", "size", F.posexplode("prefix").alias("place", "token"))
    shared = posted.join(lists.where("n > 1"), "token")
    held = shared.join(prefixes.select("class", F.col("small").alias("bitmap")), "class")
    chunk = F.pmod(F.xxhash64("token", "class"), F.ceil(F.col("n") / CHUNK)).alias("chunk")
    return held.select("token", "n", chunk, "class", "size", "place", "bitmap")


def gather(held: DataFrame, *keys: Column | str) -> DataFrame:
    one = F.struct("class", "size", "place", "bitmap", "root")
    return held.groupBy(*keys).agg(F.collect_list(one).alias("sets"))


def compare(pairs_of_chunks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes from `left` and `right` (arrays of sets of one list) that sizes, places
    and bitmaps do not rule out. Sets that have the same root are known to be connected."""

    @lean
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given: set[tuple[bytes, bytes]] = set()
        for batch in batches:
            rows = []
            for left, right in zip(batch["left"], batch["right"]):
                size_l = np.array([x["size"] for x in left])[:, None]
                size_r = np.array([x["size"] for x in right])[None, :]
                place_l = np.array([x["place"] for x in left])[:, None]
                place_r = np.array([x["place"] for x in right])[None, :]
                need = -(-percent * (size_l + size_r) // (100 + percent))
                most = np.minimum(place_l, place_r) + np.minimum(size_l - place_l, size_r - place_r)
                for i, j in np.argwhere((most >= need) & (need <= np.minimum(size_l, size_r))).tolist():
                    x, y = left[i], right[j]
                    if x["class"] == y["class"] or x["root"] is not None and x["root"] == y["root"]:
                        continue
                    pair = (x["class"], y["class"]) if x["class"] < y["class"] else (y["class"], x["class"])
                    if pair in given or x["size"] + y["size"] - 2 * need[i, j] < differing(x["bitmap"], y["bitmap"]):
                        continue
                    if len(given) >= REMEMBERED:
                        given.clear()
                    given.add(pair)
                    rows.append(pair)
            yield pd.DataFrame(rows, columns=["a", "b"])

    return pairs_of_chunks.select("left", "right").mapInPandas(compare, "a binary, b binary").distinct()


def promising(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs that whole bitmaps do not rule out."""

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([differing(x, y) for x, y in zip(a, b)], dtype="int32")

    left = prefixes.select(F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("bitmap").alias("bits_a"))
    right = prefixes.select(F.col("class").alias("b"), F.col("size").alias("size_b"), F.col("bitmap").alias("bits_b"))
    joined = pairs.join(left, "a").join(right, "b")
    sizes = F.col("size_a") + F.col("size_b")
    # of the sum of both sizes at least 2 * need is shared
    most = sizes - 2 * F.ceil(sizes * percent / (100 + percent))
    return joined.where(apart("bits_a", "bits_b") <= most).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar, with their number of shared shingles."""
    left = sets.select(F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("elements").alias("set_a"))
    right = sets.select(F.col("class").alias("b"), F.col("size").alias("size_b"), F.col("elements").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", shared.alias("shared"))
    similar = F.col("shared") * (100 + percent) >= (F.col("size_a") + F.col("size_b")) * percent
    return joined.where(similar).select("a", "b", "shared")


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, size, class) of all documents, and links (a, b) between classes that
    connect just those that chains of similar pairs connect."""
    long_rows(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    frequency = frequencies(docs, width)
    described = describe(docs, width, percent, frequency)
    prefixes = described.where(F.col("prefix").isNotNull()).select("class", "size", "prefix", "bitmap", "small")
    prefixes = stored(prefixes.dropDuplicates(["class"]), "prefixes")
    rows = stored(described.select("doc_id", "text_hash", "size", "class"), "rows")
    discard(described)
    lists = prefixes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    lists = stored(lists.where("n > 1"), "lists")
    small = boundary(prefixes, lists, percent)
    held = stored(chunks(prefixes, lists, small), "postings")
    no_root = held.withColumn("root", F.lit(None).cast("binary"))

    # every list: whole if it is one chunk, else its centers with all
    whole = stored(gather(no_root, "token", "n", "chunk"), "chunks")
    single = whole.where(F.col("n") <= CHUNK).select(F.col("sets").alias("left"), F.col("sets").alias("right"))
    first = whole.where((F.col("n") > CHUNK) & (F.col("chunk") == 0)).select("token", F.slice("sets", 1, CENTERS).alias("left"))
    long = whole.where(F.col("n") > CHUNK).select("token", F.col("sets").alias("right"))
    tried = stored(compare(single.unionByName(first.join(long, "token").select("left", "right")), percent), "tried")
    pairs = stored(promising(tried, prefixes, percent), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class"))
    asked = asked.unionByName(prefixes.where(F.col("size") <= 100 * small // percent).select("class"))
    asked = stored(asked.distinct(), "asked")
    sets = stored(asked_sets(docs, rows, width, asked), "elements")
    links = verified(pairs, sets, percent).select("a", "b")
    if small:
        links = links.unionByName(light_links(sets.where(F.col("size") <= 100 * small // percent), small, percent))
    links = stored(links, "links")
    discard(lists, whole, pairs, asked, sets)

    # long lists: what is outside the largest component, with all others
    rest = held.where(F.col("n") > CHUNK)
    if not rest.isEmpty():
        found_roots = components(links)
        roots = found_roots.select(F.col("node").alias("class"), "root")
        rest = rest.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        rest = stored(rest, "rooted")
        discard(found_roots)
        parts = rest.groupBy("token", "root").agg(F.count("*").alias("members"))
        largest = parts.groupBy("token").agg(F.max(F.struct("members", "root")).alias("x"), F.sum("members").alias("all"))
        largest = largest.where(F.col("x.members") < F.col("all")).select("token", F.col("x.root").alias("largest"), F.col("all"), F.col("x.members").alias("in_largest"))
        open_lists = stored(rest.join(largest, "token"), "open")
        outside = F.ceil((F.col("all") - F.col("in_largest")) / CHUNK)
        block = F.pmod(F.xxhash64("class", "token"), outside).alias("block")
        left = gather(open_lists.where(F.col("root") != F.col("largest")), "token", block).select("token", F.col("sets").alias("left"))
        right = gather(open_lists, "token", "chunk").select("token", F.col("sets").alias("right"))
        more = compare(left.join(right, "token"), percent).join(tried, ["a", "b"], "left_anti")
        more = stored(promising(more, prefixes, percent), "pairs")
        asked = stored(more.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "asked")
        if not asked.isEmpty():
            sets = stored(asked_sets(docs, rows, width, asked), "elements")
            found = stored(verified(more, sets, percent).select("a", "b"), "links")
            links = links.unionByName(found)
            discard(sets)
        discard(rest, open_lists, more, asked)
    discard(prefixes, held, tried)
    return rows, links


def named(docs: DataFrame, width: int, percent: int, what: Column) -> DataFrame:
    """The rows of `join` and, for each, the least `what` of its group in a column `first`."""
    rows, links = join(docs, width, percent)
    roots = components(links)
    classes = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(what).alias("least"))
    rooted = classes.join(roots, classes["class"] == roots["node"], "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    rooted = stored(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"))
    firsts = small_side(stored(rooted.join(firsts, "root").select("class", "first"), "named"))
    return rows.join(firsts, "class", "left")


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row per row of `docs` (doc_id, text): doc_id, text_hash, n_shingles, component_id.

    component_id is the smallest doc_id that links of similar documents reach, the document's own
    included. Words are parted by ASCII white space, A-Z lower-cased; a text of fewer words than
    `width` is one shingle. Null and blank texts have no shingles and are linked with nothing.
    Repeated rows are linked with each other. Rows without an id take the id of their group, if it
    has one. An empty table gives an empty result; other columns are left out.
    """
    out = named(docs, width, percent, F.col("doc_id")).withColumnRenamed("first", "component_id")
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(
        real(F.col("doc_id")).alias("doc_id"),
        "text_hash",
        F.col("size").cast("long").alias("n_shingles"),
        real(F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each group, the one with the smallest doc_id; all columns stay.

    Rows without shingles stay. Of rows that repeat a kept document one stays; of a group without any
    id, too. Groups are told apart by their links, so unlinked texts without an id, or with the same
    one, all stay.
    """
    row = F.struct("doc_id", "text_hash")
    found = named(docs, width, percent, row).where(F.col("first").isNotNull())
    found = stored(found.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("__id"), F.col("text_hash").alias("__hash"), (row == F.col("first")).alias("first")), "groups")
    gone = found.where(~F.col("first")).select("__id", "__hash").distinct()
    repeated = found.where("first").groupBy("__id", "__hash").agg(F.count("*").alias("n"))
    repeated = stored(repeated.where("n > 1").select("__id", "__hash"), "repeated")
    key = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    kept = docs.join(small_side(stored(gone, "gone")), key, "left_anti")
    if repeated.isEmpty():
        return kept
    repeated = small_side(repeated)
    once = kept.join(repeated, key, "left_semi").withColumn("__hash", F.xxhash64("text"))
    once = once.dropDuplicates(["doc_id", "__hash"]).drop("__hash")
    return kept.join(repeated, key, "left_anti").unionByName(once)
