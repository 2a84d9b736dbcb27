"""URL rules and host lists looked up in a cascade of Bloom filters.

A filter over the listed keys lets some unlisted keys pass. All keys that the corpus can ask for are
known, so those false positives can be listed too: the second level holds them, the third holds the
listed keys that wrongly pass the second, and so on until no key is wrong. Membership is then exact
for every key of the corpus, and looking a URL up takes some hashes and no join.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import LOWER, UPPER
from flowloom.session import cut_lineage

HASHES = 4
#: Bits a key gets in the first level, and in the later ones, which hold few keys.
FIRST_BITS, LATER_BITS = 12, 6
#: The largest filter that is sent to every task: 16 MB.
MAX_BITS = 1 << 27


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null URL or one without `://`. The host is what stands up to `/`, `?` or `#`,
    with A-Z lower-cased; the path goes on from there up to `?` or `#`."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


@dataclass(frozen=True)
class Rules:
    """Rules of one kind: key (host followed by the start of a path) -> shapes they come in."""

    keys: tuple[str, ...]

    @property
    def shapes(self) -> list[tuple[int, int]]:
        """(labels of the host, characters of the path), longest first."""
        found = {(len(h.split(".")), len(p)) for h, p in map(split_key, self.keys)}
        return sorted(found, key=lambda x: (-x[1], -x[0]))


def split_key(key: str) -> tuple[str, str]:
    host, slash, path = key.partition("/")
    return host, slash + path


def candidate(host: Column, path: Column, labels: int, length: int) -> Column:
    """The key of a shape that a URL would match: null if its host or path is too short."""
    enough = (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= length) & (host != "")
    return F.when(enough, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)]


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(position, F.lit(64)).cast("int"))


def _filter_words(keys: DataFrame, level: int, bits: int) -> list[int]:
    """The filter as 64-bit words. Bits are set on the executors, the driver gets at most MAX_BITS."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(_bit(F.col("at"))).alias("bits"))
    out = [0] * (bits // 64)
    for row in words.toLocalIterator():
        out[row["word"]] = row["bits"]
    return out


def _passes(key: Column, level: int, bits: int, words: Column) -> Column:
    passed = F.lit(True)
    for at in _positions(key, level, bits):
        passed &= F.get(words, F.floor(at / 64).cast("int")).bitwiseAND(_bit(at)) != 0
    return passed


@dataclass(frozen=True)
class Cascade:
    levels: tuple[tuple[int, Column], ...]  # (bits, words as a scalar)

    def holds(self, key: Column) -> Column:
        """True for listed keys; exact for every key of the universe it was built over, false for null."""
        verdict = F.lit(len(self.levels) % 2 == 1)  # a key that passes all levels
        for level in reversed(range(len(self.levels))):
            bits, words = self.levels[level]
            verdict = F.when(_passes(key, level, bits, words), verdict).otherwise(F.lit(level % 2 == 1))
        return F.when(key.isNull(), F.lit(False)).otherwise(verdict)


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that tells the keys of `listed` from all other keys of `universe` (column key).

    A filter of more than MAX_BITS is refused: split the list, or join, for such a list.
    """
    spark = listed.sparkSession
    listed = listed.where(F.col("key").isNotNull()).distinct()
    inside = cut_lineage(listed)
    outside = cut_lineage(universe.where(F.col("key").isNotNull()).distinct().join(inside, "key", "left_anti"))
    levels: list[tuple[int, Column]] = []
    while True:
        encoded, other = (inside, outside) if len(levels) % 2 == 0 else (outside, inside)
        count = encoded.count()
        if count == 0 and levels:
            return Cascade(tuple(levels))
        bits = max(64, -(-count * (LATER_BITS if levels else FIRST_BITS) // 64) * 64)
        if bits > MAX_BITS:
            raise ValueError(f"{count} keys need a filter of {bits} bits; at most {MAX_BITS} are broadcast")
        words = _filter_words(encoded, len(levels), bits)
        literal = spark.createDataFrame([(words,)], "words array<bigint>").scalar()
        levels.append((bits, literal))
        wrong = cut_lineage(other.where(_passes(F.col("key"), len(levels) - 1, bits, literal)))
        inside, outside = (inside, wrong) if other is outside else (wrong, outside)


def judge(
    pages: DataFrame, allow: Iterable[str], block: Iterable[str], listed_hosts: Iterable[str] = ()
) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict.

    The longest fitting rule decides (by its path, then its host); a rule fits its host and all
    subdomains if the path starts with the rule's. Without a rule a page is blocked if its host or a
    parent domain is in `listed_hosts`, else allowed. Null and malformed URLs have no host, fit no
    rule and are allowed. Repeated rows and pages without ids are judged like others; an empty table
    gives an empty result; other columns of `pages` are left out.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    lists = {"allow": Rules(tuple(allow)), "block": Rules(tuple(block)), "listed": Rules(tuple(listed_hosts))}
    shapes = sorted({s for rules in lists.values() for s in rules.shapes}, key=lambda x: (-x[1], -x[0]))
    keys = {s: candidate(F.col("host"), F.col("path"), *s) for s in shapes}
    universe = cut_lineage(pages.select(F.explode(F.array(*keys.values())).alias("key")).distinct()) if keys else None
    hit = {}
    for name, rules in lists.items():
        if rules.keys:
            listed = spark.createDataFrame([(k,) for k in rules.keys], "key string")
            cascade = build_cascade(listed, universe)
            hit[name] = {s: cascade.holds(keys[s]) for s in rules.shapes}
    rule, verdict = F.lit(None).cast("string"), F.lit("allow")
    for found in hit.get("listed", {}).values():
        verdict = F.when(found, F.lit("block")).otherwise(verdict)
    for shape in reversed(shapes):  # the longest is asked first
        for name in ("allow", "block"):
            if (found := hit.get(name, {}).get(shape)) is not None:
                rule = F.when(found, keys[shape]).otherwise(rule)
                verdict = F.when(found, F.lit(name)).otherwise(verdict)
    return pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
