"""Secrets in every version of every text, scanned once for each distinct text and rule version.

Texts are content-addressed: a blob is a SHA-256 and its text. The ledger is a table of (blob, rule,
version, spans). A scan takes only the pairs of blob and rule version that the ledger lacks, and
findings are joined back to all paths that ever held the blob. A new rule, or a new version of one,
scans old blobs for that rule alone; a new version of a file scans its own text alone.

Everything is SQL functions. Spans come from one pass that pairs each match with the text before it:
lengths add up to places, in code points.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.session import path_exists, scratch_path

WORD = "[A-Za-z0-9+/_.=-]"


class Rule(NamedTuple):
    kind: str
    pattern: str  # without groups that capture, but for what `least` measures
    least: int  # code points that the match, or its only capturing group, must have
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Kinds that the contract fixes, in its order.
BASE = (
    Rule("assign", rf"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?({WORD}+)", 8),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{32,}", 32),
)
#: Kinds beyond these: tokens with prefixes of well-known services, signed tokens, private keys.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("stripe", "[sr]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 27),
)
RULES = BASE + MORE
SPAN = "struct<start:bigint,end:bigint>"
LEDGER = f"blob string, rule string, spans array<{SPAN}>"
#: Copies of a blob's findings, so that a blob at many paths is joined in as many tasks.
SALTS = 16
#: Matches whose spans are put together at once.
BLOCK = 512


def _bound(value: Column, fn) -> Column:
    """fn(value), with the value worked out once however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _placed(block: Column, start: Column, least: int) -> Column:
    """Spans of a block of (before, match, size), the first of which begins at `start`."""
    return F.aggregate(
        block,
        F.struct(start.alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["before"] + m["match"]).alias("at"),
            F.when(
                (m["match"] > 0) & (m["size"] >= least),
                F.array_append(
                    acc["spans"],
                    F.struct((acc["at"] + m["before"]).alias("start"), (acc["at"] + m["before"] + m["match"]).alias("end")),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def _starts(blocks: Column) -> Column:
    """Where each block begins, and where the last one ends."""
    total = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda acc, m: acc + m["before"] + m["match"])
    add = lambda acc, block: F.array_append(acc, F.element_at(acc, -1) + total(block))
    return F.aggregate(blocks, F.array(F.lit(0).cast("long")), add)


def find(text: Column, rule: Rule) -> Column:
    """Spans of the rule's matches, leftmost and without overlap; those that are too short are dropped.

    Every match of the pattern below is (text before, match); the last one ends the text, so no place is
    tried twice. Lists are added up in blocks, as appending copies what is there.
    """
    grouped = "(" in rule.pattern.replace("(?", "")
    each = F.lit(rf"(?s)(.*?)({rule.pattern}|\z)")
    lengths = lambda group: F.transform(F.regexp_extract_all(text, each, F.lit(group)), lambda x: F.length(x).cast("long"))
    sized = F.arrays_zip(lengths(1).alias("before"), lengths(2).alias("match"), lengths(3 if grouped else 2).alias("size"))
    numbers = lambda xs: F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
    cut = lambda xs: F.transform(numbers(xs), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))
    place = lambda block, start: F.when(block.isNull(), F.array().cast(f"array<{SPAN}>")).otherwise(_placed(block, start, rule.least))
    spans = _bound(sized, lambda xs: _bound(cut(xs), lambda blocks: F.flatten(F.zip_with(blocks, _starts(blocks), place))))
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def content_address(texts: DataFrame) -> DataFrame:
    """`texts` with blob, the SHA-256 of the text; a null text is an empty one."""
    return texts.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))


def scan(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New rows of the ledger: the pairs of `blobs` (blob, text) and rules that it does not hold yet."""
    asked = F.array(*[F.lit(r.name) for r in rules])
    done = ledger.where(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    open_ = blobs.select("blob", "text").distinct().join(done, "blob", "left")
    open_ = open_.withColumn("open", F.array_except(asked, F.coalesce("done", F.array().cast("array<string>")))).where(F.size("open") > 0)
    pair = lambda r: F.when(F.array_contains("open", r.name), F.struct(F.lit(r.name).alias("rule"), find(F.col("text"), r).alias("spans")))
    return open_.select("blob", F.inline(F.array_compact(F.array(*[pair(r) for r in rules]))))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans (start, place of the rule, end, kind) in order, for blobs with a span under `rules`."""
    held = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(i).alias("place")) for i, r in enumerate(rules)]
    place = reduce(lambda out, i: F.when(F.col("rule") == rules[i].name, held[i]).otherwise(out), range(len(rules)), F.lit(None))
    each = ledger.where(F.size("spans") > 0).withColumn("as", place).where("as is not null")
    each = each.select(
        "blob",
        F.transform(
            "spans",
            lambda s: F.struct(s["start"].alias("start"), F.col("as.place").alias("place"), s["end"].alias("end"), F.col("as.kind").alias("kind")),
        ).alias("spans"),
    )
    return each.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def at_paths(paths: DataFrame, found: DataFrame) -> DataFrame:
    """Every row of `paths` (with blob) and its `spans`, null where the blob has none.

    One blob may be the text of most paths: its findings are copied to SALTS keys and the paths dealt
    out over them.
    """
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = paths.withColumn("salt", F.pmod(F.hash("path", F.spark_partition_id()), F.lit(SALTS)))
    return dealt.join(salted, ["blob", "salt"], "left").drop("salt")


class Ledger:
    """A stored ledger: parts that are only ever added, each by one scan."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "secret-ledger")
        if not path_exists(spark, self.path):
            empty = [F.lit(None).cast(t).alias(c) for c, t in (("blob", "string"), ("rule", "string"), ("spans", f"array<{SPAN}>"))]
            spark.range(0).select(*empty).write.mode("ignore").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def add(self, texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what is new in `texts` (text). Doing so again adds nothing, so a job that broke off
        before its rows were committed is simply run again."""
        blobs = content_address(texts).select("blob", F.coalesce("text", F.lit("")).alias("text"))
        scan(blobs, self.read(), rules).write.mode("append").parquet(self.path)


def scan_versions(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of `versions` (path, text: one historical version of a file) with blob and spans.

    spans: (start, place of the rule, end, kind) by start, then the order of `rules`; null where there is
    none; ends are exclusive, in code points. A null text is an empty one, rows that repeat a path or a
    text are all returned, a null path is a path, and an empty table gives an empty result. Texts are
    scanned whole. Other columns are returned beside; the names blob, spans and salt are replaced.
    """
    rows = versions.drop("blob", "spans", "salt")
    ledger.add(rows.select("text"), rules)
    return at_paths(content_address(rows).drop("text"), findings(ledger.read(), rules))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.coalesce(F.array_join(shown, ","), F.lit(""))


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of the contract's kinds, the digest of their spans, and all spans as text, a row per path."""
    count = lambda kind: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>"))
    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in BASE]))
    return scanned.withColumn("spans", spans).select(
        F.col("path").alias("doc_id"),
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )
