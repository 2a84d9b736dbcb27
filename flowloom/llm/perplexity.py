"""Quality by the perplexity of a character n-gram model trained on trusted text.

The model is interpolated modified Kneser-Ney of order ORDER, one per language, on all documents that
labels trust. It is cross-fitted: texts fall into two folds by checksum, a model per fold is trained,
and each text is scored by the model of the other fold, so that no text is judged by itself or by its
copies. A language's threshold is a quantile of its trusted documents' scores. Repetition is no surprise
to the model, so a text is judged by its novelty too, the share of its n-grams that are new in their
block; there the threshold is the opposite quantile.

Counts are tables sharded by n-gram. Every distinct n-gram of the corpus is joined with the counts,
level by level, so that each has its probability; a document's score is the mean over its n-grams.
The table of distinct n-grams is sent to the tasks if it has at most MAX_GRAMS rows; beyond that the
documents' n-grams are joined with it. Both give the same scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import discard, lean, long_rows, small_side, stored

ORDER = 5
#: What stands before a text, ORDER - 1 times.
PAD = "\n"
#: Distinct n-grams that are broadcast: 16 bytes each as arrays, about three times that with an index.
MAX_GRAMS = 4_000_000
#: Characters that are counted or scored at once, and n-grams that a task holds back to add them up: some
#: 40 bytes each, twice as many before they are added up, a few times that while they are.
CHUNK, HELD = 1 << 19, 3 << 17
#: Rows of n-grams that become Python strings together.
OUT_ROWS = 1 << 16
#: The share of trusted documents that each limit keeps, and what is added to the upper one, in nats per
#: character. From 100 documents on, no single one sets a limit.
QUANTILE, MARGIN = 0.99, 0.1
#: N-grams in a block that novelty is counted in, and the part of the trusted quantile that suffices.
BLOCK, SLACK = 256, 0.95
#: Scores are told apart down to this many nats for the quantile.
STEP = 0.001
#: Characters of average trusted text that every document's score is mixed with, so that a few odd
#: characters do not condemn a short one.
PRIOR = 100
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
TRUSTED, NATS, CHARS, NOVEL = "__trusted", "__nats", "__chars", "__novel"
DIGEST, USUAL, LIMIT, LEAST = "__digest", "__usual", "__limit", "__least"


def fold_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) & 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def window_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each window of ORDER characters."""
    return code_hashes(code_points(text))


def code_hashes(codes: np.ndarray) -> np.ndarray:
    """`window_hashes` of code points."""
    codes = codes.astype(np.uint64)
    n = len(codes) - ORDER + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(ORDER):
        out += codes[i : i + len(out)]
        out *= MULTIPLIER
        out ^= out >> np.uint64(31)
    return out


def gram_hashes(grams: list[str], langs: list[str]) -> np.ndarray:
    """`window_hashes` of n-grams one by one, told apart by language."""
    own = window_hashes("".join(grams))[::ORDER]
    marks = {lang: np.uint64(lang_hash(lang)) for lang in set(langs)}
    return own ^ np.fromiter((marks[lang] for lang in langs), np.uint64, len(langs))


def lang_hash(lang: str) -> int:
    return zlib.crc32(lang.encode()) * 0x9E3779B97F4A7C15 % 2**64


def segments(text: str) -> Iterator[str]:
    """A padded text in pieces of bounded length, each with the context of its first character."""
    text = PAD * (ORDER - 1) + text
    for start in range(0, len(text) - ORDER + 1, CHUNK):
        yield text[start : start + CHUNK + ORDER - 1]


def new_in_blocks(hashes: np.ndarray) -> int:
    """How many windows are the first of their kind in their block of BLOCK."""
    short = hashes.astype(np.uint32)
    whole = len(short) // BLOCK * BLOCK
    blocks = np.sort(short[:whole].reshape(-1, BLOCK), axis=1)
    repeated = np.count_nonzero(blocks[:, 1:] == blocks[:, :-1])
    rest = np.sort(short[whole:])
    return len(short) - repeated - np.count_nonzero(rest[1:] == rest[:-1])


def novelty(text: str | None) -> float | None:
    if not text:
        return None
    return mixed_novelty(sum(new_in_blocks(window_hashes(piece)) for piece in segments(text)), len(text))


def mixed_novelty(new: int, chars: int) -> float:
    """The share of new windows, mixed with PRIOR new ones."""
    return (new + PRIOR) / (chars + PRIOR)


def gram_counts(text: str) -> tuple[list[str], np.ndarray]:
    """Distinct windows of a piece of text and how often each stands there."""
    hashes = window_hashes(text)
    codes, distinct = pd.factorize(hashes)
    where = np.zeros(len(distinct), np.int64)
    where[codes] = np.arange(len(codes))
    return [text[i : i + ORDER] for i in where.tolist()], np.bincount(codes, minlength=len(distinct))


class Counts:
    """N-grams of a task as arrays: a hash of language and n-gram, the language's number, code points, and
    in how many places the n-gram stands in trusted texts of either fold."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, kind: tuple[str, int], texts: list[str]) -> None:
        """Padded texts or pieces of one kind: language, and fold or 2."""
        lang, role = kind
        hashes, codes, counts = _joint_counts(texts)
        both = np.zeros((len(hashes), 2), np.int64)
        if role < 2:
            both[:, role] = counts
        number = np.full(len(hashes), self.langs.setdefault(lang, len(self.langs)), np.int32)
        self.parts.append((hashes ^ np.uint64(lang_hash(lang)), number, codes, both))
        self.rows += len(hashes)

    def full(self) -> bool:
        """Whether HELD n-grams are there; they are added up whenever there are twice as many rows."""
        if self.rows < 2 * HELD:
            return False
        self.merge()
        return self.rows >= HELD

    def merge(self) -> None:
        """Add up the rows of each n-gram."""
        if len(self.parts) > 1:
            columns = [list(x) for x in zip(*self.parts)]
            self.parts = []
            keys = np.concatenate(columns.pop(0))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            own, keys = order[first], keys[first]
            both = np.add.reduceat(np.concatenate(columns.pop())[order], first)
            codes = np.concatenate(columns.pop())[own]
            self.parts = [(keys, np.concatenate(columns.pop())[own], codes, both)]
            self.rows = len(first)

    def out(self) -> Iterator[pd.DataFrame]:
        """All rows, which are forgotten."""
        self.merge()
        parts, self.parts, self.rows = self.parts, [], 0
        names = np.array(list(self.langs), object)
        for _, numbers, codes, both in parts:
            for low in range(0, len(numbers), OUT_ROWS):
                part = slice(low, low + OUT_ROWS)
                text = codes[part].tobytes().decode("utf-32-le")
                grams = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
                yield pd.DataFrame({"lang": names[numbers[part]], "gram": grams, "c0": both[part, 0], "c1": both[part, 1]})


@lean
def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows lang, gram, c0, c1: in how many places each n-gram stands in trusted texts of either fold;
    n-grams of other texts only, which will need a probability, have zeros."""
    held, pad = Counts(), PAD * (ORDER - 1)
    for batch in batches:
        waiting: dict[tuple[str, int], list[str]] = {}
        size: dict[tuple[str, int], int] = {}
        for text, lang, trusted in zip(batch["text"], batch["lang"], batch[TRUSTED]):
            if not text:
                continue
            kind = lang, fold_of(text) if trusted else 2
            if len(text) > CHUNK // 4:
                for piece in segments(text):
                    held.add(kind, [piece])
                    if held.full():
                        yield from held.out()
            else:
                waiting.setdefault(kind, []).append(pad + text)
                size[kind] = size.get(kind, 0) + len(text)
                if size[kind] >= CHUNK:
                    held.add(kind, waiting.pop(kind))
                    size[kind] = 0
        for kind, texts in waiting.items():
            held.add(kind, texts)
        if held.full():
            yield from held.out()
    yield from held.out()


def _joint_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and code points of the distinct windows of padded texts, and how often each stands there."""
    codes = code_points("".join(texts))
    hashes = code_hashes(codes)
    inside = np.ones(len(hashes), bool)
    at = 0
    for text in texts:  # the windows that end in the next text's padding
        at += len(text)
        inside[at - ORDER + 1 : at] = False
    starts = np.flatnonzero(inside)
    found, distinct = pd.factorize(hashes[starts])
    where = np.zeros(len(distinct), np.int64)
    where[found] = starts
    return distinct, codes[where[:, None] + np.arange(ORDER)], np.bincount(found, minlength=len(distinct))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that labels call good and never toxic; a document with differing labels is not trusted."""
    good = (F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)
    ids = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(good.alias(TRUSTED))
    return ids.where(TRUSTED).select(F.col("doc_id").alias("__id"), F.lit(True).alias(TRUSTED))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    ids = small_side(trusted_ids(labels))
    joined = docs.join(ids, docs["doc_id"] == ids["__id"], "left").drop("__id")
    return joined.withColumn(TRUSTED, F.coalesce(TRUSTED, F.lit(False)))


def _lang() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, c0, c1 over all documents (with a column TRUSTED)."""
    rows = docs.select("text", _lang().alias("lang"), TRUSTED)
    counted = rows.mapInPandas(_count, "lang string, gram string, c0 long, c1 long")
    return stored(counted.groupBy("lang", "gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "grams")


def _discounts(level: DataFrame) -> DataFrame:
    """The three discounts of both models per language, from how many n-grams stand once, twice, ..."""
    seen = [F.sum((F.col(f"c{f}") == i).cast("long")).alias(f"t{f}{i}") for f in (0, 1) for i in (1, 2, 3, 4)]
    out = []
    for f in (0, 1):
        t = {i: F.col(f"t{f}{i}") for i in (1, 2, 3, 4)}
        y = F.try_divide(t[1], t[1] + 2 * t[2])
        for i, plain in ((1, 0.5), (2, 1.0), (3, 1.5)):
            d = i - (i + 1) * y * F.try_divide(t[i + 1], t[i])
            # too few n-grams for the estimate
            ok = (t[1] > 0) & (t[i] > 0) & (t[i + 1] > 0) & (d > 0) & (d < i)
            out.append(F.when(ok, d).otherwise(F.lit(plain)).alias(f"d{f}{i}"))
    return level.groupBy("lang").agg(*seen).select("lang", *out)


def probabilities(grams: DataFrame) -> DataFrame:
    """lang, gram, p0, p1: the probability of an n-gram's last character after the ones before, under
    either fold's model, for all n-grams of the corpus; null where a model has no text of the language.

    Levels are joined from single characters up. All tables are sharded by language and n-gram, both
    models side by side.
    """
    levels = {ORDER: grams}
    for n in range(ORDER - 1, 0, -1):
        # how many different characters stand before it; zeros are kept, since they are asked for
        seen = [F.sum((F.col(f"c{f}") > 0).cast("long")).alias(f"c{f}") for f in (0, 1)]
        levels[n] = stored(levels[n + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(*seen), f"grams-{n}")
    alphabet = levels[1].groupBy("lang").agg((1 / F.count("*")).alias("p0"), (1 / F.count("*")).alias("p1"))
    told = alphabet.withColumn("gram", F.lit(""))
    for n in range(1, ORDER + 1):
        level = levels[n].join(F.broadcast(_discounts(levels[n])), "lang")
        held_back = {}
        for f in (0, 1):
            c = F.col(f"c{f}")
            rate = F.when(c == 1, F.col(f"d{f}1")).when(c == 2, F.col(f"d{f}2")).otherwise(F.col(f"d{f}3"))
            held_back[f] = F.when(c > 0, rate).otherwise(0.0)
        level = level.select(
            "lang",
            "gram",
            F.expr(f"substring(gram, 1, {n - 1})").alias("context"),
            F.expr("substring(gram, 2)").alias("shorter"),
            *[x for f in (0, 1) for x in (F.col(f"c{f}"), held_back[f].alias(f"d{f}"))],
        )
        sums = [F.sum(f"{x}{f}").alias(f"{x}{f}_all") for f in (0, 1) for x in "cd"]
        totals = level.groupBy("lang", "context").agg(*sums)
        before = told.select("lang", F.col("gram").alias("shorter"), F.col("p0").alias("b0"), F.col("p1").alias("b1"))
        if n == 1:  # a row per language
            joined = level.join(F.broadcast(totals), ["lang", "context"]).join(F.broadcast(before), ["lang", "shorter"])
        else:
            joined = level.join(totals, ["lang", "context"]).join(before, ["lang", "shorter"])
        ps = []
        for f in (0, 1):
            own = (F.col(f"c{f}") - F.col(f"d{f}") + F.col(f"d{f}_all") * F.col(f"b{f}")) / F.col(f"c{f}_all")
            backed_off = F.lit(None) if n == 1 else F.col(f"b{f}")  # no text of the language at all
            ps.append(F.when(F.col(f"c{f}_all") > 0, own).otherwise(backed_off).cast("double").alias(f"p{f}"))
        shorter, told = told, stored(joined.select("lang", "gram", *ps), f"probabilities-{n}")
        discard(levels[n], *([shorter] if n > 1 else []))
    return told


def _as_arrays(told: DataFrame) -> list[np.ndarray] | None:
    """Keys in their order and the logs of both folds, or None if there are too many rows."""
    if told.count() > MAX_GRAMS:
        return None

    @lean
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = gram_hashes(batch["gram"].tolist(), batch["lang"].tolist())
            logs = {f"l{f}": np.log(batch[f"p{f}"].to_numpy(np.float64)).astype(np.float32) for f in (0, 1)}
            yield pd.DataFrame({"key": keys.view(np.int64), **logs})

    table = told.mapInPandas(hashed, "key long, l0 float, l1 float").toArrow()
    keys, *logs = (table.column(c).to_numpy() for c in ("key", "l0", "l1"))
    order = np.argsort(keys)
    return [keys[order], *(x[order] for x in logs)]


class Scorer:
    """Mean negative log probability per character, by lookups in sorted keys, and novelty."""

    def __init__(self, arrays: list[np.ndarray]):
        self.index = pd.Index(arrays[0])
        # what is not found is at -1
        self.logs = [np.append(x, np.float32(np.nan)) for x in arrays[1:]]

    def scores(self, text: str | None, lang: str) -> tuple[float | None, float | None]:
        if not text:
            return None, None
        logs = self.logs[1 - fold_of(text)]
        mark, total, new = np.uint64(lang_hash(lang)), 0.0, 0
        for piece in segments(text):
            hashes = window_hashes(piece)
            new += new_in_blocks(hashes)
            keys = (hashes ^ mark).view(np.int64)
            total -= float(logs[self.index.get_indexer(keys)].sum(dtype=np.float64))
        return None if np.isnan(total) else total / len(text), mixed_novelty(new, len(text))


def _by_broadcast(docs: DataFrame, arrays: list[np.ndarray]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(arrays)

    @F.pandas_udf("nats double, novel double")
    @lean
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scorer = None
        for texts, langs in batches:
            scorer = scorer or Scorer(shared.value)
            found = [scorer.scores(t, g) for t, g in zip(texts, langs)]
            yield pd.DataFrame(found, columns=["nats", "novel"], dtype="float64")

    scored = docs.withColumn("__scores", scores("text", _lang()))
    return scored.withColumns({NATS: F.col("__scores.nats"), NOVEL: F.col("__scores.novel")}).drop("__scores")


def _by_join(docs: DataFrame, told: DataFrame) -> DataFrame:
    """The same scores where the table is too large to send: n-grams of each distinct text are joined
    with it. Copies of a text add to sums and counts alike, so their mean is the text's own."""

    @lean
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, lang, digest in zip(batch["text"], batch["lang"], batch[DIGEST]):
                for piece in segments(text):
                    grams, counts = gram_counts(piece)
                    yield pd.DataFrame({DIGEST: digest, "lang": lang, "fold": 1 - fold_of(text), "gram": grams, "n": counts})

    digest = F.md5(F.concat_ws("\0", _lang(), F.col("text")))
    texts = docs.where(F.length("text") > 0).select("text", _lang().alias("lang"), digest.alias(DIGEST))
    rows = texts.mapInPandas(explode, f"{DIGEST} string, lang string, fold int, gram string, n long")
    joined = rows.join(told, ["lang", "gram"])
    logp = F.log(F.when(F.col("fold") == 0, F.col("p0")).otherwise(F.col("p1")))
    mean = (-F.sum(F.col("n") * logp) / F.sum("n")).alias(NATS)
    scores = joined.groupBy(DIGEST).agg(mean)

    @F.pandas_udf("double")
    def novel(texts: pd.Series) -> pd.Series:
        return pd.Series([novelty(t) for t in texts], dtype="float64")

    return docs.withColumn(DIGEST, digest).join(scores, DIGEST, "left").drop(DIGEST).withColumn(NOVEL, novel("text"))


def mixed() -> Column:
    """The score that is judged: a document's nats, mixed with the usual ones of its language."""
    return (F.col(NATS) * F.col(CHARS) + F.col(USUAL) * PRIOR) / (F.col(CHARS) + PRIOR)


def limits(scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """__lang, USUAL, LIMIT, LEAST of every language with trusted documents: their nats per character,
    the smallest mixed score that `quantile` of them reach at most, plus a margin, and SLACK of the
    largest novelty that as many reach at least. A language has some thousand different steps at most,
    however many documents."""
    trusted = scored.where(F.col(TRUSTED)).select(_lang().alias("lang"), CHARS, NATS, NOVEL)
    # rows are left out of what is stored: a filter before it goes below the join, where all documents are scored for it
    trusted = stored(trusted, "trusted").where(F.col(NATS).isNotNull())
    usual = trusted.groupBy("lang").agg((F.sum(F.col(NATS) * F.col(CHARS)) / F.sum(CHARS)).alias(USUAL))
    both = trusted.join(small_side(usual), "lang")
    steps = both.groupBy("lang", F.ceil(mixed() / STEP).alias("step")).agg(F.count("*").alias("n"), F.max(USUAL).alias(USUAL))
    below = Window.partitionBy("lang").orderBy("step")
    total = F.sum("n").over(Window.partitionBy("lang"))
    ranked = steps.withColumn("upto", F.sum("n").over(below)).withColumn("total", total)
    reached = F.when(F.col("upto") >= F.col("total") * quantile, F.col("step"))
    found = ranked.groupBy("lang").agg(F.max(USUAL).alias(USUAL), (F.min(reached) * STEP + margin).alias(LIMIT))
    steps = trusted.groupBy("lang", F.floor(F.col(NOVEL) / STEP).alias("step")).agg(F.count("*").alias("n"))
    ranked = steps.withColumn("upto", F.sum("n").over(below)).withColumn("total", total)
    passed = F.when(F.col("upto") > F.col("total") * (1 - quantile), F.col("step"))
    least = ranked.groupBy("lang").agg((F.min(passed) * STEP * SLACK).alias(LEAST))
    return small_side(stored(found.join(least, "lang").withColumnRenamed("lang", "__lang"), "limits"))


def trained(marked: DataFrame, max_grams: int = MAX_GRAMS):
    """A function that adds NATS (null without text or model), NOVEL and CHARS to documents."""
    long_rows(marked.sparkSession)
    told = probabilities(count_grams(marked))
    arrays = _as_arrays(told) if max_grams else None
    if arrays:
        discard(told)

    def scores(docs: DataFrame) -> DataFrame:
        scored = _by_broadcast(docs, arrays) if arrays else _by_join(docs, told)
        return scored.withColumn(CHARS, F.coalesce(F.length("text"), F.lit(0)))

    return scores


def with_limits(scored: DataFrame, known: DataFrame) -> DataFrame:
    """USUAL, LIMIT and LEAST of each row's language added; null without trusted documents in it."""
    return scored.join(known, _lang() == F.col("__lang"), "left").drop("__lang")


def rejected() -> Column:
    """Documents without a text are rejected, those that no model can judge are not."""
    surprising = F.coalesce(mixed() > F.col(LIMIT), F.lit(False))
    return (F.col(CHARS) == 0) | surprising | F.coalesce(F.col(NOVEL) < F.col(LEAST), F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, max_grams: int = MAX_GRAMS) -> DataFrame:
    """A row per row of `docs` (doc_id, text, lang): doc_id, lang, nats (per character), perplexity,
    judged (mixed with PRIOR characters of the language's usual perplexity), max_judged, kept (within
    that limit, and not repeating itself more than trusted texts do).

    Null and empty texts have no perplexity and are not kept. A language without trusted documents in
    the other fold, or with a null name that is taken as "", has no model: kept, without perplexity.
    Repeated rows are trained on and judged one by one. An empty table gives an empty result; other
    columns are left out.
    """
    marked = flagged(docs.select("doc_id", "text", "lang"), labels)
    scored = trained(marked, max_grams)(marked)
    scored = stored(scored.select("doc_id", "lang", TRUSTED, NATS, CHARS, NOVEL), "scores")
    return with_limits(scored, limits(scored)).select(
        "doc_id",
        "lang",
        F.col(NATS).alias("nats"),
        F.exp(NATS).alias("perplexity"),
        F.exp(mixed()).alias("judged"),
        F.exp(LIMIT).alias("max_judged"),
        (~rejected()).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns. Trusted texts are scored twice,
    for the limits and for the decision, so that no text is shuffled or stored."""
    marked = flagged(docs, labels)
    scores = trained(marked)
    known = limits(scores(marked.where(F.col(TRUSTED))))
    return with_limits(scores(marked), known).where(~rejected()).drop(TRUSTED, NATS, CHARS, NOVEL, USUAL, LIMIT, LEAST)
