"""Running totals over ordered groups of any size.

`sum(x) over (partition by key order by seq)` sorts a whole key in one task. When one key holds a
third of the data that task never ends. Here each key is cut into blocks of its order column; the
windows run inside (key, block), and a small table with one row per (key, block) carries the totals
of the blocks before. Blocks are cut by value, so a recomputed task sees the same blocks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 20


class Measure(NamedTuple):
    kind: str  # sum, max or min
    value: Column
    inclusive: bool = True  # False leaves the current row out


_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(kind: str, left: Column, right: Column) -> Column:
    if kind == "sum":
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return F.greatest(left, right) if kind == "max" else F.least(left, right)


def id_block(seq: Column, bits: int = BLOCK_BITS) -> Column:
    """Block of a unique integer: at most 2**bits rows, whatever the data looks like."""
    return F.shiftright(seq, bits)


def _before(keys, order, inclusive):
    end = Window.currentRow if inclusive else -1
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)


def _carry(totals: DataFrame, keys: list[str], block: str, kinds: dict, levels: int) -> DataFrame:
    """Totals of the blocks before each block."""

    def running_blocks(frame, group, column):
        w = _before(group, [column], False)
        return [_FOLD[kind](name).over(w).alias(f"_c_{name}") for name, kind in kinds.items()]

    if levels == 1:
        return totals.select(*keys, block, *running_blocks(totals, keys, block))
    totals = totals.withColumn("_super", F.shiftright(block, BLOCK_BITS))
    folds = [_FOLD[kind](name).alias(name) for name, kind in kinds.items()]
    top = _carry(totals.groupBy(*keys, "_super").agg(*folds), keys, "_super", kinds, levels - 1)
    top = top.select(*keys, "_super", *[F.col(f"_c_{n}").alias(f"_t_{n}") for n in kinds])
    inner = totals.select(
        *keys, block, "_super", *running_blocks(totals, [*keys, "_super"], block)
    ).join(top, [*keys, "_super"], "left")
    merged = [_merge(k, F.col(f"_t_{n}"), F.col(f"_c_{n}")).alias(f"_c_{n}") for n, k in kinds.items()]
    return inner.select(*keys, block, *merged)


def running(
    df: DataFrame,
    keys: list[str],
    block: str,
    order: list,
    measures: dict[str, Measure],
    levels: int = 1,
) -> DataFrame:
    """`df` with one running column per measure, over (keys ordered by block, then order).

    `block` must not decrease along the order. Keys must not be null. `levels=2` splits the block
    table too, for orders whose blocks alone outgrow a task (ids far sparser than 2**20 per block).
    """
    kinds = {name: m.kind for name, m in measures.items()}
    folds = [_FOLD[m.kind](m.value).alias(name) for name, m in measures.items()]
    totals = df.groupBy(*keys, block).agg(*folds)
    carry = _carry(totals, keys, block, kinds, levels)
    joined = df.join(carry, [*keys, block], "left")
    group = [*keys, block]
    out = [F.col(c) for c in df.columns]
    for name, m in measures.items():
        local = _FOLD[m.kind](m.value).over(_before(group, order, m.inclusive))
        out.append(_merge(m.kind, F.col(f"_c_{name}"), local).alias(name))
    return joined.select(*out)


class Opener(NamedTuple):
    """A session boundary: a row opens one if its time is later than all before it plus its `gap`."""

    gap: int | Column  # not negative
    mark: Column  # what later rows of the session carry
    inclusive: bool = True  # False leaves the current row out


def _last(column: Column, window) -> Column:
    return F.last(column, ignorenulls=True).over(window)


def _session_carry(blocks: DataFrame, keys: list[str], block: str, openers: dict, kinds: dict, levels: int) -> DataFrame:
    """What each block finds before it: the latest time, the opener in force, and the folded measures.

    A block knows its latest time and its last own opener (one that opens if nothing came before), with
    the time it must be later than, its own minus its gap. That opener stands if the latest time before
    the block is below; if it does not, no earlier one of the block does, as theirs are lower. So two
    windows over the block table decide everything. With more levels the block table is cut into blocks
    itself, which fold in the same way.
    """

    def inside(frame, group, column):
        w = _before(group, [column], False)
        frame = frame.withColumn("_c_us", F.max("_us").over(w))
        stands = {f"_s_{n}": F.when(F.col("_c_us").isNull() | (F.col(f"{n}.over") > F.col("_c_us")), F.col(n)) for n in openers}
        frame = frame.withColumns(stands)
        carried = {f"_c_{n}": _last(F.col(f"_s_{n}"), w) for n in openers}
        return frame.withColumns(carried | {f"_c_{n}": _FOLD[kind](n).over(w) for n, kind in kinds.items()})

    names = ["_c_us", *[f"_c_{n}" for n in (*openers, *kinds)]]
    if levels == 1:
        return inside(blocks, keys, block).select(*keys, block, *names)
    wider = f"{block}_"
    blocks = inside(blocks.withColumn(wider, F.shiftright(block, BLOCK_BITS)), [*keys, wider], block)
    tops = blocks.groupBy(*keys, wider).agg(
        F.max("_us").alias("_us"),
        *[F.max_by(f"_s_{n}", F.when(F.col(f"_s_{n}").isNotNull(), F.col(block))).alias(n) for n in openers],
        *[_FOLD[kind](n).alias(n) for n, kind in kinds.items()],
    )
    above = _session_carry(tops, keys, wider, openers, kinds, levels - 1)
    above = above.select(*keys, wider, *[F.col(c).alias(f"_t{c}") for c in names])
    joined = blocks.join(above, [*keys, wider], "left")
    before = _before([*keys, wider], [block], False)
    out = [_merge("max", F.col("_t_c_us"), F.col("_c_us")).alias("_c_us")]
    for n in openers:
        still = F.when(F.col("_t_c_us").isNull() | (F.col(f"_s_{n}.over") > F.col("_t_c_us")), F.col(f"_s_{n}"))
        out.append(F.coalesce(_last(still, before), F.col(f"_t_c_{n}")).alias(f"_c_{n}"))
    out += [_merge(kind, F.col(f"_t_c_{n}"), F.col(f"_c_{n}")).alias(f"_c_{n}") for n, kind in kinds.items()]
    return joined.select(*keys, block, *out)


def running_sessions(
    df: DataFrame,
    keys: list[str],
    block: str,
    order: list,
    us: Column,
    openers: dict[str, Opener],
    measures: dict[str, Measure] | None = None,
    levels: int = 1,
) -> DataFrame:
    """`df` with the opener's mark in force per name in `openers`, and one column per measure.

    Rows are ordered by block, then `order`, inside `keys`; `us` is their time, which need not rise. The
    input is read twice, whatever is asked: once for a row per (key, block), once to assign. Boundaries
    and measures of a block need one window each, over one sort.
    """
    measures = measures or {}
    group = [*keys, block]
    before, upto = _before(group, order, False), _before(group, order, True)
    rows = df.withColumn("_us_", us)
    rows = rows.withColumn("_seen_", F.max("_us_").over(before))
    for n, o in openers.items():
        over = F.col("_us_") - o.gap
        own = F.struct(over.alias("over"), o.mark.alias("mark"))
        rows = rows.withColumn(f"_o_{n}", F.when(F.col("_seen_").isNull() | (over > F.col("_seen_")), own))
    kinds = {n: m.kind for n, m in measures.items()}
    blocks = rows.groupBy(*group).agg(
        F.max("_us_").alias("_us"),
        *[F.max(f"_o_{n}").alias(n) for n in openers],  # those of a block rise
        *[_FOLD[m.kind](m.value).alias(n) for n, m in measures.items()],
    )
    joined = rows.join(_session_carry(blocks, keys, block, openers, kinds, levels), group, "left")
    stands = {f"_o_{n}": F.when(F.col("_c_us").isNull() | (F.col(f"_o_{n}.over") > F.col("_c_us")), F.col(f"_o_{n}")) for n in openers}
    joined = joined.withColumns(stands)
    out = [F.col(c) for c in df.columns]
    for n, o in openers.items():
        out.append(F.coalesce(_last(F.col(f"_o_{n}"), upto if o.inclusive else before), F.col(f"_c_{n}"))["mark"].alias(n))
    for n, m in measures.items():
        local = _FOLD[m.kind](m.value).over(upto if m.inclusive else before)
        out.append(_merge(m.kind, F.col(f"_c_{n}"), local).alias(n))
    return joined.select(*out)


def beside(*rows: DataFrame) -> DataFrame:
    """One-row tables with different columns as a single row, without a join."""
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def smallest_by_hash(
    df: DataFrame, group: list[str], key: Column, seed: int, cap: Column
) -> DataFrame:
    """The `cap` rows of each group with the smallest hash of (key, seed): a fixed random sample.

    A histogram of the first four hash digits (at most 65,536 rows per group) shows in which slice
    the cap is reached. Slices before it stay whole, later ones go, and only that one is ranked, so
    no group is sorted in one task. `cap` may use the group's row count `_size`.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))))
    hashed = hashed.withColumn("_slice", F.substring("_h", 1, 4))
    slices = hashed.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    all_of = Window.partitionBy(*group)
    slices = slices.withColumn("_size", F.sum("_n").over(all_of))
    slices = slices.withColumn(
        "_ahead", F.coalesce(F.sum("_n").over(_before(group, ["_slice"], False)), F.lit(0))
    )
    slices = slices.withColumn("_cap", cap).filter("_ahead < _cap")
    whole = F.col("_ahead") + F.col("_n") <= F.col("_cap")
    slices = slices.select(*group, "_slice", "_ahead", "_cap", whole.alias("_whole"))
    near = hashed.join(slices, [*group, "_slice"])
    rank = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy("_h", key))
    ranked = near.withColumn("_rank", rank)
    return ranked.filter(F.col("_whole") | (F.col("_rank") + F.col("_ahead") <= F.col("_cap"))).select(
        *df.columns
    )
