"""Hard negatives by exact inner products over cover trees.

Every candidate x gets one more component, sqrt(M^2 - |x|^2) for the largest norm M, so that all have
the same norm and an inner product with q is a distance: |q - x|^2 = |q|^2 + M^2 - 2 qx. A ball around
a node's centre that covers its rows then bounds their products from both sides.

The tree's first level are pivots from a bounded sample; rows are dealt out by pivot and distance from
it and cut into blocks of bounded size, each with a tree of its own: a node's rows are covered by
balls of half its radius (or by the FAN balls that cover best), and so on down to leaves. Anchors come
in blocks, too: a task holds one block of anchors and walks the trees it reads, best bound first. It
skips nodes that lie outside what an anchor still asks for and verifies leaves by integer products.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import discard, stored
from flowloom.session import scratch_path

POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative's lies.
WINDOW = (30, 90)
#: Components are floor(SCALE * x), held to +-LIMIT so that products fit into a long.
SCALE, LIMIT = 256, 1 << 25
#: Rows the pivots are chosen from, and how many pivots.
SAMPLE, PIVOTS = 4096, 32
#: Rows of a block, rows of a leaf, children of a node.
BLOCK, LEAF, FAN = 8192, 64, 64
#: Anchors that a task holds at once.
ANCHORS = 4096
NULL_ID = np.iinfo(np.int64).min
#: Distances are a square root of differences, so they are right to this share of the norms.
SLACK = 1e-7

ROWS = "vec_id long, label int, vec array<int>"
TREE = "cell int, near double, far double, ids binary, labels binary, vecs binary, nodes binary"
FOUND = "slot long, score long, vec_id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label and whole-number vec of the rows that take part; equal rows once.

    Rows with a null label, a null vector or a component that is null or not finite take no part.
    """
    x = lambda v: F.least(F.greatest(F.floor(v.cast("double") * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    fine = lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.transform("embedding", x).alias("vec"))
    return rows.distinct()


# -- building ------------------------------------------------------------------------------------


def _matrix(vecs: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros."""
    lengths = np.diff(vecs.offsets.to_numpy())
    values = vecs.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return values.reshape(len(vecs), dim).astype(np.int32)
    out = np.zeros((len(vecs), dim), np.int32)
    out[np.repeat(np.arange(len(vecs)), lengths), np.concatenate([np.arange(n) for n in lengths] or [[]]).astype(int)] = values
    return out


def _norms(rows: np.ndarray) -> np.ndarray:
    return (rows.astype(np.float64) ** 2).sum(1)


def augmented(rows: np.ndarray, top: float) -> np.ndarray:
    """One more component, so that every squared norm is `top`."""
    return np.column_stack([rows.astype(np.float64), np.sqrt(np.maximum(top - _norms(rows), 0))])


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(1))


def farthest_first(points: np.ndarray, count: int, within: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Centres, starting with row 0, until all rows are `within` or there are `count`; each row's centre."""
    centres, owner = [0], np.zeros(len(points), np.int64)
    nearest = _distances(points, points[0])
    while len(centres) < count and nearest.max() > within:
        centres.append(int(nearest.argmax()))
        far = _distances(points, points[centres[-1]])
        closer = far < nearest
        owner[closer] = len(centres) - 1
        nearest = np.minimum(nearest, far)
    return np.array(centres), owner


#: Columns of a tree's nodes: the centre's row, the range of rows, the covering radius, the children.
CENTRE, LOW, HIGH, RADIUS, FIRST, COUNT = range(6)


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the nodes over it: a node's rows and its children stand together."""
    order = np.arange(len(points))
    nodes = [[0, 0, len(points), 0.0, 0, 0]]
    for node in nodes:
        low, high = node[LOW], node[HIGH]
        rows = order[low:high]
        rows[:] = np.concatenate([[node[CENTRE]], rows[rows != node[CENTRE]]])
        inside = points[rows]
        node[RADIUS] = float(_distances(inside, inside[0]).max())
        if high - low <= leaf or node[RADIUS] == 0:
            continue
        centres, owner = farthest_first(inside, FAN, node[RADIUS] / 2)
        node[FIRST], node[COUNT] = len(nodes), len(centres)
        centres = rows[centres]
        rows[:] = rows[np.argsort(owner, kind="stable")]
        ends = low + np.cumsum(np.bincount(owner, minlength=len(centres)))
        nodes += [[int(c), int(a), int(b), 0.0, 0, 0] for c, a, b in zip(centres, [low, *ends[:-1]], ends)]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    table = np.array(nodes, np.float64)
    table[:, CENTRE] = place[table[:, CENTRE].astype(np.int64)]
    return order, table


def _near_pivot(pivots, dim: int, top: float):
    def assign(batches):
        points = augmented(pivots.value, top)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = augmented(_matrix(batch.column("vec"), dim), top)
            apart = np.stack([_distances(rows, p) for p in points], 1)
            cell = apart.argmin(1)
            extra = [pa.array(cell.astype(np.int32)), pa.array(apart[np.arange(len(rows)), cell])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "cell", "apart"])

    return assign


def _planter(dim: int, top: float, block: int, leaf: int):
    def plant(batches):
        """A tree for every run of at most `block` rows of one cell in the partition's order."""
        held: list[pa.RecordBatch] = []

        def tree():
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            vecs = _matrix(rows["vec"].combine_chunks(), dim)
            order, nodes = build(augmented(vecs, top), leaf)
            ids = rows["vec_id"].fill_null(NULL_ID).to_numpy()[order]
            apart = rows["apart"].to_numpy()
            out = (rows["cell"][0].as_py(), apart.min(), apart.max(), ids.tobytes(), rows["label"].to_numpy()[order].tobytes(), vecs[order].tobytes(), nodes.tobytes())
            names = [x.split()[0] for x in TREE.split(", ")]
            types = [pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types)], names=names)

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for low, high in zip(cuts, cuts[1:]):
                while low < high:
                    if held and held[0].column("cell")[0].as_py() != cells[low]:
                        yield tree()
                    room = block - sum(b.num_rows for b in held)
                    held.append(batch.slice(low, min(room, high - low)))
                    low += held[-1].num_rows
                    if held[-1].num_rows == room:
                        yield tree()
        if held:
            yield tree()

    return plant


class Forest(NamedTuple):
    trees: DataFrame  # stored, a row per block
    pivots: np.ndarray
    dim: int
    top: float  # the largest squared norm


def plant(rows: DataFrame, block: int = BLOCK, leaf: int = LEAF, pivots: int = PIVOTS) -> Forest | None:
    """Trees over `prepared` rows, None if there are none. The driver gets SAMPLE rows."""
    spark = rows.sparkSession
    square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    size = rows.agg(F.max(F.size("vec")).alias("dim"), F.max(square).alias("top")).first()
    if size.dim is None:
        return None
    dim, top = max(size.dim, 1), size.top
    sample = rows.orderBy(F.xxhash64("vec"), "vec_id").limit(SAMPLE).select("vec").toArrow()
    sample = _matrix(sample["vec"].combine_chunks(), dim)
    centres, _ = farthest_first(augmented(sample, top), pivots)
    shared = spark.sparkContext.broadcast(sample[centres])
    near = rows.mapInArrow(_near_pivot(shared, dim, top), f"{ROWS}, cell int, apart double")
    dealt = near.repartitionByRange("cell", "apart", "vec_id").sortWithinPartitions("cell", "apart", "vec_id", "label", "vec")
    trees = stored(dealt.mapInArrow(_planter(dim, top, block, leaf), TREE), "cover-trees")
    return Forest(trees, sample[centres], dim, top)


# -- searching -----------------------------------------------------------------------------------


class Asked(NamedTuple):
    """A block of anchors and what is searched for them: slots, in the order of their anchors."""

    ids: np.ndarray
    labels: np.ndarray
    vecs: np.ndarray
    slots: np.ndarray  # the anchor of each slot
    low: np.ndarray  # scores a slot takes, both included
    high: np.ndarray
    keep: int
    same_label: bool


class Best:
    """The best `keep` rows of every slot so far, and the score that a row needs to be one."""

    def __init__(self, asked: Asked):
        self.keep = asked.keep
        self.scores = np.full((len(asked.slots), asked.keep), np.iinfo(np.int64).min)
        self.ids = np.zeros_like(self.scores)
        self.count = np.zeros(len(asked.slots), np.int64)
        self.need = asked.low.copy()

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        moved = np.unique(slots)
        old = np.arange(self.keep) < self.count[moved][:, None]
        slots = np.concatenate([slots, np.repeat(moved, self.count[moved])])
        scores = np.concatenate([scores, self.scores[moved][old]])
        ids = np.concatenate([ids, self.ids[moved][old]])
        order = np.lexsort((ids, -scores, slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        rank = np.arange(len(slots)) - np.searchsorted(slots, slots)
        first = rank < self.keep
        slots, scores, ids, rank = slots[first], scores[first], ids[first], rank[first]
        self.scores[slots, rank], self.ids[slots, rank] = scores, ids
        self.count[moved] = np.bincount(slots, minlength=len(self.count))[moved]
        full = moved[self.count[moved] == self.keep]
        self.need[full] = np.maximum(self.need[full], self.scores[full, -1])


class Search:
    """One block of anchors against one tree after the other."""

    def __init__(self, asked: Asked, pivots: np.ndarray, top: float):
        self.asked, self.best, self.top = asked, Best(asked), top
        self.norms = _norms(asked.vecs)
        self.slack = SLACK * np.sqrt(self.norms + top)
        self.with_slots = np.unique(asked.slots)
        self.high = np.zeros(len(asked.ids), np.int64)
        np.maximum.at(self.high, asked.slots, asked.high)
        self.apart = np.sqrt(np.maximum(self.norms[:, None] + top - 2 * self.products(asked.vecs, pivots), 0))

    def products(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Exact: in floating point where sums stay whole numbers, else in integers."""
        most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(left.shape[1], 1)
        kind = np.float64 if most < 2**53 else np.int64
        return left.astype(kind) @ right.astype(kind).T

    def bounds(self, anchors: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most product with rows between these distances."""
        fixed = (self.norms[anchors] + self.top)[:, None]
        slack = self.slack[anchors][:, None]
        give = 1 + 1e-9 * fixed
        return (fixed - (farthest + slack) ** 2) / 2 - give, (fixed - np.maximum(nearest - slack, 0) ** 2) / 2 + give

    def needs(self) -> np.ndarray:
        need = np.full(len(self.asked.ids), np.iinfo(np.int64).max)
        np.minimum.at(need, self.asked.slots, self.best.need)
        return need

    def walk(self, cell: int, near: float, far: float, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, nodes: np.ndarray) -> int:
        """Take in a tree; returns the number of products with rows."""
        anchors, verified = self.with_slots, 0
        apart = self.apart[anchors, cell][:, None]
        low, up = self.bounds(anchors, np.maximum(np.maximum(apart - far, near - apart), 0), apart + far)
        fits = (up[:, 0] >= self.needs()[anchors]) & (low[:, 0] <= self.high[anchors])
        heap = [(-np.inf, 0, anchors[fits], up[fits, 0])] if fits.any() else []
        while heap:
            _, at, anchors, up = heapq.heappop(heap)
            need = self.needs()
            anchors = anchors[up >= need[anchors]]
            if not len(anchors):
                continue
            node = nodes[at]
            if not node[COUNT]:
                rows = slice(int(node[LOW]), int(node[HIGH]))
                verified += len(anchors) * (rows.stop - rows.start)
                self.verify(anchors, ids[rows], labels[rows], vecs[rows])
                continue
            first = int(node[FIRST])
            children = nodes[first : first + int(node[COUNT])]
            centres = vecs[children[:, CENTRE].astype(np.int64)]
            square = (self.norms[anchors] + self.top)[:, None] - 2 * self.products(self.asked.vecs[anchors], centres)
            apart, radius = np.sqrt(np.maximum(square, 0)), children[:, RADIUS] + SLACK * np.sqrt(self.top)
            low, up = self.bounds(anchors, np.maximum(apart - radius, 0), apart + radius)
            fits = (up >= need[anchors][:, None]) & (low <= self.high[anchors][:, None])
            for i in np.flatnonzero(fits.any(0)):
                mine = fits[:, i]
                heapq.heappush(heap, (-up[mine, i].max(), first + int(i), anchors[mine], up[mine, i]))
        return verified

    def verify(self, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> None:
        asked = self.asked
        place = np.full(len(asked.ids), -1)
        place[anchors] = np.arange(len(anchors))
        slots = np.flatnonzero(place[asked.slots] >= 0)
        owner = asked.slots[slots]
        scores = self.products(asked.vecs[anchors], vecs).astype(np.int64)[place[owner]]
        fits = (scores >= self.best.need[slots][:, None]) & (scores <= asked.high[slots][:, None])
        same = asked.labels[owner][:, None] == labels
        if asked.same_label:
            norms = self.norms[owner][:, None]
            itself = (asked.ids[owner][:, None] == ids) & same & (scores == norms) & (_norms(vecs) == norms)
            fits &= same & ~itself
        else:
            fits &= ~same
        slot, row = np.nonzero(fits)
        if len(slot):
            self.best.add(slots[slot], scores[slot, row], ids[row])


def _searcher(asked, pivots: np.ndarray, dim: int, top: float):
    def search(batches):
        run = Search(asked.value, pivots, top)
        for batch in batches:
            for tree in batch.to_pylist():
                read = lambda name, kind: np.frombuffer(tree[name], kind)  # noqa: B023, E731
                vecs = read("vecs", np.int32).reshape(-1, dim)
                nodes = read("nodes", np.float64).reshape(-1, 6)
                run.walk(tree["cell"], tree["near"], tree["far"], read("ids", np.int64), read("labels", np.int32), vecs, nodes)
        best = run.best
        slot, rank = np.nonzero(np.arange(best.keep) < best.count[:, None])
        ids = best.ids[slot, rank]
        columns = [pa.array(slot.astype(np.int64)), pa.array(best.scores[slot, rank]), pa.array(ids, mask=ids == NULL_ID)]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "score", "vec_id"])

    return search


def search(forest: Forest, asked: Asked) -> DataFrame:
    """slot, score, vec_id, rank: the first `keep` rows of each slot over all trees."""
    shared = forest.trees.sparkSession.sparkContext.broadcast(asked)
    found = forest.trees.mapInArrow(_searcher(shared, forest.pivots, forest.dim, forest.top), FOUND)
    by = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= asked.keep)


def mine(vectors: DataFrame, every: int = 100, block: int = BLOCK, anchors: int = ANCHORS, leaf: int = LEAF) -> DataFrame:
    """RESULT: hard negatives of `vectors` (vec_id, embedding, label) for anchors and their positives.

    Anchors are the rows whose vec_id is divisible by `every`. Scores are exact inner products of
    floor(256 x); an anchor's positives are the first other rows of its label, a positive's negatives the
    first rows of other labels with a score within WINDOW of the positive's.

    What takes no part: see `prepared`. Equal rows count once; rows that share an id only are rows of
    their own. Null ids are never anchors and stand first among ties. Shorter vectors end in zeros,
    components beyond +-LIMIT count as that. Anchors without positives, and positives without
    negatives, have no rows; an empty table gives an empty result. Other columns are left out.

    The driver and each task hold one block of about `anchors` anchors at a time.
    """
    spark = vectors.sparkSession
    rows = stored(prepared(vectors), "vectors")
    forest = plant(rows, block, leaf)
    path = scratch_path(spark, "hard-negatives")
    of = rows.where(F.col("vec_id") % every == 0)
    blocks = -(-of.count() // anchors) if forest else 0
    spark.createDataFrame([], RESULT).write.parquet(path)
    for i in range(blocks):
        part = of.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id", "label", "vec").toArrow()
        if not part.num_rows:
            continue
        ids, labels = part["vec_id"].to_numpy(), part["label"].to_numpy()
        vecs = _matrix(part["vec"].combine_chunks(), forest.dim)
        every_score = np.full(len(ids), np.iinfo(np.int64).max)
        first = Asked(ids, labels, vecs, np.arange(len(ids)), -every_score, every_score, POSITIVES, True)
        positives = search(forest, first).orderBy("slot", "rank").toArrow()
        slot, score = positives["slot"].to_numpy(), positives["score"].to_numpy()
        ends = [(-(-WINDOW[0] * s // 100), WINDOW[1] * s // 100) for s in score.tolist()]
        low, high = np.array(ends, np.int64).reshape(-1, 2).T
        found = search(forest, Asked(ids, labels, vecs, slot, low, high, NEGATIVES, False))
        owner = pa.table({"slot": np.arange(len(slot)), "anchor_id": ids[slot], "positive_id": positives["vec_id"], "positive_score": score})
        owner = F.broadcast(spark.createDataFrame(owner))  # POSITIVES rows for each anchor of the block
        out = found.join(owner, "slot").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        out.write.mode("append").parquet(path)
    discard(rows, *([forest.trees] if forest else []))
    return spark.read.schema(RESULT).parquet(path)
