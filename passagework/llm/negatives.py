"""Hard negatives of labelled vectors, searched exactly in a tree of split points.

A node of the tree has up to sixteen split points, and a row goes to the
nearest: a multiway cut by hyperplanes. Every split point keeps the range of its
distances to the rows below each of its siblings. A question is a window of
scores, which is an annulus around the anchor, wider by the range of norms
below a sibling; a sibling whose range, seen from any split point, does not
meet the annulus is left out with all that is below it. What remains is
multiplied exactly.

The tree is fitted on a bounded sample of rows, so it is small; every row is
indexed and the ranges are those of all rows. Rows are stored by leaf. A leaf
with many rows, as of copies of one vector, is cut over tasks.

Anchors are asked in blocks of bounded size, each in two passes: the nearest
rows of the own label, then a window below the score of each.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.llm.common import forget
from passagework.session import scratch_path

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80

SAMPLE_ROWS = 8192  # the bound on what the tree is fitted on
SPLIT_POINTS = 16
LEAF_ROWS = 64  # of the sample
CHUNK_ROWS = 1 << 16  # rows of a leaf that are multiplied at once
TASK_ROWS = 1 << 18
BLOCK_CELLS = 1 << 20  # components of the anchors of a block
MATRIX_CELLS = 1 << 21  # scores in memory at once
NO_ID = (1 << 63) - 1  # a missing id comes last among ties

HITS = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


# vectors


def vectors(batch: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers; shorter vectors count as ending in zeros."""
    lengths = np.asarray(batch.value_lengths().fill_null(0), np.int64)
    made = np.zeros((len(batch), dim), np.int64)
    made[np.arange(dim) < lengths[:, None]] = np.asarray(batch.flatten(), np.int64)
    return made


def norms(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows, dtype=np.float64)


def exact_type(largest_norm: float) -> type:
    """A float type in which every inner product, and every sum on the way to it, is exact."""
    if largest_norm < 1 << 24:
        return np.float32
    if largest_norm < 1 << 53:
        return np.float64
    raise ValueError("components are too large for exact inner products")


def shipped(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that a worker reads with ``pickle.loads``, without this package installed."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


# the tree


@dataclass
class Tree:
    """Split points by node, and what is below each: a node, or a leaf as its complement."""

    dim: int
    points: list[np.ndarray] = field(default_factory=list)
    below: list[list[int]] = field(default_factory=list)
    leaf_parent: list[tuple[int, int]] = field(default_factory=list)
    node_parent: list[tuple[int, int] | None] = field(default_factory=list)

    def distances(self, node: int, rows: np.ndarray) -> np.ndarray:
        """Squared, and exact while they are below 2^53."""
        points = self.points[node].astype(np.float64)
        return norms(rows)[:, None] + norms(points) - 2 * (rows.astype(np.float64) @ points.T)

    def path(self, leaf: int) -> list[tuple[int, int]]:
        found, at = [], self.leaf_parent[leaf]
        while at is not None:
            found.append(at)
            at = self.node_parent[at[0]]
        return found[::-1]

    def visit(self, rows: np.ndarray, seen: Callable | None = None) -> np.ndarray:
        """The leaf of every row. ``seen(node, child, distances, members)`` is told of each step."""
        leaves = np.zeros(len(rows), np.int32)
        waiting = [(0, np.arange(len(rows)))] if len(rows) else []
        while waiting:
            node, members = waiting.pop()
            away = self.distances(node, rows[members])
            nearest = away.argmin(axis=1)
            for child, below in enumerate(self.below[node]):
                mine = nearest == child
                if not mine.any():
                    continue
                if seen:
                    seen(node, child, away[mine], members[mine])
                if below < 0:
                    leaves[members[mine]] = ~below
                else:
                    waiting.append((below, members[mine]))
        return leaves


def far_apart(rows: np.ndarray, count: int) -> np.ndarray:
    """Some of the first rows, each as far from those before as there is; no two are equal."""
    rows = np.unique(rows[: 3 * count], axis=0).astype(np.float64)
    chosen = [int(norms(rows).argmax())]
    away = norms(rows - rows[chosen[0]])
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, norms(rows - rows[chosen[-1]]))
    return rows[chosen].astype(np.int64)


def fit(sample: np.ndarray, split_points: int = SPLIT_POINTS, leaf_rows: int = LEAF_ROWS) -> Tree:
    tree = Tree(sample.shape[1])

    def grow(rows: np.ndarray, parent: tuple[int, int] | None) -> int:
        node = len(tree.points)
        tree.points.append(far_apart(rows, split_points) if len(rows) else np.zeros((1, tree.dim), np.int64))
        tree.below.append([])
        tree.node_parent.append(parent)
        nearest = tree.distances(node, rows).argmin(axis=1)
        for child in range(len(tree.points[node])):
            mine = rows[nearest == child]
            if len(mine) > leaf_rows and len(mine) < len(rows) and (mine != mine[0]).any():
                tree.below[node].append(grow(mine, (node, child)))
            else:
                tree.leaf_parent.append((node, child))
                tree.below[node].append(~(len(tree.leaf_parent) - 1))
        return node

    grow(sample, None)
    return tree


@dataclass
class Ranges:
    """By node: the least and largest squared distance from split point i to the rows below child j, and their norms."""

    least: list[np.ndarray]
    most: list[np.ndarray]
    norm_least: list[np.ndarray]
    norm_most: list[np.ndarray]


RANGE = "node int, child int, point int, least double, most double, norm_least double, norm_most double"


def ranges(stored: DataFrame, tree: Tree) -> Ranges:
    """Of all rows, added up in the tasks; as many numbers as the tree has pairs of siblings."""
    dim, packed = tree.dim, shipped(stored.sparkSession, tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        mine, found = pickle.loads(packed.value), {}

        def seen(node: int, child: int, away: np.ndarray, members: np.ndarray) -> None:
            size = own_norms[members]
            now = np.vstack([away.min(axis=0), away.max(axis=0), np.full(away.shape[1], size.min()), np.full(away.shape[1], size.max())])
            if (node, child) in found:
                old = found[node, child]
                now[::2], now[1::2] = np.minimum(now[::2], old[::2]), np.maximum(now[1::2], old[1::2])
            found[node, child] = now

        for batch in batches:
            rows = unpacked(batch.column(0), dim)
            own_norms = norms(rows)
            mine.visit(rows, seen)
        for (node, child), now in found.items():
            points = now.shape[1]
            columns = [np.full(points, node, np.int32), np.full(points, child, np.int32), np.arange(points, dtype=np.int32), *now]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in RANGE.split(", ")])

    made = stored.select("vector").mapInArrow(run, RANGE).groupBy("node", "child", "point")
    made = made.agg(F.min("least"), F.max("most"), F.min("norm_least"), F.max("norm_most"))
    shape = [(len(p), len(p)) for p in tree.points]
    result = Ranges(
        [np.full(s, np.inf) for s in shape],
        [np.full(s, -np.inf) for s in shape],
        [np.full(s[0], np.inf) for s in shape],
        [np.full(s[0], -np.inf) for s in shape],
    )
    for node, child, point, least, most, norm_least, norm_most in made.collect():
        result.least[node][point, child], result.most[node][point, child] = least, most
        result.norm_least[node][child], result.norm_most[node][child] = norm_least, norm_most
    packed.destroy()
    return result


# the index


def packed_rows(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows.astype("<i8"))
    small = np.ascontiguousarray(rows.astype("<i2"))
    if (small == raw).all():
        raw = small
    width = raw.shape[1] * raw.itemsize
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def unpacked(batch: pa.Array, dim: int) -> np.ndarray:
    """As they were packed: two bytes a component where all of a batch fit, else eight."""
    found = np.zeros((len(batch), dim), np.int64)
    cells = batch.to_pylist()
    wide = np.array([len(c) == 8 * dim for c in cells], bool)
    for kind, mine in (("<i8", wide), ("<i2", ~wide)):
        at = np.flatnonzero(mine)
        if len(at) and dim:
            found[at] = np.frombuffer(b"".join(cells[i] for i in at), kind).reshape(-1, dim)
    return found


@dataclass
class Index:
    rows: DataFrame  # leaf, cut, id, label, vector; a leaf and a cut of it are in one task, one after the other
    tree: Tree
    ranges: Ranges
    sample: tuple[np.ndarray, np.ndarray]  # labels, vectors
    kind: type


def index(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Index:
    """``rows`` are ``id, label, vector`` without nulls, ``vector`` an array of whole numbers."""
    spark = rows.sparkSession
    numbered = rows.withColumn("number", F.monotonically_increasing_id())
    dim = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    least = numbered.orderBy(F.xxhash64("id", "vector", "number")).limit(sample_rows).toArrow()
    sample = vectors(least.column("vector").combine_chunks(), dim)
    labels = np.asarray(least.column("label"), np.int64)
    tree = fit(sample)
    shared = shipped(spark, tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        mine = pickle.loads(shared.value)
        for batch in batches:
            made = vectors(batch.column("vector"), dim)
            leaf = pa.array(mine.visit(made), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [leaf, batch.column("number"), batch.column("id"), batch.column("label"), packed_rows(made)], schema=arrow
            )

    names = "leaf int, number bigint, id bigint, label bigint, vector binary"
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    arrow = pa.schema([pa.field(c.split()[0], k) for c, k in zip(names.split(", "), kinds)])
    path = scratch_path(spark, "leaves")
    numbered.mapInArrow(run, names).write.parquet(path)
    stored = spark.read.schema(names).parquet(path)
    found = ranges(stored, tree)
    largest = max((float(n.max()) for n in found.norm_most), default=0.0)

    counts = stored.groupBy("leaf").count()  # one row per leaf of the tree
    total = counts.agg(F.sum("count")).first()[0] or 0
    cuts = counts.select("leaf", F.ceil(F.col("count") / CHUNK_ROWS).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("number"), F.col("cuts")).cast("int")
    dealt = stored.join(F.broadcast(cuts), "leaf").withColumn("cut", cut).drop("cuts", "number")
    dealt = dealt.repartition(-(-total // TASK_ROWS) or 1, "leaf", "cut").sortWithinPartitions("leaf", "cut", "id")
    path = scratch_path(spark, "index")
    dealt.write.parquet(path)
    return Index(spark.read.schema(dealt.schema).parquet(path), tree, found, (labels, sample), exact_type(max(largest, 0.0)))


# questions


@dataclass
class Questions:
    """Windows of scores around anchors: ``low`` to ``high``, of the own label or of others, the best ``count``."""

    vectors: np.ndarray  # by anchor
    labels: np.ndarray
    ids: np.ndarray
    anchor: np.ndarray  # by question
    low: np.ndarray
    high: np.ndarray
    own_label: bool
    count: int


def seeded(asked: Questions, sample: tuple[np.ndarray, np.ndarray], kind: type) -> Questions:
    """Raises ``low`` to the last score that the sample alone would return."""
    labels, rows = sample
    rows = rows.astype(kind)
    step = max(1, MATRIX_CELLS // max(1, len(rows)))
    for at in range(0, len(asked.anchor) if len(rows) >= asked.count else 0, step):
        part = slice(at, at + step)
        mine = asked.anchor[part]
        scores = (asked.vectors[mine].astype(kind) @ rows.T).astype(np.float64)
        fits = (labels == asked.labels[mine][:, None]) == asked.own_label
        fits &= (scores >= asked.low[part][:, None]) & (scores <= asked.high[part][:, None])
        last = np.partition(np.where(fits, scores, -np.inf), -asked.count, axis=1)[:, -asked.count]
        asked.low[part] = np.maximum(asked.low[part], last)
    return asked


class Walk:
    """The siblings that the questions cannot leave out, along the path to a leaf."""

    slack = 1e-6

    def __init__(self, tree: Tree, ranges: Ranges, asked: Questions):
        self.tree, self.ranges, self.asked = tree, ranges, asked
        self.norms = norms(asked.vectors)
        self.alive: dict[tuple[int, int], np.ndarray] = {}
        self.away: dict[int, np.ndarray] = {}

    def meets(self, node: int, child: int, who: np.ndarray) -> np.ndarray:
        """Which of the questions have an annulus that all ranges of the child meet."""
        asked, ranges = self.asked, self.ranges
        if node not in self.away:
            self.away[node] = np.sqrt(np.maximum(self.tree.distances(node, asked.vectors), 0))
        away, norm = self.away[node][asked.anchor[who]], self.norms[asked.anchor[who]]
        inner = np.sqrt(np.maximum(norm + ranges.norm_least[node][child] - 2 * asked.high[who], 0))[:, None]
        outer = np.sqrt(np.maximum(norm + ranges.norm_most[node][child] - 2 * asked.low[who], 0))[:, None]
        least, most = np.sqrt(np.maximum(ranges.least[node][:, child], 0)), np.sqrt(np.maximum(ranges.most[node][:, child], 0))
        possible = norm + ranges.norm_most[node][child] - 2 * asked.low[who] >= -self.slack
        near = np.maximum(away - most, least - away) <= outer + self.slack
        far = away + most >= inner - self.slack
        return possible & (near & far).all(axis=1) & (asked.low[who] <= asked.high[who])

    def questions(self, leaf: int) -> np.ndarray:
        path = self.tree.path(leaf)
        self.alive = {step: who for step, who in self.alive.items() if step in path}
        nodes = {node for node, _ in path}
        self.away = {node: away for node, away in self.away.items() if node in nodes}
        who = np.arange(len(self.asked.anchor))
        for node, child in path[:-1]:
            if (node, child) not in self.alive:
                self.alive[node, child] = who[self.meets(node, child, who)]
            who = self.alive[node, child]
        # the last step is taken with the scores found by now
        return who[self.meets(*path[-1], who)]


def undominated(label: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Of rows with equal vector and label, ordered by id, the first ``most``: no answer can hold another."""
    both = np.ascontiguousarray(np.column_stack([label, rows]))
    _, same = np.unique(both.view(np.dtype((np.void, both.dtype.itemsize * both.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    same = same[order]
    first = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
    place = np.arange(len(same)) - np.repeat(first, np.diff(np.r_[first, len(same)]))
    return np.sort(order[place < most])


class Best:
    """The best answers of every question so far."""

    def __init__(self, asked: Questions, kind: type):
        self.asked, self.kind = asked, kind
        self.found = np.zeros((0, 4), np.int64)  # question, score, id, whether it is the anchor's own row
        self.multiplied = 0

    def look(self, who: np.ndarray, ids: np.ndarray, label: np.ndarray, rows: np.ndarray) -> None:
        asked = self.asked
        keep = undominated(label, rows, asked.count)
        ids, label, rows = ids[keep], label[keep], rows[keep]
        turned = rows.astype(self.kind).T
        step = max(1, MATRIX_CELLS // max(1, len(rows)))
        for at in range(0, len(who), step):
            mine = who[at : at + step]
            anchors, of = np.unique(asked.anchor[mine], return_inverse=True)
            self.multiplied += len(anchors) * len(rows)
            scores = (asked.vectors[anchors].astype(self.kind) @ turned)[of]
            fits = (scores >= asked.low[mine][:, None]) & (scores <= asked.high[mine][:, None])
            fits &= (label == asked.labels[asked.anchor[mine]][:, None]) == asked.own_label
            q, x = np.nonzero(fits)
            if len(q):
                self.add(mine[q], scores[q, x].astype(np.int64), ids[x], rows[x])

    def add(self, question: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        anchor = self.asked.anchor[question]
        own = ids == self.asked.ids[anchor]
        own[own] = (rows[own] == self.asked.vectors[anchor[own]]).all(axis=1)
        known = self.found[np.isin(self.found[:, 0], question)]
        rest = self.found[~np.isin(self.found[:, 0], question)]
        both = np.concatenate([known, np.stack([question, score, ids, own.astype(np.int64)], axis=1)])
        both = both[np.lexsort((1 - both[:, 3], both[:, 2], -both[:, 1], both[:, 0]))]
        first = np.flatnonzero(np.r_[True, both[1:, 0] != both[:-1, 0]])
        place = np.arange(len(both)) - np.repeat(first, np.diff(np.r_[first, len(both)]))
        last = both[place == self.asked.count - 1]
        self.asked.low[last[:, 0]] = np.maximum(self.asked.low[last[:, 0]], last[:, 1])
        self.found = np.concatenate([rest, both[place < self.asked.count]])


def answers(held: Index, asked: Questions) -> DataFrame:
    """``question, score, id, own``: the best of each task."""
    spark = held.rows.sparkSession
    shared = shipped(spark, (held.tree, held.ranges, asked, held.kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        tree, ranges, asked, kind = pickle.loads(shared.value)
        walk, best = Walk(tree, ranges, asked), Best(asked, kind)
        leaf, waiting, rows_held = -1, [], 0

        def done() -> None:
            who = walk.questions(leaf) if waiting else []
            if len(who):
                best.look(who, *(np.concatenate(c) for c in zip(*waiting)))

        for batch in batches:
            leaves = np.asarray(batch.column("leaf"))
            ids, labels = np.asarray(batch.column("id")), np.asarray(batch.column("label"))
            rows = unpacked(batch.column("vector"), tree.dim)
            bounds = np.r_[0, np.flatnonzero(np.diff(leaves)) + 1, len(leaves)]
            for a, z in zip(bounds[:-1], bounds[1:]):
                if z > a and (leaves[a] != leaf or rows_held >= CHUNK_ROWS):
                    done()
                    leaf, waiting, rows_held = int(leaves[a]), [], 0
                if z > a:
                    order = np.argsort(ids[a:z], kind="stable")
                    waiting.append((ids[a:z][order], labels[a:z][order], rows[a:z][order]))
                    rows_held += z - a
        done()
        columns = [pa.array(np.ascontiguousarray(c)) for c in best.found.T]
        yield pa.RecordBatch.from_arrays(columns, names=["question", "score", "id", "own"])

    found = held.rows.select("leaf", "id", "label", "vector").mapInArrow(run, "question bigint, score bigint, id bigint, own bigint")
    order = Window.partitionBy("question").orderBy(F.desc("score"), "id", F.desc("own"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= asked.count)


# mining


def usable(vector: Column) -> Column:
    """No null, no null component, none that is not finite."""
    finite = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def blocks(spark: SparkSession, anchors: DataFrame, dim: int, cells: int = BLOCK_CELLS) -> Iterator[pa.Table]:
    """The anchors, so many at a time that their components are about ``cells``."""
    total = anchors.count()
    count = -(-total * max(1, dim) // cells) or 1
    path = scratch_path(spark, "anchors")
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)).cast("int"))
    dealt.write.partitionBy("block").parquet(path)
    stored = spark.read.schema(dealt.schema).parquet(path)
    for block in range(count):
        found = stored.where(F.col("block") == block).toArrow()
        if found.num_rows:
            yield found


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    sample_rows: int = SAMPLE_ROWS,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of others just below.

    ``rows`` are ``id, label, vector``, where ``vector`` is an array of whole
    numbers (see ``whole_numbers``); scores are inner products, larger ones
    first, ties by the smaller id. Rows with a null label or vector take no
    part; a null id comes last among ties, and an anchor has an id. Repeated
    rows are rows of their own, so one may be the positive of its copy, and an
    anchor that occurs twice is asked twice. A shorter vector counts as ending
    in zeros. An empty table, or one without anchors, gives no rows. Inner
    products of 2^53 and more are refused with an error.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "vectors")
    kept = rows.where("label is not null and vector is not null")
    kept = kept.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False)))
    kept.select(
        F.coalesce("id", F.lit(NO_ID)).alias("id"), F.col("label").cast("bigint").alias("label"), "vector", "is_anchor"
    ).write.parquet(path)
    stored = spark.read.parquet(path)
    held = index(stored.drop("is_anchor"), sample_rows)
    dim = held.tree.dim
    hits = scratch_path(spark, "negatives")
    spark.createDataFrame([], HITS).write.parquet(hits)
    for block in blocks(spark, stored.where("is_anchor").drop("is_anchor"), dim, block_cells):
        ids, labels = np.asarray(block.column("id"), np.int64), np.asarray(block.column("label"), np.int64)
        made = vectors(block.column("vector").combine_chunks(), dim)
        size = len(ids)
        # the anchor itself is among the rows of its label: one more is asked for, and it is taken out
        near = Questions(made, labels, ids, np.arange(size), np.full(size, -np.inf), np.full(size, np.inf), True, positives + 1)
        found = answers(held, seeded(near, held.sample, held.kind)).toArrow()
        anchor, score, other, own, place = (np.asarray(found.column(c), np.int64) for c in ("question", "score", "id", "own", "place"))
        itself = np.full(size, positives + 1, np.int64)
        np.minimum.at(itself, anchor[own == 1], place[own == 1])
        place = place - (place > itself[anchor])
        kept_ones = (place <= positives) & ~((own == 1) & (place == itself[anchor]))
        anchor, score, other = anchor[kept_ones], score[kept_ones], other[kept_ones]
        low = -(-least_percent * score // 100).astype(np.float64)
        below = Questions(made, labels, ids, anchor, low, score.astype(np.float64), False, negatives)
        windows = spark.sparkContext.broadcast((ids[anchor], other, score))

        def named(batches: Iterator[pa.RecordBatch], shared=windows) -> Iterator[pa.RecordBatch]:
            anchor_ids, positive_ids, scores = shared.value
            for batch in batches:
                q = np.asarray(batch.column("question"))
                cells = [anchor_ids[q], positive_ids[q], np.asarray(batch.column("place")), np.asarray(batch.column("id")), scores[q]]
                arrays = [pa.array(c) for c in cells] + [batch.column("score")]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in HITS.split(", ")])

        best = answers(held, seeded(below, held.sample, held.kind)).select("question", "place", "id", "score")
        best.mapInArrow(named, HITS).write.mode("append").parquet(hits)
        windows.destroy()
    result = spark.read.schema(HITS).parquet(hits)
    named_id = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return result.select("anchor_id", named_id("positive_id"), "rank", named_id("negative_id"), "positive_score", "negative_score")


def oracle() -> str:
    return f"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS vector
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label AS own, b.id, b.label, CAST(list_inner_product(a.vector, b.vector) AS BIGINT) AS score
      FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own
  AND 100 * s.score BETWEEN {LEAST_PERCENT} * p.positive_score AND 100 * p.positive_score
QUALIFY rank <= {NEGATIVES}"""
