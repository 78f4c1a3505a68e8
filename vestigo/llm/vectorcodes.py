"""Product-quantised vector codes; codebooks are refined over metric trees of the parts.

Vectors become integers and are cut into equal parts. Each task's block of vectors gets, for every
part position, a metric tree by the anchors hierarchy: far-apart anchors take the points nearest to
them (a point whose anchor is near enough is never compared), anchors are joined upwards into a
binary tree (the pair with the smallest common ball first) and large anchors are split downwards in
the same way. Every ball keeps its centre, radius, number of points and their sum.

A round walks the trees from the root with a list of candidate entries. A child inherits its
parent's list and strikes entries that another beats everywhere in its ball. A ball with one entry
left is wholly owned: its cached sum and count go to that entry and its points are not read. Only
points of leaves with several entries left are compared, in integers. Rounding can't change a result:
bounds are kept loose by more than the rounding, and what they leave open is compared exactly.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vestigo.llm.joins import small_side
from vestigo.session import stash

#: Vectors of a block, and so of a tree, at most, fewer where they are long; a leaf with at most so
#: many points is not split.
BLOCK_ROWS, BLOCK_VALUES = 8192, 1 << 20
LEAF_POINTS = 48
#: Relative and absolute looseness of the bounds, far above the rounding of doubles.
SLACK = 1e-6
#: Integers up to this size have exact 64-bit distances (two of them square to less than 2^55 a component).
EXACT_LIMIT = 1 << 26

_LONG_MAX = 2**63 - 1


@dataclass
class Ball:
    """A node: `points` are row numbers of the block, None above the leaves."""

    centre: np.ndarray
    radius: float
    count: int
    total: np.ndarray
    children: tuple[int, ...]
    points: np.ndarray | None


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.sqrt(np.einsum("...i,...i->...", gap, gap))


def anchors_of(points: np.ndarray, k: int) -> list[np.ndarray]:
    """Partition of the points (by row number) among up to k anchors, each the point furthest from its
    owner so far. A new anchor meets only points that may be nearer to it: those further from their
    own anchor than half the distance between the two anchors."""
    owner = np.zeros(len(points), dtype=np.int64)
    away = _distances(points, points[0])
    at = np.empty((k, points.shape[1]))
    at[0] = points[0]
    for new in range(1, k):
        furthest = int(away.argmax())
        if away[furthest] <= 0.0:
            k = new
            break
        at[new] = points[furthest]
        half = _distances(at[:new], at[new]) / 2
        rows = np.flatnonzero(away > half[owner])
        own = _distances(points[rows], at[new])
        nearer = own < away[rows]
        rows = rows[nearer]
        owner[rows], away[rows] = new, own[nearer]
    order = np.argsort(owner, kind="stable")
    return [rows for rows in np.split(order, np.searchsorted(owner[order], np.arange(1, k))) if len(rows)]


class BallTree:
    """Anchors hierarchy over the integer points of one part position of one block."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.floats = points.astype(np.float64)
        self.balls: list[Ball] = []
        self.root = self._grow(np.arange(len(points)))

    def _leaf(self, rows: np.ndarray) -> int:
        total = self.points[rows].sum(axis=0)
        centre = total.astype(np.float64) / len(rows)
        radius = float(_distances(self.floats[rows], centre).max())
        return self._add(Ball(centre, radius, len(rows), total, (), rows))

    def _add(self, ball: Ball) -> int:
        self.balls.append(ball)
        return len(self.balls) - 1

    def _grow(self, rows: np.ndarray) -> int:
        """Middle out: anchors first, joined upwards to one ball, each split downwards in turn."""
        if len(rows) <= LEAF_POINTS:
            return self._leaf(rows)
        parts = anchors_of(self.floats[rows], int(np.ceil(np.sqrt(len(rows)))))
        if len(parts) == 1:  # all points are equal
            return self._leaf(rows)
        return self._joined([self._grow(rows[p]) for p in parts])

    def _joined(self, nodes: list[int]) -> int:
        """Joins the two balls with the smallest common ball until one is left."""
        size = len(nodes)
        centres = np.array([self.balls[n].centre for n in nodes])
        radii = np.array([self.balls[n].radius for n in nodes])
        spans = (_distances(centres[:, None], centres[None]) + radii[:, None] + radii[None]) / 2
        np.fill_diagonal(spans, np.inf)
        for _ in range(size - 1):
            i, j = divmod(int(np.argmin(spans)), size)
            a, b = self.balls[nodes[i]], self.balls[nodes[j]]
            count, total = a.count + b.count, a.total + b.total
            centre = total.astype(np.float64) / count
            reach = _distances(np.array([a.centre, b.centre]), centre) + [a.radius, b.radius]
            nodes[i] = self._add(Ball(centre, float(reach.max()), count, total, (nodes[i], nodes[j]), None))
            centres[i], radii[i] = centre, reach.max()
            spans[j] = spans[:, j] = np.inf
            alive = np.isfinite(spans[i])
            row = np.where(alive, (_distances(centres, centre) + radii + radii[i]) / 2, np.inf)
            row[i] = np.inf
            spans[i], spans[:, i] = row, row
        return nodes[i]

    def packed(self) -> dict[str, np.ndarray]:
        """Arrays of the tree, children before parents; leaves list their points one after the other."""
        leaves = [b.points if b.points is not None else np.empty(0, np.int64) for b in self.balls]
        return {
            "centre": np.array([b.centre for b in self.balls]),
            "radius": np.array([b.radius for b in self.balls]),
            "count": np.array([b.count for b in self.balls]),
            "total": np.array([b.total for b in self.balls]),
            "child": np.array([b.children or (-1, -1) for b in self.balls]),
            "first": np.cumsum([0, *map(len, leaves)]),
            "rows": np.concatenate(leaves).astype(np.int32),
        }


def _survivors(centre: np.ndarray, radius: np.ndarray, entries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Of each ball's candidate entries, those that its nearest one doesn't beat everywhere in the ball."""
    gap = centre[:, None] - entries[None]
    square = np.einsum("nei,nei->ne", gap, gap)
    square[~candidates] = np.inf
    best = square.argmin(1)
    nearest = square[np.arange(len(best)), best]
    apart = _distances(entries[best][:, None], entries[None])
    # on a ball of this radius the difference of squared distances varies by twice radius times the entries' distance
    margin = 2 * radius[:, None] * apart * (1 + SLACK) + SLACK * (1 + nearest[:, None])
    with np.errstate(invalid="ignore"):
        beaten = square - nearest[:, None] > margin + SLACK * np.where(np.isfinite(square), square, 0)
    return candidates & ~beaten


def assign(tree: dict[str, np.ndarray], points: np.ndarray, codebook: np.ndarray) -> Iterator[tuple[np.ndarray | None, int | np.ndarray, int]]:
    """Walks a tree: yields (None, entry, ball) for wholly owned balls, and (rows, entries, -1) for the
    points compared one by one; each point is in one of them. Ties go to the lower entry."""
    entries = codebook.astype(np.float64)
    nodes = np.array([len(tree["count"]) - 1])
    candidates = np.zeros((1, len(codebook)), dtype=bool)
    candidates[0, np.unique(codebook, axis=0, return_index=True)[1]] = True  # of equal entries the first
    rows_left: list[np.ndarray] = []
    lists_left: list[np.ndarray] = []
    while len(nodes):
        candidates = _survivors(tree["centre"][nodes], tree["radius"][nodes], entries, candidates)
        owned = candidates.sum(1) == 1
        for node, entry in zip(nodes[owned], candidates[owned].argmax(1)):
            yield None, int(entry), int(node)
        nodes, candidates = nodes[~owned], candidates[~owned]
        children = tree["child"][nodes]
        leaf = children[:, 0] < 0
        for node, listed in zip(nodes[leaf], candidates[leaf]):
            rows = tree["rows"][tree["first"][node] : tree["first"][node + 1]]
            rows_left.append(rows)
            lists_left.append(np.broadcast_to(listed, (len(rows), len(listed))))
        nodes, candidates = children[~leaf].ravel(), np.repeat(candidates[~leaf], 2, axis=0)
    if rows_left:
        rows, listed = np.concatenate(rows_left), np.concatenate(lists_left)
        point, entry = np.nonzero(listed)
        square = ((points[rows][point] - codebook[entry]) ** 2).sum(-1)
        starts = np.flatnonzero(np.r_[True, point[1:] != point[:-1]])
        least = np.repeat(np.minimum.reduceat(square, starts), np.diff(np.r_[starts, len(point)]))
        hits = np.flatnonzero(square == least)
        _, first = np.unique(point[hits], return_index=True)
        yield rows, entry[hits[first]], -1


def _integers(vectors: list[np.ndarray]) -> np.ndarray:
    """floor(256 x) of each component, as 64-bit integers where distances fit, else Python's."""
    scaled = np.floor(np.asarray(vectors, dtype=np.float64) * 256.0)
    if scaled.size and np.abs(scaled).max() > EXACT_LIMIT:
        return np.array([[int(x) for x in row] for row in scaled], dtype=object)
    return scaled.astype(np.int64)


_BLOCK = "ids binary, vectors binary, trees binary"


def _blocks(rows: DataFrame, id_column: str, label: str, vector: str, parts: int) -> DataFrame:
    """One row per block: its ids and labels, its integer vectors and a tree for each part position."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            told = pa.Table.from_batches(held)
            held.clear()
            flat = told[vector].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            points = _integers(flat.reshape(len(told), -1))
            cut = points.reshape(len(told), parts, -1)
            if points.dtype == object:
                trees = None
            else:
                trees = [BallTree(np.ascontiguousarray(cut[:, p])).packed() for p in range(parts)]
            ids = (told[id_column].to_pylist(), told[label].to_pylist())
            packed = [pickle.dumps(x, protocol=5) for x in (ids, points, trees)]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], names=["ids", "vectors", "trees"])

        for batch in batches:
            while batch.num_rows:
                size = min(BLOCK_ROWS, max(1, BLOCK_VALUES // len(batch[vector][0])))
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == size:
                    yield block()
        if held:
            yield block()

    return rows.mapInArrow(build, _BLOCK)


def _owners(points: np.ndarray, trees: list | None, codebooks: list[np.ndarray], part: int) -> np.ndarray:
    """Entry of each point of a part position."""
    width = points.shape[1] // len(codebooks)
    mine = points[:, part * width : (part + 1) * width]
    if trees is None:  # integers too large for the trees' arithmetic: Python's compare every entry
        return np.array([min(range(len(codebooks[part])), key=lambda e: (sum((int(a) - int(b)) ** 2 for a, b in zip(row, codebooks[part][e])), e)) for row in mine])
    out = np.empty(len(points), dtype=np.int64)
    tree = trees[part]
    for rows, entry, node in assign(tree, mine, codebooks[part]):
        if rows is None:
            out[_points_below(tree, node)] = entry
        else:
            out[rows] = entry
    return out


def _points_below(tree: dict[str, np.ndarray], node: int) -> np.ndarray:
    found, open_nodes = [], [node]
    while open_nodes:
        n = open_nodes.pop()
        a, b = tree["child"][n]
        if a < 0:
            found.append(tree["rows"][tree["first"][n] : tree["first"][n + 1]])
        else:
            open_nodes += [a, b]
    return np.concatenate(found)


def _sums(blocks: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """Number of points and sum of each entry of each part position, over all blocks: part, entry, n, place, total."""
    parts = len(codebooks)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [[0] * len(c) for c in codebooks]
        totals = [[[0] * c.shape[1] for _ in range(len(c))] for c in codebooks]
        any_block = False
        for batch in batches:
            for vectors, packed in zip(batch["vectors"].to_pylist(), batch["trees"].to_pylist()):
                any_block = True
                points, trees = pickle.loads(vectors), pickle.loads(packed)
                width = points.shape[1] // parts
                for p in range(parts):
                    mine = points[:, p * width : (p + 1) * width]
                    if trees is None:
                        found = [(np.arange(len(mine)), _owners(points, None, codebooks, p), -1)]
                    else:
                        found = assign(trees[p], mine, codebooks[p])
                    for rows, entry, node in found:
                        if rows is None:
                            counts[p][entry] += int(trees[p]["count"][node])
                            totals[p][entry] = [a + int(b) for a, b in zip(totals[p][entry], trees[p]["total"][node])]
                            continue
                        for e in np.unique(entry):
                            hit = rows[entry == e]
                            counts[p][e] += len(hit)
                            totals[p][e] = [a + int(b) for a, b in zip(totals[p][e], mine[hit].sum(axis=0))]
        if any_block:
            told = [(p, e, counts[p][e], [str(t) for t in totals[p][e]]) for p in range(parts) for e in range(len(counts[p])) if counts[p][e]]
            columns = [pa.array(c, t) for c, t in zip(zip(*told), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "totals"])

    found = blocks.select("vectors", "trees").mapInArrow(walk, "part int, entry int, n long, totals array<string>")
    spread = found.select("part", "entry", "n", F.posexplode("totals").alias("place", "total"))
    # sums stay exact: 38 digits hold the sum of more components than a table can have
    return spread.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def usable(vector: Column) -> Column:
    """Vectors that are there and hold numbers only, no null, NaN or infinity."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd


def starting_codebooks(vectors: DataFrame, id_column: str, vector: str, parts: int, entries: int) -> list[np.ndarray]:
    """Parts of the vectors with the smallest ids (null ids last; of equal ids, by vector)."""
    first = vectors.orderBy(F.col(id_column).asc_nulls_last(), vector).limit(entries).select(vector).collect()
    points = _integers([row[0] for row in first])
    return [np.ascontiguousarray(c) for c in np.split(points, parts, axis=1)]


def refined(blocks: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the componentwise floored mean of the parts nearest to it; unused ones stay."""
    out = [c.astype(object) for c in codebooks]
    for row in _sums(blocks, codebooks).collect():  # one row per part, entry and component
        out[row["part"]][row["entry"]][row["place"]] = int(row["total"]) // row["n"]
    return [np.array(c.tolist(), dtype=object) if max((abs(x) for x in c.ravel()), default=0) > EXACT_LIMIT else c.astype(np.int64) for c in out]


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for c in codebooks for x in c.ravel()).encode()).hexdigest()


def coded(blocks: DataFrame, codebooks: list[np.ndarray], id_type: str, label_type: str) -> DataFrame:
    """Code and error of every vector: vec_id, label, code, error."""
    parts = len(codebooks)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, packed in zip(*[batch[c].to_pylist() for c in ("ids", "vectors", "trees")]):
                points, trees = pickle.loads(vectors), pickle.loads(packed)
                width = points.shape[1] // parts
                codes = np.empty((len(points), parts), dtype=np.uint8)
                error = np.zeros(len(points), dtype=points.dtype)
                for p in range(parts):
                    codes[:, p] = owner = _owners(points, trees, codebooks, p)
                    error += ((points[:, p * width : (p + 1) * width] - codebooks[p][owner]) ** 2).sum(axis=1)
                vec_ids, labels = pickle.loads(ids)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": vec_ids,
                        "label": labels,
                        "code": [row.tobytes().hex() for row in codes],
                        "error": [min(int(e), _LONG_MAX) for e in error],
                    },
                    schema=pa.schema([("vec_id", _arrow(id_type)), ("label", _arrow(label_type)), ("code", pa.string()), ("error", pa.int64())]),
                )

    return blocks.mapInArrow(walk, f"vec_id {id_type}, label {label_type}, code string, error long")


def _arrow(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[name]


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_column: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """One row per usable vector: vec_id, code (two hex digits an entry, in part order), error (squared
    distances summed over parts), label_error (error summed over equal labels, nulls together) and
    codebooks_sha256.

    Vectors that are null or hold a null, NaN or infinity are left out, and so are those whose length
    differs from the first codebook vector's or doesn't fall into equal parts, as they have no parts to
    compare. Repeated rows and ids each get their row; an empty table gives no rows. Errors stop at the
    largest long. Components beyond 2^26 after scaling are compared with Python's integers.
    Blocks and their trees are written once, to the shared folder; each round reads them there and
    sends one row per part, entry and component to the driver, whatever the table's size.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code holds entries 0 to 255")
    kept = vectors.select(F.col(id_column).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("_v")).where(usable(F.col("_v")))
    id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    out = [*(F.col(c) for c in ("vec_id", "code", "error", "label_error"))]
    whole = kept.where((F.size("_v") > 0) & (F.size("_v") % parts == 0))
    lead = whole.orderBy(F.col("vec_id").asc_nulls_last(), "_v").limit(1).select(F.size("_v")).collect()
    if not lead:
        nothing = whole.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return nothing.select(*out, F.lit(codebooks_digest([])).alias("codebooks_sha256"))
    whole = whole.where(F.size("_v") == lead[0][0])
    codebooks = starting_codebooks(whole, "vec_id", "_v", parts, entries)
    blocks = stash(_blocks(whole, "vec_id", "label", "_v", parts), "vector-blocks")
    for _ in range(rounds):
        codebooks = refined(blocks, codebooks)
    codes = stash(coded(blocks, codebooks, id_type, label_type), "vector-codes")
    by_label = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG_MAX)).cast("long").alias("label_error"))
    by_label = small_side(stash(by_label.withColumnRenamed("label", "_label"), "vector-labels"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        *out, F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256")
    )
