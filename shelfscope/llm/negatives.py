"""Hard negatives: Strassen products of integer tiles, then mergeable heaps of positives and of windows below them.

Equal vectors of one label are one point. Anchor points and candidate points are dealt to the cells of a grid, each of which holds a
bounded number of both. A cell multiplies its tiles by Strassen's recursion on int64, whose additions are exact, and keeps the best
entries of each anchor; heaps of different cells merge by taking the best of both. The first pass meets points of the same label
and finds the positives, the second meets points of other labels and fills the window that each positive score opens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_table, materialize

#: Candidates and anchors of a cell at most, about; rows of a tile on either side; the side below which a product isn't divided.
CANDIDATES, ANCHORS, TILE, LEAF = 8192, 8192, 1024, 32
#: Cells that a key is dealt to as soon as it has that many times SPREAD candidates, so that small tables run in many tasks too.
CELLS, SPREAD = 64, 512
_INT64 = 2**63 - 1
_NONE = -(2**63)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b by Strassen's recursion: seven half-size products in place of eight, odd sides filled up with a row or column of zeros.

    Sums and products of int64 wrap, and wrapping is a ring: the result is exact whenever it fits 64 bits itself, whatever the
    sums on the way do. Arrays of Python integers work alike.
    """
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * r, 2 * t), dtype=p1.dtype)
    out[:r, :t] = p1 + p4 - p5 + p7
    out[:r, t:] = p3 + p5
    out[r:, :t] = p2 + p4
    out[r:, t:] = p1 - p2 + p3 + p6
    return out[:n, :m]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the rows of b as int64; what leaves 64 bits is the nearest int64."""
    with np.errstate(over="ignore"):
        reach = np.abs(a.astype(float)).sum(axis=1).max(initial=0) * np.abs(b.astype(float)).max(initial=0)
        if reach < 2.0**62:
            return strassen(a, b.T)
        exact = strassen(a.astype(object), b.T.astype(object))
        return np.clip(exact, _NONE + 1, _INT64).astype(np.int64)


class Heap:
    """For each of n keys the k best entries (score, id, point) that have been added; two heaps merge by adding one's entries."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.point = np.full((n, k), _NONE), np.full((n, k), _INT64), np.full((n, k), -1)

    def add(self, score: np.ndarray, ids: np.ndarray, point: np.ndarray) -> None:
        s, i, p = (np.concatenate(x, axis=1) for x in ((self.score, score), (self.id, ids), (self.point, point)))
        order = np.lexsort((p, i, ~s), axis=-1)[:, : self.k]  # ~s falls as s rises, and doesn't overflow
        self.score, self.id, self.point = (np.take_along_axis(x, order, 1) for x in (s, i, p))


def _lists(column: pd.Series, k: int) -> np.ndarray:
    """Lists of at most k ids as rows, filled up with the largest integer."""
    out = np.full((len(column), k), _INT64)
    for j, x in enumerate(column):
        out[j, : len(x[:k])] = x[:k]
    return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.int64).reshape(len(vectors), len(vectors.iloc[0]))


def _sorted_tiles(side: pd.DataFrame):
    """Candidates by their smallest id, in tiles: (points, vectors, ids)."""
    side = side.assign(first=[x[0] for x in side["own"]]).sort_values(["first", "point"], kind="stable")
    for at in range(0, len(side), TILE):
        part = side.iloc[at : at + TILE]
        yield part["point"].to_numpy(), _matrix(part["v"]), part["own"], part["label"].to_numpy()


def _front(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, the first of equal ones first. Columns are in the order of their smallest id."""
    return np.argsort(~score, axis=1, kind="stable")[:, :k] if score.shape[1] else np.empty((len(score), 0), dtype=np.int64)


def positives_of(anchors: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """(anchor, point, id, score): the k best rows of the same label for each anchor point of a cell."""
    out = []
    for at in range(0, len(anchors), TILE):
        part = anchors.iloc[at : at + TILE]
        a = _matrix(part["v"])
        heap = Heap(len(part), k)
        for points, v, own, _ in _sorted_tiles(candidates):
            s = scores(a, v)
            front = _front(s, k)
            ids = _lists(own, k)[front]  # anchors x points x ids
            none = ids == _INT64
            s = np.where(none, _NONE, np.take_along_axis(s, front, 1)[:, :, None])
            heap.add(s.reshape(len(part), -1), ids.reshape(len(part), -1), np.where(none, -1, points[front][:, :, None]).reshape(len(part), -1))
        out.append(_rows(heap, part["point"].to_numpy()))
    return pd.concat(out) if out else pd.DataFrame({"anchor": [], "point": [], "id": [], "score": []}, dtype="int64")


def _rows(heap: Heap, anchor: np.ndarray) -> pd.DataFrame:
    row, col = np.nonzero(heap.point >= 0)
    return pd.DataFrame({"anchor": anchor[row], "point": heap.point[row, col], "id": heap.id[row, col], "score": heap.score[row, col]})


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and the highest score s with 50 p <= 100 s <= 95 p, without products that could leave 64 bits. Empty below 0."""
    p = np.asarray(positive, dtype=np.int64)
    return p - p // 2, p // 20 * 19 + p % 20 * 19 // 20


def negatives_of(anchors: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """(anchor, positive_score, id, score): the k best rows of another label in each window (`open`: positive scores) of a cell."""
    out = []
    for at in range(0, len(anchors), TILE):
        part = anchors.iloc[at : at + TILE]
        a = _matrix(part["v"])
        labels = part["label"].to_numpy()
        width = max(map(len, part["open"]))
        asked = np.full((len(part), width), -1)
        for j, x in enumerate(part["open"]):
            asked[j, : len(x)] = x
        low, high = window(asked)
        low, high = np.where(asked < 0, _INT64, low), np.where(asked < 0, _NONE, high)
        heaps = [Heap(len(part), k) for _ in range(width)]
        for points, v, own, of in _sorted_tiles(candidates):
            s = scores(a, v)
            s[labels[:, None] == of[None, :]] = _NONE
            order = _front(s, s.shape[1])
            s = np.take_along_axis(s, order, 1)
            ids = _lists(own, k)
            for w, heap in enumerate(heaps):
                # scores fall along a row, so a window is a stretch, which begins where they come down to its upper end
                begin = (s > high[:, w : w + 1]).sum(axis=1)[:, None] + np.arange(k)
                inside = begin < s.shape[1]
                begin = np.minimum(begin, s.shape[1] - 1)
                got = np.take_along_axis(s, begin, 1)
                good = inside & (got >= low[:, w : w + 1]) & (got != _NONE)
                at_ids = ids[np.take_along_axis(order, begin, 1)]
                got = np.where(good[:, :, None] & (at_ids != _INT64), got[:, :, None], _NONE)
                where = np.where(got == _NONE, -1, np.take_along_axis(points[order], begin, 1)[:, :, None])
                heap.add(got.reshape(len(part), -1), np.where(got == _NONE, _INT64, at_ids).reshape(len(part), -1), where.reshape(len(part), -1))
        for w, heap in enumerate(heaps):
            rows = _rows(heap, np.arange(len(part)))
            out.append(pd.DataFrame({"anchor": part["point"].to_numpy()[rows["anchor"]], "positive_score": asked[rows["anchor"], w], "id": rows["id"].to_numpy(), "score": rows["score"].to_numpy()}))
    return pd.concat(out) if out else pd.DataFrame({"anchor": [], "positive_score": [], "id": [], "score": []}, dtype="int64")


def _grid(anchors: DataFrame, candidates: DataFrame, keys: list[str]):
    """Both sides dealt to cells of a key: each anchor to all rows of cells of its key, each candidate to all columns.

    The numbers of rows and columns follow the counts of the key, so a cell holds a bounded number of both, and a key that a third
    of all rows have is met in as many cells as it needs.
    """
    n = candidates.groupBy(*keys).agg(F.count("*").alias("n"))
    m = anchors.groupBy(*keys).agg(F.count("*").alias("m"))
    ceil = lambda x, most: F.ceil(x / F.lit(most)).cast("int")
    shape = n.join(m, keys).select(*keys, F.greatest(ceil(F.col("n"), CANDIDATES), F.least(F.lit(CELLS), ceil(F.col("n"), SPREAD))).alias("rows"), ceil(F.col("m"), ANCHORS).alias("cols"))
    # counts by key go to the points by joins, which Spark broadcasts if it finds them small
    side = lambda df, own, other: (
        df.join(shape, keys)
        .withColumn(own[1], F.pmod(F.xxhash64("point", F.lit(own[1])), F.col(own[0])).cast("int"))
        .withColumn(other[1], F.explode(F.sequence(F.lit(0), F.col(other[0]) - 1)))
        .drop("rows", "cols")
    )
    row, col = ("rows", "row"), ("cols", "col")
    by = [*keys, "row", "col"]
    return side(anchors, col, row).groupBy(*by), side(candidates, row, col).groupBy(*by)


def hard_negatives(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50, relabel: int = 0, labels: int = 10, scale: int = 256, positives: int = 5, negatives: int = 3) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor, positive and negative.

    Anchors are rows whose id is divisible by every; with relabel, rows whose id is divisible by it first get the label
    (label + 1) % labels. Components become floor(scale * x); a score is the integer inner product with the anchor, higher first,
    ties by smaller id. An anchor's positives are its first other rows of the same label, all if fewer; for each of them the first
    rows of another label with 50 * positive_score <= 100 * score <= 95 * positive_score follow, all if fewer. A window below a
    negative score is empty, and a positive whose window holds nothing gives no row.

    Rows with a null id, label or vector or with a null, NaN or infinite component take no part; vectors of different lengths never
    meet; rows that repeat id, label and vector count once; an id with several vectors or labels is as many rows, each an anchor of
    its own that has the others as other rows. Scores beyond 64 bits count as the nearest long. An empty table gives an empty
    result; other columns are ignored.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    good = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(x, bad))
    id_, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    if relabel:
        label = F.when(id_ % relabel == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label)
    good = good.select(id_.alias("id"), label.alias("label"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
    good = good.withColumn("anchor", F.col("id") % every == 0)

    # a point keeps as many of its smallest ids as can be asked for; the limit acts before the shuffle
    k = positives + 1
    most = max(k, negatives)
    first = Window.partitionBy("label", "v", "anchor").orderBy("id")
    few = good.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= most)
    own = F.slice(F.array_sort(F.collect_list("id")), 1, most)
    points = few.groupBy("label", "v").agg(own.alias("own"), F.bool_or("anchor").alias("anchor"))
    points = materialize(points.select(F.monotonically_increasing_id().alias("point"), "label", "v", F.size("v").alias("dim"), "own", "anchor"), "points")
    candidates = points.select("point", "label", "dim", "v", "own")
    asked = points.where("anchor").select("point", "label", "dim", "v").toDF("point", "label", "dim", "v")  # columns of its own

    left, right = _grid(asked, candidates, ["dim", "label"])
    met = left.cogroup(right).applyInPandas(lambda a, c: positives_of(a, c, k), "anchor long, point long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id", "point")
    top = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    sort = F.array_sort(F.collect_list(F.struct("place", "point", "id", "score")))
    found = materialize(top.groupBy("anchor").agg(sort.alias("found")), "positives")

    opened = found.select(F.col("anchor").alias("point"), F.filter(F.array_distinct(F.transform("found", lambda f: f["score"])), lambda s: s >= 0).alias("open")).where(F.size("open") > 0)
    left, right = _grid(asked.join(opened, "point"), candidates, ["dim"])
    met = left.cogroup(right).applyInPandas(lambda a, c: negatives_of(a, c, negatives), "anchor long, positive_score long, id long, score long")
    order = Window.partitionBy("anchor", "positive_score").orderBy(F.col("score").desc(), "id")
    below = materialize(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives), "negatives")
    heaps = below.groupBy("anchor", "positive_score").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("below"))

    # each anchor row takes the heap of its point without itself
    each = found.select("anchor", F.explode("found").alias("f")).select("anchor", F.col("f.place").alias("place"), F.col("f.point").alias("at"), F.col("f.id").alias("positive_id"), F.col("f.score").alias("positive_score"))
    filled = each.join(heaps, ["anchor", "positive_score"]).select("anchor", "place", "below")
    both = found.join(filled.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "below"))).alias("by_place")), "anchor")
    heads = good.where("anchor").select("id", "label", "v").distinct().join(points.where("anchor").select("label", "v", "point"), ["label", "v"]).select(F.col("id").alias("anchor_id"), F.col("point").alias("anchor"))
    kept = F.slice(F.filter("found", lambda f: ~((f["id"] == F.col("anchor_id")) & (f["point"] == F.col("anchor")))), 1, positives)
    out = heads.join(both, "anchor").select("anchor_id", "by_place", F.explode(kept).alias("p"))
    out = out.select("anchor_id", "p", F.explode(F.element_at("by_place", F.col("p.place"))).alias("n"))
    out = materialize(out.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("n.rank").alias("rank"), F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score")), "hard-negatives")
    for t in (points, found, below):
        drop_table(t)
    return out
