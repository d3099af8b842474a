"""Exact top-k inner products with vector-approximation files.

Distinct vectors are kept in blocks twice: as quantised cells (one byte for each component) and as exact integers. A search scans
the cells alone, from which every vector gets an upper and a lower bound of its score for each query. A few blocks are scanned
first, and the kth lower bound that they give a query is shared by the scan of all blocks: only vectors that may still reach it
come out. Their exact vectors are read best bound first: those in front give a kth exact score, and of the rest only those are
read whose bound reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_table, materialize

#: Vectors in a block, queries in a block, blocks that a task meets with all queries, blocks that are scanned first.
BLOCK, QUERY_BLOCK, GROUP, FIRST = 4096, 256, 32, 16
#: Cells for each component.
CELLS = 64
_BLOCKS = "block long, dim int, cells binary, edges binary, own array<array<long>>, exact array<array<long>>"
_MOST = float(2**63 - 1024)  # the largest double that is a long


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (own, v) as blocks of one dimension: cells as uint8, the edges of the cells for each component, exact vectors."""
    for batch in batches:
        for dim, same in batch.groupby(batch["v"].map(len), sort=True):
            for at in range(0, len(same), BLOCK):
                part = same.iloc[at : at + BLOCK]
                exact = np.array(part["v"].tolist(), dtype=np.int64).reshape(len(part), dim).astype(float)
                edges = np.floor(np.linspace(exact.min(axis=0), exact.max(axis=0) + 1, CELLS + 1)) if dim else np.zeros((CELLS + 1, 0))
                edges[-1] = np.maximum(edges[-1], exact.max(axis=0)) if dim else edges[-1]
                cells = np.stack([np.searchsorted(edges[:, j], exact[:, j], side="right") - 1 for j in range(dim)], axis=1) if dim else exact
                cells = np.clip(cells, 0, CELLS - 1).astype(np.uint8)
                block = np.random.default_rng().integers(2**62)
                yield pd.DataFrame({"block": [block], "dim": [dim], "cells": [cells.tobytes()], "edges": [edges.tobytes()], "own": [part["own"].tolist()], "exact": [part["v"].tolist()]})


_LOTS = "dim int, q_ids array<long>, q array<array<long>>, least array<double>, m array<int>"


def _lots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Queries (dim, query_id, q, least, m) as blocks of one dimension."""
    for batch in batches:
        for dim, same in batch.groupby("dim", sort=True):
            for at in range(0, len(same), QUERY_BLOCK):
                part = same.iloc[at : at + QUERY_BLOCK]
                yield pd.DataFrame({"dim": [dim]} | {n: [part[c].tolist()] for n, c in (("q_ids", "query_id"), ("q", "q"), ("least", "least"), ("m", "m"))})


def _bounds(cells: bytes, edges: bytes, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of the scores, vectors x queries, wide enough for the rounding of doubles."""
    dim = q.shape[1]
    at = np.frombuffer(cells, np.uint8).reshape(-1, dim).astype(np.int64) if dim else np.zeros((1, 0), np.int64)
    edges = np.frombuffer(edges, np.float64).reshape(CELLS + 1, dim)
    low, high = np.take_along_axis(edges, at, axis=0), np.take_along_axis(edges, at + 1, axis=0)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    slack = (dim + 4) * 2.0**-51 * np.abs(q).sum(axis=1) * np.abs(edges).max(initial=0)
    return np.clip(high @ plus.T + low @ minus.T + slack, -_MOST, _MOST), np.clip(low @ plus.T + high @ minus.T - slack, -_MOST, _MOST)


def _scan(batches: Iterator[pd.DataFrame], k: int, found: bool) -> Iterator[pd.DataFrame]:
    """Blocks of vectors met by blocks of queries. found: the vectors that may be among the best k; else the k best lower bounds."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            q = np.array(row.q.tolist(), dtype=float).reshape(len(row.q_ids), row.dim)
            upper, lower = _bounds(row.cells, row.edges, q)
            for j, (qid, least, m) in enumerate(zip(row.q_ids, row.least, row.m, strict=True)):
                # m vectors may hold no rows but the query's own; each other stands for a candidate at least
                sure = np.sort(lower[:, j])[::-1]
                if found:
                    if len(sure) >= k + m:
                        least = max(least, sure[k + m - 1])
                    at = np.flatnonzero(upper[:, j] >= least)
                    out.append(pd.DataFrame({"query_id": qid, "block": row.block, "row": at.astype(np.int32), "upper": upper[at, j]}))
                else:
                    out.append(pd.DataFrame({"query_id": qid, "lower": sure[: k + m]}))
        if out:
            yield pd.concat(out)


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v) with v = floor(scale * x); rows with a null id or vector, or with a null or non-finite component, are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    good = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(x, bad)
    return vectors.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _score(a: Column, b: Column) -> Column:
    """The exact inner product; what leaves 64 bits is the nearest long."""
    exact = F.aggregate(F.zip_with(a, b, F.try_multiply), F.lit(0).cast("long"), F.try_add)
    rough = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(exact, F.greatest(F.least(rough, F.lit(_MOST)), F.lit(-_MOST)).cast("long"))


def exact_top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """For each row whose id is divisible by every, the k rows with the highest inner product: query_id, rank, vec_id, score.

    Components become floor(scale * x), so scores are exact integers, whatever their size (beyond 64 bits the nearest long). Ties go
    to the smaller id; a query is not its own candidate; fewer rows than k give fewer results. Vectors that are null or hold null,
    NaN or infinite components take no part; vectors of different lengths never meet. Rows that repeat an id each count as a
    candidate, as a query they count once. An empty table gives an empty result; other columns are ignored.

    Equal vectors are one point with the smallest ids of its rows (as many as can be asked for), so a vector that a third of the rows
    have is scanned once. The work is that of all queries on all cells; vectors move once and queries once for each GROUP blocks.
    """
    points = usable(vectors, id_col, vector_col, scale)
    # repeated ids that equal the query's own aren't its candidates, so k + 1 different ids are enough, each with its rows
    first = Window.partitionBy("v").orderBy("id")
    ids = points.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    few = ids.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    own = F.array_sort(F.flatten(F.collect_list(F.array_repeat("id", F.col("n")))))
    distinct = few.groupBy("v").agg(own.alias("own"))
    blocks = materialize(distinct.select("own", "v").mapInPandas(_packed, _BLOCKS), "vector-blocks")
    cells = blocks.select("block", "dim", "cells", "edges")

    # m: distinct vectors of the query's own id
    asked = points.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"), F.countDistinct("v").cast("int").alias("m"))
    queries = materialize(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim"), "m"), "queries")

    def met(cells: DataFrame, asked: DataFrame, groups: int) -> DataFrame:
        """Each block of cells with each block of queries of its dimension, in an equi-join on a group of blocks."""
        lots = asked.select("dim", "query_id", "q", "least", "m").mapInPandas(_lots, _LOTS)
        spread = lots.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        grouped = cells.withColumn("group", F.pmod(F.col("block"), F.lit(groups)).cast("int"))
        return grouped.join(spread, ["dim", "group"]).select("block", "dim", "cells", "edges", "q_ids", "q", "least", "m")

    some = cells.select("block").orderBy("block").limit(FIRST)
    lowest = F.lit(float("-inf"))
    started = met(cells.join(F.broadcast(some), "block"), queries.withColumn("least", lowest), 1).mapInPandas(lambda it: _scan(it, k, False), "query_id long, lower double")
    best = Window.partitionBy("query_id").orderBy(F.col("lower").desc())
    known = started.withColumn("n", F.row_number().over(best)).join(queries.select("query_id", "m"), "query_id").where(F.col("n") == k + F.col("m")).select("query_id", F.col("lower").alias("least"))
    asked = materialize(queries.join(known, "query_id", "left").withColumn("least", F.coalesce("least", lowest)), "asked")
    groups = max(1, -(-blocks.count() // GROUP))
    found = met(cells, asked, groups).mapInPandas(lambda it: _scan(it, k, True), "query_id long, block long, row int, upper double")
    front = Window.partitionBy("query_id").orderBy(F.col("upper").desc(), "block", "row")
    found = materialize(found.withColumn("place", F.row_number().over(front)), "candidates")

    exact = blocks.select("block", F.posexplode(F.arrays_zip("own", "exact")).alias("row", "x"))

    def read(chosen: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of the rows of these vectors."""
        rows = chosen.select("query_id", "block", "row").join(exact, ["block", "row"]).join(queries.select("query_id", "q"), "query_id")
        scored = rows.select("query_id", "x.own", _score(F.col("x.exact"), F.col("q")).alias("score"))
        return scored.select("query_id", F.explode("own").alias("vec_id"), "score").where("vec_id <> query_id")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ahead = materialize(ranked(read(found.where(F.col("place") <= 2 * k))), "front")
    kth = ahead.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = found.where(F.col("place") > 2 * k).join(kth, "query_id", "left").where(F.coalesce(F.col("upper") >= F.col("kth"), F.lit(True)))
    out = materialize(ranked(ahead.drop("rank").unionByName(read(rest))).select("query_id", "rank", "vec_id", "score"), "top-k")
    for t in (blocks, queries, asked, found, ahead):
        drop_table(t)
    return out
