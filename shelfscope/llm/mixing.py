"""Mixing sources to target weights, with DataFrame operations only.

Every row has a fixed 60-bit hash of its id and text. A source takes each of its documents a whole number of times and, for what is left
of its budget, the documents whose hash lies below a threshold. The threshold comes from nested histograms: sizes are summed by
source and hash bucket, the bucket in which the budget runs out is found from the running sums, and only the rows of that bucket
are summed again by finer buckets, until a bucket is a single hash. No rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_names, materialize

#: Bits of the hash that a histogram resolves, and the number of nested histograms; together they cover all 60 bits.
LEVEL_BITS, LEVELS = 12, 5
WORD = r"[^\x20\x09-\x0D]+"


def row_hash(id_col: str, text_col: str) -> Column:
    """60 bits of the MD5 of the id and the text (nulls: the empty text), the same in every run."""
    both = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def text_size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size) with a target for each source: weights repeat over the sources by code point (null last); a target
    stops at most times the source's size and what is left over goes to the others by weight.

    Sources fill up in the order of size by weight, so the targets of those that are not full share one level: what the full
    ones leave, by weight. One row for each source is sorted, never rows of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("place"))
    every = Window.partitionBy()
    up_to = by_room.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    sums = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("weight_from", F.sum("weight").over(every) - F.sum("weight").over(up_to) + F.col("weight"))
        .withColumn("cap_before", most * (F.sum("source_size").over(up_to) - F.col("source_size")))
    )
    # a source is full if the level that it would see, were it and those after it open, is above its own cap
    full = F.col("weight") * (F.col("total") - F.col("cap_before")) >= most * F.col("source_size") * F.col("weight_from")
    marked = sums.withColumn("full", full)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(every)
    open_words = F.col("total") - F.sum(F.when(F.col("full"), most * F.col("source_size")).otherwise(0)).over(every)
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(open_words.cast("double") * F.col("weight") / open_weight)
    return marked.select("source", "source_size", target.alias("target"))


def _threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below): rows with hash < below fit the budget `rest` of the source, as near to it as whole hashes allow.

    rows: source, size, hash; budgets: source, rest. The bucket in which the running sum passes the budget is refined; at the
    last level, a single hash, it is taken if that comes nearer to the budget than leaving it out.
    """
    edge = budgets.select(F.col("source").alias("of"), F.lit(0).cast("long").alias("start"), "rest")
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        width = 1 << shift
        own = F.col("source").eqNullSafe(F.col("of"))
        inside = F.col("hash").between(F.col("start"), F.col("start") + (width * (1 << LEVEL_BITS) - 1))
        sums = rows.join(edge, own & inside).groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
        before = sums.withColumn("before", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size"))
        # the first bucket that passes the budget; with none the whole range fits
        passed = before.where(F.col("before") + F.col("size") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", "before", "size", "rest")).alias("b"))
        found = passed.select(F.col("source").alias("of"), (F.col("b.bucket") * width).alias("start"), (F.col("b.rest") - F.col("b.before")).alias("rest"), F.col("b.size").alias("edge_size"))
        edge = materialize(found, f"mix-level-{level}")
    nearer = F.col("edge_size") - F.col("rest") < F.col("rest")
    return edge.select(F.col("of").alias("source"), F.when(nearer, F.col("start") + 1).otherwise(F.col("start")).alias("below"))


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row for each source: of, source_size, target, whole (times that every row is taken), below (rows with a hash below it
    are taken once more)."""
    rows = materialize(docs.select(F.col(source_col).alias("source"), text_size(text_col).alias("size"), row_hash(id_col, text_col).alias("hash")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    plan = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    limits = _threshold(rows, plan.select("source", "rest").where(F.col("rest") > 0))
    decided = plan.alias("p").join(limits.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left")
    return materialize(decided.select(F.col("p.source").alias("of"), "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below")), "mix-plan")


def mix_to_targets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """docs with size, source_size, target, taken and copies; columns of docs with these names are replaced.

    size counts runs of characters other than space and \\t to \\r (null text: 0). Sources sorted by code point, null last, weigh
    `weights`, repeating, and share all words; no target exceeds `most` times the words of its source, and the excess goes to the
    others by weight. taken = copies * size are the words that the mix takes of a row; copies is 0 to `most`. Rows of one source
    with the same id (or null ids) and the same text share a hash and are taken alike. The same input gives the same result in every run. Sources
    without words have the target 0; an empty table gives an empty result. The number of sources is taken to be small (one row
    for each is sorted in one task); rows and hot sources are not.
    """
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights, most=most)
    new = ("size", "source_size", "target", "taken", "copies")
    keep = [c for c in docs.columns if c not in new]
    hash_, *others = free_names([*docs.columns, *new], "hash", *(f"plan_{c}" for c in plan.columns))
    name = dict(zip(plan.columns, others, strict=True))
    named = plan.select(*(F.col(c).alias(n) for c, n in name.items()))
    joined = docs.select(*keep, text_size(text_col).alias("size"), row_hash(id_col, text_col).alias(hash_)).join(named, F.col(source_col).eqNullSafe(F.col(name["of"])))
    copies = (F.col(name["whole"]) + F.when(F.col(hash_) < F.col(name["below"]), 1).otherwise(0)).cast("long")
    return joined.select(*keep, "size", F.col(name["source_size"]).alias("source_size"), F.col(name["target"]).alias("target"), (copies * F.col("size")).alias("taken"), copies.alias("copies"))
