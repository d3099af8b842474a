"""What is missing, what may be done, and what a sync would do, as rules over columns and tables of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .similarity import MATCH


def missing_fields(products: DataFrame, rules: DataFrame, facts: DataFrame) -> DataFrame:
    """(product_id, field, blocker): fields that the rules of a kind ask for and no verified fact gives.

    products: product_id, kind; rules: kind, field, blocker; facts: product_id, field, verified.
    """
    asked = products.join(rules, "kind")
    return asked.join(facts.where("verified").select("product_id", "field").distinct(), ["product_id", "field"], "left_anti").select("product_id", "field", "blocker")


def completeness(products: DataFrame, missing: DataFrame) -> DataFrame:
    blocked = missing.where("blocker").select("product_id").distinct().withColumn("blocked", F.lit(True))
    return products.join(blocked, "product_id", "left").select("product_id", F.coalesce("blocked", F.lit(False)).alias("blocked")).select("product_id", (~F.col("blocked")).alias("complete"))


def enforced_kind(kind: Column, folded: Column, alcoholic: str, exception: str) -> Column:
    """The alcoholic kind where its words are found and no exception is."""
    return F.when(folded.rlike(alcoholic) & ~folded.rlike(exception), "alcoholic").otherwise(kind)


def plan_create(stock: Column, when_incomplete: str = "pending") -> Column:
    return F.struct(F.lit(True).alias("ok"), F.lit("create").alias("mode"), F.lit(when_incomplete).alias("status"), F.lit(True).alias("content_updated"), stock.alias("stock"))


def plan_update(complete: Column, status: Column, has_price: Column, stock: Column, when_complete: str = "publish") -> Column:
    """Trash is refused; a live product gets only stock from an incomplete listing; a pending one with a price moves on when complete."""
    known = F.when(status.isin("publish", "pending", "draft", "private"), status).otherwise("pending")
    after = F.when((status == "pending") & complete & has_price, when_complete).otherwise(known)
    refused = status == "trash"
    null = F.lit(None)
    return F.struct(
        (~refused).alias("ok"), F.lit("update").alias("mode"), F.when(~refused, after).alias("status"), F.when(~refused, complete | (status != "publish")).alias("content_updated"), F.when(~refused, stock).otherwise(null).alias("stock")
    )


def allowed_targets(verdict: Column, candidates: Column) -> Column:
    """Ids that may be updated: sure matches where there is one, else every candidate (array of id, score)."""
    sure = F.filter(candidates, lambda c: (verdict != "match") | (c["score"] >= MATCH))
    return F.transform(sure, lambda c: c["id"])


def decision_error(verdict: Column, candidates: Column, mode: Column, target: Column) -> Column:
    """Null if the decision is allowed, else why not."""
    allowed = F.array_contains(allowed_targets(verdict, candidates), target)
    return (
        F.when(verdict.isNull(), "no duplicate check")
        .when((mode == "create") & (verdict == "match"), "exists already")
        .when((mode == "update") & ~F.coalesce(allowed, F.lit(False)), F.when(verdict == "match", "not the match").otherwise("not a candidate"))
    )


def store_changed(known: Column, fresh_verdict: Column, fresh: Column, mode: Column, target: Column) -> Column:
    """Null if the store is as it was when reviewed: known and fresh are arrays of candidate ids."""
    return (
        F.when((mode == "create") & (fresh_verdict == "match"), "a match appeared")
        .when((mode == "create") & (F.size(F.array_except(fresh, known)) > 0), "new candidates")
        .when((mode == "update") & ~F.array_contains(fresh, target), "the target is gone")
    )


def default_choice(verdict: Column, candidates: Column) -> Column:
    ids = allowed_targets(verdict, candidates)
    return F.when(verdict == "none", F.struct(F.lit("create").alias("mode"), F.lit(None).cast("long").alias("target"))).when(
        (verdict == "match") & (F.size(ids) == 1), F.struct(F.lit("update").alias("mode"), F.get(ids, F.lit(0)).cast("long").alias("target"))
    )


def merged_attributes(existing: Column, ours: Column) -> Column:
    """Existing attributes in order (global ones stay, same-named others give way to ours), then ours that are new. Both: array of
    (name, global, value); ours replace by name without case and outer blanks."""
    key = lambda x: F.lower(F.trim(x["name"]))
    local = F.filter(existing, lambda x: ~x["global"])
    names = F.transform(existing, key)
    kept = F.transform(existing, lambda x: F.when(x["global"], x).otherwise(F.coalesce(F.get(F.filter(ours, lambda o: key(o) == key(x)), F.lit(0)), x)))
    replaced = F.transform(local, key)
    return F.concat(kept, F.filter(ours, lambda o: ~F.array_contains(replaced, key(o)) & ~F.array_contains(names, key(o))))


def share_budget(lengths: Column, total: int = 64_000, least: int = 2_500) -> Column:
    """Characters for each of the sources in order: each gets what is left, but `least` stay for every one that follows."""
    def step(state: Column, n: Column) -> Column:
        after = F.size(lengths) - F.size(state["got"]) - 1
        share = F.greatest(F.least(n, state["left"] - after * least), F.least(n, F.lit(least)))
        share = F.least(share, F.greatest(state["left"], F.lit(0)))
        return F.struct((state["left"] - share).alias("left"), F.concat(state["got"], F.array(share)).alias("got"))

    start = F.struct(F.lit(total).alias("left"), F.array().cast("array<int>").alias("got"))
    return F.aggregate(lengths, start, step, lambda s: s["got"])


def merged_ids(existing: Column, ours: Column) -> Column:
    """Category or brand ids of a product and ours, each once, the existing ones first."""
    none = F.array().cast("array<long>")
    return F.array_union(F.coalesce(existing, none), F.coalesce(ours, none))


def brand_key(name: Column, fold=tx.fold_latin) -> Column:
    """Letters and digits of a folded name, by which brands meet whatever their spelling."""
    return F.regexp_replace(fold(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "")


def brand_ids(items: DataFrame, brands: DataFrame, fold=tx.fold_latin) -> DataFrame:
    """items (brand and others) with brand_id, the smallest id of a brand (id, name) with the same key; null where there is none."""
    known = brands.withColumn("__key", brand_key(F.col("name"), fold)).where("__key <> ''").groupBy("__key").agg(F.min("id").alias("brand_id"))
    return items.withColumn("__key", brand_key(F.col("brand"), fold)).join(known, "__key", "left").drop("__key")


def ids_of_names(names: Column, ids: Column) -> Column:
    """Of an array of names those ids that a map (name to id) has; names that it lacks give null."""
    return F.transform(names, lambda n: F.try_element_at(ids, n))
