"""Catalogue snapshots: JSON envelopes with a list of records, and the files that an audit writes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .work import materialize

_NAMED = "array<struct<name:string>>"
PRODUCT = (
    "id long, name string, slug string, permalink string, type string, sku string, description string, short_description string, on_sale boolean, is_purchasable boolean, "
    "low_stock_remaining int, weight string, dimensions struct<length:string,width:string,height:string>, prices struct<price:string,regular_price:string>, "
    "stock_availability struct<class:string,text:string>, images array<struct<id:long,name:string,src:string,alt:string>>, "
    f"tags {_NAMED}, brands {_NAMED}, attributes array<struct<name:string,taxonomy:string,terms:{_NAMED}>>"
)
CORE_PRODUCT = "id long, date string, modified string, product_cat array<long>, product_brand array<long>"
MEDIA = "id long, date string, slug string, post long, source_url string, mime_type string, alt_text string"
TERM = "id long, count long, description string, name string, slug string, parent long"
ID_PROBE = "hidden_product_ids array<long>, hidden_media_ids array<long>, other_type_or_permanently_deleted_ids array<long>, unresolved array<long>"


def read_snapshot(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The records of an envelope {source_urls, captured_at, count, data}; fields that a file lacks are null."""
    schema = f"source_urls array<string>, captured_at string, count long, data array<struct<{', '.join(_field(f) for f in _fields(record))}>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("data").alias("r")).select("r.*")


def loaded(rows: DataFrame) -> DataFrame:
    """rows with entities decoded and escaped closing tags plain in every text column."""
    return rows.select(*(tx.decode_entities(F.replace(F.col(c), F.lit("<\\/"), F.lit("</"))).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes))


def parquet_tables(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """A reader of the tables of a store that were extracted as parquet, one folder or file for each."""
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_tables(spark: SparkSession, url: str, **options: str) -> Callable[[str], DataFrame]:
    """A reader of the tables of a store in a database; columns and filters that a query needs are sent to it."""
    return lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _fields(record: str) -> list[str]:
    """Cut a list of columns at the commas that no bracket encloses."""
    out, depth = [""], 0
    for c in record:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def _field(column: str) -> str:
    name, _, kind = column.partition(" ")
    return f"{name}:{kind.strip()}"


def write_snapshot(rows: DataFrame, path: str, urls: list[str], captured_at: str) -> None:
    """The records as lines of JSON in `data`, and in `envelope` where they come from, when they were taken and how many there are.

    An envelope around all records would have to be written by one task.
    """
    write_json(rows, f"{path}/data")
    written = rows.sparkSession.read.schema(rows.schema).json(f"{path}/data")
    written.agg(F.array(*map(F.lit, urls)).alias("source_urls"), F.lit(captured_at).alias("captured_at"), F.count("*").alias("count")).coalesce(1).write.json(f"{path}/envelope")


def write_json(rows: DataFrame, path: str) -> None:
    """Lines of JSON with every field, also those without a value; letters stay as they are."""
    rows.write.json(path, ignoreNullFields=False)


def write_csv(rows: DataFrame, path: str) -> None:
    """Lists are joined with '; ' and nulls are empty."""
    cells = [F.array_join(F.col(c).cast("array<string>"), "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*cells).write.option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def classify_ids(spark: SparkSession, most: int, published: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, kind) of all ids from 1 to most that are not published. answers: id, product_status, media_status (HTTP codes)."""
    ids = spark.range(1, most + 1).join(published.select("id"), "id", "left_anti").join(answers, "id", "left")
    hidden = lambda c: F.col(c).isin(401, 403)
    kind = F.when(F.col("product_status") == 200, "published").when(hidden("product_status"), "hidden_product").when(F.col("product_status") != 404, "unresolved")
    kind = kind.when(F.col("media_status") == 200, "media").when(hidden("media_status"), "hidden_media").when(F.col("media_status") == 404, "other_or_deleted")
    return ids.select("id", kind.otherwise("unresolved").alias("kind"))


def _json_prefix(body: str) -> str | None:
    """The first JSON array or object that a text holds, whatever follows it."""
    for at, c in enumerate(body):
        if c in "[{":
            try:
                return body[at : json.JSONDecoder().raw_decode(body, at)[1]]
            except ValueError:
                continue
    return None


def split_payloads(blocks: DataFrame, text_col: str = "text") -> DataFrame:
    """(url, json, raw): a text of '# title' blocks with an address line each; json is the first JSON value of a block, also where
    other text follows it, and null where there is none."""
    one = blocks.select(F.explode(F.split(F.col(text_col), r"\n(?=# [^\n]*\nURL: )")).alias("block"))
    url = F.regexp_extract("block", r"(?m)^URL: (\S+)", 1)
    body = F.regexp_extract("block", r"(?s)^#[^\n]*\nURL: [^\n]*\n(.*)$", 1)
    first = F.pandas_udf(lambda s: s.map(_json_prefix, na_action="ignore"), "string")
    return one.select(url.alias("url"), first(body).alias("json"), F.trim(body).alias("raw")).where("url <> ''")


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, conflicts): a row conflicts if any of its non-empty keys is taken; the conflict names the row that has it."""
    found = None
    for k in keys:
        taken = existing.where(F.coalesce(F.col(k), F.lit("")) != "").groupBy(k).agg(F.min("id").alias("existing_id"))
        hit = incoming.join(taken, k).select("row_id", F.lit(k).alias("key"), "existing_id")
        found = hit if found is None else found.unionByName(hit)
    return incoming.join(found.select("row_id").distinct(), "row_id", "left_anti"), found


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the key kept only on the first row that has it; later ones have it in key_taken."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    ranked = rows.withColumn("__place", place)
    keep = (F.col("__place") == 1) | (F.coalesce(F.col(key), F.lit("")) == "")
    return ranked.withColumns({f"{key}_taken": F.when(~keep, F.col(key)), key: F.when(keep, F.col(key))}).drop("__place")


def get_or_create(terms: DataFrame, existing: DataFrame) -> DataFrame:
    """(slug, id) of all terms; new ones get ids after the highest, in the order of their slugs.

    New slugs are dealt into ranges and numbered in each; what stands in the ranges before is added, so no task sees them all.
    """
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = terms.select("slug").where("slug IS NOT NULL").distinct().join(existing.select("slug"), "slug", "left_anti")
    placed = materialize(fresh.repartitionByRange("slug").sortWithinPartitions("slug").select("slug", F.monotonically_increasing_id().alias("at")), "new-terms")
    range_, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.sum("n").over(Window.orderBy("range")) - F.col("n")
    ranges = placed.groupBy(range_.alias("range")).agg(F.count("*").alias("n")).select("range", before.alias("before"))  # one row for each range
    numbered = placed.join(F.broadcast(ranges), range_ == F.col("range")).join(F.broadcast(top)).select("slug", (F.col("top") + F.col("before") + place + 1).cast("long").alias("id"))
    return existing.select("slug", F.col("id").cast("long").alias("id")).unionByName(numbered)
