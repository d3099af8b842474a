"""Diagnostics of a store's relational tables.

Every function takes a function that reads a table by name and returns a DataFrame. Orphans are anti-joins, comma lists are taken
apart before they are joined, key and value rows are folded into one row in one pass, ids that are text meet numbers by try_cast
(text that is no number meets nothing, and an empty decimal is null).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_emoji

Read = Callable[[str], DataFrame]
PRODUCTS = ("product", "product_variation")
EXPORT_KEYS = {
    "sku": "_sku", "regular_price": "_regular_price", "sale_price": "_sale_price", "stock": "_stock", "stock_status": "_stock_status", "weight": "_weight", "length": "_length", "width": "_width",
    "height": "_height", "thumbnail_id": "_thumbnail_id", "gallery_ids": "_product_image_gallery", "gtin": "_global_unique_id", "cloned_from": "_dp_original",
}
STOCK_KEYS = {"manage_stock": "_manage_stock", "stock_qty": "_stock", "stock_status": "_stock_status", "backorders": "_backorders", "low_stock_amount": "_low_stock_amount"}


def _posts(t: Read, *types: str) -> DataFrame:
    posts = t("wp_posts")
    return posts.where(F.col("post_type").isin(*types)) if types else posts


def _meta(t: Read, key: str, name: str = "meta_value") -> DataFrame:
    return t("wp_postmeta").where(F.col("meta_key") == key).select("post_id", F.col("meta_value").alias(name))


def _as_id(c: str) -> Column:
    return F.col(c).try_cast("bigint")


def _listed(id_: str = "ID", status: str = "post_status") -> Column:
    """id:status of a group, by id; rows without an id are left out."""
    rows = F.array_sort(F.collect_list(F.when(F.col(id_).isNotNull(), F.struct(F.col(id_).alias("i"), F.coalesce(F.col(status), F.lit("")).alias("s")))))
    text = F.array_join(F.transform(rows, lambda r: F.concat(r["i"].cast("string"), F.lit(":"), r["s"])), ", ")
    return F.nullif(text, F.lit(""))


def _wide(t: Read, posts: DataFrame, keys: dict[str, str]) -> DataFrame:
    """posts with a column for each key, the largest value where one repeats; only the wanted keys are read and grouped."""
    wanted = t("wp_postmeta").where(F.col("meta_key").isin(*keys.values()))
    folded = wanted.groupBy("post_id").agg(*(F.max(F.when(F.col("meta_key") == k, F.col("meta_value"))).alias(n) for n, k in keys.items()))
    return posts.join(folded, posts["ID"] == folded["post_id"], "left").drop("post_id")


def id_consumers(t: Read) -> DataFrame:
    return _posts(t).groupBy("post_type", "post_status").agg(F.count("*").alias("n"), F.min("ID").alias("min_id"), F.max("ID").alias("max_id")).orderBy(F.col("n").desc())


def product_status(t: Read) -> DataFrame:
    return _posts(t, *PRODUCTS).groupBy("post_type", "post_status").agg(F.count("*").alias("n")).orderBy("post_type", "post_status")


def unpublished(t: Read) -> DataFrame:
    """Products that are not public, with author, time of deletion and SKU; more than one value of a key is an error."""
    p = _posts(t, "product").where("post_status <> 'publish'")
    one = lambda k, n: _meta(t, k).groupBy("post_id").agg(F.when(F.count("*") > 1, F.raise_error(F.lit(f"several values of {k}")).cast("string")).otherwise(F.max("meta_value")).alias(n))
    users = t("wp_users").select(F.col("ID").alias("uid"), F.col("user_login").alias("author"))
    out = p.join(users, p["post_author"] == users["uid"], "left")
    for key, name in (("_wp_trash_meta_time", "trashed_at_unix"), ("_sku", "sku")):
        out = out.join(one(key, name).withColumnRenamed("post_id", f"{name}_of"), F.col("ID") == F.col(f"{name}_of"), "left")
    return out.select("ID", "post_status", "post_title", "post_name", "post_date", "post_modified", "author", "trashed_at_unix", "sku").orderBy("ID")


def clones(t: Read) -> DataFrame:
    p, m = _posts(t, *PRODUCTS), _meta(t, "_dp_original", "original_id")
    o = _posts(t).select(F.col("ID").alias("oid"), F.col("post_status").alias("original_status"), F.col("post_title").alias("original_title"))
    linked = p.join(m, p["ID"] == m["post_id"]).join(o, _as_id("original_id") == F.col("oid"), "left")
    return linked.select(F.col("ID").alias("clone_id"), F.col("post_status").alias("clone_status"), F.col("post_title").alias("clone_title"), "original_id", "original_status", "original_title").orderBy("clone_id")


def duplicate_skus(t: Read, collation: str | None = None) -> DataFrame:
    """SKUs of several posts. Comparison is exact unless a collation is named, e.g. UNICODE_CI_AI."""
    m = _meta(t, "_sku", "sku").where("sku <> ''")
    rows = m.join(_posts(t, *PRODUCTS), F.col("post_id") == F.col("ID"))
    return _repeated(rows, "sku", collation)


def duplicate_titles(t: Read, collation: str | None = None) -> DataFrame:
    return _repeated(_posts(t, "product").where("post_status <> 'auto-draft'"), "post_title", collation)


def _repeated(rows: DataFrame, key: str, collation: str | None) -> DataFrame:
    by = F.collate(F.col(key), collation) if collation else F.col(key)
    grouped = rows.groupBy(by.alias("__by")).agg(F.min(key).alias(key), F.count("*").alias("n"), _listed().alias("products"))
    return grouped.where("n > 1").select(key, "n", "products").orderBy(F.col("n").desc(), key)


def collided_slugs(t: Read) -> DataFrame:
    slug = F.col("post_name")
    return _posts(t, "product").where(slug.like("%\\_\\_trashed%") | slug.rlike("-[0-9]+$")).select("ID", "post_status", "post_name", "post_title").orderBy("post_name")


def orphan_counts(t: Read) -> DataFrame:
    """Rows of each check whose post is gone. Equal keys are counted before the join, so a key of very many rows is one row in it, and
    the posts are read once for all checks."""
    checks = (
        ("postmeta without post", t("wp_postmeta"), "post_id"),
        ("term_relationships without post", t("wp_term_relationships"), "object_id"),
        ("variations without parent product", _posts(t, "product_variation"), "post_parent"),
        ("attachments whose parent was deleted", _posts(t, "attachment").where("post_parent <> 0"), "post_parent"),
        ("comments/reviews without post", t("wp_comments"), "comment_post_ID"),
    )
    keys = reduce(DataFrame.unionByName, (rows.select(F.lit(name).alias("check_name"), F.col(key).cast("bigint").alias("k")) for name, rows, key in checks))
    counted = keys.groupBy("check_name", "k").agg(F.count("*").alias("n"))
    gone = counted.join(_posts(t).select("ID"), F.col("k") == F.col("ID"), "left_anti").groupBy("check_name").agg(F.sum("n").alias("n"))
    names = keys.sparkSession.range(1).select(F.explode(F.array(*(F.lit(c[0]) for c in checks))).alias("check_name"))
    return names.join(gone, "check_name", "left").select("check_name", F.coalesce("n", F.lit(0)).alias("n"))


def images_of_unpublished(t: Read) -> DataFrame:
    a = _posts(t, "attachment").select(F.col("ID").alias("attachment_id"), "guid", "post_parent")
    p = _posts(t, "product").where("post_status <> 'publish'").select(F.col("ID").alias("product_id"), "post_status", "post_title")
    return a.join(p, a["post_parent"] == p["product_id"]).drop("post_parent").orderBy("product_id")


def unused_images(t: Read) -> DataFrame:
    a = _posts(t, "attachment").where(F.col("post_mime_type").startswith("image/"))
    shown = _meta(t, "_thumbnail_id").select(_as_id("meta_value").alias("k"))
    listed = _meta(t, "_product_image_gallery").select(F.explode(F.split("meta_value", ",")).alias("meta_value")).select(_as_id("meta_value").alias("k"))
    return a.join(shown.unionByName(listed), F.col("ID") == F.col("k"), "left_anti").select("ID", "post_date", "guid").orderBy("ID")


def featured_image_problems(t: Read) -> DataFrame:
    p, m = _posts(t, "product").select("ID", "post_status", "post_title"), _meta(t, "_thumbnail_id", "thumbnail_id")
    posts = _posts(t).select(F.col("ID").alias("aid"))
    broken = p.join(m, F.col("ID") == F.col("post_id")).join(posts, _as_id("thumbnail_id") == F.col("aid"), "left_anti")
    bare = p.where(F.col("post_status").isin("publish", "draft", "pending", "private")).join(m, F.col("ID") == F.col("post_id"), "left")
    bare = bare.where(F.col("thumbnail_id").isNull() | F.col("thumbnail_id").isin("", "0"))
    row = lambda df, c, problem: df.select("ID", "post_status", "post_title", c.alias("thumbnail_id"), F.lit(problem).alias("problem"))
    return row(broken, F.col("thumbnail_id"), "thumbnail missing in wp_posts").unionByName(row(bare, F.lit(None).cast("string"), "no featured image"))


def galleries(t: Read) -> DataFrame:
    m = _meta(t, "_product_image_gallery", "gallery_ids").where("gallery_ids <> ''")
    return _posts(t, "product").join(m, F.col("ID") == F.col("post_id")).select("ID", "post_status", "post_title", "gallery_ids").orderBy("ID")


def lookup_presence(t: Read) -> DataFrame:
    p, lookup = _posts(t).select("ID", "post_type", "post_status", "post_title"), t("wp_wc_product_meta_lookup").select("product_id")
    missing = p.where(F.col("post_type").isin(*PRODUCTS) & (F.col("post_status") == "publish")).join(lookup, F.col("ID") == F.col("product_id"), "left_anti")
    gone = lookup.join(p, F.col("product_id") == F.col("ID"), "left_anti")
    named = missing.select(F.lit("published product missing in lookup").alias("check_name"), "ID", "post_title")
    return named.unionByName(gone.select(F.lit("lookup row for deleted post").alias("check_name"), F.col("product_id").alias("ID"), F.lit(None).cast("string").alias("post_title")))


def lookup_values(t: Read) -> DataFrame:
    lookup = t("wp_wc_product_meta_lookup").select("product_id", F.col("sku").alias("lookup_sku"), F.col("stock_quantity").alias("lookup_stock"), F.col("stock_status").alias("lookup_status"))
    p = _posts(t, *PRODUCTS).select("ID", "post_title")
    w = _wide(t, p, {"meta_sku": "_sku", "meta_stock": "_stock", "meta_status": "_stock_status"}).join(lookup, F.col("ID") == F.col("product_id"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    amount = lambda c: F.coalesce(c, F.lit(-999999).cast("decimal(19,4)"))
    differs = (text("lookup_sku") != text("meta_sku")) | (text("lookup_status") != text("meta_status")) | (amount(F.col("lookup_stock")) != amount(F.col("meta_stock").try_cast("decimal(19,4)")))
    return w.where(differs).select("ID", "post_title", "lookup_sku", "meta_sku", "lookup_stock", "meta_stock", "lookup_status", "meta_status")


def stock_settings(t: Read) -> DataFrame:
    p = _posts(t, "product").where("post_status = 'publish'").select("ID", "post_title")
    return _wide(t, p, STOCK_KEYS).orderBy(F.col("stock_status").asc_nulls_first(), "ID")


def empty_terms(t: Read) -> DataFrame:
    tt = t("wp_term_taxonomy").where(F.col("taxonomy").isin("product_cat", "product_tag", "product_brand") & (F.col("count") == 0))
    linked = tt.join(t("wp_terms"), "term_id").join(t("wp_term_relationships"), "term_taxonomy_id", "left").join(_posts(t).select("ID", "post_status"), F.col("object_id") == F.col("ID"), "left")
    return linked.groupBy("term_taxonomy_id", "taxonomy", "term_id", "name", "count").agg(_listed().alias("linked_posts")).drop("term_taxonomy_id").orderBy("taxonomy", "name")


def orders_of_deleted(t: Read) -> DataFrame:
    """Lines by product before the join: a product of very many lines is one row in it."""
    lines = t("wp_wc_order_product_lookup").groupBy("product_id").agg(F.count("*").alias("order_lines"), F.min("date_created").alias("first_sale"), F.max("date_created").alias("last_sale"))
    return lines.join(_posts(t).select("ID"), F.col("product_id") == F.col("ID"), "left_anti").orderBy(F.col("order_lines").desc())


def order_items_of_deleted(t: Read) -> DataFrame:
    """Lines by product before the join, as in orders_of_deleted; text that is no number is no post."""
    items = t("wp_woocommerce_order_itemmeta").where("meta_key = '_product_id'").groupBy(F.col("meta_value").alias("product_id")).agg(F.count("*").alias("order_lines"))
    return items.join(_posts(t).select("ID"), _as_id("product_id") == F.col("ID"), "left_anti").orderBy(F.col("order_lines").desc())


def authors(t: Read) -> DataFrame:
    users = t("wp_users").select(F.col("ID").alias("uid"), F.col("user_login").alias("author"))
    return _posts(t, "product").join(users, F.col("post_author") == F.col("uid"), "left").groupBy("post_status", "author").agg(F.count("*").alias("n")).orderBy(F.col("n").desc())


def last_editors(t: Read) -> DataFrame:
    users = t("wp_users").select(F.col("ID").alias("uid"), F.col("user_login").alias("last_editor"))
    edited = _posts(t, "product").join(_meta(t, "_edit_last"), F.col("ID") == F.col("post_id")).join(users, _as_id("meta_value") == F.col("uid"), "left")
    return edited.groupBy("last_editor", "post_status").agg(F.count("*").alias("n")).orderBy(F.col("n").desc())


def emoji_flags(t: Read) -> DataFrame:
    flags = (("post_title", "emoji_in_title"), ("post_content", "emoji_in_description"), ("post_excerpt", "emoji_in_short_description"))
    return _posts(t, "product").where(~F.col("post_status").isin("auto-draft")).select("ID", "post_status", "post_title", *(has_emoji(F.col(c)).alias(n) for c, n in flags)).orderBy("ID")


def weights(t: Read) -> DataFrame:
    """Counts of what fills the database; the posts are read once for three of them."""
    label = F.explode(F.array_compact(F.array(F.when(F.col("post_type") == "revision", "revisions"), F.when(F.col("post_status") == "auto-draft", 'auto-drafts (IDs reserved by "Add new" clicks)'), F.when(F.col("post_status") == "trash", "trash (all types)"))))
    names = F.explode(F.array(F.lit("revisions"), F.lit('auto-drafts (IDs reserved by "Add new" clicks)'), F.lit("trash (all types)")))
    counted = _posts(t).select(label.alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    all_ = t("wp_posts").sparkSession.range(1).select(names.alias("item")).join(counted, "item", "left").select("item", F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    options = t("wp_options")
    transient = options.where(F.col("option_name").like("\\_transient\\_%") | F.col("option_name").like("\\_site\\_transient\\_%")).agg(F.lit("transients").alias("item"), F.count("*").cast("double").alias("n"))
    loaded = options.where(F.col("autoload").isin("yes", "on", "auto", "auto-on")).agg(F.lit("autoloaded options (KB)").alias("item"), F.round(F.sum(F.octet_length("option_value")) / 1024).alias("n"))
    return all_.unionByName(transient).unionByName(loaded)


def scheduler(t: Read) -> DataFrame:
    return t("wp_actionscheduler_actions").groupBy("status").agg(F.count("*").alias("n"))


def scheduler_log(t: Read) -> DataFrame:
    return t("wp_actionscheduler_logs").agg(F.count("*").alias("action_scheduler_log_rows"))


def table_sizes(t: Read, schema: str) -> DataFrame:
    size = F.col("data_length") + F.col("index_length")
    rows = t("information_schema.tables").where(F.col("table_schema") == schema)
    return rows.orderBy(size.desc()).limit(25).select("table_name", F.round(size / 1024 / 1024, 2).alias("size_mb"), "table_rows")


def order_posts(t: Read) -> DataFrame:
    return _posts(t, "shop_order", "shop_order_placehold", "shop_order_refund").groupBy("post_type", "post_status").agg(F.count("*").alias("n"), F.min("ID").alias("min_id"), F.max("ID").alias("max_id"))


def full_export(t: Read) -> DataFrame:
    p = _posts(t, "product").where("post_status <> 'auto-draft'")
    p = p.select("ID", "post_status", "post_date", "post_modified", "post_name", "post_title", F.char_length("post_content").cast("long").alias("description_chars"), F.char_length("post_excerpt").cast("long").alias("short_description_chars"))
    return _wide(t, p, EXPORT_KEYS).orderBy("ID")
