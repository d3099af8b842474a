"""Queries of the store diagnostics over the test tables, with the SQL that they are checked against.

The tables of a store are views of the test tables; the text of each view is read by Spark and by the checking engine alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import diagnostics
from .catalogue import register

BASE = "nation customer supplier part orders lineitem events".split()
VIEWS = {
    "wp_posts": """
        SELECT p_partkey + 1 AS "ID", 'product' AS post_type,
            CASE p_partkey % 8 WHEN 0 THEN 'draft' WHEN 1 THEN 'pending' WHEN 2 THEN 'private' WHEN 3 THEN 'trash' WHEN 4 THEN 'auto-draft' ELSE 'publish' END AS post_status,
            CASE WHEN p_partkey % 9 = 0 THEN p_name || ' 🍓' ELSE p_name END AS post_title,
            replace(p_name, ' ', '-') || CASE WHEN p_partkey % 11 = 0 THEN '-2' WHEN p_partkey % 13 = 0 THEN '__trashed' ELSE '' END AS post_name,
            '20' || (10 + p_partkey % 15) || '-01-02' AS post_date, '20' || (10 + p_partkey % 15) || '-03-04' AS post_modified,
            p_partkey % 40 AS post_author, 0 AS post_parent, '' AS post_mime_type, 'http://store/?p=' || p_partkey AS guid,
            CASE WHEN p_partkey % 7 = 0 THEN p_type || ' ☂' ELSE p_type END AS post_content, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END AS post_excerpt FROM part
        UNION ALL SELECT 200000000 + p_partkey, 'product_variation', CASE WHEN p_partkey % 4 = 0 THEN 'private' ELSE 'publish' END, p_name, 'v', '2020-01-02', '2020-01-03', 1,
            CASE WHEN p_partkey % 5 = 0 THEN 999999999 ELSE p_partkey + 1 END, '', 'v', '', '' FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT 300000000 + o_orderkey, 'attachment', 'inherit', 'file', 'file', '' || CAST(o_orderdate AS DATE), '' || CAST(o_orderdate AS DATE), 1,
            CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 9 = 0 THEN 888888888 ELSE o_custkey + 1 END,
            CASE WHEN o_orderkey % 5 = 0 THEN 'application/pdf' ELSE 'image/png' END, 'http://store/f/' || o_orderkey, '', '' FROM orders
        UNION ALL SELECT 400000000 + c_custkey, 'revision', 'inherit', c_name, 'r', '2020-01-02', '2020-01-03', 1, c_custkey, '', 'r', '', '' FROM customer
        UNION ALL SELECT 500000000 + o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'shop_order' ELSE 'shop_order_placehold' END, o_orderstatus, 'order', 'o',
            '' || CAST(o_orderdate AS DATE), '' || CAST(o_orderdate AS DATE), 1, 0, '', 'o', '', '' FROM orders WHERE o_orderkey % 3 = 0""",
    "wp_postmeta": """
        SELECT p_partkey + 1 AS post_id, '_sku' AS meta_key, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_brand || '-' || (p_size % 10) END AS meta_value FROM part
        UNION ALL SELECT p_partkey + 1, '_stock', CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '' || p_size END FROM part
        UNION ALL SELECT p_partkey + 1, '_stock_status', CASE WHEN p_size > 25 THEN 'instock' ELSE 'outofstock' END FROM part WHERE p_partkey % 14 <> 0
        UNION ALL SELECT p_partkey + 1, '_manage_stock', 'yes' FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT p_partkey + 1, '_backorders', CASE WHEN p_size > 40 THEN 'notify' ELSE 'no' END FROM part
        UNION ALL SELECT p_partkey + 1, '_low_stock_amount', '' || (p_size % 5) FROM part WHERE p_partkey % 4 = 0
        UNION ALL SELECT p_partkey + 1, '_regular_price', '' || (p_size * 10) FROM part
        UNION ALL SELECT p_partkey + 1, '_regular_price', '' || (p_size * 9) FROM part WHERE p_partkey % 20 = 0
        UNION ALL SELECT p_partkey + 1, '_weight', '' || p_size FROM part WHERE p_partkey % 2 = 0
        UNION ALL SELECT p_partkey + 1, '_thumbnail_id', CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN 'none' ELSE '' || (300000000 + p_partkey * 7) END FROM part WHERE p_partkey % 15 <> 0
        UNION ALL SELECT p_partkey + 1, '_product_image_gallery', (300000000 + p_partkey * 5) || ',' || (300000000 + p_partkey * 5 + 1) || ',x' FROM part WHERE p_partkey % 2 = 0
        UNION ALL SELECT p_partkey + 1, '_product_image_gallery', '' FROM part WHERE p_partkey % 2 = 1
        UNION ALL SELECT p_partkey + 1, '_dp_original', CASE WHEN p_partkey % 34 = 0 THEN 'gone' ELSE '' || (p_partkey - 5) END FROM part WHERE p_partkey % 17 = 0
        UNION ALL SELECT p_partkey + 1, '_edit_last', '' || (p_partkey % 37) FROM part WHERE p_partkey % 5 <> 0
        UNION ALL SELECT p_partkey + 1, '_wp_trash_meta_time', '' || (1700000000 + p_partkey) FROM part WHERE p_partkey % 8 = 3
        UNION ALL SELECT 777000000 + p_partkey, '_sku', 'lost' FROM part WHERE p_partkey % 50 = 0""",
    "wp_users": """SELECT c_custkey AS "ID", c_name AS user_login FROM customer WHERE c_mktsegment <> 'BUILDING'""",
    "wp_terms": "SELECT c_custkey AS term_id, c_mktsegment || ' ' || c_custkey AS name FROM customer",
    "wp_term_taxonomy": "SELECT 5000 + c_custkey AS term_taxonomy_id, c_custkey AS term_id, CASE c_custkey % 4 WHEN 0 THEN 'product_cat' WHEN 1 THEN 'product_tag' WHEN 2 THEN 'product_brand' ELSE 'nav_menu' END AS taxonomy, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 END AS count FROM customer",
    "wp_term_relationships": "SELECT CASE WHEN l_orderkey % 31 = 0 THEN 999000000 ELSE l_partkey + 1 END AS object_id, 5000 + l_orderkey % 200 AS term_taxonomy_id FROM lineitem WHERE l_linenumber = 1",
    "wp_comments": """SELECT event_id % 5000 AS "comment_post_ID" FROM events""",
    "wp_wc_product_meta_lookup": """
        SELECT p_partkey + 1 AS product_id, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand || '-' || (p_size % 10) END AS sku,
            CAST(CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN p_size + 1 ELSE p_size END AS DECIMAL(19, 4)) AS stock_quantity,
            CASE WHEN p_size > 26 THEN 'instock' ELSE 'outofstock' END AS stock_status FROM part WHERE p_partkey % 12 <> 0
        UNION ALL SELECT 666000000 + p_partkey, 'lost', NULL, 'instock' FROM part WHERE p_partkey % 60 = 0""",
    "wp_wc_order_product_lookup": "SELECT CASE WHEN l_linenumber > 5 THEN 555000000 + l_partkey % 25 ELSE l_partkey + 1 END AS product_id, '' || CAST(l_shipdate AS DATE) AS date_created FROM lineitem",
    "wp_woocommerce_order_itemmeta": "SELECT '_product_id' AS meta_key, CASE WHEN l_linenumber > 5 THEN '' || (555000000 + l_partkey % 25) WHEN l_linenumber = 5 THEN 'none' ELSE '' || (l_partkey + 1) END AS meta_value FROM lineitem UNION ALL SELECT '_qty', '1' FROM lineitem",
    "wp_options": "SELECT CASE event_id % 5 WHEN 0 THEN '_transient_' WHEN 1 THEN '_site_transient_' ELSE 'transient' END || event_id AS option_name, CASE event_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'auto-on' ELSE 'no' END AS autoload, props AS option_value FROM events",
    "wp_actionscheduler_actions": "SELECT o_orderpriority AS status FROM orders",
    "wp_actionscheduler_logs": "SELECT l_linenumber AS n FROM lineitem",
    "information_schema.tables": "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'shop' ELSE 'other' END AS table_schema, n_name AS table_name, n_nationkey * 3000000 AS data_length, n_nationkey * 1000000 AS index_length, n_nationkey * 7 AS table_rows FROM nation",
}


def store(t: Callable[[str], DataFrame]) -> Callable[[str], DataFrame]:
    """A reader of the store's tables from a reader of the test tables."""

    def read(name: str) -> DataFrame:
        base = {b: t(b) for b in BASE if f" {b}" in VIEWS[name]}
        text = VIEWS[name].replace('"', "`")
        for b in base:
            text = text.replace(f"FROM {b}", f"FROM {{{b}}}")
        return next(iter(base.values())).sparkSession.sql(text, **base)

    return read


def _with_views(sql: str) -> str:
    """The SQL with the views that it names."""
    named = [v for v in VIEWS if v.rpartition(".")[2] in sql]
    return "WITH " + ", ".join(f"{v.replace('information_schema.tables', 'schema_tables')} AS ({VIEWS[v]})" for v in named) + sql.replace("information_schema.tables", "schema_tables")


_LISTED = """string_agg("ID"::VARCHAR || ':' || coalesce(post_status, ''), ', ' ORDER BY "ID") AS """
_PIVOT = lambda keys: ", ".join(f"max(CASE WHEN meta_key = '{k}' THEN meta_value END) AS {n}" for n, k in keys.items())
_EMOJI = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"
_GONE_LINES = """ SELECT product_id, count(*) AS order_lines, min(date_created) AS first_sale, max(date_created) AS last_sale FROM wp_wc_order_product_lookup
    WHERE product_id NOT IN (SELECT "ID" FROM wp_posts) GROUP BY 1"""

#: Name of the query, the operator, its SQL.
DIAGNOSTICS = {
    "store_id_consumers": (diagnostics.id_consumers, """ SELECT post_type, post_status, count(*) AS n, min("ID") AS min_id, max("ID") AS max_id FROM wp_posts GROUP BY 1, 2"""),
    "store_product_status": (diagnostics.product_status, " SELECT post_type, post_status, count(*) AS n FROM wp_posts WHERE post_type IN ('product', 'product_variation') GROUP BY 1, 2"),
    "store_unpublished": (diagnostics.unpublished, """
        SELECT "ID", post_status, post_title, post_name, post_date, post_modified, user_login AS author,
            (SELECT meta_value FROM wp_postmeta WHERE post_id = p."ID" AND meta_key = '_wp_trash_meta_time') AS trashed_at_unix,
            (SELECT meta_value FROM wp_postmeta WHERE post_id = p."ID" AND meta_key = '_sku') AS sku
        FROM wp_posts p LEFT JOIN (SELECT "ID" AS uid, user_login FROM wp_users) ON uid = post_author WHERE post_type = 'product' AND post_status <> 'publish'"""),
    "store_clones": (diagnostics.clones, """
        SELECT p."ID" AS clone_id, p.post_status AS clone_status, p.post_title AS clone_title, meta_value AS original_id, o.post_status AS original_status, o.post_title AS original_title
        FROM wp_posts p JOIN wp_postmeta ON post_id = p."ID" AND meta_key = '_dp_original' LEFT JOIN wp_posts o ON o."ID" = try_cast(meta_value AS BIGINT)
        WHERE p.post_type IN ('product', 'product_variation')"""),
    "store_duplicate_skus": (diagnostics.duplicate_skus, f"""
        SELECT meta_value AS sku, count(*) AS n, {_LISTED} products FROM wp_postmeta JOIN wp_posts ON post_id = "ID"
        WHERE meta_key = '_sku' AND meta_value <> '' AND post_type IN ('product', 'product_variation') GROUP BY 1 HAVING count(*) > 1"""),
    "store_duplicate_titles": (diagnostics.duplicate_titles, f" SELECT post_title, count(*) AS n, {_LISTED} products FROM wp_posts WHERE post_type = 'product' AND post_status <> 'auto-draft' GROUP BY 1 HAVING count(*) > 1"),
    "store_collided_slugs": (diagnostics.collided_slugs, r""" SELECT "ID", post_status, post_name, post_title FROM wp_posts WHERE post_type = 'product' AND (contains(post_name, '__trashed') OR regexp_matches(post_name, '-[0-9]+$'))"""),
    "store_orphan_counts": (diagnostics.orphan_counts, """
        SELECT 'postmeta without post' AS check_name, count(*) AS n FROM wp_postmeta WHERE post_id NOT IN (SELECT "ID" FROM wp_posts)
        UNION ALL SELECT 'term_relationships without post', count(*) FROM wp_term_relationships WHERE object_id NOT IN (SELECT "ID" FROM wp_posts)
        UNION ALL SELECT 'variations without parent product', count(*) FROM wp_posts WHERE post_type = 'product_variation' AND post_parent NOT IN (SELECT "ID" FROM wp_posts)
        UNION ALL SELECT 'attachments whose parent was deleted', count(*) FROM wp_posts WHERE post_type = 'attachment' AND post_parent <> 0 AND post_parent NOT IN (SELECT "ID" FROM wp_posts)
        UNION ALL SELECT 'comments/reviews without post', count(*) FROM wp_comments WHERE "comment_post_ID" NOT IN (SELECT "ID" FROM wp_posts)"""),
    "store_images_of_unpublished": (diagnostics.images_of_unpublished, """
        SELECT a."ID" AS attachment_id, a.guid, p."ID" AS product_id, p.post_status, p.post_title FROM wp_posts a JOIN wp_posts p ON a.post_parent = p."ID"
        WHERE a.post_type = 'attachment' AND p.post_type = 'product' AND p.post_status <> 'publish'"""),
    "store_unused_images": (diagnostics.unused_images, """
        SELECT "ID", post_date, guid FROM wp_posts WHERE post_type = 'attachment' AND post_mime_type LIKE 'image/%'
        AND "ID" NOT IN (SELECT try_cast(meta_value AS BIGINT) FROM wp_postmeta WHERE meta_key = '_thumbnail_id' AND try_cast(meta_value AS BIGINT) IS NOT NULL)
        AND "ID" NOT IN (SELECT try_cast(g AS BIGINT) FROM (SELECT unnest(string_split(meta_value, ',')) AS g FROM wp_postmeta WHERE meta_key = '_product_image_gallery') WHERE try_cast(g AS BIGINT) IS NOT NULL)"""),
    "store_featured_images": (diagnostics.featured_image_problems, """
        SELECT "ID", post_status, post_title, meta_value AS thumbnail_id, 'thumbnail missing in wp_posts' AS problem FROM wp_posts JOIN wp_postmeta ON post_id = "ID" AND meta_key = '_thumbnail_id'
        WHERE post_type = 'product' AND NOT EXISTS (SELECT 1 FROM wp_posts a WHERE a."ID" = try_cast(meta_value AS BIGINT))
        UNION ALL SELECT "ID", post_status, post_title, NULL, 'no featured image' FROM wp_posts LEFT JOIN wp_postmeta ON post_id = "ID" AND meta_key = '_thumbnail_id'
        WHERE post_type = 'product' AND post_status IN ('publish', 'draft', 'pending', 'private') AND (meta_value IS NULL OR meta_value IN ('', '0'))"""),
    "store_galleries": (diagnostics.galleries, """
        SELECT "ID", post_status, post_title, meta_value AS gallery_ids FROM wp_posts JOIN wp_postmeta ON post_id = "ID" AND meta_key = '_product_image_gallery' WHERE post_type = 'product' AND meta_value <> ''"""),
    "store_lookup_presence": (diagnostics.lookup_presence, """
        SELECT 'published product missing in lookup' AS check_name, "ID", post_title FROM wp_posts WHERE post_type IN ('product', 'product_variation') AND post_status = 'publish' AND "ID" NOT IN (SELECT product_id FROM wp_wc_product_meta_lookup)
        UNION ALL SELECT 'lookup row for deleted post', product_id, NULL FROM wp_wc_product_meta_lookup WHERE product_id NOT IN (SELECT "ID" FROM wp_posts)"""),
    "store_lookup_values": (diagnostics.lookup_values, f""", m AS (SELECT post_id, {_PIVOT({"meta_sku": "_sku", "meta_stock": "_stock", "meta_status": "_stock_status"})} FROM wp_postmeta GROUP BY 1)
        SELECT "ID", post_title, sku AS lookup_sku, meta_sku, stock_quantity AS lookup_stock, meta_stock, stock_status AS lookup_status, meta_status
        FROM wp_wc_product_meta_lookup JOIN wp_posts ON "ID" = product_id LEFT JOIN m ON post_id = "ID" WHERE post_type IN ('product', 'product_variation') AND (coalesce(sku, '') <> coalesce(meta_sku, '')
        OR coalesce(stock_status, '') <> coalesce(meta_status, '') OR coalesce(stock_quantity, -999999) <> coalesce(try_cast(meta_stock AS DECIMAL(19, 4)), -999999))"""),
    "store_stock_settings": (diagnostics.stock_settings, f""", m AS (SELECT post_id, {_PIVOT(diagnostics.STOCK_KEYS)} FROM wp_postmeta GROUP BY 1)
        SELECT "ID", post_title, {", ".join(diagnostics.STOCK_KEYS)} FROM wp_posts LEFT JOIN m ON post_id = "ID" WHERE post_type = 'product' AND post_status = 'publish'"""),
    "store_empty_terms": (diagnostics.empty_terms, """
        SELECT taxonomy, tt.term_id, name, count, string_agg(CASE WHEN "ID" IS NOT NULL THEN "ID"::VARCHAR || ':' || coalesce(post_status, '') END, ', ' ORDER BY "ID") AS linked_posts
        FROM wp_term_taxonomy tt JOIN wp_terms t ON t.term_id = tt.term_id LEFT JOIN wp_term_relationships r ON r.term_taxonomy_id = tt.term_taxonomy_id LEFT JOIN wp_posts ON "ID" = object_id
        WHERE taxonomy IN ('product_cat', 'product_tag', 'product_brand') AND count = 0 GROUP BY tt.term_taxonomy_id, taxonomy, tt.term_id, name, count"""),
    "store_orders_of_deleted": (diagnostics.orders_of_deleted, _GONE_LINES),
    "store_order_items_of_deleted": (diagnostics.order_items_of_deleted, """
        SELECT meta_value AS product_id, count(*) AS order_lines FROM wp_woocommerce_order_itemmeta
        WHERE meta_key = '_product_id' AND NOT EXISTS (SELECT 1 FROM wp_posts WHERE "ID" = try_cast(meta_value AS BIGINT)) GROUP BY 1"""),
    "store_authors": (diagnostics.authors, """ SELECT post_status, user_login AS author, count(*) AS n FROM wp_posts p LEFT JOIN wp_users u ON u."ID" = post_author WHERE post_type = 'product' GROUP BY 1, 2"""),
    "store_last_editors": (diagnostics.last_editors, """
        SELECT user_login AS last_editor, post_status, count(*) AS n FROM wp_posts p JOIN wp_postmeta ON post_id = p."ID" AND meta_key = '_edit_last' LEFT JOIN wp_users u ON u."ID" = try_cast(meta_value AS BIGINT)
        WHERE post_type = 'product' GROUP BY 1, 2"""),
    "store_emoji_flags": (diagnostics.emoji_flags, f"""
        SELECT "ID", post_status, post_title, regexp_matches(post_title, '{_EMOJI}')::INTEGER AS emoji_in_title, regexp_matches(post_content, '{_EMOJI}')::INTEGER AS emoji_in_description,
            regexp_matches(post_excerpt, '{_EMOJI}')::INTEGER AS emoji_in_short_description FROM wp_posts WHERE post_type = 'product' AND post_status <> 'auto-draft'"""),
    "store_weights": (diagnostics.weights, """
        SELECT 'revisions' AS item, count(*)::DOUBLE AS n FROM wp_posts WHERE post_type = 'revision' UNION ALL SELECT 'auto-drafts (IDs reserved by "Add new" clicks)', count(*) FROM wp_posts WHERE post_status = 'auto-draft'
        UNION ALL SELECT 'trash (all types)', count(*) FROM wp_posts WHERE post_status = 'trash'
        UNION ALL SELECT 'transients', count(*) FROM wp_options WHERE starts_with(option_name, '_transient_') OR starts_with(option_name, '_site_transient_')
        UNION ALL SELECT 'autoloaded options (KB)', round(sum(strlen(option_value)) / 1024) FROM wp_options WHERE autoload IN ('yes', 'on', 'auto', 'auto-on')"""),
    "store_scheduler": (diagnostics.scheduler, " SELECT status, count(*) AS n FROM wp_actionscheduler_actions GROUP BY 1"),
    "store_scheduler_log": (diagnostics.scheduler_log, " SELECT count(*) AS action_scheduler_log_rows FROM wp_actionscheduler_logs"),
    "store_table_sizes": (lambda t: diagnostics.table_sizes(t, "shop"), """
        SELECT table_name, round((data_length + index_length) / 1024 / 1024, 2) AS size_mb, table_rows FROM information_schema.tables WHERE table_schema = 'shop' ORDER BY data_length + index_length DESC LIMIT 25"""),
    "store_order_posts": (diagnostics.order_posts, """ SELECT post_type, post_status, count(*) AS n, min("ID") AS min_id, max("ID") AS max_id FROM wp_posts WHERE post_type IN ('shop_order', 'shop_order_placehold', 'shop_order_refund') GROUP BY 1, 2"""),
    "store_full_export": (diagnostics.full_export, f""", m AS (SELECT post_id, {_PIVOT(diagnostics.EXPORT_KEYS)} FROM wp_postmeta GROUP BY 1)
        SELECT "ID", post_status, post_date, post_modified, post_name, post_title, len(post_content) AS description_chars, len(post_excerpt) AS short_description_chars, {", ".join(diagnostics.EXPORT_KEYS)}
        FROM wp_posts LEFT JOIN m ON post_id = "ID" WHERE post_type = 'product' AND post_status <> 'auto-draft'"""),
}

for _name, (_operator, _sql) in DIAGNOSTICS.items():
    register(_name, lambda t, f=_operator: f(store(t)), _with_views(_sql), _operator.__doc__)
