"""Queries of the catalogue audit over the test tables, with the SQL that they are checked against.

A listing is a part with a title, texts, images and terms that its columns give; the text of that view is read by both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit
from ..sources.work import materialize, spread
from .catalogue import query

STORE = r"\bwidget house\b"
GENERIC, OFFERS = ("food-and-drink", "offers"), "offers"
ITEMS = """SELECT p_partkey AS id,
    p_name || CASE p_partkey % 6 WHEN 0 THEN ' Sabor Uva' WHEN 1 THEN ' sabor morango com leite' WHEN 2 THEN ' importado | novo | kpop' WHEN 3 THEN ', kpop' WHEN 4 THEN ' widget house' ELSE ' cor azul, preto' END
        || ' ' || p_size || CASE p_partkey % 4 WHEN 0 THEN 'ml' WHEN 1 THEN ' g' WHEN 2 THEN 'kg' ELSE '' END || CASE WHEN p_partkey % 21 = 0 THEN ' 🍓✨' ELSE '' END AS name,
    replace(p_name, ' ', '-') || CASE p_partkey % 7 WHEN 0 THEN '-2' WHEN 1 THEN '-copia' ELSE '' END AS slug,
    CASE WHEN p_partkey % 10 = 0 THEN ' ' ELSE p_brand || '-' || (p_size % 7) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-' || p_partkey END END AS sku,
    CASE WHEN p_partkey % 67 = 0 THEN '' ELSE '<p>Este produto e um ' || p_name || ' ' || p_size || ' muito bom para todos.</p>' || CASE WHEN p_partkey % 3 = 0 THEN '<b>Conservar em local seco e fresco depois de aberto.</b> ' ELSE '' END
        || CASE WHEN p_partkey % 5 = 0 THEN '<p>Ingredientes: leite, soja e ' || p_type || ' com muito sabor! Contem gluten e leite em po.</p>' ELSE '' END END AS description,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'Prazo de validade de ' || p_size || ' meses contados da data.' END AS short_description,
    '' || (p_size * 100) AS price, p_partkey % 5 = 0 AS on_sale, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '0.01' ELSE '' || p_size END AS weight,
    p_partkey % 997 AS image_1, CASE WHEN p_partkey % 9 = 0 THEN p_partkey % 997 ELSE 1000 + p_partkey % 991 END AS image_2,
    CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '1' END AS length, p_partkey % 3 AS cat_1, 3 + p_partkey % 2 AS cat_2, p_size AS stock FROM part"""
#: Slugs of the categories by id; the name of an image by its id.
CATEGORIES = ("food-and-drink", "offers", "toys", "offers", "stationery")
IMAGE_NAMES = ("img_12", "WhatsApp-image-7", "captura-de-tela", "cold-widget-front", "br-11134207-7r98o-lqx", "promo-black-friday", "abcdefghij")
_CATEGORY_SQL = "CASE {} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES)) + " END"
_IMAGE_SQL = f"CASE {{0}} % {len(IMAGE_NAMES)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(IMAGE_NAMES)) + " END || '-' || {0}"


def _pick(names: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), at.cast("int"))


def _image_name(k: Column) -> Column:
    return F.concat(_pick(IMAGE_NAMES, k % len(IMAGE_NAMES)), F.lit("-"), k.cast("string"))


def _products(t: Callable[[str], DataFrame]) -> DataFrame:
    """Listings as the audit reads them. The parts are dealt over all cores and written so: their texts are long beside their rows, and a
    file of a few megabytes is read by one task."""
    part = materialize(spread(t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey"), "audit-parts")
    items = part.sparkSession.sql(ITEMS.replace("FROM part", "FROM {part}"), part=part)
    image = lambda c: F.struct(F.col(c).alias("id"), _image_name(F.col(c)).alias("name"), F.lit("http://x/y.PNG").alias("src"), F.when(F.col(c) % 2 == 0, "").otherwise("alt").alias("alt"))
    named = lambda c: F.when(F.col(c).isNotNull(), F.array(F.struct(F.col(c).alias("name"))))
    terms = F.array(F.struct(F.lit("Peso").alias("name"), F.lit("").alias("taxonomy"), F.array(F.struct(F.col("weight").alias("name"))).alias("terms")))
    return items.select(
        "id", "name", "slug", F.lit("l").alias("permalink"), F.lit("simple").alias("type"), "sku", "description", "short_description", "on_sale", F.lit(True).alias("is_purchasable"), F.lit(None).cast("int").alias("low_stock_remaining"), "weight",
        F.struct("length", F.lit("1").alias("width"), F.lit(None).cast("string").alias("height")).alias("dimensions"), F.struct("price", F.col("price").alias("regular_price")).alias("prices"),
        F.struct(F.when(F.col("stock") > 10, "in-stock").otherwise("out-of-stock").alias("class"), F.lit("s").alias("text")).alias("stock_availability"), F.array(image("image_1"), image("image_2")).alias("images"),
        F.array(F.struct(F.lit("Caf&eacute;").alias("name"))).alias("tags"), named("brand").alias("brands"), terms.alias("attributes"), "cat_1", "cat_2",
    )


def _media(t: Callable[[str], DataFrame]) -> DataFrame:
    c, k = t("customer"), F.col("c_custkey")
    kind = F.when(k % 5 == 0, "-2.png").otherwise(".webp")
    return c.select(k.alias("id"), F.lit("2024-05-06T07:08:09").alias("date"), F.when(k % 4 == 0, F.lit(0)).otherwise(k * 3).cast("long").alias("post"), F.concat(F.lit("http://x/"), _image_name(k), kind).alias("source_url"), F.lit("image/png").alias("mime_type"), F.when(k % 3 == 0, " ").otherwise("a").alias("alt_text"))


def cards(t: Callable[[str], DataFrame]) -> DataFrame:
    p = _products(t)
    core = p.select("id", F.lit("2024-05-06").alias("date"), F.lit("2024-05-07").alias("modified"), F.array(F.col("cat_1").cast("long"), F.col("cat_2").cast("long")).alias("product_cat")).where("id % 30 <> 0")
    categories = p.sparkSession.range(len(CATEGORIES)).select("id", _pick(CATEGORIES, F.col("id")).alias("slug"))
    return audit.scorecard(p, core, _media(t), categories, store_name=STORE, generic_categories=GENERIC, offers=OFFERS)


_CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim({{0}})), '{p}') THEN '{n}'" for n, p in audit.IMAGE_CLASSES) + f" WHEN regexp_matches(lower(trim({{0}})), '{audit.JUNK_NAME}') OR len(trim({{0}})) <= 8 THEN 'junk_name' WHEN contains({{0}}, '-') AND len(trim({{0}})) >= 12 THEN 'descriptive' ELSE 'short_or_unclear' END"
_EMOJI = tx.EMOJI_AUDIT


def _class_sql(name: str) -> str:
    return _CLASS_SQL.replace("{0}", name)


_FLAG = lambda rules: "concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules) + ")"
_TITLE_RULES = (
    ("longer_than_70_chars", "len(name) > 70"), ("pipe_keyword_stuffing", "len(name) - len(replace(name, '|', '')) >= 2"), ("store_name_in_title", f"regexp_matches(title_f, '{STORE}')"), ("keyword_list_in_title", "regexp_matches(title_f, ',\\s*(?:koreia|kpop|coreia)')"),
    ("emoji_in_title", f"regexp_matches(name, '{_EMOJI}')"), ("ambiguous_multi_flavour_title", "regexp_matches(title_f, '\\bsabores\\b')"), ("spelling_error", "regexp_matches(title_f, 'koreia|ceral\\b')"),
)
_STRIP = "trim(regexp_replace(regexp_replace(coalesce({}, ''), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
#: Listings with their folded texts, and everything that is counted over all of them.
CARDS_SQL = f"""
    WITH items AS ({ITEMS}), texts AS (SELECT *, trim(sku) AS sku_t, {_STRIP.format("description")} AS descr, {_STRIP.format("short_description")} AS short, lower(strip_accents(name)) AS title_f FROM items),
    media AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey * 3 END AS post FROM customer),
    said AS (SELECT DISTINCT id, lower(strip_accents(trim(s))) AS f FROM (SELECT id, unnest(string_split(regexp_replace(trim(concat_ws(' ', descr, short)), '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS s FROM texts) WHERE len(trim(s)) >= 25),
    frequency AS (SELECT f, count(*) AS freq FROM said GROUP BY 1), common AS (SELECT id, avg(CASE WHEN freq >= 3 THEN 1.0 ELSE 0.0 END) AS share, count(*) FILTER (freq >= 3) AS k, count(*) AS n FROM said JOIN frequency USING (f) GROUP BY 1),
    named AS (SELECT texts.*, (SELECT max(c_custkey) FROM customer) AS top, common.k, common.n, count(*) OVER (PARTITION BY sku_t) AS same_sku, count(*) OVER (PARTITION BY image_1) AS same_image, count(*) OVER (PARTITION BY lower(strip_accents(descr))) AS same_desc,
        sha1(lower(strip_accents(descr))) AS desc_key, {_IMAGE_SQL.format("image_1")} AS name_1, {_IMAGE_SQL.format("image_2")} AS name_2,
        CASE WHEN texts.id % 30 = 0 THEN [] ELSE [{_CATEGORY_SQL.format("cat_1")}, {_CATEGORY_SQL.format("cat_2")}] END AS cats FROM texts LEFT JOIN common USING (id))"""
_TEXT_F = "lower(strip_accents(concat_ws(' ', descr, short, 'Peso: ' || weight)))"
_NET = "try_cast(replace(regexp_extract(title_f, '(\\d+(?:[.,]\\d+)?)\\s?(ml|g|kg)\\b', 1), ',', '.') AS DOUBLE) * CASE WHEN regexp_extract(title_f, '(\\d+(?:[.,]\\d+)?)\\s?(ml|g|kg)\\b', 2) = 'kg' THEN 1000 ELSE 1 END"
_SHOWN = "CASE WHEN image_1 = image_2 THEN {a} ELSE {a} || ',' || {b} END"


@query(CARDS_SQL + f"""
    SELECT id, name, sku_t AS sku, sku_t = '' AS sku_missing, sku_t <> '' AND same_sku > 1 AS sku_duplicated, stock <= 10 AS out_of_stock, CASE WHEN image_1 = image_2 THEN 1 ELSE 2 END AS images_count, CASE WHEN image_1 = image_2 THEN 1 ELSE 0 END AS images_repeated_entries,
        {_SHOWN.format(a=_class_sql("name_1"), b=_class_sql("name_2"))} AS image_name_classes, (CASE WHEN image_1 % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN image_2 % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS images_alt_empty,
        same_image > 1 AS featured_image_shared, len(descr) AS description_chars, CASE WHEN descr = '' THEN 0 ELSE len(string_split(descr, ' ')) END AS description_words, descr = '' AS description_missing, descr <> '' AND len(string_split(descr, ' ')) < 60 AS description_thin,
        short = '' AS short_description_missing, descr <> '' AND same_desc > 1 AS description_identical, k, n, round_even(k::DOUBLE / n, 2) AS boilerplate_ratio, len(regexp_extract_all(name, '{_EMOJI}')) AS emoji_title, {_FLAG(_TITLE_RULES)} AS title_flags,
        {_FLAG((("numeric_suffix(slug_collision)", "regexp_matches(slug, '-[0-9]+$')"), ("copy_marker", "regexp_matches(slug, 'copia|copy|duplicad')"), ("too_long", "len(slug) > 75")))} AS slug_flags,
        array_to_string(cats, ',') AS categories, len(cats) > 0 AND len(list_filter(cats, lambda c: c NOT IN ('food-and-drink', 'offers'))) = 0 AS only_generic_categories, list_contains(cats, 'offers') AND NOT on_sale AS in_offers_category_without_sale,
        brand IS NULL AS brand_missing, try_cast(weight AS DOUBLE) AS weight_kg, weight = '' AS weight_missing, CASE WHEN length = '' THEN 'length,height' ELSE 'height' END AS dimensions_missing, {_NET} AS net_content,
        coalesce(try_cast(weight AS DOUBLE) * 1000 < {_NET} * 0.9, false) AS weight_below_net_content, {", ".join(f"regexp_matches({_TEXT_F}, '{p}') AS has_{c}" for c, p in audit.CHECKS.items())}
    FROM named""")
def audit_scorecard(t):
    """Each listing's checks, with its sentences, the common ones among them and their share to two places."""
    rows = cards(t)
    joined = lambda x: F.array_join(x, ",")
    return rows.select(
        "id", "name", "sku", "sku_missing", "sku_duplicated", (F.col("stock_class") == "out-of-stock").alias("out_of_stock"), "images_count", "images_repeated_entries", joined("image_name_classes").alias("image_name_classes"), "images_alt_empty",
        F.col("featured_image_shared_with_other_products").alias("featured_image_shared"), F.col("description_chars").cast("long").alias("description_chars"), F.col("description_words").cast("long").alias("description_words"), "description_missing", "description_thin",
        "short_description_missing", F.col("description_identical_to_other_product").alias("description_identical"), F.col("sentences_common").alias("k"), F.col("sentences").alias("n"), "boilerplate_ratio",
        F.col("emoji_title").cast("long").alias("emoji_title"), F.array_join("title_flags", ";").alias("title_flags"), F.array_join("slug_flags", ";").alias("slug_flags"), joined("categories").alias("categories"), "only_generic_categories", "in_offers_category_without_sale",
        "brand_missing", "weight_kg", "weight_missing", joined("dimensions_missing").alias("dimensions_missing"), F.col("net_content_from_title_g_or_ml").alias("net_content"), "weight_below_net_content", *(f"has_{x}" for x in audit.CHECKS),
    )


@query(CARDS_SQL + """
    SELECT id, array_to_string(list_transform(list_filter(CASE WHEN image_1 = image_2 THEN [image_1] ELSE [image_1, image_2] END, lambda i: i <= top AND CASE WHEN i % 4 = 0 THEN 0 ELSE i * 3 END <> id), lambda i: i::VARCHAR), ',') AS images
    FROM named WHERE len(list_filter(CASE WHEN image_1 = image_2 THEN [image_1] ELSE [image_1, image_2] END, lambda i: i <= top AND CASE WHEN i % 4 = 0 THEN 0 ELSE i * 3 END <> id)) > 0""")
def audit_foreign_images(t):
    """Listings that show images which were uploaded for another post."""
    return cards(t).where(F.size("images_owned_by_other_post") > 0).select("id", F.array_join(F.col("images_owned_by_other_post").cast("array<string>"), ",").alias("images"))


_WORDS = "list_distinct(list_filter(string_split(regexp_replace({}, '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: len(w) > 1))"
_CORE = _WORDS.format(f"regexp_replace(regexp_replace(title_f, '{STORE}', ' ', 'g'), '{tx.GENERIC_PHRASES}', ' ', 'g')")
_VARIANT = r"regexp_extract(name, '(?i)\b(?:sabor(?:es)?|cor)\b\s+([^|,]+)', 1)"
_PAIRS_SQL = CARDS_SQL + f""", c AS (SELECT id, sku_t AS sku, desc_key, list_distinct([name_1, name_2]) AS files, {_CORE} AS core,
        CASE WHEN {_VARIANT} = '' THEN [] ELSE {_WORDS.format(f"regexp_replace(lower({_VARIANT}), '{tx.VARIANT_NOISE}', ' ', 'g')")} END AS vt FROM named),
    s AS (SELECT a.id AS a, b.id AS b, coalesce(len(list_intersect(a.core, b.core))::DOUBLE / nullif(len(list_distinct(list_concat(a.core, b.core))), 0), 0) AS sim, (len(a.vt) = 0 AND len(b.vt) = 0) OR len(list_intersect(a.vt, b.vt)) > 0 AS fits, len(a.vt) + len(b.vt) > 0 AS either,
        a.sku <> '' AND a.sku = b.sku AS same_sku, a.desc_key = b.desc_key AS same_desc, len(list_intersect(a.files, b.files)) AS shared FROM c a JOIN c b ON a.id < b.id),
    p AS (SELECT *, sim >= 0.5 AND fits AND (either OR sim >= 0.75) AS strong FROM s)"""


@query(_PAIRS_SQL + " SELECT a, b, sim AS title_similarity, fits AS variant_compatible, strong AS likely_same_item, shared AS shared_image_files, same_sku, same_desc AS identical_description FROM p WHERE strong OR shared > 0 OR same_sku OR same_desc")
def audit_duplicate_pairs(t):
    """Pairs of listings that share title words, an image file, a SKU or a description."""
    pairs = audit.duplicate_pairs(cards(t), STORE, details=False)
    return pairs.select("a", "b", "title_similarity", "variant_compatible", "likely_same_item", F.size("shared_image_files").cast("long").alias("shared_image_files"), "same_sku", "identical_description")


@query(_PAIRS_SQL.replace("WITH items", "WITH RECURSIVE items") + """, e AS (SELECT a, b FROM p WHERE strong UNION ALL SELECT b, a FROM p WHERE strong), r(id, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
    , m AS (SELECT id, min(root) AS cluster FROM r GROUP BY 1) SELECT cluster, count(*) AS size, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM m GROUP BY 1""")
def audit_clusters(t):
    """Listings that strong pairs connect; groups with one SKU, file or description are paired with their first listing only."""
    found = audit.duplicate_clusters(audit.duplicate_pairs(cards(t), STORE, stars=True, details=False))
    return found.select("cluster", "size", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


_KEY = "array_to_string(list_sort(" + _WORDS.format(f"regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(name, '{tx.VARIANT}', ' ', 'g'))), '{STORE}', ' ', 'g'), '{tx.GENERIC_PHRASES}', ' ', 'g')") + "), ' ')"


@query(CARDS_SQL + f" SELECT family_key, string_agg(id::VARCHAR, ',' ORDER BY id) AS product_ids, string_agg(DISTINCT stock::VARCHAR, ',' ORDER BY stock::VARCHAR) AS prices FROM (SELECT id, stock, {_KEY} AS family_key FROM named) GROUP BY 1 HAVING count(*) > 1")
def audit_variant_families(t):
    """Listings that are one but for their variant, with their different prices (in whole units)."""
    found = audit.variant_families(cards(t), store_name=STORE)
    price = F.array_sort(F.transform("prices", lambda x: x.cast("long").cast("string")))
    return found.select("family_key", F.array_join(F.col("product_ids").cast("array<string>"), ",").alias("product_ids"), F.array_join(price, ",").alias("prices"))


_TERMS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' || (c_custkey % 50) || ' ml' ELSE lower(c_mktsegment) || CASE c_custkey % 4 WHEN 0 THEN 's' WHEN 1 THEN '' WHEN 2 THEN ' ' || (c_custkey % 70) ELSE 'x' || c_custkey END END AS name, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS count, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'd' END AS description, CASE WHEN c_custkey = 9 THEN 4 ELSE 0 END AS parent FROM customer"


def _terms(t: Callable[[str], DataFrame]) -> DataFrame:
    c = t("customer")
    return c.sparkSession.sql(_TERMS.replace("FROM customer", "FROM {customer}"), customer=c).withColumn("pos", F.col("id"))


@query(f"WITH t AS ({_TERMS}), x AS (SELECT id, name, rtrim(name, 's') AS r FROM t) SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.id < b.id WHERE a.r = b.r OR (len(a.r) > 3 AND (contains(a.r, b.r) OR contains(b.r, a.r)) AND abs(len(a.r) - len(b.r)) <= 9)")
def audit_term_pairs(t):
    """Terms that nearly repeat each other."""
    return audit.term_pairs(_terms(t)).select("a", "b")


@query(f"""WITH t AS ({_TERMS}), b AS (SELECT DISTINCT lower(p_brand) AS n FROM part UNION SELECT 'machinery'), c AS (SELECT n_name AS n FROM nation UNION SELECT 'buildings')
    SELECT id, name, count = 0 AS orphan, regexp_matches(name, '{audit.SIZE_TAG}') AS size_tag, name IN (SELECT n FROM b) AS duplicates_brand, name IN (SELECT lower(n) FROM c) OR name || 's' IN (SELECT lower(n) FROM c) AS duplicates_category FROM t""")
def audit_tag_checks(t):
    """What is wrong with each tag."""
    spark = t("part").sparkSession
    one = lambda n: spark.range(1).select(F.lit(n).alias("name"))
    brands = t("part").select(F.col("p_brand").alias("name")).distinct().unionByName(one("machinery"))
    return audit.tag_checks(_terms(t), brands, t("nation").select(F.col("n_name").alias("name")).unionByName(one("buildings")))


@query(f"WITH t AS ({_TERMS}) SELECT count(*) AS total, count(*) FILTER (count > 0) AS used, count(*) FILTER (count = 0) AS empty, count(*) FILTER (coalesce(description, '') = '') AS without_description, coalesce(bool_or(coalesce(parent, 0) <> 0), false) AS hierarchical FROM t")
def audit_taxonomy_totals(t):
    return audit.taxonomy_totals(_terms(t))


@query(CARDS_SQL + " SELECT x || ' + ' || y AS pair, count(*) AS n FROM (SELECT list_sort(cats)[1] AS x, list_sort(cats)[2] AS y FROM named WHERE len(cats) = 2) GROUP BY 1")
def audit_category_overlap(t):
    return audit.category_overlap(cards(t))


_MEDIA_ROWS = CARDS_SQL + f""", f AS (SELECT c_custkey AS id, {_IMAGE_SQL.format("c_custkey")} AS bare, CASE WHEN c_custkey % 5 = 0 THEN '-2.png' ELSE '.webp' END AS kind, c_custkey FROM customer),
    u AS (SELECT DISTINCT image_1 AS mid, id FROM items UNION SELECT image_2, id FROM items), m AS (SELECT mid, count(*) AS users FROM u GROUP BY 1),
    r AS (SELECT f.id, bare || kind AS file, coalesce(users, 0) AS users, {_class_sql("CASE WHEN c_custkey % 5 = 0 THEN bare || '-2' ELSE bare END")} AS name_class, c_custkey % 3 = 0 AS alt_empty, regexp_matches(bare || kind, '-[0-9]+\\.(?:png|jpe?g|webp|gif)$') AS reupload_suffix, c_custkey % 4 = 0 AS loose FROM f LEFT JOIN m ON mid = f.id)"""


@query(_MEDIA_ROWS + " SELECT id, file, users, name_class, alt_empty, reupload_suffix FROM r")
def audit_media(t):
    """Each file, and by how many listings it is shown."""
    rows = audit.media_audit(_media(t), _products(t))
    return rows.select("id", "file", F.size("used_by_published_products").cast("long").alias("users"), "name_class", "alt_empty", "reupload_suffix")


@query(_MEDIA_ROWS + " SELECT 5000::BIGINT AS total_in_database, count(*) AS visible_publicly, 5000 - count(*) AS hidden, count(*) FILTER (loose) AS unattached, count(*) FILTER (users = 0) AS unused, count(*) FILTER (users > 1) AS used_by_several, count(*) FILTER (alt_empty) AS alt_empty, count(*) FILTER (reupload_suffix) AS reuploads FROM r")
def audit_media_totals(t):
    return audit.media_totals(audit.media_audit(_media(t), _products(t)), F.lit(5000).cast("long"))


@query(_PAIRS_SQL + f""", k AS (SELECT {_KEY} AS family_key, count(*) AS n FROM named GROUP BY 1 HAVING count(*) > 1)
    SELECT (SELECT count(*) FROM named) AS published_products, (SELECT count(*) FROM named WHERE sku_t = '') AS sku_missing, (SELECT count(*) FROM named WHERE stock <= 10) AS out_of_stock, (SELECT count(*) FROM named WHERE image_1 = image_2) AS products_with_single_image,
        (SELECT count(*) FROM named WHERE brand IS NULL) AS brand_missing, (SELECT count(*) FROM named WHERE regexp_matches(name, '{_EMOJI}')) AS products_with_emoji_in_title, (SELECT count(*) FROM named WHERE regexp_matches({_TEXT_F}, '{audit.CHECKS["ingredients"]}')) AS with_ingredients,
        (SELECT count(*) FROM p WHERE strong OR shared > 0 OR same_sku OR same_desc) AS duplicate_candidate_pairs, (SELECT count(*) FROM p WHERE strong) AS likely_duplicate_pairs,
        (SELECT count(*) FROM k) AS variant_families, (SELECT coalesce(sum(n), 0)::BIGINT FROM k) AS products_in_variant_families, round_even((SELECT 100.0 * count(*) FROM named WHERE stock <= 10)::DOUBLE / (SELECT count(*) FROM named), 1) AS pct_out_of_stock""")
def audit_summary(t):
    """The audit's totals in one row."""
    c = materialize(cards(t), "audit-cards")
    pairs, families = audit.pair_counts(c, STORE), audit.variant_families(c, store_name=STORE)
    none = c.select("id").limit(0)
    return audit.summary(c, pairs, none, families).select(
        "published_products", "sku_missing", "out_of_stock", "products_with_single_image", "brand_missing", "products_with_emoji_in_title", "with_ingredients", "duplicate_candidate_pairs", "likely_duplicate_pairs", "variant_families", "products_in_variant_families", "pct_out_of_stock"
    )


@query("SELECT day, count(*) AS n FROM (SELECT substr(o_orderdate::VARCHAR, 1, 10) AS day FROM orders) GROUP BY 1")
def audit_by_day(t):
    return audit.by_day(t("orders").withColumn("at", F.col("o_orderdate").cast("string")), "at")


@query("SELECT coalesce(o_orderpriority, '') AS key, count(*) AS n FROM orders GROUP BY 1")
def audit_histogram(t):
    return audit.histogram(t("orders"), F.col("o_orderpriority"))
