"""Queries over the test tables, one for each operator family, with the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sets
from ..functions import text as tx
from ..operators import audit, plan, similarity
from ..operators.components import connected_components
from ..operators.jobs import admitted
from ..operators.passages import passage_hits
from ..sources.work import finely, materialize, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, f: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None = None, doc: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a function of a table reader as a query, with the SQL that it is checked against."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(lambda table: _table(spark, sf_dir, table))

    run.__name__, run.__doc__ = name, doc or f.__doc__
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql
    return run


def query(sql: str | None = None):
    """Registers a query under its own name."""
    return lambda f: register(f.__name__, f, sql)


def _listed(ids: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_list(ids)).cast("array<string>"), ", ")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderkey) AS min_id, max(o_orderkey) AS max_id
    FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1, 2""")
def status_counts(t):
    """Counts and id ranges by two keys."""
    return t("orders").where(F.col("o_orderstatus").isin("F", "O", "P")).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("min_id"), F.max("o_orderkey").alias("max_id"))


@query("""SELECT sha1(text) AS text_sha1, count(*) AS n, string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) AS doc_ids
    FROM documents GROUP BY sha1(text) HAVING count(*) > 1""")
def dup_text_groups(t):
    """Texts that several documents share, with the ordered ids of the documents."""
    return t("documents").groupBy(F.sha1("text").alias("text_sha1")).agg(F.count("*").alias("n"), _listed(F.col("doc_id")).alias("doc_ids")).where("n > 1")


@query("""SELECT p_name, count(*) AS n, string_agg(p_partkey::VARCHAR, ', ' ORDER BY p_partkey) AS part_ids
    FROM part GROUP BY p_name HAVING count(*) > 1""")
def dup_names(t):
    """Names that several parts share."""
    return t("part").groupBy("p_name").agg(F.count("*").alias("n"), _listed(F.col("p_partkey")).alias("part_ids")).where("n > 1")


@query("""
    SELECT 'orders without lines' AS check_name, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'documents without label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'customers without urgent order', count(*) FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    UNION ALL SELECT 'parts without large return', count(*) FROM part
        WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
    UNION ALL SELECT 'lines of open orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def orphans(t):
    """Labelled counts of rows without a partner."""
    o, li = t("orders"), t("lineitem")
    checks = (
        ("orders without lines", o, li, "o_orderkey", "l_orderkey"),
        ("documents without label", t("documents"), t("labels").withColumnRenamed("doc_id", "l_doc"), "doc_id", "l_doc"),
        ("customers without urgent order", t("customer"), o.where("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey"),
        ("parts without large return", t("part"), li.where("l_returnflag = 'R' AND l_quantity > 45"), "p_partkey", "l_partkey"),
        ("lines of open orders", li, o.where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey"),
    )
    out = None
    for name, left, right, a, b in checks:
        one = left.select(a).join(right.select(b), F.col(a) == F.col(b), "left_anti").agg(F.lit(name).alias("check_name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
    WITH d AS (SELECT l_orderkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS expected FROM lineitem GROUP BY 1)
    SELECT 'status differs' AS check_name, o_orderkey, expected, o_orderstatus AS actual FROM orders JOIN d ON l_orderkey = o_orderkey
    WHERE coalesce(expected, '') <> coalesce(o_orderstatus, '')
    UNION ALL SELECT 'order without lines', o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def drift(t):
    """Stored states that differ from the derived ones, and rows that the other side lacks."""
    low, high = F.min("l_linestatus"), F.max("l_linestatus")
    lines = finely(t("lineitem").select("l_orderkey", "l_linestatus"), "l_orderkey")  # texts are grouped by sorting, which holds what a task reads
    derived = lines.groupBy("l_orderkey").agg(F.when(low == high, low).otherwise("P").alias("expected"))
    o = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("actual"))
    absent = F.col("l_orderkey").isNull()
    both = o.join(derived.hint("merge"), o["o_orderkey"] == derived["l_orderkey"], "left").where(absent | (F.coalesce("expected", F.lit("")) != F.coalesce("actual", F.lit(""))))
    return both.select(F.when(absent, "order without lines").otherwise("status differs").alias("check_name"), "o_orderkey", "expected", "actual")


EVENT_KEYS = ("signup", "error", "click", "view", "purchase")
_PIVOT_SQL = "SELECT user_id, ts::DATE AS day, " + ", ".join(f"max(CASE WHEN event_type = '{k}' THEN value END) AS {k}" for k in EVENT_KEYS) + " FROM events GROUP BY 1, 2"


@query(_PIVOT_SQL)
def eav_pivot(t):
    """Key and value rows as one wide row for each entity, in one pass."""
    e = t("events").select("user_id", F.to_date("ts").alias("day"), "event_type", "value").where(F.col("event_type").isin(*EVENT_KEYS))
    return e.groupBy("user_id", "day").agg(*(F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in EVENT_KEYS))


@query(_PIVOT_SQL)
def eav_joins(t):
    """The same through a left join for each key; one value for each entity and key comes first, so nothing fans out."""
    e = t("events").select("user_id", F.to_date("ts").alias("day"), "event_type", "value")
    values = e.groupBy("user_id", "day", "event_type").agg(F.max("value").alias("value"))
    out = e.select("user_id", "day").distinct()
    for k in EVENT_KEYS:
        out = out.join(values.where(F.col("event_type") == k).select("user_id", "day", F.col("value").alias(k)), ["user_id", "day"], "left")
    return out


@query("SELECT o_orderkey, (SELECT c_name FROM customer WHERE c_custkey = o_custkey) AS customer FROM orders WHERE o_orderstatus <> 'F'")
def scalar_subquery(t):
    """A lookup of one value for each row; rows without a partner stay."""
    o, c = t("orders").where("o_orderstatus <> 'F'"), t("customer").select("c_custkey", F.col("c_name").alias("customer"))
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select("o_orderkey", "customer")


@query("""
    WITH lists AS (SELECT p_brand, string_agg(p_partkey::VARCHAR, ',') AS csv FROM part WHERE p_size > 25 GROUP BY 1)
    SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lists WHERE list_contains(string_split(csv, ','), p_partkey::VARCHAR))""")
def not_in_csv(t):
    """Rows whose id is in none of the comma lists: the lists are taken apart, so the anti-join is on equality."""
    p = t("part")
    lists = p.where("p_size > 25").groupBy("p_brand").agg(F.array_join(F.collect_list(F.col("p_partkey").cast("string")), ",").alias("csv"))
    listed = lists.select(F.explode(F.split("csv", ",")).alias("k")).select(F.col("k").try_cast("bigint").alias("k"))
    return p.join(listed, p["p_partkey"] == listed["k"], "left_anti").select("p_partkey", "p_brand")


@query("""SELECT event_id, k, c_name FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    LEFT JOIN customer ON c_custkey = k""")
def text_id_join(t):
    """Ids that are text inside JSON meet numeric ids; what is no number meets nothing."""
    e = t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    c = t("customer").select("c_custkey", "c_name")
    return e.join(c, e["k"] == c["c_custkey"], "left").select("event_id", "k", "c_name")


_FLAGS = {"has_digits": "[0-9]{4}", "has_email": "[a-z0-9.]+@[a-z0-9.]+", "has_emoji": tx.EMOJI_QUERY, "has_notice": "[Cc]opyright|[Ll]icen[sc]ed?", "has_junk": "[*#%]{3}"}


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}')::INTEGER AS {n}" for n, p in _FLAGS.items()) + ", (source LIKE '%\\_\\_%' ESCAPE '\\' OR regexp_matches(source, '[0-9]+$'))::INTEGER AS numbered FROM documents")
def regex_flags(t):
    """Patterns as columns of 0 and 1."""
    numbered = F.col("source").like("%\\_\\_%") | F.col("source").rlike("[0-9]+$")
    return t("documents").select("doc_id", *(F.col("text").rlike(p).cast("int").alias(n) for n, p in _FLAGS.items()), numbered.cast("int").alias("numbered"))


def _sql_decoded(expr: str) -> str:
    for entity, char in tx.ENTITIES:
        expr = f"replace({expr}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return expr


_STRIPPED = "trim(regexp_replace(" + _sql_decoded("regexp_replace(replace(coalesce(html, ''), '<\\/', '</'), '<[^>]*>', ' ', 'g')") + ", '[ \\t\\n\\x0B\\f\\r\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))"


@query(f"SELECT page_id, len(s) AS chars, len(string_split(s, ' ')) AS words, sha1(s) AS text_sha1 FROM (SELECT page_id, {_STRIPPED} AS s FROM pages)")
def strip_html(t):
    """Pages without tags, and their size."""
    s = t("pages").select("page_id", tx.strip_html(F.col("html")).alias("s"))
    return s.select("page_id", F.length("s").cast("long").alias("chars"), F.size(F.split("s", " ")).cast("long").alias("words"), F.sha1("s").alias("text_sha1"))


@query("""
    WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(text, '\\S+')) AS words, count(*) OVER (PARTITION BY sha1(text)) AS same FROM documents),
    l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1)
    SELECT d.doc_id, source, words, quality, quality IS NULL AS label_missing, words > 0 AND words < 60 AS thin, same > 1 AS identical,
        concat_ws(';', CASE WHEN words > 2000 THEN 'too_long' END, CASE WHEN regexp_matches(text, '!!') THEN 'shouting' END,
                  CASE WHEN regexp_matches(text, '[*#%]{3}') THEN 'junk' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS flags
    FROM d LEFT JOIN l ON l.doc_id = d.doc_id""")
def scorecard(t):
    """One wide row of checks for each document."""
    d = t("documents").withColumn("words", F.regexp_count("text", F.lit(r"\S+")).cast("long")).withColumn("key", F.sha1("text"))
    same = d.groupBy("key").agg(F.count("*").alias("same"))
    labels = t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    w, text = F.col("words"), F.col("text")
    flags = sets.flags((("too_long", w > 2000), ("shouting", text.rlike("!!")), ("junk", text.rlike("[*#%]{3}")), ("toxic", F.col("toxic") == 1)))
    return d.join(same, "key").join(labels, "doc_id", "left").select(
        "doc_id", "source", "words", "quality", F.col("quality").isNull().alias("label_missing"), ((w > 0) & (w < 60)).alias("thin"), (F.col("same") > 1).alias("identical"), F.array_join(flags, ";").alias("flags")
    )


@query("""
    WITH lines AS (SELECT DISTINCT doc_id, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE len(trim(line)) >= 25),
    f AS (SELECT line, count(*) AS freq FROM lines GROUP BY 1)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (freq >= 3) AS n_common FROM lines JOIN f USING (line) GROUP BY 1""")
def boilerplate(t):
    """How many lines of a document stand in three documents or more."""
    each = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    lines = each.where(F.length("line") >= 25).distinct()
    frequency = lines.groupBy("line").agg(F.count("*").alias("freq"))
    return lines.join(frequency, "line").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("freq") >= 3).alias("n_common"))


_CHECKS = {"license": "licen[cs]ed", "email": "@[a-z0-9]+[.]", "phone": "[+]1 ", "secret": "password=|token =", "shouting": "!!", "number": "[0-9]{5}"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER (regexp_matches(lower(text), '{p}')) AS n, count(*) AS total, (100 * count(*) FILTER (regexp_matches(lower(text), '{p}')))::DOUBLE / count(*) AS percent FROM documents" for n, p in _CHECKS.items()))
def content_checks(t):
    """Named patterns over the folded text: how many rows, and per cent; all in one pass."""
    low = F.lower("text")
    counted = t("documents").agg(F.count("*").alias("total"), *(F.count_if(low.rlike(p)).alias(n) for n, p in _CHECKS.items()))
    long_ = counted.unpivot(["total"], list(_CHECKS), "check_name", "n")
    return long_.select("check_name", "n", "total", ((100 * F.col("n")).cast("double") / F.col("total")).alias("percent"))


_URL_RULES = (("fragment", "#"), ("tracked", "[?&](ref|utm_[a-z]+)="), ("paged", "[?&]page="), ("mobile", "^https?://m[.]"), ("plain", "^http://"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{n}'" for n, p in _URL_RULES) + " ELSE 'other' END AS kind FROM pages) GROUP BY 1")
def classifier(t):
    """The first rule that matches names the class; classes are counted."""
    return t("pages").select(tx.first_match(F.col("url"), _URL_RULES, "other").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_PART_WORDS = "list_distinct(string_split(lower(p_name || ' ' || p_type || ' s' || (p_size // 10)::VARCHAR), ' '))"


def _part_words() -> Column:
    size = F.concat(F.lit("s"), F.floor(F.col("p_size") / 10).cast("string"))
    return F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", size)), " "))


@query(f"""
    WITH w AS (SELECT p_brand, list_sort({_PART_WORDS}) AS s, min(p_partkey) AS id, count(*) AS parts FROM part GROUP BY 1, 2)
    SELECT a.p_brand, a.id AS a, b.id AS b, a.parts AS a_parts, b.parts AS b_parts,
        len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) AS similarity
    FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.id < b.id
    WHERE len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) >= 0.5""")
def title_core_sim(t):
    """Pairs of different titles of one brand that share half of their words; equal titles are one row with a count."""
    w = t("part").select("p_brand", F.array_sort(_part_words()).alias("s"), "p_partkey").groupBy("p_brand", "s").agg(F.min("p_partkey").alias("id"), F.count("*").alias("parts"))
    pairs = similarity.jaccard_pairs(w, "id", "s", 0.5, "p_brand")
    side = lambda x: w.select(F.col("id").alias(x), F.col("parts").alias(f"{x}_parts"), *(["p_brand"] if x == "a" else []))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("p_brand", "a", "b", "a_parts", "b_parts", "similarity")


@query("""
    WITH RECURSIVE w AS (SELECT doc_id, lang, list_sort(list_distinct(regexp_extract_all(lower(text), '[^ \\n]+'))) AS s FROM documents),
    k AS (SELECT *, md5(lang || ' ' || array_to_string(s, ' ')) AS k FROM w WHERE len(s) > 0),
    u AS (SELECT lang, k, any_value(s) AS s, len(any_value(s)) AS n FROM k GROUP BY 1, 2),
    e AS (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.lang = b.lang AND a.k <> b.k AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)
          WHERE len(list_intersect(a.s, b.s))::DOUBLE / (a.n + b.n - len(list_intersect(a.s, b.s))) >= 0.8),
    c(k, root) AS (SELECT k, k FROM u UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.k),
    r AS (SELECT k, min(root) AS root FROM c GROUP BY 1),
    d AS (SELECT doc_id, root FROM k JOIN r USING (k))
    SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS cluster, count(*) OVER (PARTITION BY root) AS size FROM d
    QUALIFY count(*) OVER (PARTITION BY root) > 1""")
def clusters(t):
    """Documents that chains of similar word sets connect (0.8 or more, within a language); equal sets are one node."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[^ \n]+"), F.lit(0))))
    w = t("documents").select("doc_id", "lang", words.alias("s")).where(F.size("s") > 0)
    keyed = w.withColumn("k", F.md5(F.concat("lang", F.lit(" "), F.array_join("s", " ")))).where("k IS NOT NULL")
    grouped = keyed.groupBy("k", "lang").agg(F.first("s").alias("s"))
    nodes = materialize(grouped.select("k", F.col("lang").alias("g"), "s", F.monotonically_increasing_id().alias("id")), "cluster-nodes")
    links = similarity.large_set_pairs(nodes, 0.8).select(F.col("a").alias("u"), F.col("b").alias("v"))
    parts = connected_components(links)
    named = nodes.select("k", "id").join(parts, F.col("id") == F.col("node"), "left").select("k", F.coalesce("component", "id").alias("root"))
    rooted = keyed.select("doc_id", "k").join(named, "k").select("doc_id", "root")
    sizes = rooted.groupBy("root").agg(F.min("doc_id").alias("cluster"), F.count("*").alias("size")).where("size > 1")
    return rooted.join(sizes, "root").select("doc_id", "cluster", "size")


@query("""
    WITH k AS (SELECT array_to_string(list_sort(list_distinct(string_split(p_name, ' ')[2:])), ' ') AS family_key, p_partkey, p_retailprice FROM part)
    SELECT family_key, count(*) AS n, count(DISTINCT p_retailprice) AS n_prices, min(p_retailprice) AS low, max(p_retailprice) AS high, min(p_partkey) AS first_id
    FROM k GROUP BY 1 HAVING count(*) > 1""")
def families(t):
    """Parts that are one but for their first word, with the range of their prices."""
    words = F.split("p_name", " ")
    key = sets.sorted_key(F.slice(words, F.lit(2), F.size(words)))
    return t("part").select(key.alias("family_key"), "p_partkey", "p_retailprice").groupBy("family_key").agg(
        F.count("*").alias("n"), F.countDistinct("p_retailprice").alias("n_prices"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), F.min("p_partkey").alias("first_id")
    ).where("n > 1")


@query("""
    WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS w FROM part), x AS (SELECT w, rtrim(w, 's') AS r FROM w)
    SELECT a.w AS a, b.w AS b FROM x a JOIN x b ON a.w < b.w
    WHERE a.r = b.r OR (len(a.r) > 3 AND (contains(a.r, b.r) OR contains(b.r, a.r)) AND abs(len(a.r) - len(b.r)) <= 9)""")
def taxonomy_pairs(t):
    """Terms that nearly repeat each other."""
    terms = t("part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), " ")).alias("name")).distinct()
    found = audit.term_pairs(terms.select(F.col("name").alias("id"), "name", F.col("name").alias("pos")), tx.fold_latin)
    return found.select("a", "b")


@query("""
    WITH h AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text))
    SELECT b.item_id, count(h.doc_id) AS n_docs, coalesce(string_agg(h.doc_id::VARCHAR, ', ' ORDER BY h.doc_id), '') AS doc_ids
    FROM benchmark b LEFT JOIN h USING (item_id) GROUP BY 1""")
def media_usage(t):
    """Which documents hold a passage, word for word."""
    items = t("benchmark").select("item_id", "text")
    hits = passage_hits(t("documents").select("doc_id", "text"), items).groupBy("item_id").agg(F.count("*").alias("n_docs"), _listed(F.col("doc_id")).alias("doc_ids"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("doc_ids", F.lit("")).alias("doc_ids"))


def _part_scores(t, least: float, score: Callable[..., DataFrame] = similarity.score_blocks) -> DataFrame:
    """Listings of one brand and line, two by two, that score least or more."""
    words = F.split("p_name", " ")
    p = t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.element_at(words, 1).alias("variant"), F.element_at(words, -1).alias("line"))
    # one listing for each distinct name, type and size of a brand stands for its copies; a brand and a line are a block
    items = spread(p.groupBy("p_brand", "p_name", "p_type", "p_size", "variant", "line").agg(F.min("p_partkey").alias("id")), "id")
    title = F.concat_ws(" ", "p_name", "p_type", F.concat("p_size", F.lit("ml")))
    item = items.select("p_brand", "line", F.col("id").alias("item_id"), title.alias("title"), F.col("p_brand").alias("brand"), "variant", F.lit("").alias("net_content"), F.lit("").alias("gtin"), F.lit("").alias("sku"))
    cand = items.select("p_brand", "line", "id", title.alias("c_name"), F.array("p_brand").alias("c_brands"), F.lit("").alias("c_gtin"), F.lit("").alias("c_sku"))
    return score(similarity.item_features(item), similarity.candidate_features(cand), ["p_brand", "line"], least)


_SCORED = """
    WITH items AS (SELECT p_brand, p_name, p_type, p_size, min(p_partkey) AS id, string_split(p_name, ' ')[1] AS variant, string_split(p_name, ' ')[-1] AS line FROM part GROUP BY 1, 2, 3, 4),
    w AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: len(x) > 1)) AS s FROM items),
    v AS (SELECT *, list_filter(string_split(lower(variant), ' '), lambda x: len(x) > 1) AS vs FROM w),
    pairs AS (
        SELECT a.id AS item_id, b.id, len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) + 0.10
            + CASE WHEN len(list_intersect(a.vs, b.s)) = len(a.vs) THEN 0.15 ELSE 0.0 END
            + CASE WHEN abs(a.p_size - b.p_size)::DOUBLE / greatest(a.p_size, b.p_size) <= 0.03 THEN 0.10 ELSE 0.0 END AS added,
            len(list_intersect(a.vs, b.s)) = 0 OR abs(a.p_size - b.p_size)::DOUBLE / greatest(a.p_size, b.p_size) > 0.03 AS against
        FROM v a JOIN v b ON a.p_brand = b.p_brand AND a.line = b.line AND a.id <> b.id),
    scored AS (SELECT item_id, id, greatest(least(round(CASE WHEN against THEN least(added, 0.45) ELSE added END, 3), 1.0), 0.0) AS score FROM pairs)
"""


@query(_SCORED + " SELECT item_id, id, score FROM scored WHERE score >= 0.4")
def compare_score(t):
    """The score of listings of one brand."""
    return _part_scores(t, 0.4)


@query(_SCORED + """, top AS (SELECT item_id, id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS place FROM scored WHERE score >= 0.55)
    SELECT t.item_id, id, score, place::INTEGER AS place, CASE WHEN max(score) OVER (PARTITION BY t.item_id) >= 0.8 THEN 'match' ELSE 'possible' END AS verdict
    FROM top t WHERE place <= 6""")
def top_candidates(t):
    """The six best candidates of each listing, and the verdict."""
    scored = _part_scores(t, similarity.POSSIBLE, similarity.best_in_blocks).select("item_id", "id", "score", F.lit(0).alias("tier"), F.lit("publish").alias("status"))
    top, verdict = similarity.verdicts(materialize(scored, "scored"))
    return top.join(verdict, "item_id").select("item_id", "id", "score", "place", "verdict")


_CODE_SQL = "lpad(((p_partkey * 7919 + 400000) % 10000000000000)::VARCHAR, 13, '0')"


@query(f"""SELECT p_partkey, {_CODE_SQL} AS code, (list_sum(list_transform(range(1, 14), lambda i: substr({_CODE_SQL}, i::INTEGER, 1)::INTEGER * (CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END))) % 10) = 0 AS valid FROM part""")
def gtin_valid(t):
    """Check digits of codes of 13 digits."""
    code = F.lpad(((F.col("p_partkey") * 7919 + 400000) % 10000000000000).cast("string"), 13, "0")
    return t("part").select("p_partkey", code.alias("code"), tx.valid_gtin(code).alias("valid"))


@query("""
    WITH b AS (SELECT vec_id, label, list_transform(embedding[1:63], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS s FROM embeddings)
    SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(list_zip(x.s, y.s), lambda z: abs(z[1] - z[2])))::INTEGER AS distance
    FROM b x JOIN b y ON x.label = y.label AND x.vec_id < y.vec_id
    WHERE list_sum(list_transform(list_zip(x.s, y.s), lambda z: abs(z[1] - z[2]))) <= 22""")
def hamming_near(t):
    """Pairs of one label whose 63 sign bits differ in at most 22 places."""
    bits = F.aggregate(F.transform(F.slice("embedding", 1, 63), lambda x: F.when(x > 0, 1).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, x: a * 2 + x)
    b = t("embeddings").select("vec_id", "label", bits.alias("bits"))
    x, y = b.alias("x"), b.alias("y")
    distance = F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits")))
    near = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.vec_id") < F.col("y.vec_id")) & (distance <= 22))
    return near.select(F.col("x.vec_id").alias("a"), F.col("y.vec_id").alias("b"), distance.alias("distance"))


@query(r"""
    WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', ''), '/+$', '') AS path,
                      list_filter(string_split(CASE WHEN contains(regexp_replace(url, '#.*$', ''), '?') THEN regexp_replace(regexp_replace(url, '#.*$', ''), '^[^?]*[?]', '') ELSE '' END, '&'),
                                  lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid|ref|srsltid)(=|$)', 'i')) AS kept, html FROM pages),
    u AS (SELECT page_id, CASE WHEN len(kept) = 0 THEN path ELSE path || '?' || array_to_string(kept, '&') END AS canonical,
                 regexp_replace(lower(regexp_extract(path, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www[.]', '') AS host, html FROM c)
    SELECT host, canonical, count(*) AS n, arg_max(page_id, (len(html), -page_id)) AS page_id FROM u GROUP BY 1, 2""")
def merge_by_url(t):
    """Pages by canonical address; the longest stands for each."""
    u = t("pages").select("page_id", tx.canonical_url(F.col("url")).alias("canonical"), F.length("html").alias("size"))
    best = F.max(F.struct("size", (-F.col("page_id")).alias("p")))
    out = u.withColumn("host", tx.domain_of(F.col("canonical"))).groupBy("host", "canonical").agg(F.count("*").alias("n"), best.alias("m"))
    return out.select("host", "canonical", "n", (-F.col("m.p")).alias("page_id"))


@query("""
    WITH rules AS (SELECT * FROM (VALUES ('en', 'quality'), ('en', 'toxic'), ('fr', 'quality'), ('de', 'quality'), ('de', 'toxic'), ('es', 'quality')) r(lang, field)),
    facts AS (SELECT doc_id, 'quality' AS field FROM labels WHERE quality = 1 UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 0)
    SELECT d.doc_id, r.field FROM documents d JOIN rules r USING (lang) WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.doc_id = d.doc_id AND f.field = r.field)""")
def missing_fields(t):
    """Fields that the rules of a kind ask for and no verified fact gives."""
    rules = F.explode(F.array(*(F.struct(F.lit(a).alias("kind"), F.lit(b).alias("field")) for a, b in (("en", "quality"), ("en", "toxic"), ("fr", "quality"), ("de", "quality"), ("de", "toxic"), ("es", "quality")))))
    labels = t("labels")
    facts = labels.where("quality = 1").select("doc_id", F.lit("quality").alias("field")).unionByName(labels.where("toxic = 0").select("doc_id", F.lit("toxic").alias("field")))
    spark = labels.sparkSession
    rules = spark.range(1).select(rules.alias("r")).select("r.kind", "r.field", F.lit(True).alias("blocker"))
    products = t("documents").select(F.col("doc_id").alias("product_id"), F.col("lang").alias("kind"))
    found = plan.missing_fields(products, rules, facts.select(F.col("doc_id").alias("product_id"), "field", F.lit(True).alias("verified")))
    return found.select(F.col("product_id").alias("doc_id"), "field")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'reject' ELSE 'update' END AS decision,
        o_totalprice > 150000 OR o_orderstatus <> 'F' AS content_updated,
        CASE WHEN o_orderstatus = 'P' AND o_totalprice > 150000 THEN 'F' ELSE o_orderstatus END AS status
    FROM orders""")
def decision_table(t):
    """A plan for each row: rejected, text or stock only, and the state afterwards."""
    status, complete = F.col("o_orderstatus"), F.col("o_totalprice") > 150000
    return t("orders").select(
        "o_orderkey",
        F.when((F.col("o_orderpriority") == "5-LOW") & (status == "P"), "reject").otherwise("update").alias("decision"),
        (complete | (status != "F")).alias("content_updated"),
        F.when((status == "P") & complete, "F").otherwise(status).alias("status"),
    )


@query("""
    SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS last_ts, count(*) AS n,
        max(ts) < (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS stale
    FROM events GROUP BY 1""")
def latest_state(t):
    """The last state of each key, and whether it has been left alone for a week."""
    e = t("events")
    now = e.agg(F.max("ts").alias("now"))
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return last.join(F.broadcast(now)).select("user_id", "state", "last_ts", "n", (F.col("last_ts") < F.col("now") - F.expr("INTERVAL 7 DAY")).alias("stale"))


@query("""
    WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) AS at_us FROM events),
    a AS (SELECT event_type, min(at_us) AS at_us FROM e GROUP BY 1
        UNION ALL SELECT a.event_type, (SELECT min(at_us) FROM e WHERE e.event_type = a.event_type AND e.at_us >= a.at_us + 600000000) FROM a WHERE a.at_us IS NOT NULL),
    f AS (SELECT e.event_type, min(event_id) AS event_id FROM e JOIN a ON a.event_type = e.event_type AND a.at_us = e.at_us GROUP BY e.event_type, e.at_us)
    SELECT e.event_id, e.event_type, f.event_id IS NOT NULL AS admitted FROM e LEFT JOIN f ON f.event_id = e.event_id""")
def admission(t):
    """One event of a type in any ten minutes is admitted; those that are turned away don't count."""
    e = t("events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return admitted(e, key="event_type", at="at", order="event_id", most=1, within=600_000_000).drop("at")


@query("""
    SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, sum(len(text)) AS chars,
        md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS transcript_md5
    FROM conversations GROUP BY 1""")
def chat_projection(t):
    """Turns rolled up into one row for each conversation."""
    rolled = t("conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), F.sum(F.length("text")).alias("chars"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all")
    )
    lines = F.transform("all", lambda x: F.concat_ws(": ", x["role"], x["text"]))
    return rolled.select("conv_id", "turns", "roles", "chars", F.md5(F.array_join(lines, "\n")).alias("transcript_md5"))
