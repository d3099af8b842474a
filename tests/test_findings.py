"""Queries against their SQL on small tables of odd rows, one test for each finding of a review."""

import math
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from shelfscope.functions import text as tx
from shelfscope.operators import audit, diagnostics, duplicates, jobs, meeting, near, research, similarity, verify
from shelfscope.operators.components import connected_components
from shelfscope.plans import audits
from shelfscope.sources.work import materialize


def same_as_sql(spark, folder, name, **tables) -> list:
    """The sorted rows of a query, after a check that its SQL gives the same."""
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table, rows in tables.items():
        db.execute(f"COPY ({rows}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    got = sorted(map(tuple, df.collect()), key=repr)
    wanted = db.execute(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert got == sorted(wanted, key=repr)
    return got


def test_f10_the_numbers_of_a_value_stand_to_the_digit(spark, tmp_path):
    said = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty {} twenty two"
    docs = " UNION ALL ".join(f"SELECT {i}::BIGINT AS doc_id, '{said.format(n)}' AS text" for i, n in ((8, "7"), (32, "07"), (44, "007")))
    assert same_as_sql(spark, tmp_path, "evidence_variants", documents=docs) == [(32, False), (44, False), (8, True)]


def test_f12_a_title_is_cased_once(spark):
    made = spark.createDataFrame([("🍓 hot bolt DE uva ACME SHOP | promo",), (None,), ("a " * 60,)], "t string").select(tx.enforce_title(F.col("t"), ("Acme Shop",)).alias("m"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("[a-z][A-Z]") == 1
    assert [(r.m.title, r.m.adjustments) for r in made.collect()] == [("Hot Bolt DE Uva", ["emoji", "separators", "store_name"]), (None, []), (("A " + "a " * 34).strip(), ["length"])]


def test_f3_pairs_of_one_sku_are_not_shuffled(spark):
    rows = [(i, i % 7, "ready" if i % 3 else "done", "" if i % 5 == 0 else f"s{i % 2}") for i in range(60)]
    matches = [(i, i % 4, 0.9 if i % 2 else 0.5) for i in range(60)] + [(1, 1, 0.9)]
    jobs_, matched = spark.createDataFrame(rows, "id long, created_at long, status string, sku string"), spark.createDataFrame(matches, "id long, product_id long, score double")
    df = jobs.superseded(jobs_, matched)
    sure = {(i, p) for i, p, s in matches if s >= 0.8}
    wanted = {(a[0], b[0]) for a in rows for b in rows if a[2] == "ready" and a[1] < b[1] and ((a[3] and a[3] == b[3]) or any((a[0], p) in sure and (b[0], p) in sure for p in range(4)))}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    assert df._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # nothing stands above the joins


def _overlap(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def test_f4_strong_pairs_are_those_of_all_pairs_and_meet_at_two_words(spark):
    words, variants = "red hot old new bolt ring rod gear 10ml 20ml uva leite".split(), ([], ["uva"], ["uva", "leite"], ["preto"])
    items = [(i, [w for k, w in enumerate(words) if (i * 7 + k * k + i // 5) % (2 + i % 3) == 0][:5], variants[i % 4]) for i in range(90)]
    strong = {(x[0], y[0]) for x in items for y in items if x[0] < y[0] and (x[1] or y[1]) and (_overlap(x[1], y[1]) >= (0.5 if x[2] or y[2] else 0.75)) and (set(x[2]) & set(y[2]) or not (x[2] or y[2]))}
    df = spark.createDataFrame(items, "id long, core array<string>, vt array<string>")
    got = [tuple(r) for r in audit.strong_pairs(df).collect()]
    assert len(got) == len(strong) and set(got) == strong and len(strong) > 20
    roots = {r.node: r.component for r in connected_components(audit.strong_pairs(df, stars=True).toDF("u", "v")).collect()}
    assert roots == {r.node: r.component for r in connected_components(spark.createDataFrame(sorted(strong), "u long, v long")).collect()}


def test_f6_titles_alike_give_pairs_only_if_strong(spark):
    # the old rule paired all titles that share half of their words, of which only strong ones count
    rows = spark.createDataFrame([(i, [f"a{i % 9}", f"b{i % 7}", "x", "y"]) for i in range(63)], "id long, s array<string>")
    got = {(r.a, r.b): r.similarity for r in similarity.small_set_pairs(rows, "id", "s", 0.5).collect()}
    assert got == {(r.a, r.b): r.similarity for r in similarity.jaccard_pairs(rows, "id", "s", 0.5).collect()} and got
    assert not similarity.small_set_pairs(rows, "id", "s", 0.75).collect()


def test_f11_the_scorecard_shows_the_counts_of_sentences(spark, tmp_path):
    parts = "SELECT i::BIGINT AS p_partkey, 'hot bolt' AS p_name, 'Brand#' || (i % 3) AS p_brand, 'LARGE' AS p_type, (1 + i % 2)::INTEGER AS p_size FROM range(12) t(i)"
    got = same_as_sql(spark, tmp_path, "audit_scorecard", part=parts, customer="SELECT i::BIGINT AS c_custkey FROM range(5) t(i)")
    names = __spark_entry__.queries()["audit_scorecard"](spark, str(tmp_path)).columns
    k, n, ratio = (names.index(c) for c in ("k", "n", "boilerplate_ratio"))
    assert {r[n] for r in got} >= {2, 4} and all(r[n] is None or abs(r[k] / r[n] - r[ratio]) <= 0.005 for r in got)


def test_f1_words_are_intersected_for_classes_and_not_for_pairs(spark, tmp_path):
    parts = "SELECT i::BIGINT AS p_partkey, ['hot','red','old'][1 + i % 3] || ' bolt' AS p_name, 'Brand#1' AS p_brand, 'LARGE' AS p_type, (1 + i % 9)::INTEGER AS p_size FROM range(40) t(i)"
    assert len(same_as_sql(spark, tmp_path, "compare_score", part=parts)) == 72
    plan = __spark_entry__.queries()["compare_score"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan


def test_f14_score_blocks_equals_the_score_of_all_pairs(spark, tmp_path):
    names, tails = ("uva doce", "uva", "morango doce"), ("", " 30ml", " 31 ml", " 1 kg", " 30ml 2kg", " 2kg 30ml", " 0 ml")
    rows = [(i, i % 2, f"{names[i % 3]}{tails[i % 7]}", "acme" if i % 5 else "", "uva" if i % 4 else "", "7" if i % 11 == 0 else "", f"s{i % 13}" if i % 3 == 0 else "") for i in range(84)]
    df = spark.createDataFrame(rows, "n long, block long, title string, brand string, variant string, gtin string, sku string")
    item = similarity.item_features(df.select("block", F.col("n").alias("item_id"), "title", "brand", "variant", F.lit("").alias("net_content"), "gtin", "sku"))
    cand = similarity.candidate_features(df.select("block", F.col("n").alias("id"), F.col("title").alias("c_name"), F.array("brand").alias("c_brands"), F.col("gtin").alias("c_gtin"), F.col("sku").alias("c_sku")))
    wanted = similarity.score_features(item.join(cand, "block").where("item_id <> id")).where("score >= 0.4").select("item_id", "id", "score")
    got = similarity.score_blocks(item, cand, ["block"], 0.4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count() > 500
    # the scores of top_candidates come the same way
    parts = "SELECT i::BIGINT AS p_partkey, ['hot','red','old'][1 + i % 3] || ' bolt' AS p_name, 'Brand#1' AS p_brand, 'LARGE' AS p_type, (1 + i % 9)::INTEGER AS p_size FROM range(40) t(i)"
    same_as_sql(spark, tmp_path, "top_candidates", part=parts)


def test_f8_terms_of_one_name_are_cut_into_parts_once(spark):
    names = ["building", "buildings", "build", "", "abc", "abcs", "building 12", "ld", "furniture"] * 4
    terms = spark.createDataFrame([(i, n, 100 - i) for i, n in enumerate(names)], "id long, name string, pos long")
    bare = [n.rstrip("s") for n in names]
    near = lambda x, y: x == y or (len(x) > 3 and (x in y or y in x) and abs(len(x) - len(y)) <= 9)
    wanted = sorted((i, j) for i in range(36) for j in range(36) if i > j and near(bare[i], bare[j]))
    df = audit.term_pairs(terms, tx.fold_latin)
    assert sorted((r.a, r.b) for r in df.collect()) == wanted and len(wanted) > 100
    assert df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0].count("Aggregate") == 0  # pairs are not made distinct


def test_f2_pairs_by_name_are_dealt_in_shares_and_not_grouped(spark, monkeypatch):
    monkeypatch.setattr(research, "SHARE", 5)
    items = [(i, "b7" if i % 5 == 0 else "", "789-1" if i % 4 == 0 else None, ("Cold Widget", "red", "", "zzz q")[i % 4]) for i in range(24)]
    listed = [(i, f"B{i % 9}", f"789{i % 3}", ("cold widget", "red widget", "old bolt")[i % 3]) for i in range(30)]
    df = research.lookup_candidates(spark.createDataFrame(items, "item_id long, sku string, gtin string, name string"), spark.createDataFrame(listed, "id long, sku string, gtin string, name string"))

    def tier(a, b):
        words = [w for w in a[3].lower().split() if len(w) > 2]
        rules = ((a[2] or "").replace("-", "") == b[2], a[1].upper() == b[1], bool(words) and all(w in b[3] for w in words))
        return next((t for t, holds in enumerate(rules) if holds), None)

    wanted = sorted((a[0], b[0], tier(a, b)) for a in items for b in listed if tier(a, b) is not None)
    assert sorted(map(tuple, df.select("item_id", "id", "tier").collect())) == wanted and {w[2] for w in wanted} == {0, 1, 2}
    assert df._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_f7_the_duplicate_check_sends_no_table_through_the_driver(spark):
    rows = spark.createDataFrame([(1, "hot bolt 30ml", "acme"), (2, "red ring 40ml", "acme")], "n long, title string, brand string")
    item = similarity.item_features(rows.select(F.col("n").alias("pid"), "title", "brand", *(F.lit("").alias(c) for c in ("variant", "net_content", "gtin", "sku"))))
    groups = similarity.candidate_features(rows.select(F.col("n").alias("gid"), F.col("title").alias("c_name"), F.array("brand").alias("c_brands"), F.lit("").alias("c_gtin"), F.lit("").alias("c_sku")))
    pairs = duplicates.similar_pairs(materialize(duplicates.ranked_words(item, groups), "p"), materialize(groups, "g"), 0.9)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.pid, r.gid) for r in pairs.collect()) == [(1, 1), (2, 2)]


def test_f9_large_sets_meet_by_hashes_and_fetch_words_only_if_they_may_overlap(spark):
    rng = random.Random(9)
    made = [sorted({f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.choice((3, 20, 60, 300, 700)))}) for _ in range(120)]
    for _ in range(150):  # near copies on both sides of the threshold
        s = rng.choice(made)
        made.append(sorted(set(rng.sample(s, max(1, round(len(s) * rng.uniform(0.78, 1))))) | {f"x{rng.randrange(99)}" for _ in range(round(len(s) * rng.uniform(0, 0.15)))}))
    rows = [(i, (None, "en", "de")[i % 3], s) for i, s in enumerate(made)] + [(999, "en", [])]
    wanted = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] and b[2] and _overlap(a[2], b[2]) >= 0.8}
    df = materialize(spark.createDataFrame(rows, "id long, g string, s array<string>"), "sets")
    got = [(r.a, r.b) for r in similarity.large_set_pairs(df, 0.8).collect()]
    assert len(got) == len(wanted) and set(got) == wanted and len(wanted) > 30
    met = {tuple(r) for r in similarity.met_pairs(df.where("id <> 999").select("id", "g", F.transform("s", lambda w: F.xxhash64(w)).alias("h")), 0.8).collect()}
    assert wanted <= met and len(met) <= 2 * len(wanted)


def test_f13_the_hashes_of_a_small_group_ask_for_no_keys(spark):
    rng = random.Random(13)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = [(w, i, rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8))) if i % 9 else None) for w, n in ((1, 5), (2, 60), (3, 100), (None, 9), (4, 1)) for i in range(n)]
    rows = [(w, i, h if h is None or h < 1 << 63 else h - (1 << 64)) for w, i, h in rows]
    away = lambda x, y: bin((x ^ y) & ((1 << 64) - 1)).count("1")
    wanted = sorted((a[0], a[1], b[1], away(a[2], b[2])) for a in rows for b in rows if a[0] and a[0] == b[0] and a[1] < b[1] and None not in (a[2], b[2]) and away(a[2], b[2]) <= 5)
    df = spark.createDataFrame(rows, "within long, id long, hash long")
    assert sorted(map(tuple, near.near_hashes(df, apart=5).collect())) == wanted and {w[0] for w in wanted} >= {1, 2, 3}
    # every row asks for keys only in groups that are large: here none is
    small = near.near_hashes(df.where("within <> 3"), apart=5)
    assert sorted(map(tuple, small.collect())) == [w for w in wanted if w[0] != 3]
    assert "left_semi" in small._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftsemi", "left_semi")


def test_f17_sources_are_made_normal_and_read_by_all_cores(spark, tmp_path):
    parts = "SELECT i::BIGINT AS p_partkey, (1 + i % 9)::INTEGER AS p_size FROM range(200) t(i)"
    assert len(same_as_sql(spark, tmp_path, "verify_nutrition", part=parts)) == 200
    cited = spark.range(200).selectExpr("cast(id as string) source_id")
    texts = verify._normal_sources(cited.withColumn("text", F.lit("Kcal 3")).coalesce(1), cited, F.col("text"))
    assert texts.rdd.getNumPartitions() >= 4 and texts.count() == 200  # one small partition before


def test_f15_f18_rows_are_counted_by_key_before_they_meet_the_posts(spark):
    posts = spark.createDataFrame([(1, "product", 0), (2, "product_variation", 1), (3, "product_variation", 77), (4, "attachment", 0), (5, "attachment", 88), (6, "attachment", 88)], "ID long, post_type string, post_parent long")
    one = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} long")
    items = spark.createDataFrame([("_product_id", v) for v in ("1", "9", "9", "none", "none", "none", None, " 2 ")] + [("_qty", "9")], "meta_key string, meta_value string")
    sold = spark.createDataFrame([(1, "a"), (9, "c"), (9, "b"), (7, None)], "product_id long, date_created string")
    tables = {"wp_posts": posts, "wp_postmeta": one("post_id", 1, 9, 9), "wp_term_relationships": one("object_id", 1, 2), "wp_comments": one("comment_post_ID", *[8] * 50, 3), "wp_woocommerce_order_itemmeta": items, "wp_wc_order_product_lookup": sold}
    counts, lines, orders = (f(tables.__getitem__) for f in (diagnostics.orphan_counts, diagnostics.order_items_of_deleted, diagnostics.orders_of_deleted))
    assert sorted(map(tuple, counts.collect())) == [("attachments whose parent was deleted", 2), ("comments/reviews without post", 50), ("postmeta without post", 2), ("term_relationships without post", 0), ("variations without parent product", 1)]
    assert {tuple(r) for r in lines.collect()} == {("9", 2), ("none", 3), (None, 1)}
    assert {tuple(r) for r in orders.collect()} == {(9, 2, "b", "c"), (7, 1, None, None)}
    for df in (counts, lines, orders):  # the rows below the join are grouped
        below = df._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti")
        assert len(below) == 2 and "Aggregate" in below[1]


def test_f14_the_best_of_a_block_are_found_without_its_pairs(spark, tmp_path):
    names, tails = ("uva doce", "uva", "morango doce"), ("", " 30ml", " 31 ml", " 1 kg", " 30ml 2kg", " 2kg 30ml", " 0 ml", " 30.9ml", " 40 ml", " 29ml")
    rows = [(i, i % 2, f"{names[i % 3]}{tails[i % 10]}", "acme" if i % 5 else "", "uva" if i % 4 else "", "7" if i % 11 == 0 else "", f"s{i % 13}" if i % 7 == 0 else "") for i in range(240)]
    df = spark.createDataFrame(rows, "n long, block long, title string, brand string, variant string, gtin string, sku string")
    item = similarity.item_features(df.select("block", F.col("n").alias("item_id"), "title", "brand", "variant", F.lit("").alias("net_content"), "gtin", "sku"))
    cand = similarity.candidate_features(df.select("block", F.col("n").alias("id"), F.col("title").alias("c_name"), F.array("brand").alias("c_brands"), F.col("gtin").alias("c_gtin"), F.col("sku").alias("c_sku")))
    best = lambda df: sorted((i, p, s) for i, of in _by_item(df).items() for p, s in of[:6])
    for least in (0.3, 0.55):  # below the cap of listings that differ, and above
        every = similarity.score_blocks(item, cand, ["block"], least)
        found = similarity.best_in_blocks(item, cand, ["block"], least)
        assert best(found) == best(every) and max(map(len, _by_item(found).values())) <= 7 < max(map(len, _by_item(every).values()))
    parts = "SELECT i::BIGINT AS p_partkey, ['hot','red','old'][1 + i % 3] || ' bolt' AS p_name, 'Brand#1' AS p_brand, ['LARGE', 'SMALL'][1 + i % 2] AS p_type, (28 + i // 6)::INTEGER AS p_size FROM range(120) t(i)"
    assert len(same_as_sql(spark, tmp_path, "top_candidates", part=parts)) > 200
    text = __spark_entry__.queries()["top_candidates"](spark, str(tmp_path))
    scored = spark.read.parquet(next(f for f in text.inputFiles() if "/scored-" in f).rpartition("/")[0])
    assert scored.groupBy("item_id").count().agg(F.max("count")).first()[0] <= 7


def _by_item(df) -> dict:
    """The candidates of each item with their scores, the best first."""
    found = {}
    for r in sorted(df.collect(), key=lambda r: (-r.score, r.id)):
        found.setdefault(r.item_id, []).append((r.id, r.score))
    return found


def test_f16_the_parts_of_the_audit_are_read_by_all_cores(spark, tmp_path):
    parts = "SELECT i::BIGINT AS p_partkey, 'hot bolt' AS p_name, 'Brand#' || (i % 3) AS p_brand, 'LARGE' AS p_type, (1 + i % 2)::INTEGER AS p_size FROM range(200) t(i)"
    duckdb.execute(f"COPY ({parts}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    listings = audits._products(lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet"))
    assert listings.rdd.getNumPartitions() >= 4 and listings.select("id").distinct().count() == 200  # one small partition before
    texts = ["Café &AMP; Pão", "PLAIN text", "a &amp; b", "", None, "ΣΑΣ ’x’"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(tx.fold_audit(F.col("t")).alias("f"))
    assert [r.f for r in got.collect()] == ["cafe & pao", "plain text", "a & b", "", "", "σας 'x'"]


def test_f19_quotes_read_their_sources_once_to_meet_and_once_to_show(spark):
    said = [f"zero one two three {'four ' * (i % 3)}five 7 six seven eight nine" for i in range(12)]
    sources = materialize(spark.createDataFrame(list(enumerate(said)), "source_id long, plain string"), "plain-sources")
    quotes = spark.createDataFrame([(i, i, q) for i, q in enumerate(["two three five 7 six seven eight", "five 7 six", "two three five 8 six seven eight"] * 4)], "fact_id long, source_id long, quote string")
    df = verify.find_quotes(quotes, sources)
    got = {r.fact_id: r.window for r in df.collect()}
    assert got == {i: said[i] for i in range(12) if i % 3 != 2}
    # what was met is written; only stretches that begin somewhere read the sources again (three times before, once for words as rows)
    assert df._jdf.queryExecution().optimizedPlan().toString().count(",plain#") == 1


def test_f20_evidence_sends_no_table_through_the_driver(spark):
    sources = spark.createDataFrame([(str(i), "t", f"Produto {i} na cor azul, mede {i} cm") for i in range(30)], "source_id string, title string, text string")
    facts = spark.createDataFrame([(i, "color", "azul", "na cor azul" if i % 2 else "na cor verde", [str(i), "none"]) for i in range(30)], "fact_id long, field string, value string, evidence string, source_ids array<string>")
    checked = verify.verify_facts(facts, sources)
    assert {r.fact_id for r in checked.where("verified").collect()} == {i for i in range(30) if i % 2}
    texts = materialize(sources.select("source_id", F.lower("text").alias("plain")), "plain")
    found = verify.find_quotes(facts.select("fact_id", F.explode("source_ids").alias("source_id"), F.col("evidence").alias("quote")), texts)
    for df in (checked, found):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_f21_drift_reads_its_lines_once_in_fine_parts(spark, tmp_path):
    orders = "SELECT i::BIGINT AS o_orderkey, ['F', 'O', 'P', NULL, ''][1 + i % 5] AS o_orderstatus FROM range(60) t(i)"
    lines = "SELECT (i % 50)::BIGINT AS l_orderkey, ['F', 'O', 'F', NULL, ''][1 + (i // 50 + i) % 5] AS l_linestatus FROM range(120) t(i)"
    got = same_as_sql(spark, tmp_path, "drift", orders=orders, lineitem=lines)
    assert {r[0] for r in got} == {"status differs", "order without lines"} and sum(r[0] == "order without lines" for r in got) == 10
    df = __spark_entry__.queries()["drift"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linestatus#") and plan.count("Relation") == 2 and "RepartitionByExpression" in plan  # four tables read before


def _shuffled_joins(df):
    """The joins of a plan whose rows are shuffled or grouped by what stands above them."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = [next((i for i, x in enumerate(lines) if "Join Inner" in x), len(lines))]
    return [x for x in lines[: above[0]] if "Aggregate" in x or "Repartition" in x or "Sort" in x]


def test_r04_f1_pairs_of_listings_leave_their_joins_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(meeting, "SIDE", 3)
    monkeypatch.setattr(audit, "LOT", 2)
    rng = random.Random(4)
    words, titles = "red hot old new bolt ring rod".split(), []
    for i in range(70):
        tail = rng.choice(("", " sabor uva", " sabor uva com leite", " cor azul"))
        files = rng.choice(([], None, ["a", "b"], ["b", "a", "c"], ["d"], ["a", None, "a"]))
        titles.append((i, " ".join(rng.sample(words, 2)) + tail, rng.choice(("", "s1", "s2", "s3")), files, rng.choice("xyz") + str(i % 6)))
    cards = spark.createDataFrame(titles, "id long, name string, sku string, image_names array<string>, desc_key string").selectExpr("*", "name AS title_f", "'t' AS created", "1 AS price_brl", "'in' AS stock_class")
    c = {r.id: r for r in cards.withColumn("core", tx.title_core(F.col("title_f"))).withColumn("vt", tx.variant_tokens(tx.variant_value(F.col("name")))).collect()}
    wanted = set()
    for x in c.values():
        for y in c.values():
            sim, fits = _overlap(x.core, y.core), bool(set(x.vt) & set(y.vt)) or not (x.vt or y.vt)
            strong = sim >= (0.5 if x.vt or y.vt else 0.75) and fits
            files = tuple(sorted({f for f in x.image_names or () if f} & {f for f in y.image_names or () if f}))
            if x.id < y.id and (strong or files or (x.sku and x.sku == y.sku) or x.desc_key == y.desc_key):
                wanted.add((x.id, y.id, round(sim, 9), fits, strong, files, bool(x.sku) and x.sku == y.sku, x.desc_key == y.desc_key))
    df = audit.duplicate_pairs(cards, details=False)
    got = [(r.a, r.b, round(r.title_similarity, 9), r.variant_compatible, r.likely_same_item, tuple(r.shared_image_files), r.same_sku, r.identical_description) for r in df.collect()]
    assert len(got) == len(wanted) and set(got) == wanted and len(wanted) > 300
    assert not _shuffled_joins(df)
    full = audit.duplicate_pairs(cards)
    assert {(r.a, r.b) for r in full.collect()} == {w[:2] for w in wanted} and {"a_name", "b_stock_class"} <= set(full.columns)


def test_r04_f3_terms_stand_at_the_names_that_they_hold(spark, monkeypatch):
    monkeypatch.setattr(meeting, "SIDE", 3)
    names = ["building", "buildings", "build", "", "abc", "abcs", "building 12", "ld", "s"] * 3
    terms = spark.createDataFrame([(i, n, 100 - i) for i, n in enumerate(names)], "id long, name string, pos long")
    bare = [n.rstrip("s") for n in names]
    near = lambda x, y: x == y or (len(x) > 3 and (x in y or y in x) and abs(len(x) - len(y)) <= 9)
    wanted = sorted((i, j, names[i], names[j]) for i in range(27) for j in range(27) if i > j and near(bare[i], bare[j]))
    df = audit.term_pairs(terms, tx.fold_latin)
    assert sorted(map(tuple, df.select("a", "b", "a_name", "b_name").collect())) == wanted and len(wanted) > 50
    # one join makes the pairs; both of its sides are dealt, and no pair goes through a second one
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_r04_f5_items_meet_listings_at_a_search_and_codes_are_not_grouped(spark, monkeypatch):
    monkeypatch.setattr(research, "SHARE", 9)
    items = [(i, "b1" if i % 3 else None, "7-1" if i % 4 == 0 else "", ("Cold Widget", "widget", None)[i % 3]) for i in range(30)]
    listed = [(i, f"B{i % 2}" if i % 5 else None, f"7{i % 3}", ("cold widget", "red widget", "old bolt")[i % 3]) for i in range(30)]
    df = research.lookup_candidates(spark.createDataFrame(items, "item_id long, sku string, gtin string, name string"), spark.createDataFrame(listed, "id long, sku string, gtin string, name string"))

    def tier(a, b):
        words = (a[3] or "").lower().split()
        rules = (bool(a[2]) and a[2].replace("-", "") == b[2], bool(a[1]) and a[1].upper() == b[1], bool(words) and all(w in b[3] for w in words))
        return next((t for t, holds in enumerate(rules) if holds), None)

    wanted = sorted((a[0], b[0], tier(a, b)) for a in items for b in listed if tier(a, b) is not None)
    assert sorted(map(tuple, df.select("item_id", "id", "tier").collect())) == wanted and {w[2] for w in wanted} == {0, 1, 2}
    assert not _shuffled_joins(df)


def test_r04_f6_jobs_that_match_several_products_are_not_made_distinct(spark, monkeypatch):
    monkeypatch.setattr(meeting, "SIDE", 4)
    rows = [(i, i % 5, "ready" if i % 3 else "done", None if i % 7 == 0 else "" if i % 2 else f"s{i % 4}") for i in range(60)]
    matches = [(i, p, 0.9 if (i + p) % 3 else 0.5) for i in range(60) for p in (i % 4, i % 3, 5)] + [(1, None, 0.9), (2, None, 0.9)]
    jobs_, matched = spark.createDataFrame(rows, "id long, created_at long, status string, sku string"), spark.createDataFrame(matches, "id long, product_id long, score double")
    df = jobs.superseded(jobs_, matched)
    sure = {(i, p) for i, p, s in matches if s >= 0.8 and p is not None}
    wanted = {(a[0], b[0]) for a in rows for b in rows if a[2] == "ready" and a[1] < b[1] and ((a[3] and a[3] == b[3]) or any((a[0], p) in sure and (b[0], p) in sure for p in range(6)))}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(wanted) and set(got) == wanted and len(wanted) > 300
    assert not _shuffled_joins(df)


def test_r04_f2_the_summary_counts_strong_pairs_by_their_classes(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.sample("red hot old new bolt ring".split(), 2)) + rng.choice(("", " sabor uva", " cor azul")), rng.choice(("", "s1", "s2", None)), rng.choice((["a", "b"], ["b"], None)), f"d{i % 9}") for i in range(50)]
    cards = spark.createDataFrame(rows, "id long, name string, sku string, image_names array<string>, desc_key string").selectExpr("*", "name AS title_f", "'t' AS created", "1 AS price_brl", "'in' AS stock_class")
    wanted = audit.duplicate_pairs(cards, details=False).groupBy().agg(F.count("*"), F.count_if("likely_same_item")).first()
    df = audit.pair_counts(cards)
    got = df.collect()
    assert (sum(r.n for r in got), sum(r.n for r in got if r.likely_same_item)) == tuple(wanted) and wanted[1] > 30
    assert [r.n for r in audit.pair_counts(cards.limit(0)).collect()] == [0, 0, 0]


def test_r04_f7_counts_of_slots_come_to_the_driver_as_bytes(spark, monkeypatch):
    counted = spark.range(100_000).selectExpr("cast(id * 40 as int) AS slot", "id % 700 AS n")
    rows = []
    collect = type(counted).collect
    monkeypatch.setattr(type(counted), "collect", lambda df: rows.append(collect(df)) or rows[-1])
    monkeypatch.setattr(type(counted), "toPandas", None)
    got = similarity._byte_counts(counted)
    wanted = [0] * similarity.SLOTS
    for i in range(100_000):
        wanted[i * 40] = min(round(math.log2(i % 700) * 8), 255) if i % 700 > 1 else 0
    assert got.tolist() == wanted and [len(r) for r in rows] == [62]


def test_r04_f4_only_groups_that_can_lead_are_expanded(spark):
    rng = random.Random(44)
    named = spark.createDataFrame([(p, g, rng.choice((0.9, 0.8, 0.7))) for p in range(3) for g in range(40)], "pid int, gid int, score double")
    listings = spark.createDataFrame([(g, g * 3 + i, rng.choice(("publish", "draft"))) for g in range(40) for i in range(3)], "gid int, id int, status string")
    items = spark.createDataFrame([(p * 10 + i, p) for p in range(3) for i in range(2)], "item_id int, pid int")
    coded = [(11, 3 * g) for g in rng.sample(range(40), 5)]
    aside = spark.createDataFrame([(i, x // 3, 1) for i, x in coded], "item_id int, gid int, aside long")
    kept = {(r.pid, r.gid) for r in duplicates.leading_groups(named, items, aside, listings).collect()}
    by_pid, of = [[r for r in named.collect() if r.pid == p] for p in range(3)], listings.collect()
    for i, p in ((r.item_id, r.pid) for r in items.collect()):
        every = sorted((-r.score, x.status != "publish", x.id, r.gid) for r in by_pid[p] for x in of if x.gid == r.gid and (i, x.id) not in coded)
        assert {(p, x[3]) for x in every[:6]} <= kept
    assert [sum(k[0] == p for k in kept) for p in range(3)] == [6, 11, 6]
