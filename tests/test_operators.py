"""Audit, diagnostics, verification, plans, jobs and sources on hand-made tables."""

import json

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import audit, diagnostics, jobs, plan, verify
from shelfscope.operators.components import connected_components
from shelfscope.sources import snapshots

from . import evidence_plain as plain


def product(i, name, **more):
    base = {
        "id": i, "name": name, "slug": f"p-{i}", "permalink": "", "type": "simple", "sku": "", "description": "", "short_description": "", "on_sale": False, "is_purchasable": True, "low_stock_remaining": None,
        "weight": "", "dimensions": {"length": "1", "width": "", "height": "2"}, "prices": {"price": "1000", "regular_price": ""}, "stock_availability": {"class": "in-stock", "text": ""},
        "images": [], "tags": [], "brands": [], "attributes": [],
    }
    return base | more


def image(i, name, alt=""):
    return {"id": i, "name": name, "src": f"http://x/{name}.JPG", "alt": alt}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("snap")
    text = "Este texto aparece em muitos produtos da loja. "
    products = [
        product(1, "Soju Sabor Morango 360ml", sku="A", description=f"<p>{text}</p>", images=[image(7, "soju-morango-360"), image(7, "soju-morango-360"), image(8, "image1", "x")], brands=[{"name": "Gen&eacute;rico"}], weight="0.1"),
        product(2, "Soju Sabor Morango 360ml | kpop | acme shop", sku="A ", description=f"<p>{text}</p>", images=[image(7, "soju-morango-360")]),
        product(3, "Soju Sabor Uva 360ml", description=text + "Mais.", slug="soju-2", attributes=[{"name": "Cor", "taxonomy": "pa", "terms": [{"name": "Azul"}]}]),
        product(4, "Caneca 🍓", prices={"price": "", "regular_price": ""}, on_sale=True, description="Validade de 12 meses"),
    ]
    core = [{"id": 1, "date": "2026-01-02T03", "modified": "m", "product_cat": [5, 99, 6], "product_brand": []}, {"id": 2, "date": None, "modified": "m", "product_cat": [6], "product_brand": []}]
    media = [{"id": 7, "date": "2026-01-01", "slug": "s", "post": 0, "source_url": "http://x/soju-1.png", "mime_type": "image/png", "alt_text": " "}, {"id": 9, "date": "2026-01-01", "slug": "s", "post": 3, "source_url": "http://x/a-b-c-d-e-f-g.png", "mime_type": "image/png", "alt_text": "t"}]
    terms = [{"id": 5, "count": 1, "description": "", "name": "Comida", "slug": "comida-e-bebida", "parent": 0}, {"id": 6, "count": 0, "description": "d", "name": "Ofertas", "slug": "ofertas", "parent": 5}]
    out = {}
    for name, rows, schema in (("products", products, snapshots.PRODUCT), ("core", core, snapshots.CORE_PRODUCT), ("media", media, snapshots.MEDIA), ("terms", terms, snapshots.TERM)):
        (folder / f"{name}.json").write_text(json.dumps({"source_urls": ["u"], "captured_at": "t", "count": len(rows), "data": rows}))
        out[name] = snapshots.read_snapshot(spark, str(folder / f"{name}.json"), schema)
    return out


@pytest.fixture(scope="module")
def cards(store):
    return audit.scorecard(store["products"], store["core"], store["media"], store["terms"], store_name=STORE, generic_categories=("comida-e-bebida", "ofertas"), offers="ofertas").cache()


STORE = r"\bacme shop\b"


def test_scorecard(cards):
    r = {x.id: x for x in cards.collect()}
    assert r[1].sku_duplicated and r[2].sku_duplicated and r[3].sku_missing and not r[3].sku_duplicated
    assert (r[1].images_count, r[1].images_repeated_entries, r[1].images_alt_empty) == (2, 1, 2) and r[1].image_name_classes == ["descriptive", "junk_name"]
    assert r[1].images_owned_by_other_post == [7] and r[1].featured_image_shared_with_other_products and r[1].image_formats == ["jpg", "jpg"]
    assert r[1].categories == ["comida-e-bebida", "ofertas"] and r[1].only_generic_categories and r[1].in_offers_category_without_sale
    assert r[1].description_identical_to_other_product and not r[4].description_identical_to_other_product and r[1].boilerplate_ratio == 1.0
    assert r[1].brand_generic and r[2].brand_missing and r[1].weight_below_net_content and not r[2].weight_below_net_content and r[1].dimensions_missing == ["width"]
    assert r[2].title_flags == ["pipe_keyword_stuffing", "store_name_in_title", "ambiguous_multi_flavour_title"][:2] and r[3].slug_flags == ["numeric_suffix(slug_collision)"]
    assert r[4].price_zero and r[4].emoji_title == 1 and r[4].has_shelf_life and r[4].has_age_range and not r[4].has_ingredients and r[3].attributes_are_global
    assert float(r[1].price_brl) == 10 and r[1].created.startswith("2026") and r[4].created is None


def test_rounding_is_that_of_the_exact_value(spark):
    values = [2.675, 0.125, 0.375, 1.005, 33.35, 0.15, 0.25, 0.35, 12.5, 1 / 3, 100.0, 0.0, 66.65, 2.5, 0.5]
    got = spark.createDataFrame([(x,) for x in values], "x double").select(audit.rounded(F.col("x"), 2).alias("two"), audit.rounded(F.col("x"), 1).alias("one"), audit.rounded(F.col("x"), 0).alias("none")).collect()
    assert [(r.two, r.one, r.none) for r in got] == [(round(x, 2), round(x, 1), round(x, 0)) for x in values]


def test_pairs_clusters_families_summary(cards):
    pairs = audit.duplicate_pairs(cards, STORE)
    got = {(p.a, p.b): p for p in pairs.collect()}
    assert got[1, 2].likely_same_item and got[1, 2].same_sku and got[1, 2].shared_image_files == ["soju-morango-360"] and got[1, 2].identical_description
    assert (1, 3) not in got or not got[1, 3].likely_same_item
    clusters = audit.duplicate_clusters(pairs)
    assert [(c.cluster, c["size"], c.ids) for c in clusters.collect()] == [(1, 2, [1, 2])]
    families = audit.variant_families(cards, store_name=STORE)
    assert {(p.a, p.b) for p in audit.duplicate_pairs(cards, STORE, stars=True).collect()} <= set(got)
    assert [1, 3] in [f.product_ids for f in families.collect()] or [1, 2, 3] in [f.product_ids for f in families.collect()]
    s = audit.summary(cards, pairs, clusters, families).first()
    assert (s.published_products, s.sku_missing, s.duplicate_candidate_clusters, s.likely_duplicate_pairs, s.pct_sku_missing) == (4, 2, 1, 1, 50.0)


def test_taxonomy_and_media(spark, store, cards):
    totals = audit.taxonomy_totals(store["terms"]).first()
    assert (totals.total, totals.used, totals.empty, totals.without_description, totals.hierarchical) == (2, 1, 1, 1, True)
    tags = spark.createDataFrame([(1, "360ml", 0, 0), (2, "Lotte", 1, 1), (3, "Comida", 0, 2), (4, "doces", 1, 3), (5, "doce", 1, 4)], "id int, name string, count int, pos int")
    brands = spark.createDataFrame([("LOTTE",)], "name string")
    checks = {r.id: r for r in audit.tag_checks(tags, brands, store["terms"]).collect()}
    assert checks[1].size_tag and checks[1].orphan and checks[2].duplicates_brand and checks[3].duplicates_category and not checks[4].duplicates_category
    assert [(r.a, r.b) for r in audit.term_pairs(tags).collect()] == [(4, 5)]
    assert [(r.pair, r.n) for r in audit.category_overlap(cards).collect()] == [("comida-e-bebida + ofertas", 1)]
    media = {r.id: r for r in audit.media_audit(store["media"], store["products"]).collect()}
    assert media[7].used_by_published_products == [1, 2] and media[7].reupload_suffix and media[7].alt_empty and media[9].used_by_published_products == [] and media[9].name_class == "descriptive"
    totals = audit.media_totals(audit.media_audit(store["media"], store["products"]), F.lit(5)).first()
    assert (totals.hidden, totals.unattached, totals.unused, totals.used_by_several) == (3, 1, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    post = "ID long, post_type string, post_status string, post_title string, post_name string, post_content string, post_excerpt string, post_mime_type string, guid string, post_parent long, post_author long, post_date string, post_modified string"
    row = lambda i, kind, status="publish", title="t", slug="s", mime="", parent=0, author=1: (i, kind, status, title, slug, "é🍓", "", mime, f"g{i}", parent, author, "d", "m")
    made = {
        "wp_posts": ([row(1, "product"), row(2, "product", "draft", "t", "s-2", author=9), row(3, "attachment", "inherit", mime="image/png"), row(4, "attachment", "inherit", mime="image/png", parent=2), row(5, "product_variation", parent=77), row(6, "attachment", "inherit", mime="image/png", parent=88), row(7, "shop_order", "done"), row(8, "revision", "inherit")], post),
        "wp_postmeta": ([(1, "_sku", "X"), (2, "_sku", "X"), (5, "_sku", ""), (1, "_thumbnail_id", "3"), (2, "_thumbnail_id", "12abc"), (1, "_product_image_gallery", "4,99"), (1, "_stock", "5"), (1, "_stock_status", "instock"), (2, "_dp_original", "1"), (999, "_sku", "Z"), (2, "_wp_trash_meta_time", "123"), (1, "_edit_last", "1"), (1, "_manage_stock", "yes")], "post_id long, meta_key string, meta_value string"),
        "wp_users": ([(1, "ann")], "ID long, user_login string"),
        "wp_terms": ([(1, "a"), (2, "b")], "term_id long, name string"),
        "wp_term_taxonomy": ([(10, 1, "product_tag", 0), (11, 2, "product_tag", 3)], "term_taxonomy_id long, term_id long, taxonomy string, count long"),
        "wp_term_relationships": ([(2, 10), (1, 10), (500, 10)], "object_id long, term_taxonomy_id long"),
        "wp_comments": ([(1,), (404,)], "comment_post_ID long"),
        "wp_options": ([("_transient_a", "xé", "yes"), ("b", "y", "no")], "option_name string, option_value string, autoload string"),
        "wp_wc_product_meta_lookup": ([(1, "X", "5.0000", "instock"), (5, "Q", None, None), (600, "", None, None)], "product_id long, sku string, stock_quantity string, stock_status string"),
        "wp_wc_order_product_lookup": ([(600, "2026-01-01"), (600, "2026-01-03"), (1, "2026-01-02")], "product_id long, date_created string"),
        "wp_woocommerce_order_itemmeta": ([("_product_id", "600"), ("_product_id", "abc"), ("_product_id", "1"), ("_qty", "9")], "meta_key string, meta_value string"),
        "wp_actionscheduler_actions": ([("done",), ("done",)], "status string"),
        "wp_actionscheduler_logs": ([(1,)], "log_id long"),
        "information_schema.tables": ([("a", "s", 1048576, 0, 5), ("b", "s", 3 * 1048576, 0, 1), ("c", "other", 9, 9, 9)], "table_name string, table_schema string, data_length long, index_length long, table_rows long"),
    }
    frames = {n: spark.createDataFrame(rows, schema) for n, (rows, schema) in made.items()}
    frames["wp_wc_product_meta_lookup"] = frames["wp_wc_product_meta_lookup"].withColumn("stock_quantity", F.col("stock_quantity").cast("decimal(19,4)"))
    return frames.__getitem__


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_diagnostics(tables):
    d = diagnostics
    assert ("product", "draft", 1) in rows_of(d.id_consumers(tables), "post_type", "post_status", "n")
    assert rows_of(d.product_status(tables), "post_type", "post_status", "n") == [("product", "draft", 1), ("product", "publish", 1), ("product_variation", "publish", 1)]
    assert rows_of(d.unpublished(tables), "ID", "author", "trashed_at_unix", "sku") == [(2, None, "123", "X")]
    assert rows_of(d.clones(tables), "clone_id", "original_id", "original_status") == [(2, "1", "publish")]
    assert rows_of(d.duplicate_skus(tables), "sku", "n", "products") == [("X", 2, "1:publish, 2:draft")]
    assert rows_of(d.duplicate_titles(tables), "post_title", "n") == [("t", 2)]
    assert rows_of(d.collided_slugs(tables), "ID") == [(2,)]
    assert [r[1] for r in rows_of(d.orphan_counts(tables), "check_name", "n")] == [1, 1, 1, 1, 1]
    assert rows_of(d.images_of_unpublished(tables), "attachment_id", "product_id") == [(4, 2)]
    assert rows_of(d.unused_images(tables), "ID") == [(6,)]
    assert sorted(rows_of(d.featured_image_problems(tables), "ID", "thumbnail_id", "problem")) == [(2, "12abc", "thumbnail missing in wp_posts")]
    assert rows_of(d.galleries(tables), "ID", "gallery_ids") == [(1, "4,99")]
    assert sorted(rows_of(d.lookup_presence(tables), "check_name", "ID")) == [("lookup row for deleted post", 600)]
    assert rows_of(d.lookup_values(tables), "ID", "lookup_sku", "meta_sku") == [(5, "Q", "")]
    assert rows_of(d.stock_settings(tables), "ID", "manage_stock", "stock_qty", "backorders") == [(1, "yes", "5", None)]
    assert rows_of(d.empty_terms(tables), "name", "linked_posts") == [("a", "1:publish, 2:draft")]
    assert rows_of(d.orders_of_deleted(tables), "product_id", "order_lines", "first_sale", "last_sale") == [(600, 2, "2026-01-01", "2026-01-03")]
    assert sorted(rows_of(d.order_items_of_deleted(tables), "product_id", "order_lines")) == [("600", 1), ("abc", 1)]
    assert sorted(rows_of(d.authors(tables), "post_status", "author", "n"), key=repr) == [("draft", None, 1), ("publish", "ann", 1)]
    assert rows_of(d.last_editors(tables), "last_editor", "post_status", "n") == [("ann", "publish", 1)]
    assert rows_of(d.emoji_flags(tables), "ID", "emoji_in_title", "emoji_in_description") == [(1, 0, 1), (2, 0, 1)]
    assert sorted(r[1] for r in rows_of(d.weights(tables), "item", "n")) == [0, 0, 0, 1, 1]
    assert rows_of(d.scheduler(tables), "status", "n") == [("done", 2)] and rows_of(d.scheduler_log(tables), "action_scheduler_log_rows") == [(1,)]
    assert rows_of(d.table_sizes(tables, "s"), "table_name", "size_mb") == [("b", 3.0), ("a", 1.0)]
    assert rows_of(d.order_posts(tables), "post_type", "n") == [("shop_order", 1)]
    assert rows_of(d.full_export(tables), "ID", "sku", "stock", "cloned_from", "description_chars") == [(1, "X", "5", None, 2), (2, "X", None, "1", 2)]


def test_facts(spark):
    source = "Soju Morango. Teor alcoolico 12,5% vol. Nao contem gluten. Volume 1.500 ml por garrafa."
    sources = spark.createDataFrame([("s1", "Soju", source), ("s2", "Outro", "nada")], "source_id string, title string, text string")
    facts = [
        (1, "alcohol_abv", "12,5%", "teor alcoólico 12,5% vol", ["s1"]), (2, "alcohol_abv", "12,6%", "teor alcoólico 12,5% vol", ["s1"]), (3, "alcohol_abv", "12,5%", "teor alcoólico 12,5% vol", ["s2", "zz"]),
        (4, "gluten", "Contém glúten", "Não contém glúten", ["s1"]), (5, "gluten", "Não contém", "Não contém glúten", ["s1"]), (6, "volume", "1500 ml", "Volume 1500 ml", ["s1"]), (7, "volume", "1500 ml", "", ["s1"]), (8, "gtin", "123", "Volume 1500 ml", ["s1"]), (9, "volume", "x", "v" * 301, ["s1"]),
    ]
    table = spark.createDataFrame(facts, "fact_id int, field string, value string, evidence string, source_ids array<string>")
    assert {r.fact_id for r in verify.verify_facts(table, sources).collect() if r.verified} == {1, 5, 6}
    other = spark.createDataFrame([("s1", True, ["Uva"])], "source_id string, mentions boolean, aliases array<string>")
    assert {r.fact_id for r in verify.verify_facts(table, sources, other).collect() if r.verified} == {6}
    assert plain.find_quote("ingredientes: agua acucar sal limao 5", "ingredientes agua, açúcar, sal, 5 gotas de limao e mel") and not plain.find_quote("agua acucar 7", "agua acucar 8 sal")
    rows = [("Valor energético", "100 kcal"), ("Carboidratos", "20 g"), ("Sódio", "5 mg")]
    text = "Porção de 30 g: energia 100 kcal; carboidrato 20 g; sodio 5 mg"
    assert plain.nutrition_holds("30 g", rows, text) and not plain.nutrition_holds("30 g", [*rows[:2], ("Sódio", "6 mg")], text) and not plain.nutrition_holds("31 g", rows, text)
    tables = spark.createDataFrame([(1, "30 g", rows, ["s3"])], "table_id int, serving string, rows array<struct<nutrient:string,amount:string>>, source_ids array<string>")
    assert verify.verify_nutrition(tables, spark.createDataFrame([("s3", "t", text)], "source_id string, title string, text string")).first().verified


def test_plans(spark):
    df = spark.createDataFrame([(True, "pending", True), (False, "publish", True), (True, "trash", True), (False, "odd", False)], "c boolean, s string, p boolean")
    got = [r.x for r in df.select(plan.plan_update(F.col("c"), F.col("s"), F.col("p"), F.lit(5)).alias("x")).collect()]
    assert [(g.ok, g.status, g.content_updated) for g in got] == [(True, "publish", True), (True, "publish", False), (False, None, None), (True, "pending", True)]
    cands = F.array(F.struct(F.lit(1).alias("id"), F.lit(0.9).alias("score")), F.struct(F.lit(2).alias("id"), F.lit(0.6).alias("score")))
    ask = spark.createDataFrame([("match", "create", None), ("match", "update", 1), ("match", "update", 2), ("possible", "update", 2), ("none", "create", None), (None, "create", None)], "v string, m string, t int")
    assert [r.e for r in ask.select(plan.decision_error(F.col("v"), cands, F.col("m"), F.col("t")).alias("e")).collect()] == ["exists already", None, "not the match", None, None, "no duplicate check"]
    one = spark.range(1)
    ids = lambda *x: F.array(*map(F.lit, x))
    assert one.select(plan.store_changed(ids(1), F.lit("possible"), ids(1, 2), F.lit("create"), F.lit(None).cast("int")).alias("e")).first().e == "new candidates"
    assert one.select(plan.store_changed(ids(1), F.lit("match"), ids(2), F.lit("update"), F.lit(1)).alias("e")).first().e == "the target is gone"
    got = one.select(plan.share_budget(F.array(*[F.lit(12_000)] * 12)).alias("b")).first().b
    assert sum(got) <= 64_000 and got[0] == 12_000 and min(got) >= 2_500
    attr = lambda *rows: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(g).alias("global"), F.lit(v).alias("value")) for n, g, v in rows))
    merged = one.select(plan.merged_attributes(attr(("Cor", True, "a"), ("Peso", False, "b"), ("X", False, "c")), attr((" peso", False, "B"), ("Novo", False, "n"))).alias("m")).first().m
    assert [(r.name.strip(), r.value) for r in merged] == [("Cor", "a"), ("peso", "B"), ("X", "c"), ("Novo", "n")]
    missing = plan.missing_fields(spark.createDataFrame([(1, "food"), (2, "food")], "product_id int, kind string"), spark.createDataFrame([("food", "weight", True), ("food", "color", False)], "kind string, field string, blocker boolean"), spark.createDataFrame([(1, "weight", True), (2, "weight", False)], "product_id int, field string, verified boolean"))
    assert sorted(rows_of(missing, "product_id", "field")) == [(1, "color"), (2, "color"), (2, "weight")]


def test_jobs(spark):
    events = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate([0, 0, 10, 10, 59, 59, 60, 61, 70, None])], "id int, k int, at int")
    got = {r.id: r.admitted for r in jobs.admitted(events, key="k", at="at", order="id", most=1, within=60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: True, 8: False, 9: False}
    table = spark.createDataFrame([(1, 1, "ready", "a"), (2, 2, "ready", "a"), (3, 3, "ready", ""), (4, 4, "done", "z")], "id int, created_at int, status string, sku string")
    matches = spark.createDataFrame([(2, 7, 0.9), (3, 7, 0.9), (4, 7, 0.5)], "id int, product_id int, score double")
    assert sorted(rows_of(jobs.superseded(table, matches), "old", "new")) == [(1, 2), (2, 3)]
    assert sorted(rows_of(jobs.replaced_by(table, matches), "old", "new")) == [(1, 2), (2, 3)]
    assert rows_of(jobs.history(table, 2), "id") == [(4,), (3,)]
    assert rows_of(jobs.upgraded(table, {"tries": 0, "sku": "none"}), "id", "tries")[0] == (1, 0)
    updates = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b")], "id int, seq int, state string")
    assert rows_of(jobs.latest(updates, "id", "seq"), "id", "state") == [(1, "c")]


def test_components(spark):
    import random

    r = random.Random(4)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 300 + i) for i in range(30)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "u int, v int")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"], None), (2, [], "é")], "id long, tags array<string>, name string")
    snapshots.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.splitlines() == ["id,tags,name", "1,a; b,", "2,,é"]
    snapshots.write_snapshot(rows.coalesce(1), str(tmp_path / "snap"), ["u"], "t")
    back = spark.read.schema("id long, tags array<string>, name string").json(str(tmp_path / "snap/data"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "snap/envelope")).select("source_urls", "captured_at", "count").collect()] == [(["u"], "t", back.count())]
    assert sorted(rows_of(back, "id", "name")) == [(1, None), (2, "é")]
    published = spark.createDataFrame([(1,)], "id long")
    answers = spark.createDataFrame([(2, 401, 0), (3, 404, 403), (4, 404, 404), (5, 500, 0), (6, 404, 200)], "id long, product_status int, media_status int")
    assert rows_of(snapshots.classify_ids(spark, 7, published, answers).orderBy("id"), "kind") == [("hidden_product",), ("hidden_media",), ("other_or_deleted",), ("unresolved",), ("media",), ("unresolved",)]
    blocks = spark.createDataFrame([('# A\nURL: http://a\n{"x": 1} tail\n# B\nURL: http://b\nplain\n',)], "text string")
    assert sorted(rows_of(snapshots.split_payloads(blocks), "url", "json"), key=repr) == [("http://a", '{"x": 1}'), ("http://b", None)]
    new, conflicts = snapshots.new_rows(spark.createDataFrame([(1, "A", ""), (2, "B", "g"), (3, "C", "")], "row_id int, sku string, gtin string"), spark.createDataFrame([(9, "A", "g")], "id int, sku string, gtin string"), ["sku", "gtin"])
    assert rows_of(new, "row_id") == [(3,)] and sorted(rows_of(conflicts, "row_id", "key", "existing_id")) == [(1, "sku", 9), (2, "gtin", 9)]
    first = snapshots.first_wins(spark.createDataFrame([(1, "A"), (2, "A"), (3, ""), (4, "")], "id int, sku string"), "sku", "id")
    assert sorted(rows_of(first, "id", "sku", "sku_taken"), key=repr) == [(1, "A", None), (2, None, "A"), (3, "", None), (4, "", None)]
    made = snapshots.get_or_create(spark.createDataFrame([("b",), ("a",), ("x",)], "slug string"), spark.createDataFrame([(7, "x")], "id long, slug string"))
    assert sorted(rows_of(made, "slug", "id")) == [("a", 8), ("b", 9), ("x", 7)]


def test_stream_of_admissions(spark, tmp_path):
    from shelfscope.streaming.admission import admitted_stream

    spark.createDataFrame([(1, 0), (1, 10), (1, 70), (2, 5)], "k long, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, at long").parquet(str(tmp_path / "in"))
    q = admitted_stream(stream, key="k", at="at", most=1, within=60).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM admitted").collect())) == [(1, 0, True), (1, 10, False), (1, 70, True), (2, 5, True)]
