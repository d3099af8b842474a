"""Listings and research on small tables."""

from pyspark.sql import functions as F

from shelfscope.functions import text as tx
from shelfscope.operators import listing, near, research


def test_skus_are_stable_and_follow_the_variant(spark):
    rows = [("Soju", "Lotte", "Chum Churum", v, "360 ml", p) for v, p in (("Morango", None), ("Morango", None), ("Morango Silvestre", None), ("Morango", 6))] + [(None, None, None, None, None, None)]
    got = [r.sku for r in listing.build_sku(spark.createDataFrame(rows, "product_type string, brand string, line string, variant string, net_content string, pack_count int")).collect()]
    assert got[0] == got[1] and got[0].startswith("SOJ-LOT-CHCH-MOR-360ML-") and len(set(got)) == 4 and got[3].split("-")[-2] == "6UN" and got[4].startswith("SKU-")


def test_nutrition_and_facts(spark):
    df = spark.createDataFrame([("s1", "Porção de 30 g: Valor energético 160 kcal 8%; Carboidratos 20g; Sódio 5 mg 1%\nOrigem: Coreia"), ("s2", "nada"), ("s3", None)], "source_id string, text string")
    got = [r.n for r in df.select(listing.nutrition_rows(F.col("text")).alias("n")).collect()]
    assert got[0].serving == "30 g" and [(r.nutrient, r.amount, r.daily) for r in got[0].rows] == [("Valor energético", "160 kcal", "8%"), ("Carboidratos", "20g", None), ("Sódio", "5 mg", "1%")] and got[1:] == [None, None]
    facts = listing.labelled_facts(df, {"origin": r"(?i)origem: (\w+)", "none": "x(y)z"}).collect()
    assert [(f.source_id, f.field, f.value) for f in facts] == [("s1", "origin", "Coreia")]


def test_safe_html(spark):
    html = '<p onclick="x">a<script>b</script><a href="javascript:1">c</a> &amp; d<br></p><td colspan="2" id=1>e</td>'
    df = spark.createDataFrame([(html,), (None,)], "h string")
    got = [(r.s, r.t) for r in df.select(listing.safe_html(F.col("h")).alias("s"), listing.html_text(F.col("h")).alias("t")).collect()]
    assert got == [('<p>ac &amp; d<br /></p><td colspan="2">e</td>', "ac & de"), (None, None)]


def test_attributes_and_description(spark):
    facts = spark.createDataFrame([(1, 2, "net_content", "Conteúdo", "360 ml", True), (1, 1, "brand", "Marca", "Lotte 🍓", True), (1, 3, "brand", "Marca", "Outra", True), (1, 4, "color", "Cor", "x", False)], "product_id int, pos int, field string, label string, value string, verified boolean")
    products = spark.createDataFrame([(1, "food", "Morango"), (2, "food", None)], "product_id int, kind string, variant string")
    got = {r.product_id: [(a["name"], a["value"]) for a in r.attributes] for r in listing.attributes(facts, products).collect()}
    assert got == {1: [("Marca", "Lotte"), ("Conteúdo", "360 ml"), ("Sabor / variação", "Morango")], 2: []}
    one = spark.range(1).select(F.array(F.lit("Oi <b>"), F.lit("")).alias("p"), F.array(F.lit("h")).alias("h"), F.array(F.struct(F.lit("A").alias("name"), F.lit("b&").alias("value"))).alias("a"), F.array(F.struct(F.lit("Validade").alias("heading"), F.lit("manter").alias("text"))).alias("s"), F.array(F.lit("n"), F.lit("n")).alias("n"))
    text = one.select(listing.description(*(F.col(c) for c in "phasn")).alias("d")).first().d
    assert text == '<p>Oi &lt;b&gt;</p>\n<h2>Destaques</h2><ul><li>h</li></ul>\n<h2>Especificações</h2><table><tbody><tr><th scope="row">A</th><td>b&amp;</td></tr></tbody></table>\n<h2>Validade</h2><p>Manter</p>\n<h2>Avisos importantes</h2><ul><li><strong>n</strong></li></ul>'


def test_errors_and_inputs(spark):
    rows = [(0, ""), (403, ""), (400, "bad api key"), (429, ""), (503, ""), (None, "ETIMEDOUT"), (404, ""), (None, "odd")]
    got = [r.c for r in spark.createDataFrame(rows, "s int, d string").select(listing.error_class(F.col("s"), F.col("d")).alias("c")).collect()]
    assert got == ["network", "credentials", "credentials", "quota", "network", "network", "unknown", "unknown"]
    asked = spark.createDataFrame([("ab", "ftp://x", -1), ("abc", None, 5), (None, "", None)], "n string, u string, s int")
    assert [r.e for r in asked.select(listing.input_errors(F.col("n"), F.col("u"), F.col("s")).alias("e")).collect()] == [["name", "url", "stock"], [], ["name", "stock"]]


def test_images(spark):
    rows = [(1, 1, 10, 10, 0b0), (1, 2, 20, 20, 0b111), (1, 3, 5, 5, 0b11111111), (1, 4, 30, 30, -1), (2, 9, 1, 1, 0)]
    got = near.greedy_images(spark.createDataFrame(rows, "product_id int, image_id int, width int, height int, hash long"))
    assert sorted((r.product_id, r.image_id) for r in got.collect()) == [(1, 2), (1, 4), (2, 9)]
    sources = spark.createDataFrame([(1, "S1", "reference", 1, ["http://x/a-100x100.jpg", "http://x/logo.png"]), (1, "S2", "web", 2, ["http://x/a.jpg?v=1", " http://x/b.jpg ", "data:xx"])], "item_id int, source_id string, origin string, place int, images array<string>")
    assert [(r.url, r.source_id) for r in research.image_candidates(sources).orderBy("priority").collect()] == [("http://x/a-100x100.jpg", "S1"), ("http://x/b.jpg", "S2")]
    reviews = spark.createDataFrame([(1, 0, "ok", True, False), (1, 1, "main", True, False), (1, 1, "ok", True, False), (1, 2, "reject", True, False), (1, 9, "ok", True, False), (1, 3, "ok", True, True)], "item_id int, index int, verdict string, matches boolean, overlay boolean")
    assert [r["index"] for r in research.accepted_images(reviews, F.lit(5), 4).orderBy("place").collect()] == [1, 0]


def test_research(spark):
    hits = spark.createDataFrame([(1, 0, "http://a/?utm_x=1", "A", "curto", ["i"]), (1, 1, "http://a", "B", "texto mais longo", ["j", "i"]), (1, 2, "http://b", "Lotte soju morango", "360ml 8801", [])], "item_id int, pos int, url string, title string, text string, images array<string>")
    merged = research.merged_hits(hits)
    first = merged.where("key = 'http://a'").first()
    assert (first.title, first.text, first.images) == ("A", "texto mais longo", ["i", "j"])
    identity = {"brand": "Lotte", "line": "Soju", "native_name": None, "product_type": "x y", "net_content": "360 ML", "gtin": "8801"}
    scored = research.relevance(merged.withColumns({k: F.lit(v).cast("string") for k, v in identity.items()}).withColumn("variants", F.array(F.lit("Morango"))))
    assert {r.url: r.score for r in scored.collect()} == {"http://a/?utm_x=1": 0, "http://b": 2 + 2 + 3 + 1 + 5}
    pages = spark.createDataFrame([(1, 0, "x", 5), (1, 1, "한국", 2), (1, 2, "y", 2), (1, 3, "z", 7), (1, 4, "한국", 2)], "item_id int, pos int, text string, score int")
    assert [r.pos for r in research.ranked_sources(pages, 3).orderBy("place").collect()] == [3, 0, 1]


def test_candidate_lookup(spark):
    items = spark.createDataFrame([(1, "ab-1", None, "soju morango"), (2, "", "88-01", "x")], "item_id int, sku string, gtin string, name string")
    catalogue = spark.createDataFrame([(10, "AB-1", "", "outro"), (11, "", "8801", "Soju de Morango 360ml"), (12, "", None, "Soju Uva")], "id int, sku string, gtin string, name string")
    got = research.lookup_candidates(items, catalogue, tx.fold_latin)
    assert sorted(map(tuple, got.collect())) == [(1, 10, 1), (1, 11, 2), (2, 11, 0)]


def test_names_by_rare_grams(spark, monkeypatch):
    import random

    r = random.Random(2)
    names = [(i, " ".join("".join(r.choices("abc-", k=r.randint(1, 6))) for _ in range(r.randint(0, 4)))) for i in range(300)] + [(900, "x"), (901, "")]
    queries = [(i, ["".join(r.choices("abc-", k=r.randint(3, 5))) for _ in range(r.randint(0, 3))]) for i in range(200)] + [(900, ["abc"]), (901, ["zzz", "abc"])]
    a, b = spark.createDataFrame(queries, "qid int, words array<string>"), spark.createDataFrame(names, "nid int, name string")
    want = sorted((q, n) for q, w in queries for n, name in names if w and all(x in name for x in w))
    for share, floor in ((0.01, 50), (0.02, 1), (1.0, 1)):
        monkeypatch.setattr(research, "GRAM_SHARE", share)
        monkeypatch.setattr(research, "GRAM_FLOOR", floor)
        assert sorted(map(tuple, research.names_with_words(a, b).collect())) == want
    assert len(want) > 100 and research.names_with_words(a.limit(0), b).count() == 0 and research.names_with_words(a, b.limit(0)).count() == 0
