"""Text rules on small columns."""

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import sets
from shelfscope.functions import text as tx
from shelfscope.operators import similarity


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_folding(spark):
    assert column(spark, ["Pelúcia O’Star AÇÚCAR", None, "&amp;é"], tx.fold_title) == ["pelucia o'star acucar", "", "&amp;e"]
    assert column(spark, ["Pelúcia O’Star", "&amp;É"], tx.fold_audit) == ["pelucia o'star", "&e"]
    assert column(spark, ["Pelúcia"], tx.fold_latin) == ["pelucia"]


def test_html(spark):
    got = column(spark, ["a<br>b &amp;lt; c<\\/p>  d", None, "", "<p>x&nbsp;y</p>"], tx.strip_html)
    assert got[0].startswith("a b &") and got[1:3] == ["", ""] and got[3] == "x y"
    assert column(spark, ["<a href=\"x\">'&"], tx.escape_html) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;"]


def test_measures(spark):
    got = column(spark, ["soju 360 ml e 1,5l e 30g e 1kg", "x", "10mm 3 unidades"], tx.measures)
    assert [[(m.value, m.unit) for m in g] for g in got] == [[(360, "ml"), (1500, "ml"), (30, "g"), (1000, "g")], [], [(1, "cm"), (3, "un")]]
    assert column(spark, ["x 1,5 kg", "7", None], tx.net_content) == [1500.0, None, None]


def test_codes(spark):
    got = column(spark, ["8801030000396", "8801030000397", "96385074", "12345", "880103000039X", None, " 96385074"], tx.valid_gtin)
    assert got == [True, False, True, False, False, False, True]
    assert column(spark, ["abc"], tx.short_hash) == ["IGAZ"]


def test_titles(spark):
    assert column(spark, ["CHUM-CHURUM morango de USB 360ML ChocoPie o'star"], tx.title_case) == ["Chum-Churum Morango de USB 360ml ChocoPie O'Star"]
    got = column(spark, ["Soju 🍓 | promo | x", "Acme Shop Soju, kpop importado", "palavra " * 20], lambda c: tx.enforce_title(c, ("Acme Shop", "Acme")))
    assert (got[0].title, got[0].adjustments) == ("Soju", ["emoji", "separators"])
    assert (got[1].title, got[1].adjustments) == ("Soju", ["store_name", "keywords"])
    assert len(got[2].title) <= 70 and got[2].adjustments == ["length"]


def test_slugs(spark):
    got = column(spark, ["pelucia o'star 30g!", "-".join(["palavra"] * 12), "", "a" * 90], tx.slugify)
    assert got[0] == "pelucia-ostar-30g" and got[1] == "-".join(["palavra"] * 8) and got[2] == "" and got[3] == "a" * 70


def test_numbers(spark):
    assert column(spark, ["1.500 ml", "1.250,75", "12,5 e 1,25", "1.5", "1.234.567,8 x"], tx.plain_numbers) == ["1500 ml", "1250.75", "12.5 e 1.25", "1.5", "1234567.8 x"]
    assert column(spark, ["007 1.50 2.0 0.5"], tx.numbers_in) == [["7", "1.5", "2", "0.5"]]


def test_addresses(spark):
    urls = ["https://www.x.com/a/?utm_source=q&b=1#top", "http://x.com/", "http://x.com/a?ref=1", "nothing"]
    assert column(spark, urls, tx.canonical_url) == ["https://www.x.com/a?b=1", "http://x.com", "http://x.com/a", "nothing"]
    assert column(spark, urls, tx.domain_of) == ["x.com", "x.com", "x.com", ""]


def test_words_and_variants(spark):
    assert sorted(column(spark, ["acme shop snack coreano de camarao 30g sabor pimenta"], lambda c: tx.title_core(c, r"\bacme shop\b"))[0]) == ["30g", "camarao", "pimenta"]
    assert column(spark, ["Soju Sabor Morango, 360ml", "Soju"], tx.variant_value) == ["morango", None]
    assert column(spark, ["soju chum 360 ml de morango"], tx.tokens) == [["soju", "chum", "morango"]]


def test_sentences_and_claims(spark):
    text = "Uma frase que tem mais de vinte. \u2705 Outra frase que tem mais de vinte!  curta. Fim"
    assert column(spark, [text], tx.audit_sentences) == [["Uma frase que tem mais de vinte.", "\u2705 Outra frase que tem mais de vinte!"]]
    assert column(spark, ["Copo 300ml com 20% e 20% de vidro 300ml", "Copo"], lambda c: tx.clean_title(c, F.array(F.lit("300 ML")))) == ["Copo 300ml com e de vidro 300ml", "Copo"]


def test_prose(spark):
    allowed = F.array(F.lit("360 ml"))
    got = column(spark, ["Bebida doce. Tem 16% de alcool. Contem 360ml. Compre agora no www.x.com."], lambda c: tx.clean_prose(c, allowed))[0]
    assert got.text == "Bebida doce. Contem 360ml." and len(got.removed) == 2
    assert column(spark, ["Lotte", "Lott"], lambda c: tx.appears_in_any(c, F.array(F.lit("a LOTTE choco"), F.lit("Lotteria")))) == [True, False]
    assert column(spark, ['{"a":1}', 'x ```json\n{"a":2}\n```', 'so {"a":3} it is', "none"], lambda c: tx.parse_json_text(c, "a int")["a"]) == [1, 2, 3, None]


def test_emoji_and_sentences(spark):
    assert column(spark, ["a✅b🍓", None], tx.count_emoji) == [2, 0]
    assert column(spark, ["a 🍓  b", "x️"], tx.strip_emoji) == ["a b", "x"]
    assert column(spark, ["Short. This one is long enough to stay here. Tail"], tx.audit_sentences) == [["This one is long enough to stay here."]]


def test_near_terms_and_secrets(spark):
    df = spark.createDataFrame([("cores", "core"), ("24 cores", "4 cores"), ("abc", "abcd"), ("doce", "doce de leite")], "a string, b string")
    assert [r.y for r in df.select(tx.near_duplicate_terms(F.col("a"), F.col("b")).alias("y")).collect()] == [True, True, False, True]
    assert column(spark, ["api_key=abc123 and Bearer xyz.1"], tx.redact_secrets) == ["api_key=*** and Bearer ***"]


def test_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    got = df.select(sets.jaccard(F.col("a"), F.col("b")).alias("j"), sets.only_of(F.col("a"), ["a", "b", "x"]).alias("o"), sets.holds_all(F.col("a"), F.col("b")).alias("h")).collect()
    assert [(round(r.j, 3), r.o, r.h) for r in got] == [(0.333, True, False), (0.0, False, True)]


LISTING = {"brand": "Lotte", "variant": "Morango", "net_content": "360 ml", "gtin": "", "sku": ""}


@pytest.mark.parametrize(
    ("title", "changes", "name", "brands", "codes", "low", "high", "reason"),
    [
        ("Soju Chum Churum Morango 360ml", {}, "Soju Chum Churum sabor morango 360 ml", ["Lotte"], {}, 0.8, 1, "same variant"),
        ("Soju Chum Churum Morango 360ml", {}, "Soju Chum Churum sabor uva 360 ml", ["Lotte"], {}, 0, 0.5499, "different variant"),
        ("Soju Chum Churum Morango 360ml", {}, "Soju Chum Churum morango 640 ml", ["Lotte"], {}, 0, 0.5499, "different size"),
        ("Soju Morango", {"net_content": "240ml"}, "Soju morango 238 ml", ["Lotte"], {}, 0.8, 1, "same size"),
        ("x", {"gtin": "8801-0300", "variant": "", "net_content": ""}, "y", [], {"c_gtin": "88010300"}, 1, 1, "same gtin"),
        ("x", {"sku": "ab-1", "variant": "", "net_content": ""}, "y", [], {"c_sku": "AB-1"}, 0.98, 0.98, "same sku"),
        ("x", {"sku": "ab-1", "net_content": "360 ml", "variant": ""}, "y 640ml", [], {"c_sku": "AB-1"}, 0.7, 0.7, "same code but other variant or size"),
    ],
)
def test_listing_scores(spark, title, changes, name, brands, codes, low, high, reason):
    row = LISTING | changes | {"title": title, "c_name": name, "c_brands": brands, "c_gtin": "", "c_sku": ""} | codes
    schema = ", ".join(f"{k} {'array<string>' if k == 'c_brands' else 'string'}" for k in row)
    got = similarity.compare_listings(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert low <= got.score <= high and reason in got.reasons


def test_verdicts(spark):
    rows = [(1, i, s, 0, st) for i, s, st in ((1, 0.9, "draft"), (2, 0.9, "publish"), (3, 0.99, "trash"), (4, 0.5, "publish"))] + [(2, 9, 0.6, 1, "publish"), (3, 9, 0.1, 1, "publish")]
    top, verdict = similarity.verdicts(spark.createDataFrame(rows, "item_id int, id int, score double, tier int, status string"))
    assert [(r.item_id, r.id, r.place) for r in top.orderBy("item_id", "place").collect()] == [(1, 2, 1), (1, 1, 2), (2, 9, 1)]
    assert {r.item_id: r.verdict for r in verdict.collect()} == {1: "match", 2: "possible", 3: "none"}


def test_jaccard_pairs_equal_brute_force(spark):
    import random

    r = random.Random(2)
    rows = [(i, [r.choice("abcdefghij") for _ in range(r.randint(0, 7))], i % 2) for i in range(60)]
    got = {(x.a, x.b) for x in similarity.jaccard_pairs(spark.createDataFrame(rows, "id int, s array<string>, g int"), "id", "s", 0.6, "g").collect()}
    sets_ = {i: set(s) for i, s, _ in rows}
    want = {(a, b) for a in sets_ for b in sets_ if a < b and a % 2 == b % 2 and sets_[a] and sets_[b] and len(sets_[a] & sets_[b]) / len(sets_[a] | sets_[b]) >= 0.6}
    assert got == want
