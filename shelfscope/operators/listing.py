"""Listings from verified facts: SKUs, attributes, descriptions, nutrition rows, safe HTML, error classes, admission checks."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sets
from ..functions import text as tx

# Order of attributes, sections, tags that may stay.
SPEC_ORDER = "brand manufacturer country_of_origin net_content alcohol_abv caffeine material dimensions capacity item_weight color size age_grading compatibility package_contents gtin inmetro anvisa anatel warranty".split()
SECTIONS = {"ingredients": "Ingredientes", "allergens": "Alergênicos", "gluten": "Glúten", "lactose": "Lactose", "preparation": "Modo de preparo", "usage": "Modo de uso", "storage": "Conservação", "shelf_life": "Validade", "care": "Cuidados"}
ALLOWED_TAGS = frozenset("h2 h3 p ul ol li strong em br table thead tbody tr th td small".split())
ALLOWED_ATTRIBUTES = {"th": "scope", "td": "colspan"}
_SKU_NOISE = "de da do com sem sabor cor e".split()
_TABLE = r"(?i)Porção de ([^:]+):\s*([^\n]+)"
_ROW = r"([A-Za-zÀ-ÿ ]+?)\s+(\d+(?:[.,]\d+)?\s?(?:kcal|g|mg))(?:\s+(\d+%))?"


def sku_code(folded: Column, letters: int = 3) -> Column:
    """Three letters of one word, two of each of the first two."""
    bare = F.regexp_replace(F.replace(F.coalesce(folded, F.lit("")), F.lit("'"), F.lit("")), "[^a-z0-9 ]+", " ")
    words = F.filter(F.split(bare, " "), lambda w: (F.length(w) > 1) & ~w.isin(*_SKU_NOISE))
    two = F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 2)), "")
    return F.upper(F.when(F.size(words) == 0, "").when(F.size(words) == 1, F.substring(F.get(words, F.lit(0)), 1, letters)).otherwise(two))


def build_sku(items: DataFrame, fold=tx.fold_title) -> DataFrame:
    """items (product_type, brand, line, variant, net_content, pack_count) with sku: readable parts and a hash of the whole identity."""
    named = ("product_type", "brand", "line", "variant", "net_content")
    folded = items.withColumns({f"__{c}": fold(F.coalesce(c, F.lit(""))) for c in named})
    size = F.get(tx.measures(F.col("__net_content")), F.lit(0))
    whole = size["value"] == F.floor(size["value"])
    amount = F.when(whole, F.floor(size["value"]).cast("string")).otherwise(F.format_string("%.1f", size["value"]))
    pack = F.when(F.col("pack_count") > 1, F.concat(F.col("pack_count").cast("string"), F.lit("UN"))).otherwise("")
    parts = F.array(*(sku_code(F.col(f"__{c}")) for c in named[:4]), F.coalesce(F.concat(amount, F.upper(size["unit"])), F.lit("")), pack)
    readable = F.regexp_replace(F.substring(F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), "-"), 1, 34), "-+$", "")
    plain = lambda c: F.regexp_replace(c, "[^a-z0-9]+", "")
    key = F.concat_ws("|", *(plain(F.col(f"__{c}")) for c in ("brand", "line", "product_type", "variant", "net_content")), F.coalesce(F.col("pack_count").cast("string"), F.lit("")))
    sku = F.concat_ws("-", F.when(readable == "", "SKU").otherwise(readable), tx.short_hash(key))
    return folded.withColumn("sku", sku).drop(*(f"__{c}" for c in named))


def nutrition_rows(text: Column) -> Column:
    """A struct of serving and rows (nutrient, amount, daily) of a table in one line; null with fewer than three rows."""
    serving, body = F.trim(F.regexp_extract(text, _TABLE, 1)), F.regexp_extract(text, _TABLE, 2)
    cell = lambda p, k: F.regexp_extract(p, _ROW, k)
    row = lambda p: F.struct(F.trim(cell(p, 1)).alias("nutrient"), F.regexp_replace(cell(p, 2), r"\s", " ").alias("amount"), F.nullif(cell(p, 3), F.lit("")).alias("daily"))
    rows = F.filter(F.transform(F.split(body, ";"), lambda p: row(F.trim(p))), lambda r: r["nutrient"] != "")
    return F.when(F.size(rows) >= 3, F.struct(serving.alias("serving"), rows.alias("rows")))


def labelled_facts(texts: DataFrame, rules: dict[str, str], id_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """(id, field, value): the first match of each field's pattern in each text."""
    found = texts.select(id_col, *(F.nullif(F.trim(F.regexp_extract(F.coalesce(text_col, F.lit("")), p, 1)), F.lit("")).alias(n) for n, p in rules.items()))
    return found.unpivot([id_col], list(rules), "field", "value").where("value IS NOT NULL")


class _Allowed(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "textarea", "option", "noscript"):
            self.hidden += 1
        elif tag in ALLOWED_TAGS and not self.hidden:
            kept = "".join(f' {k}="{(v or "").replace(chr(34), "&quot;")}"' for k, v in attrs if ALLOWED_ATTRIBUTES.get(tag) == k)
            self.out.append(f"<{tag}{kept} />" if tag == "br" else f"<{tag}{kept}>")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "textarea", "option", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ALLOWED_TAGS and tag != "br" and not self.hidden:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))

    def handle_entityref(self, name):
        self.out += [] if self.hidden else [f"&{name};"]

    def handle_charref(self, name):
        self.out += [] if self.hidden else [f"&#{name};"]


def sanitized(html: str) -> str:
    parser = _Allowed()
    parser.feed(html)
    parser.close()
    return "".join(parser.out).strip()


def safe_html(html: Column) -> Column:
    """Only the tags of a product page; others go and their text stays, scripts and styles go with their content."""
    return F.pandas_udf(lambda s: s.map(sanitized, na_action="ignore"), "string")(html)


def html_text(html: Column) -> Column:
    """The text of safe HTML in one line."""
    return tx.collapse(tx.decode_common_entities(F.regexp_replace(safe_html(html), "<[^>]*>", "")))


def safe_text(text: Column) -> Column:
    return tx.escape_html(F.trim(tx.strip_emoji(text)))


def attributes(facts: DataFrame, products: DataFrame) -> DataFrame:
    """(product_id, attributes): the first verified fact of each field in the order of the list, then the variant.

    facts: product_id, pos, field, label, value, verified; products: product_id, kind, variant.
    """
    order = F.array_position(F.array(*map(F.lit, SPEC_ORDER)), F.col("field"))
    shown = facts.where(F.col("verified") & F.col("field").isin(*SPEC_ORDER)).groupBy("product_id", "field").agg(F.min_by(F.struct("label", "value"), "pos").alias("f"))
    listed = shown.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("f.label").alias("name"), F.trim(tx.strip_emoji(F.col("f.value"))).alias("value")))).alias("a"))
    pair = lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))
    name = F.when(F.col("kind").isin("backpack_bag", "apparel_footwear"), "Cor / modelo").otherwise("Sabor / variação")
    variant = F.when(F.coalesce("variant", F.lit("")) != "", F.array(F.struct(name.alias("name"), F.col("variant").alias("value")))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    facts_ = F.filter(F.transform(F.coalesce("a", F.array().cast("array<struct<o:bigint,name:string,value:string>>")), pair), lambda x: x["value"] != "")
    merged = products.join(listed, "product_id", "left").select("product_id", F.concat(facts_, variant).alias("all"))
    names = F.transform("all", lambda x: x["name"])
    return merged.select("product_id", F.filter("all", lambda x, i: F.array_position(names, x["name"]) == i + 1).alias("attributes"))


def description(paragraphs: Column, highlights: Column, attributes_: Column, sections: Column, notices: Column) -> Column:
    """The page of a product: paragraphs, highlights, a table, sections (heading, text), notices; all texts are made safe."""
    some = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), safe_text), lambda x: x != "")
    wrap = lambda a, before, after: F.array_join(F.transform(a, lambda x: F.concat(F.lit(before), x, F.lit(after))), "")
    body = lambda a, head, inner, tail: F.when(F.size(a) > 0, F.concat(F.lit(head), inner, F.lit(tail)))
    intro, best, warn = some(paragraphs), some(highlights), F.array_distinct(some(notices))
    rows = F.array_join(F.transform(attributes_, lambda a: F.concat(F.lit('<tr><th scope="row">'), tx.escape_html(a["name"]), F.lit("</th><td>"), tx.escape_html(a["value"]), F.lit("</td></tr>"))), "")
    parts = F.array_join(F.transform(sections, lambda s: F.concat(F.lit("<h2>"), s["heading"], F.lit("</h2><p>"), safe_text(F.concat(F.upper(F.substring(F.trim(s["text"]), 1, 1)), F.substr(F.trim(s["text"]), F.lit(2)))), F.lit("</p>"))), "\n")
    return F.concat_ws(
        "\n",
        F.nullif(F.array_join(F.transform(intro, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "\n"), F.lit("")),
        body(best, "<h2>Destaques</h2><ul>", wrap(best, "<li>", "</li>"), "</ul>"),
        body(attributes_, "<h2>Especificações</h2><table><tbody>", rows, "</tbody></table>"),
        F.nullif(parts, F.lit("")),
        body(warn, "<h2>Avisos importantes</h2><ul>", wrap(warn, "<li><strong>", "</strong></li>"), "</ul>"),
    )


def error_class(status: Column, detail: Column) -> Column:
    """The kind of a failed request: the first rule that fits."""
    says = lambda p: F.coalesce(detail, F.lit("")).rlike("(?i)" + p)
    return (
        F.when(status == 0, "network")
        .when(status.isin(401, 403) | ((status == 400) & says("api[ _-]?key")), "credentials")
        .when(status.isin(402, 429, 432, 433) | (status.isNotNull() & says("quota|credits|rate.?limit|usage limit")), "quota")
        .when((status >= 500) | (status == 408) | (status.isNotNull() & says("high demand|overloaded")), "network")
        .when(status.isNull() & says("timeout|timed out|abort|ETIMEDOUT|ECONNRESET|ECONNREFUSED|ENOTFOUND|EAI_AGAIN|fetch failed"), "network")
        .otherwise("unknown")
    )


def input_errors(name: Column, url: Column, stock: Column) -> Column:
    """What is wrong with a request to register a product."""
    return sets.flags((
        ("name", ~F.coalesce(F.length(F.trim(name)).between(3, 200), F.lit(False))), ("url", (F.coalesce(url, F.lit("")) != "") & ~url.rlike("(?i)^https?://")), ("stock", ~F.coalesce(stock.between(0, 100_000), F.lit(False))),
    ))
