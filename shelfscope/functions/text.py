"""Text rules of catalogue titles and descriptions, as functions from columns to columns.

Two foldings and three notions of an emoji exist side by side because the rules that use them differ; they are not merged.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce, wraps

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide results.
GENERIC_PHRASES = (
    r"\b(?:importad[oa]s?|coreian?[oa]s?|coreano|coreana|koreia|kpop|k-pop|k-snacks?|bebida|snack|salgadinhos?|original de|de|da|do|com|c/|e|para|"
    r"premium|sabor(?:es)?|cor|un|unidades?|caixa|crocante|batata frita|design)\b"
)
VARIANT = r"(?i)\b(?:sabor(?:es)?|cor)\b\s+([^|,]+)"
VARIANT_NOISE = r"\b(?:de|com|sem|acucar|zero|importad[oa]|\d+(?:ml|g|l)?)\b"
NET_CONTENT = r"(?i)(\d+(?:[.,]\d+)?)\s?(ml|g|kg)\b"
MEASURE = r"(\d+(?:[.,]\d+)?)\s?(ml|l|g|kg|cm|mm|un|unid|unidades)\b"
GENERIC_WORDS = (
    "de", "da", "do", "das", "dos", "e", "com", "sem", "para", "em", "a", "o", "no", "na", "c",
    "coreano", "coreana", "coreanos", "coreanas", "korea", "koreia", "coreia", "kpop", "importado", "importada", "original",
    "snack", "salgadinho", "salgadinhos", "bebida", "sabor", "sabores", "cor", "unidade", "unidades", "un", "kit", "caixa",
    "pacote", "design", "premium", "produto", "novo", "crocante",
)
SMALL_WORDS = "de da do das dos e com sem para em a o ao na no".split()
#: Common entities; the full table needs the pandas function below.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&eacute;", "é"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"))
EMOJI_AUDIT = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{2190}-\x{21FF}\x{3030}\x{303D}\x{3297}\x{3299}\x{24C2}\x{2122}\x{2139}]"
EMOJI_QUERY = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"
EMOJI_TITLE = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{2190}-\x{21FF}\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{231A}-\x{231B}\x{2328}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}\x{25AA}-\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{3030}\x{303D}\x{3297}\x{3299}]"
EMOJI_GLUE = r"[\x{FE0F}\x{FE0E}\x{200D}\x{20E3}\x{1F3FB}-\x{1F3FF}]"
_LATIN_FROM = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
_LATIN_TO = "aaaaaaeeeeiiiiooooouuuucnyy"
#: First and last letters of the East Asian scripts, and the same inside a bracket of a Java and of a Python pattern.
CJK_RANGES = ((0x1100, 0x11FF), (0x3131, 0xD79D), (0x3040, 0x30FF), (0x4E00, 0x9FFF))
CJK = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES)
CJK_PYTHON = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in CJK_RANGES)


def _string_udf(f):
    """A pandas function over one column of texts; it is made on its first use, when there is a session."""

    @wraps(f)
    def apply(text: Column) -> Column:
        return F.pandas_udf(f, "string")(text)

    return apply


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# -- decoding and folding ------------------------------------------------------------------------------------------------


def decode_common_entities(text: Column) -> Column:
    """The entities of ENTITIES, the ampersand last; stays in the JVM."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


@_string_udf
def decode_entities(text: pd.Series) -> pd.Series:
    """Every HTML5 entity."""
    return text.map(html.unescape, na_action="ignore")


def _fold_decomposed(s: str) -> str:
    if s.isascii() and "&" not in s:  # nothing to decode or to take apart
        return s.lower()
    s = unicodedata.normalize("NFKD", html.unescape(s).replace("’", "'").replace("‘", "'"))
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


def _fold_recomposed(s: str) -> str:
    for quote in "‘’´`":
        s = s.replace(quote, "'")
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.category(c).startswith("M"))
    return unicodedata.normalize("NFC", s).lower()


@_string_udf
def fold_audit(text: pd.Series) -> pd.Series:
    """Lower case without accents, entities decoded, typographic quotes plain; Hangul stays taken apart."""
    return text.fillna("").map(_fold_decomposed)


@_string_udf
def fold_title(text: pd.Series) -> pd.Series:
    """Lower case without marks, quotes plain; syllables are put together again and entities stay."""
    return text.fillna("").map(_fold_recomposed)


def fold_latin(text: Column) -> Column:
    """Folding of Latin-1 letters without leaving the JVM."""
    return F.translate(F.lower(text), _LATIN_FROM, _LATIN_TO)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_html(text: Column, decode=decode_common_entities) -> Column:
    """Text without tags; escaped closing tags count as tags, entities are decoded after the tags have gone; null becomes ''."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("<\\/"), F.lit("</"))
    return collapse(decode(F.regexp_replace(plain, "<[^>]*>", " ")))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def as_data(text: Column) -> Column:
    """Angle brackets as look-alikes, so that a text can't close the frame around it."""
    return F.translate(text, "<>", "‹›")


# -- emoji, sentences, words ---------------------------------------------------------------------------------------------


def count_emoji(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(EMOJI_AUDIT))


def has_emoji(text: Column) -> Column:
    """1 or 0, null for null, with the narrower ranges of the SQL diagnostics."""
    return text.rlike(EMOJI_QUERY).cast("int")


def strip_emoji(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, EMOJI_TITLE, ""), EMOJI_GLUE, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[ \t]{2,}", " "), r"(?m)^[ \t]+|[ \t]+$", ""))


def audit_sentences(text: Column) -> Column:
    """Stretches of 25 characters or more that end with . ! ? or stand before a check mark."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+|(?<=\S)\s(?=[\x{2705}\x{2714}])"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= 25)


def prose_sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[\p{Lu}\d\"\x{201C}])"), lambda s: F.trim(s) != "")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(text, "[^a-z0-9 ]", " "), r"\s+"), lambda w: F.length(w) > 1))


def title_core(folded: Column, store_name: str | None = None) -> Column:
    """The words of a folded title that tell an item apart; store_name: a pattern of the store's own names, which don't."""
    named = F.regexp_replace(folded, store_name, " ") if store_name else folded
    return _words(F.regexp_replace(named, GENERIC_PHRASES, " "))


def without_variant(title: Column) -> Column:
    return F.regexp_replace(title, VARIANT, " ")


def variant_value(title: Column, fold=fold_latin) -> Column:
    """What follows the word for flavour or colour, folded; null where there is none."""
    found = F.regexp_extract(title, VARIANT, 1)
    return F.when(found != "", F.regexp_replace(fold(found), r"^[ |-]+|[ |-]+$", ""))


def variant_tokens(variant: Column) -> Column:
    return _words(F.regexp_replace(F.coalesce(variant, F.lit("")), VARIANT_NOISE, " "))


def tokens(folded: Column, own_words: tuple[str, ...] = ()) -> Column:
    """The words of a folded name without measures, generic words and the store's own names."""
    bare = F.regexp_replace(F.replace(F.regexp_replace(folded, MEASURE, " "), F.lit("'"), F.lit("")), "[^a-z0-9]+", " ")
    generic = F.array(*map(F.lit, (*GENERIC_WORDS, *own_words)))
    return F.array_distinct(F.filter(F.split(bare, " "), lambda w: (F.length(w) > 1) & ~F.array_contains(generic, w)))


# -- numbers and measures ------------------------------------------------------------------------------------------------


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def net_content(folded: Column) -> Column:
    """The first content of a title in grams or millilitres; null where there is none."""
    value, unit = number(F.regexp_extract(folded, NET_CONTENT, 1)), F.lower(F.regexp_extract(folded, NET_CONTENT, 2))
    return value * F.when(unit == "kg", 1000).otherwise(1)


def measures(folded: Column) -> Column:
    """All measures of a folded text, in order, in ml, g, cm or pieces."""
    found = F.regexp_extract_all(folded, F.lit(MEASURE), F.lit(0))

    def one(m: Column) -> Column:
        value, unit = number(F.regexp_extract(m, MEASURE, 1)), F.regexp_extract(m, MEASURE, 2)
        scaled = value * F.when(unit.isin("l", "kg"), 1000.0).otherwise(1.0) / F.when(unit == "mm", 10.0).otherwise(1.0)
        base = F.when(unit.isin("l", "ml"), "ml").when(unit.isin("kg", "g"), "g").when(unit.isin("cm", "mm"), "cm").otherwise("un")
        return F.struct(scaled.alias("value"), base.alias("unit"))

    return F.transform(found, one)


def same_measure(a: Column, b: Column) -> Column:
    """same, different or unknown: the first two measures of one unit decide, 3 % apart is the same; nothing is the same as 0."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: y["unit"] == x["unit"]), lambda y: F.struct(x["value"].alias("x"), y["value"].alias("y")))))
    first = F.get(pairs, F.lit(0))
    apart = F.try_divide(F.abs(first["x"] - first["y"]), F.greatest(first["x"], first["y"]))
    return F.when(F.size(pairs) == 0, "unknown").when(apart <= 0.03, "same").otherwise("different")


def plain_numbers(text: Column) -> Column:
    """1.250,75 as 1250.75 and 12,5 as 12.5."""
    grouped = F.regexp_replace(text, r"(?<=\d)\.(?=\d{3}(?:\.\d{3})*(?:,\d+)?(?!\d))(?<=(?<!\d)\d{1,3}\.|(?<!\d)\d{1,3}(?:\.\d{3}){1,5}\.)", "")
    return F.regexp_replace(grouped, r"(?<=\d),(?=\d)", ".")


def numbers_in(normal: Column) -> Column:
    """The numbers of a normal text without idle zeros."""
    return F.transform(F.regexp_extract_all(normal, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: F.regexp_replace(F.regexp_replace(F.regexp_replace(n, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def valid_gtin(code: Column) -> Column:
    """8, 12, 13 or 14 digits and nothing else, with a right check digit; null and other texts are not valid."""
    plain = F.trim(code)
    digits = F.transform(F.split(F.reverse(plain), "(?!^)(?!$)"), lambda d: d.try_cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: d * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return F.coalesce(plain.rlike(r"^(?:\d{8}|\d{12,14})$") & (total % 10 == 0), F.lit(False))


def format_brl(amount: Column) -> Column:
    return F.concat(F.lit("R$ "), F.translate(F.format_number(amount, 2), ",.", ".,"))


# -- titles, slugs, keys -------------------------------------------------------------------------------------------------


def slugify(folded: Column, most: int = 70) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.replace(folded, F.lit("'"), F.lit("")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.substring(slug, 1, most)
    last = F.length(cut) - F.length(F.substring_index(cut, "-", -1)) - 1  # what stands before the last hyphen
    short = F.when((F.instr(cut, "-") > 0) & (last > 20), F.substr(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(slug) <= most, slug).otherwise(F.regexp_replace(short, "-+$", ""))


def _capital(word: Column) -> Column:
    low = F.lower(word)
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substr(low, F.lit(2)))


def title_case(text: Column) -> Column:
    """Portuguese title case: units in lower case, short acronyms and mixed case as they are, parts of compounds each."""
    small = F.array(*map(F.lit, SMALL_WORDS))

    def parts(word: Column) -> Column:
        pieces = F.regexp_extract_all(word, F.lit("[-'’]|[^-'’]+"), F.lit(0))
        return F.array_join(F.transform(pieces, _capital), "")

    def one(word: Column, i: Column) -> Column:
        return (
            F.when(word == "", word)
            .when(word.rlike(r"\d"), F.lower(word))
            .when(F.length(word).between(2, 4) & (word == F.upper(word)) & word.rlike("[A-Z]"), word)
            .when(word.rlike("[a-z][A-Z]"), word)
            .when(F.substr(word, F.lit(2)).rlike("[-'’]"), parts(word))
            .when((i > 0) & F.array_contains(small, F.lower(word)), F.lower(word))
            .otherwise(_capital(word))
        )

    return F.array_join(F.transform(F.split(text, " "), one), " ")


def enforce_title(raw: Column, store_names: tuple[str, ...] = (), most: int = 70) -> Column:
    """A struct of the corrected title and the names of the corrections, in their order. store_names: longer names first."""
    # each step is bound to a name that is computed once, as the next ones name it several times
    store = r"(?i)\b(" + "|".join(map(re.escape, store_names)) + r")\b" if store_names else r"(?!)"
    tail = r"(?i),\s*(koreia|korea|coreia|kpop|k-pop|importado|original|promo[cç][aã]o|oferta)\b.*$"
    headed = lambda bare: F.when(bare.rlike(r"[|•·]"), F.get(F.split(bare, r"\s*[|•·]\s*"), F.lit(0))).otherwise(bare)
    tidy = lambda named: collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(named, tail, ""), r"\s+([,.;:])", "$1"), r"[,;:\-–]+$", ""))

    def fitting(cased: Column, words: Column) -> Column:
        # of the lengths of the first word, the first two and so on those that fit are counted; they only grow
        start = F.struct(F.lit(-1).alias("length"), F.lit(0).alias("fit"))
        counted = lambda n, fit: F.struct(n.alias("length"), (fit + (n <= most).cast("int")).alias("fit"))
        grown = lambda a, w: counted(a["length"] + 1 + F.length(w), a["fit"])
        enough = F.aggregate(words, start, grown, lambda a: a["fit"])
        return F.when(F.length(cased) > most, F.array_join(F.slice(words, F.lit(1), F.greatest(enough, F.least(F.lit(3), F.size(words)))), " ")).otherwise(cased)

    def made(bare: Column, head: Column, named: Column, cased: Column) -> Column:
        changes = (("emoji", bare != F.trim(raw)), ("separators", bare.rlike(r"[|•·]")), ("store_name", head.rlike(store)), ("keywords", named.rlike(tail)), ("length", F.length(cased) > most))
        names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in changes)))
        return bound(F.split(cased, " "), lambda words: F.struct(fitting(cased, words).alias("title"), names.alias("adjustments")))

    return bound(strip_emoji(raw), lambda bare: bound(headed(bare), lambda head: bound(F.regexp_replace(head, store, " "), lambda named: bound(title_case(tidy(named)), lambda cased: made(bare, head, named, cased)))))


def short_hash(text: Column) -> Column:
    """The last four base-36 digits of the 32-bit FNV-1a hash of an ASCII text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    prime, start = 16777619, 2166136261
    hashed = F.aggregate(codes, F.lit(start).cast("long"), lambda h, c: h.bitwiseXOR(c.cast("long")) * F.lit(prime).cast("long") % F.lit(1 << 32))
    return F.substr(F.lpad(F.conv(hashed.cast("string"), 10, 36), 7, "0"), F.lit(-4))


# -- addresses -----------------------------------------------------------------------------------------------------------


def canonical_url(url: Column) -> Column:
    """Without fragment, tracking parameters and the slash at the end."""
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.when(F.instr(bare, "?") > 0, F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise("")
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"(?i)^(?:utm_[^=]*|gclid|fbclid|ref|srsltid)(?:=|$)")), "&")
    path = F.regexp_replace(F.regexp_replace(bare, r"\?.*$", ""), "/+$", "")
    return F.when(kept == "", path).otherwise(F.concat_ws("?", path, kept))


def domain_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


# -- prose ---------------------------------------------------------------------------------------------------------------

CONTACT_OR_PROMO = r"(?i)https?://|www\.|whats ?app|@[a-z0-9_]+|\(\d{2}\)\s?\d{4,5}-?\d{4}|r\$\s?\d|desconto|promo[c\x{E7}]|frete gr[a\x{E1}]tis|compre (?:agora|j\x{E1})"
CLAIM = r"(?i)\d+(?:[.,]\d+)?\s?(?:%|mg|kg|ml|kcal|cm|mm|anos|meses|g|l)(?![a-z])"


def unbacked_claims(text: Column, allowed: Column) -> Column:
    """Numbers with units that are not among the allowed ones (spaces and case don't count)."""
    plain = lambda s: F.lower(F.regexp_replace(F.replace(s, F.lit(","), F.lit(".")), r"\s", ""))
    known = F.transform(allowed, plain)
    return F.filter(F.regexp_extract_all(text, F.lit(CLAIM), F.lit(0)), lambda c: ~F.array_contains(known, plain(c)))


def clean_prose(text: Column, allowed: Column) -> Column:
    """A struct of the text without sentences that make unbacked claims or hold contacts, prices or promotions, and of those."""
    bad = lambda s: s.rlike(CONTACT_OR_PROMO) | (F.size(unbacked_claims(s, allowed)) > 0)
    parts = prose_sentences(text)
    return F.struct(F.array_join(F.filter(parts, lambda s: ~bad(s)), " ").alias("text"), F.filter(parts, bad).alias("removed"))


def clean_title(title: Column, allowed: Column) -> Column:
    """The title without the first occurrence of each claim that is not among the allowed ones; other words stay."""
    bare = F.aggregate(unbacked_claims(title, allowed), title, _without_first)
    return F.trim(F.regexp_replace(bare, r"\s{2,}", " "))


def _without_first(text: Column, part: Column) -> Column:
    at = F.instr(text, part)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(part)))).otherwise(text)


def appears_in_any(phrase: Column, texts: Column, fold=fold_latin) -> Column:
    """The folded words of the phrase stand together, with word boundaries, in one of the texts."""
    plain = lambda s: F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(s), "[^a-z0-9]+", " ")), F.lit(" "))
    return (F.trim(plain(phrase)) != "") & F.exists(texts, lambda t: F.contains(plain(t), plain(phrase)))


def parse_json_text(raw: Column, schema: str) -> Column:
    """JSON as it is, else of a fenced block, else from the first to the last brace."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    good = lambda t: F.when(F.expr("1=1") & F.try_parse_json(t).isNotNull(), F.from_json(t, schema))
    return F.coalesce(good(raw), good(fenced), good(braced))


def parse_rows(raw: Column, fields: str, required: Iterable[str], defaults: dict[str, object]) -> Column:
    """A struct of the rows of a JSON array that have all required fields, with defaults for the others, and of how many were
    dropped; what is no array has no rows."""
    rows = F.coalesce(F.when(F.try_parse_json(raw).isNotNull(), F.from_json(raw, f"array<struct<{fields}>>")), F.array().cast(f"array<struct<{fields}>>"))
    names = [f.split(":")[0].strip() for f in fields.split(",")]
    whole = lambda r: reduce(lambda a, b: a & b, (r[c].isNotNull() for c in required))
    kept = F.transform(F.filter(rows, whole), lambda r: F.struct(*((F.coalesce(r[c], F.lit(defaults[c])) if c in defaults else r[c]).alias(c) for c in names)))
    return F.struct(kept.alias("rows"), (F.size(rows) - F.size(kept)).alias("dropped"))


def near_duplicate_terms(a: Column, b: Column) -> Column:
    """Two folded terms that are equal but for an s at the end, or of which one holds the other with at most 9 characters more."""
    x, y = F.regexp_replace(a, "s+$", ""), F.regexp_replace(b, "s+$", "")
    near = (F.contains(x, y) | F.contains(y, x)) & (F.abs(F.length(x) - F.length(y)) <= 9)
    return (x == y) | ((F.length(x) > 3) & near)


def redact_secrets(text: Column, most: int = 1500) -> Column:
    """Error texts without keys and bearer tokens, cut to a length."""
    keyed = F.regexp_replace(text, r"(?i)((?:api[_-]?key|key|token|secret|password)[\"']?\s*[=:]\s*[\"']?)[^\s\"'&]+", "$1***")
    return F.substring(F.regexp_replace(keyed, r"(?i)(bearer|basic)\s+[A-Za-z0-9._~+/=-]+", "$1 ***"), 1, most)


def first_match(text: Column, rules: Iterable[tuple[str, str]], otherwise: str | None) -> Column:
    """The name of the first rule whose pattern is found."""
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)
