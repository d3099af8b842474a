"""Folding, numbers and words of evidence as column functions: nothing of it leaves the JVM.

Letters are mapped by a dictionary that a rule makes from the character database: compatibility forms taken apart, marks dropped,
lower case. One letter for one is a translation; letters that become several are replaced one distinct letter after the other, and
only in texts that hold some; Hangul letters that stand apart are put together by arithmetic.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK, bound

# Quotes that read as an apostrophe, and the sizes of the Hangul alphabet.
QUOTES = "‘’´`"
_FIRST_SYLLABLE, _VOWELS, _TAILS = 0xAC00, 21, 28
_BETWEEN = "\ue000"  # stands between texts; no letter becomes it
_APART = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}]"
_GROUPED = r"[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?(?![0-9])"


@cache
def letters() -> tuple[str, str, dict[str, str]]:
    """Letters that become one other, what they become (letters beyond its end go), and those that become several."""
    one, gone, many = {q: "'" for q in QUOTES}, [], {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if c in one or 0xD800 <= ord(c) < 0xE000 or _FIRST_SYLLABLE <= ord(c) <= 0xD7A3:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M"))
        plain = unicodedata.normalize("NFC", plain).lower()
        if plain == c:
            continue
        if len(plain) == 1:
            one[c] = plain
        elif plain:
            many[c] = plain
        else:
            gone.append(c)
    return "".join(one) + "".join(gone), "".join(one.values()), many


def _syllable(apart: Column) -> Column:
    """Hangul letters that belong to one syllable, put together; a syllable that is closed keeps the letter behind it."""
    code = lambda i: F.ascii(F.substr(apart, F.lit(i), F.lit(1)))
    tail = lambda i: F.when(F.length(apart) >= i, code(i) - 0x11A7).otherwise(0)
    made = F.when(code(1) < _FIRST_SYLLABLE, _FIRST_SYLLABLE + ((code(1) - 0x1100) * _VOWELS + code(2) - 0x1161) * _TAILS + tail(3)).when((code(1) - _FIRST_SYLLABLE) % _TAILS == 0, code(1) + tail(2))
    return F.coalesce(F.decode(F.unhex(F.hex(made)), "UTF-16BE"), apart)


def folded(text: Column) -> Column:
    """Lower case without marks, typographic quotes plain, Hangul put together; null becomes ''. A capital sigma reads σ everywhere."""
    before, after, many = letters()
    several = "".join(many)
    rare, become = F.split(F.lit(several), ""), F.split(F.lit(_BETWEEN.join(many.values())), _BETWEEN)

    def longer(t: Column) -> Column:
        found = F.array_intersect(F.split(t, ""), rare)
        return F.when(F.length(F.translate(t, several, "")) < F.length(t), F.aggregate(found, t, lambda a, c: F.replace(a, c, F.element_at(become, F.array_position(rare, c).cast("int"))))).otherwise(t)

    def together(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(f"({_APART})"), F.lit(1)))
        longest_first = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
        return F.when(t.rlike(_APART), F.aggregate(longest_first, t, lambda a, s: F.replace(a, s, _syllable(s)))).otherwise(t)

    return bound(F.translate(bound(F.coalesce(text, F.lit("")), longer), before, after), together)


def plain_numbers(text: Column) -> Column:
    """Numbers without points between thousands: 1.250,75 reads 1250.75."""
    bare = lambda m: F.coalesce(F.replace(F.replace(m, F.lit("."), F.lit("")), F.lit(","), F.lit(".")), F.lit(""))
    mend = lambda t: F.array_join(F.zip_with(F.split(t, _GROUPED, -1), F.regexp_extract_all(t, F.lit(f"({_GROUPED})"), F.lit(1)), lambda p, m: F.concat(p, bare(m))), "")
    return bound(text, lambda t: F.when(t.rlike(_GROUPED), mend(t)).otherwise(t))


def normal(text: Column) -> Column:
    """Folded words and numbers with one space between them; null becomes ''."""
    decimals = F.regexp_replace(plain_numbers(F.coalesce(text, F.lit(""))), "([0-9]),([0-9])", "$1.$2")
    return F.trim(F.regexp_replace(folded(decimals), f"[^a-z0-9.%{CJK}]+", " "))


def again(plain: Column) -> Column:
    """normal() of a text, or a part of one, that is normal already: only points between thousands can still be left."""
    return F.trim(plain_numbers(plain))


def numbers(plain: Column) -> Column:
    """The distinct numbers of a normal text, to the last digit, without idle zeros."""
    def bare(n: Column) -> Column:
        whole = F.regexp_replace(n, "^0+(?=[0-9])", "")
        return F.regexp_replace(F.regexp_replace(whole, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")

    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit("([0-9]+(?:\\.[0-9]+)?)"), F.lit(1)), bare))


def digits(plain: Column) -> Column:
    """The distinct runs of digits of a text as they stand: 07 is not 7."""
    return F.array_distinct(F.regexp_extract_all(plain, F.lit("([0-9]+)"), F.lit(1)))
