"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds anchors: at-signs, schemes, digit contacts and identifier cues. From
each anchor a small deterministic parser walks outwards to the boundaries of an e-mail address, an IP address, a card or phone
number, an address with credentials, an account number or a secret, and checks it. No pattern is run over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_uppercase

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_names, pieces

#: Order of kinds in a list of spans; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s/@<>\"']+@[^\s<>\"']+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NUMBER = re.compile(r"(?: ?(?:no\.?|number|nr\.?|#))?[ :=#]{1,3}([0-9](?:[ -]?[0-9]){5,17})(?![0-9])", re.I)
_SECRET = re.compile(r"\s?[=:]\s?[\"']?([^\s\"']{8,})")
_KEY_ID = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_CUES = {
    "account": ("account", "acct", "iban", "konto", "compte", "cuenta"),
    "secret": ("password", "passwd", "token", "secret", "api_key", "apikey"),
}
_KEY_PREFIX = ("AKIA", "ASIA")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(f"+{d}", ("phone", 2))
        for e in "0123456789":
            for between in ("", " ", "-"):
                found.add_word(f"{d}{between}{e}", ("card", 2 + len(between)))
            found.add_word(f"{d}.{e}", ("ip", 3))
    found.add_word("@", ("email", 1))
    found.add_word("://", ("url", 3))
    for kind, cues in _CUES.items():
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(form, (kind, len(form)))
    for a in ascii_uppercase:
        for b in ascii_uppercase:
            for d in "0123456789":
                found.add_word(f"{a}{b}{d}", ("iban", 3))
    for prefix in _KEY_PREFIX:
        found.add_word(prefix, ("key_id", len(prefix)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d // 5 * -9 + 2 * d for d in map(int, even))) % 10 == 0


def _mod97(iban: str) -> bool:
    code = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def _digits_of(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


class _Scan:
    """The state of one pass over one text: for each kind, where the last match ended."""

    def __init__(self, text: str):
        self.text, self.spans, self.end = text, [], dict.fromkeys(KINDS, 0)

    def run_start(self, at: int, least: int, allowed: frozenset) -> int:
        text = self.text
        while at > least and text[at - 1] in allowed:
            at -= 1
        return at

    def take(self, kind: str, start: int, end: int, good: bool = True) -> None:
        """A match uses up its characters, also where its check fails."""
        self.end[kind] = end
        if good:
            self.spans.append((kind, start, end))

    def email(self, at: int, _: int) -> None:
        start = self.run_start(at, self.end["email"], _LOCAL)
        if start < at and (m := _DOMAIN.match(self.text, at + 1)):
            self.take("email", start, m.end())

    def ip(self, at: int, _: int) -> None:
        if at < self.end["ip"]:
            return
        start = self.run_start(at, self.end["ip"], _DIGITS)
        if m := _IP.match(self.text, start):
            # no part longer than its limit is turned into a number, whatever its length
            self.take("ip", start, m.end(), all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")))

    def card(self, at: int, _: int) -> None:
        if at >= self.end["card"] and (m := _CARD.match(self.text, at)):
            digits = _digits_of(m[0])
            self.take("card", at, m.end(), 16 <= len(digits) <= 19 and _luhn(digits))

    def phone(self, at: int, _: int) -> None:
        if at >= self.end["phone"] and (m := _PHONE.match(self.text, at)):
            self.take("phone", at, m.end(), 8 <= len(_digits_of(m[0])) <= 15)

    def url(self, at: int, size: int) -> None:
        start = at
        while start > self.end["url"] and self.text[start - 1].isascii() and self.text[start - 1].isalpha():
            start -= 1
        if start < at and (m := _URL_REST.match(self.text, at + size)):
            self.take("url", start, m.end())

    def account(self, at: int, size: int) -> None:
        if at < self.end["account"]:
            return
        if m := _NUMBER.match(self.text, at + size):
            self.take("account", m.start(1), m.end(1))

    def iban(self, at: int, _: int) -> None:
        before = self.text[at - 1 : at]
        if at < self.end["account"] or before.isalnum() or before == "_":
            return
        if m := _IBAN.match(self.text, at):
            words = m[0]
            while len(words) >= 15:  # a word that follows may look like a part of it
                if _mod97(words.replace(" ", "")):
                    return self.take("account", at, at + len(words))
                words = words.rpartition(" ")[0]

    def secret(self, at: int, size: int) -> None:
        if at >= self.end["secret"] and (m := _SECRET.match(self.text, at + size)):
            self.take("secret", m.start(1), m.end(1))

    def key_id(self, at: int, size: int) -> None:
        alone = at == 0 or not self.text[at - 1].isalnum()
        if alone and at >= self.end["secret"] and (m := _KEY_ID.match(self.text, at + size)):
            self.take("secret", at, m.end())


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data in a text, in code points with the end excluded, by kind and then start."""
    scan = _Scan(text)
    for last, (kind, size) in _anchors().iter(text):
        getattr(scan, kind)(last - size + 1, size)
    return sorted(scan.spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, *, text_col: str = "text", spans_col: str = "pii_spans", redacted_col: str | None = None) -> DataFrame:
    """docs with a column of spans, an array of (kind, start, end) sorted by kind and start, and the redacted text where a
    column for it is named.

    Kinds: email, ip, card, phone, url (an address that carries credentials), account (IBAN wherever it stands, numbers after an account cue),
    secret (keys, tokens, passwords). Offsets count code points, the end is excluded. Null texts count as empty: no spans, and
    the redacted text is null. Whole texts are read; all rows and other columns stay; a column with one of the new names is
    replaced.
    """
    schema = "spans array<struct<kind:string,start:int,end:int>>, redacted string"

    @F.pandas_udf(schema)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in pieces(batches):
            found = [find_spans(t) if t else [] for t in texts]
            cut = [redact(t, s) if s and redacted_col else None for t, s in zip(texts, found, strict=True)]
            yield pd.DataFrame({"spans": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], "redacted": cut})

    (both,) = free_names([*docs.columns, spans_col, redacted_col or ""], "pii")
    out = docs.withColumn(both, scanned(F.col(text_col))).withColumn(spans_col, F.col(both)["spans"])
    if redacted_col:
        out = out.withColumn(redacted_col, F.coalesce(F.col(both)["redacted"], F.col(text_col)))
    return out.drop(both)


def span_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, the number of spans of each base kind, a hash of the base spans, all spans as text and
    their number (n_spans).

    Null and empty texts have no spans: counts of 0, the hash of the empty text, and the empty text. Null ids are kept, repeated
    rows each give a row, an empty table gives an empty result, other columns are ignored.
    """
    found = find_personal_data(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), text_col="text")
    spans = F.col("pii_spans")
    counted = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(counted(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(F.filter(spans, lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"),
    )
