"""Evidence by its plain definition, text by text and word by word: what the joins of the library are held against."""

import re

from shelfscope.functions import text as tx
from shelfscope.operators import verify

THOUSANDS = re.compile(r"([0-9]{1,3}(?:\.[0-9]{3})+)(,[0-9]+)?(?![0-9])")


def normal(text):
    plain = THOUSANDS.sub(lambda m: m[1].replace(".", "") + (m[2] or "").replace(",", "."), text)
    return re.sub(rf"[^a-z0-9.%{tx.CJK_PYTHON}]+", " ", tx._fold_recomposed(re.sub(r"([0-9]),([0-9])", r"\1.\2", plain))).strip()


def numbers(text):
    out = []
    for n in re.findall(r"[0-9]+(?:\.[0-9]+)?", normal(text)):
        whole, _, part = n.partition(".")
        part = part.rstrip("0")
        out.append((whole.lstrip("0") or "0") + ("." + part if part else ""))
    return out


def first_stretch(words, wanted, asked, wide):
    for i in range(len(words)):
        near = words[i : i + wide]
        if len(wanted & set(near)) / len(wanted) >= verify.COVERAGE and asked <= {n for w in near for n in numbers(w)}:
            return i
    return None


def find_quote(quote, source):
    q, text = normal(quote), normal(source)
    if len(q) < 3:
        return None
    if (at := text.find(q)) >= 0:
        return text[max(0, at - 300) : at + len(q) + 300]
    telling = [w for w in q.split(" ") if len(w) >= 3 or re.search(rf"[0-9{tx.CJK_PYTHON}]", w)]
    if len(telling) < 2:
        return None
    words, wide = text.split(" "), 3 * len(telling)
    start = first_stretch(words, set(telling), set(numbers(quote)), wide)
    return None if start is None else " ".join(words[max(0, start - 40) : start + wide + 40])


def mentions_any(text, names):
    padded, edge = f" {normal(text)} ", rf"[^a-z0-9{tx.CJK_PYTHON}]"
    return any(re.search(f"(?:^|{edge}){re.escape(n)}(?:{edge}|$)", padded) for a in names if len(n := normal(a)) >= 2)


def nutrition_holds(serving, rows, source):
    text = normal(source)
    all_ = set(numbers(text))
    if len(rows) < 3 or not set(numbers(serving or "")) <= all_:
        return False
    for nutrient, amount in rows:
        want = set(numbers(amount or ""))
        alias = next((a for a in verify.NUTRIENTS if re.search(a, tx._fold_recomposed(nutrient))), None)
        places = [text[m.start() : m.start() + 120] for m in re.finditer(alias, text)] if alias else [text]
        if not want or not any(want <= set(numbers(p)) for p in places):
            return False
    return True
