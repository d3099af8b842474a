"""Which texts hold a passage, word for word, by joins on what they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a row that a text and a passage have to share before the whole passage is looked for.
RUN = 4
#: Characters in a row by which short passages meet words.
PART = 3


def bound(value: Column, body) -> Column:
    """body(value), where value is computed once however often body reads it (an expression in a lambda is computed at each step)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def runs(words: Column, n: int) -> Column:
    """64 bits for every n words in a row, in order; none for fewer words. Linear in the number of words."""
    at = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
    return bound(words, lambda w: F.when(F.size(w) >= n, at(w)).otherwise(F.array().cast("array<long>")))


def parts(word: Column, n: int) -> Column:
    """Every n characters in a row of a word; none of a shorter one."""
    return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substr(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def passage_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) for each document (doc_id, text) that holds the passage of an item (item_id, text) as it stands.

    The words inside a passage stand in a text as they are, the first and the last may be parts of longer ones. So a passage of
    RUN + 2 words or more meets the documents that share RUN words in a row, one of three words or more those that share all inner
    words in a row, and a shorter one the words that hold its longest piece, found by PART of its characters. Candidates are then
    compared in full. Empty and null passages are in no document; equal passages are looked for once; texts that repeat count once
    for each row.
    """
    held = items.where(F.col("text") != "").select("item_id", F.col("text").alias("passage"))
    w = held.select("passage").distinct().withColumn("w", words_of(F.col("passage")))
    inner = w.where(F.size("w") >= 3).select("passage", F.least(F.size("w") - 2, F.lit(RUN)).alias("n"), "w")
    runs_at = F.coalesce(*(F.when(F.col("n") == n, F.xxhash64(*(F.get("w", F.lit(k)) for k in range(1, n + 1)))) for n in range(1, RUN + 1)))
    keyed = inner.select("passage", "n", runs_at.alias("gram"))
    # only the lengths that some passage has are taken from the texts: at most RUN numbers
    asked = sorted(r.n for r in keyed.select("n").distinct().collect())
    made = bound(words_of(F.col("text")), lambda x: F.array(*(F.struct(F.lit(n).alias("n"), runs(x, n).alias("grams")) for n in asked))) if asked else None
    grams = docs.select("doc_id", F.inline(made)).select("doc_id", "n", F.explode(F.array_distinct("grams")).alias("gram")) if asked else docs.select("doc_id", F.lit(0).alias("n"), F.lit(0).cast("long").alias("gram")).limit(0)
    met = grams.join(keyed, ["n", "gram"]).select("doc_id", "passage")

    blank = F.size("w") == 0
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    short = w.where(F.size("w") < 3).select("passage", F.when(blank, F.col("passage")).otherwise(longest).alias("piece"))
    short = short.withColumn("n", F.least(F.length("piece"), F.lit(PART))).withColumn("part", F.substring("piece", 1, PART))
    tokens = F.concat(words_of(F.col("text")), F.regexp_extract_all("text", F.lit(r"\s+"), F.lit(0)))
    some = sorted(r.n for r in short.select("n").distinct().collect())  # at most PART numbers
    if not some:
        return _full(docs, held, met)
    each = docs.select("doc_id", F.explode(F.array_distinct(tokens)).alias("token"))
    known = each.select("token").distinct()
    made = F.array(*(F.struct(F.lit(n).alias("n"), parts(F.col("token"), n).alias("parts")) for n in some))
    pieces = known.select("token", F.inline(made)).select("token", "n", F.explode(F.array_distinct("parts")).alias("part"))
    holding = pieces.join(short, ["n", "part"]).where(F.contains("token", "piece")).select("token", "passage")
    return _full(docs, held, met.unionByName(each.join(holding, "token").select("doc_id", "passage")))


def _full(docs: DataFrame, held: DataFrame, met: DataFrame) -> DataFrame:
    full = met.distinct().join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("passage", "doc_id")
    return held.join(full, "passage").select("item_id", "doc_id")
