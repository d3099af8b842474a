"""Near duplicates by BagMinHash.

A text is the multiset of its shingles of five words. Each shingle owns a Poisson process over discretised weights, split into
doubling intervals of weight whose points come in the order of time; a point that falls below the shingle's count in the text
competes for one component of the signature. The points of all shingles of a text are drawn in rounds, and a shingle stops as soon
as its next point is later than all components. Two signatures agree in a component with a probability equal to the weighted
Jaccard similarity. Signatures are cut into bands, texts that share a band are linked to the texts that stand out in it, and a
link counts only if the overlap of the two multisets confirms it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .shared import drop_table, free_names, materialize, slices, text_key

WORDS = 5
#: Components of a signature, and its bands: at a similarity of 0.8 a pair shares no band with a probability of 5e-8.
SIZE, BANDS = 128, 32
#: Slots of the count by which elements are called rare; it is broadcast, 4 bytes a slot whatever the input.
SKETCH = 1 << 20
_WORD = re.compile(r"\w+")
_REMEMBERED = 300_000
_known: dict[str, int] = {}

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 random bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def word_hashes(text: str) -> np.ndarray:
    words = _WORD.findall(text.lower())
    try:
        return np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        if len(_known) > _REMEMBERED:
            _known.clear()
        for w in words:
            if w not in _known:
                _known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_bag(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit hashes, sorted) and their counts; a text of fewer words has one shingle of all its words."""
    w = word_hashes(text)
    if not len(w):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = h * _STEP + w[j : len(w) - k + 1 + j]
    return np.unique(mixed(h), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima by sum of maxima of the counts; 0 where both bags are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """Bags x size; empty bags have zeros. The identity of the point that came first in each component."""
    n = len(bags)
    time, won = np.full(n * size, np.inf), np.zeros(n * size, np.uint64)
    sizes = [len(b[0]) for b in bags]
    if not sum(sizes):
        return won.reshape(n, size)
    item, weight = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    bag = np.repeat(np.arange(n), sizes)
    # intervals of weight: (0, 1], (1, 2], (2, 4], (4, 8] ... up to the one that holds the count
    level = np.ceil(np.log2(weight)).astype(np.int64) + 1
    own = np.repeat(np.arange(len(item)), level)
    level = np.arange(len(own)) - np.repeat(np.cumsum(level) - level, level)
    low, wide = np.where(level > 0, 2.0 ** (level - 1), 0.0), np.where(level > 0, 2.0 ** (level - 1), 1.0)
    seed, top, bag = mixed(item[own] + level.astype(np.uint64) * _M1), weight[own].astype(np.float64), bag[own]
    at, drawn = np.zeros(len(own)), np.zeros(len(own), np.uint64)
    filled = np.flatnonzero(np.array(sizes))
    latest = np.full(n, np.inf)
    while len(seed):
        many = int(np.clip(8192 // len(seed), 1, 64))  # points of each process in this round
        point = mixed(seed[:, None] + (drawn[:, None] + np.arange(1, many + 1, dtype=np.uint64)) * _STEP)
        when = at[:, None] + np.cumsum(-np.log(_unit(mixed(point ^ _M1))) / wide[:, None], axis=1)
        below = low[:, None] + _unit(mixed(point ^ _M2)) * wide[:, None] <= top[:, None]
        below &= when <= latest[bag][:, None]
        r, c = np.nonzero(below)
        slot = bag[r] * size + (point[r, c] % np.uint64(size)).astype(np.int64)
        t = when[r, c]
        np.minimum.at(time, slot, t)
        first = t == time[slot]
        won[slot[first]] = point[r, c][first] | np.uint64(1)
        latest[filled] = time.reshape(n, size)[filled].max(axis=1)
        go = when[:, -1] <= latest[bag]
        seed, low, wide, top, bag = seed[go], low[go], wide[go], top[go], bag[go]
        at, drawn = when[go, -1], drawn[go] + np.uint64(many)
    return won.reshape(n, size)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(len(signature), bands, -1)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(rows.shape[2]):
        h = mixed(h * _STEP + rows[:, :, j])
    return h.view(np.int64)


def _bands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        out = []
        for part in slices(texts):
            bags = [shingle_bag(t) for t in part]
            found = band_hashes(signatures(bags))
            out += [f if len(b[0]) else None for f, b in zip(found, bags, strict=True)]
        yield pd.Series(out, dtype=object)


def _overlaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept: dict[bytes, tuple] = {}  # the texts that stand out come again and again
    for b in batches:
        out = []
        for a_text, p, p_text in zip(b["a_text"], b["p"], b["p_text"], strict=True):
            if p not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[p] = shingle_bag(p_text)
            out.append(weighted_jaccard(shingle_bag(a_text), kept[p]))
        yield pd.DataFrame({"a": b["a"], "p": b["p"], "similarity": out})


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, p) whose multisets overlap by `least` or more."""
    left = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("a_text")), "a")
    both = left.join(texts.select(F.col("key").alias("p"), F.col("text").alias("p_text")), "p")
    return both.select("a", "p", "a_text", "p_text").mapInPandas(_overlaps, "a binary, p binary, similarity double").where(F.col("similarity") >= least).select("a", "p")


def _occurrences(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A bag as a set: the first, second ... occurrence of a shingle are elements of their own."""
    which = np.arange(bag[1].sum()) - np.repeat(np.cumsum(bag[1]) - bag[1], bag[1])
    return mixed(np.repeat(bag[0], bag[1]) + which.astype(np.uint64) * _STEP)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for part in slices(b["text"]):
            slots, n = np.unique(np.concatenate([_occurrences(shingle_bag(t)) for t in part]) % np.uint64(SKETCH), return_counts=True)
            yield pd.DataFrame({"slot": slots.astype(np.int32), "n": n})


_PREFIX = "element long, key binary, component binary, loose boolean, n int, place int"


def _prefixes(batches: Iterator[pd.DataFrame], frequency: np.ndarray, least: float) -> Iterator[pd.DataFrame]:
    """The rarest elements of each text; of two texts that overlap enough each holds one of the other's."""
    for b in batches:
        for row in b.itertuples(index=False):
            x = _occurrences(shingle_bag(row.text))
            x = x[np.lexsort((x, frequency[(x % np.uint64(SKETCH)).astype(np.int64)]))]
            few = len(x) - int(np.ceil(len(x) * least - 1e-9)) + 1
            yield pd.DataFrame({"element": x[:few].view(np.int64), "key": row.key, "component": row.component, "loose": row.loose, "n": np.int32(len(x)), "place": np.arange(few, dtype=np.int32)})


def _remaining_pairs(nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, p): the pairs of nodes (key, component, loose) that may still be similar enough: of two components, one of them loose.

    Exact, by prefixes: elements are ordered from rare to frequent, and two texts that overlap enough share one of their first
    elements, early enough for what follows to suffice. The order comes from a count of fixed size, and only speed rests on it.
    """
    found = materialize(nodes.join(texts, "key").select("key", "component", "loose", "text"), "loose-texts")
    counted = materialize(found.select("text").mapInPandas(_sketch, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")), "element-counts")
    # only slots far above the mean come to the driver, a quarter of them at most; the rest is called rare
    usual = (counted.agg(F.sum("n")).first()[0] or 0) / SKETCH
    often = counted.where(F.col("n") > max(4 * usual, 8)).toPandas()
    frequency = np.zeros(SKETCH, np.int32)
    frequency[often["slot"].to_numpy()] = np.minimum(often["n"].to_numpy(), 2**31 - 1)
    shared = found.sparkSession.sparkContext.broadcast(frequency)
    first = materialize(found.mapInPandas(lambda it: _prefixes(it, shared.value, least), _PREFIX), "prefixes")
    a, b = first.where("loose").alias("a"), first.alias("b")
    enough = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) >= (F.col("a.n") + F.col("b.n")) * (least / (1 + least)) - 1e-9
    once = ~F.col("b.loose") | (F.col("a.key") < F.col("b.key"))
    met = a.join(b, (F.col("a.element") == F.col("b.element")) & (F.col("a.component") != F.col("b.component")) & once & enough)
    return met.select(F.col("a.key").alias("a"), F.col("b.key").alias("p")).distinct()


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, class_size.

    class_id is the smallest id of the texts that are connected by links of a weighted Jaccard similarity of `least` or more over
    shingles of five lower-case words (counts included); exact copies of a text always share a class. Texts of fewer than five
    words have one shingle. Null and empty texts are in no class but their own. Rows with a null id take part, and get the
    smallest id of their class; repeated rows are copies of each other. Whole texts are compared. An empty table gives an empty
    result; other columns are ignored.

    Copies become one node before anything else. In each band the node that shares most bands with others is compared with all
    nodes of the band, so that no group of near copies is expanded into its pairs. Nodes that this leaves outside its component
    are loose: an exact join on the rarest elements finds all pairs between them and the nodes of their bands that may still
    be similar enough.
    """
    return _judged(docs, id_col, text_col, least).select("doc_id", "class_id", "class_size")


def _judged(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """near_duplicate_classes with the key of each row's text and, where its class has several rows, the id and key of the row
    that stands for the class: of the smallest id (nulls last) and, where several texts have it, the smallest key."""
    key = text_key(text_col)
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("key"))
    marked = materialize(plain.select("id", "key", (F.col("text") == "").alias("blank"), F.pandas_udf(_bands, "array<long>")("text").alias("bands")), "signatures")
    nodes = marked.where(~F.col("blank")).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"))

    # bands with more than one text; 60 bits of the key tell whether there is another one
    short = F.conv(F.substring(F.hex("key"), 1, 15), 16, 10).cast("long")
    banded = marked.select("key", F.explode("bands").alias("band"))
    shared = banded.select("band", short.alias("s")).groupBy("band").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("band", "n")
    members = materialize(banded.join(shared, "band").groupBy("band", "key").agg(F.max("n").alias("n")), "band-members")
    standing = members.groupBy("key").agg(F.sum("n").alias("standing"))
    members, counted = materialize(members.select("band", "key").join(standing, "key"), "standing"), members
    drop_table(counted)
    standing = members.select("key", "standing").distinct()

    needed = standing.select("key").join(nodes, "key").select("key", F.col("id").alias("rep"))
    fetched = plain.join(needed, "key").where(F.col("id").eqNullSafe(F.col("rep"))).groupBy("key").agg(F.first("text").alias("text"))
    texts = materialize(fetched, "candidate-texts")

    chosen = members.groupBy("band").agg(F.max(F.struct("standing", "key")).alias("m")).select("band", F.col("m.key").alias("p"))
    chosen = materialize(chosen, "standing-out")
    pairs = members.join(chosen, "band").where("key <> p").select(F.col("key").alias("a"), "p").distinct()
    links = _verified(pairs, texts, least).select(F.col("a").alias("u"), F.col("p").alias("v"))
    parts = materialize(connected_components(links), "components")

    named = members.join(parts, members["key"] == parts["node"], "left").select("band", "key", F.coalesce("component", "key").alias("component"))
    centre = chosen.join(parts, chosen["p"] == parts["node"], "left").select("band", F.coalesce("component", "p").alias("centre"))
    placed = named.join(centre, "band").withColumn("loose", F.col("component") != F.col("centre"))
    # with two nodes in a band the only pair has been compared
    open_ = placed.groupBy("band").agg(F.count_if("loose").alias("loose_n"), F.count("*").alias("n")).where("loose_n > 0 AND n > 2").select("band")
    rest = placed.join(open_, "band").groupBy("key").agg(F.first("component").alias("component"), F.max("loose").alias("loose"))
    rest = materialize(rest, "loose")
    more = materialize(_verified(_remaining_pairs(rest, texts, least), texts, least), "remaining-links")
    drop_table(texts)
    # what they connect is whole components, of which few are left
    of = rest.select("key", "component")
    more = more.join(of.toDF("a", "u"), "a").join(of.toDF("p", "v"), "p").select("u", "v").distinct()
    joined = materialize(connected_components(more), "joined-components").toDF("node", "joined")
    drop_table(members)
    drop_table(chosen)

    named = nodes.join(parts, nodes["key"] == parts["node"], "left").select("key", "id", "copies", F.coalesce("component", "key").alias("component"))
    named = named.join(joined, named["component"] == joined["node"], "left").select("key", "id", "copies", F.coalesce("joined", "component").alias("component"))
    classes = named.groupBy("component").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    # only classes of several rows are joined back
    named = named.join(classes.where("class_size > 1"), "component").select("key", "class_id", "class_size", "first")
    back = marked.select("id", "key", "blank").join(named, "key", "left")
    return back.select(
        F.col("id").alias("doc_id"),
        F.when(~F.col("blank") & F.col("class_size").isNotNull(), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.when(~F.col("blank"), F.coalesce("class_size", F.lit(1))).otherwise(1).cast("long").alias("class_size"),
        "key",
        F.when(~F.col("blank"), F.col("first")).alias("first"),
    )


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of docs that stand for their class: the one with the smallest id; of repeated rows one stays. Rows with a null id
    stay only where no row of their class has an id. Only the row that is a copy goes, not others with its id."""
    judged = _judged(docs, id_col, text_col, least).where("first IS NOT NULL")
    first = (F.col("doc_id").eqNullSafe(F.col("first.id"))) & (F.col("key") == F.col("first.key"))
    key, of, id_, stays, many = free_names(docs.columns, "key", "of", "id", "stays", "many")
    rows = materialize(judged.groupBy(F.col("doc_id").alias(id_), F.col("key").alias(of)).agg(F.max(first).alias(stays), (F.count("*") > 1).alias(many)), "judged")
    same = (F.col(key) == F.col(of)) & F.col(id_col).eqNullSafe(F.col(id_))
    # only rows that go or are repeated are joined; the same kind of join at every size, whose shuffle both readings below share
    rows = rows.where(~F.col(stays) | F.col(many)).hint("merge")
    kept = docs.withColumn(key, text_key(text_col)).join(rows, same, "left").where(F.coalesce(stays, F.lit(True)))
    several = F.coalesce(many, F.lit(False))
    repeated = kept.where(several).select(*docs.columns).dropDuplicates([id_col, text_col])
    return kept.where(~several).select(*docs.columns).unionByName(repeated)
