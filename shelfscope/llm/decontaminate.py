"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

The test items are indexed; every passage of the training texts is a query. An item's score is its BM25 score divided by that of
the item itself, so 1 means that the passage holds all of it. Three bounds are tried in turn: the highest impacts of a passage's
terms on any item, then on any item of a block of items, and only for passages and blocks that may still reach the threshold the
exact scores. All items above the threshold are retrieved, and a hit counts if both the question and the answer overlap.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_names, materialize, slices

#: Parameters of BM25, items in a block, bytes of test items that one index may hold.
K1, B, ITEM_BLOCK, INDEX_BYTES = 1.2, 0.75, 16, 16 << 20
#: Share of an item's own score that a passage must reach; shares of the word pairs of question and answer that it must hold.
SCORE, QUESTION, ANSWER = 0.6, 0.7, 0.5
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item: the answer is its last sentence, or the last third of its words where it has but one."""
    parts = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    whole = parts[0] if parts else []
    cut = len(whole) - len(whole) // 3
    return whole[:cut], whole[cut:]


def _pairs(words: list[str]) -> set:
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else set(words)


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the word pairs of a part (its word, if it has one; 1 if it has none) that a passage holds."""
    want = _pairs(part)
    have = _pairs(passage) if len(part) > 1 else set(passage)
    return len(want & have) / len(want) if want else 1.0


class ItemIndex:
    """Postings of normalised impacts by term: for each item, and their maxima for each block of items."""

    def __init__(self, items: list[tuple], frequency: dict[str, int], total: int, mean_words: float):
        counted = [(i, Counter(w), w, t) for i, t in items if (w := words_of(t))]
        self.ids = [c[0] for c in counted]
        self.parts = [question_and_answer(c[3]) for c in counted]
        self.words = [len(c[2]) for c in counted]
        self.stride = 2 * max(self.words, default=1)  # twice the longest item: each window of an item lies in one passage
        self.term = {w: n for n, w in enumerate(sorted({w for c in counted for w in c[1]}))}
        idf = {w: np.log(1 + (total - frequency[w] + 0.5) / (frequency[w] + 0.5)) for w in self.term}
        rows = []
        for n, (_, tf, words, _) in enumerate(counted):
            norm = K1 * (1 - B + B * len(words) / mean_words)
            impact = {w: idf[w] * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            own = sum(impact.values())
            rows += [(self.term[w], n, x / own) for w, x in impact.items()]
        rows.sort()
        term, self.item = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self.impact = np.array([r[2] for r in rows])
        self.start = np.searchsorted(term, np.arange(len(self.term) + 1))
        self.most = np.maximum.reduceat(self.impact, self.start[:-1]) if rows else np.empty(0)
        # the terms of each item
        by_item = np.argsort(self.item, kind="stable")
        self.item_term, self.item_impact = term[by_item], self.impact[by_item]
        self.item_start = np.searchsorted(self.item[by_item], np.arange(len(counted) + 1))
        # the same for blocks of items
        first = np.r_[True, (term[1:] != term[:-1]) | (self.item[1:] // ITEM_BLOCK != self.item[:-1] // ITEM_BLOCK)] if rows else np.empty(0, bool)
        at = np.flatnonzero(first)
        self.block, self.block_most = self.item[at] // ITEM_BLOCK, np.maximum.reduceat(self.impact, at) if rows else np.empty(0)
        self.block_start = np.searchsorted(term[at], np.arange(len(self.term) + 1))

    @staticmethod
    def _postings(terms: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each term in turn its postings: the index of the term, and of the posting."""
        many = start[terms + 1] - start[terms]
        own = np.repeat(np.arange(len(terms)), many)
        return own, np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[terms], many)

    def search(self, terms: list[np.ndarray], least: float) -> Iterator[tuple[int, int, int, float]]:
        """(text, first word, item, score) of every passage of 2 * stride words, each stride words, with a score of `least` or more.
        terms: for each text the term of each word, -1 for words of no item."""
        sizes = np.array([len(t) for t in terms])
        if not sizes.sum() or not self.ids:
            return
        word = np.concatenate(terms)
        text = np.repeat(np.arange(len(terms)), sizes)
        cell = (np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // self.stride
        cells = -(-sizes // self.stride)
        base = np.cumsum(cells) - cells
        known = word >= 0
        width = len(self.term)
        found = np.unique((base[text] + cell)[known] * width + word[known])  # distinct terms of each cell
        of, term = found // width, found % width
        cap = np.zeros(cells.sum() + 1)
        cap[: cells.sum()] = np.bincount(of, weights=self.most[term], minlength=cells.sum())
        last = np.zeros(cells.sum(), bool)
        last[np.cumsum(cells)[cells > 0] - 1] = True
        bound = cap[:-1] + np.where(last, 0, cap[1:])
        likely = np.flatnonzero(bound >= least - 1e-9)  # a passage is a cell and the next one
        if not len(likely):
            return
        # distinct terms of the likely passages
        from_, to = np.searchsorted(of, likely), np.searchsorted(of, np.where(last[likely], likely, likely + 1), side="right")
        many = to - from_
        own = np.repeat(np.arange(len(likely)), many)
        pick = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(from_, many)
        pairs = np.unique(own * width + term[pick])
        own, term = pairs // width, pairs % width
        blocks = -(-len(self.ids) // ITEM_BLOCK)
        for lot in range(0, len(likely), 512):  # bounded tables
            near = slice(*np.searchsorted(own, [lot, lot + 512]))
            o, t = own[near] - lot, term[near]
            k, p = self._postings(t, self.block_start)
            most = np.bincount(o[k] * blocks + self.block[p], weights=self.block_most[p], minlength=512 * blocks) if len(k) else np.zeros(512 * blocks)
            open_ = most >= least - 1e-9
            if not open_.any():
                continue
            k, p = self._postings(t, self.start)
            go = open_[o[k] * blocks + self.item[p] // ITEM_BLOCK]
            k, p = k[go], p[go]
            slot, back = np.unique(o[k] * len(self.ids) + self.item[p], return_inverse=True)
            score = np.bincount(back, weights=self.impact[p])
            for s, x in zip(slot[score >= least - 1e-9].tolist(), score[score >= least - 1e-9].tolist(), strict=True):
                c = int(likely[lot + s // len(self.ids)])
                d = int(np.searchsorted(base, c, side="right") - 1)
                yield d, (c - int(base[d])) * self.stride, s % len(self.ids), x

    def windows(self, terms: np.ndarray, at: int, item: int, least: float) -> Iterator[tuple[int, float]]:
        """(first word, score) of the windows that start in a passage's first half and reach `least`: of twice the item's words, each
        time that many words on from the start of the text, whatever other items there are."""
        n, near = self.words[item], slice(self.item_start[item], self.item_start[item + 1])
        own, impact = self.item_term[near], self.item_impact[near]
        part = terms[at : at + 2 * self.stride]
        place = np.minimum(np.searchsorted(own, part), len(own) - 1)
        good = own[place] == part
        where, place = np.flatnonzero(good) + at, place[good]
        for first in range(-(-at // n) * n, min(at + self.stride, len(terms)), n):
            a, b = np.searchsorted(where, [first, first + 2 * n])
            score = float(impact[np.unique(place[a:b])].sum()) if b > a else 0.0
            if score >= least - 1e-9:
                yield first, score

    def hits(self, texts: list[str], least: float, question: float, answer: float) -> Iterator[tuple[int, object, float, float, float]]:
        """(text, item id, score, overlap of the question, overlap of the answer): the best window for each text and item."""
        words = [words_of(t) for t in texts]
        get = self.term.get
        terms = [np.fromiter((get(w, -1) for w in ws), np.int64, len(ws)) for ws in words]
        best: dict[tuple[int, int], tuple] = {}
        for d, at, item, _ in self.search(terms, least):
            for first, score in self.windows(terms[d], at, item, least):
                window = words[d][first : first + 2 * self.words[item]]
                q, a = (overlap(p, window) for p in self.parts[item])
                if q >= question and a >= answer:
                    best[d, item] = max(best.get((d, item), (0.0,)), (q + a, score, q, a))
        for (d, item), (_, score, q, a) in best.items():
            yield d, self.ids[item], score, q, a


@lru_cache(maxsize=1)
def _index(lot: bytes) -> ItemIndex:
    """The index of a lot; a worker holds one at a time."""
    return pickle.loads(lot)


class Benchmark:
    """The test items as indexes of lots, each built in a task and sent to the executors as bytes."""

    def __init__(self, items: DataFrame, item_id_col: str, item_text_col: str, index_bytes: int):
        spark = items.sparkSession
        tests = items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
        size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        lots = max(1, -(-size // index_bytes))
        self.item_type = items.schema[item_id_col].dataType.simpleString()
        placed = tests.withColumn("lot", F.pmod(F.xxhash64("item", "text"), F.lit(lots)).cast("int"))

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                said = [(lot, words_of(t)) for lot, t in zip(b["lot"], b["text"], strict=True)]
                rows = [(lot, w, len(ws)) for lot, ws in said for w in set(ws)] + [(lot, None, len(ws)) for lot, ws in said if ws]
                yield pd.DataFrame(rows, columns=["lot", "word", "n"])

        spoken = materialize(placed.mapInPandas(spread, "lot int, word string, n long"), "benchmark-words")
        total, mean_words = spoken.where("word IS NULL").agg(F.count("*"), F.avg("n")).first()
        frequency = spoken.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("df"))
        own = spoken.where("word IS NOT NULL").select("lot", "word").distinct().join(frequency, "word")

        def build(key: tuple, tests: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
            rows = sorted(zip(tests["item"].astype(object).where(tests["item"].notna(), None), tests["text"], strict=True), key=lambda r: (r[0] is None, r))
            made = ItemIndex(rows, dict(zip(words["word"], words["df"].tolist(), strict=True)), total, mean_words or 1.0)
            return pd.DataFrame({"made": [pickle.dumps(made)]})

        # a lot is bounded by its bytes
        made = placed.groupBy("lot").cogroup(own.groupBy("lot")).applyInPandas(build, "made binary")
        made = materialize(made, "benchmark-indexes")
        self.lots = [spark.sparkContext.broadcast(bytes(r["made"])) for r in made.toLocalIterator()]

    def hits(self, texts: list[str], least: float, question: float, answer: float) -> Iterator[tuple]:
        """As ItemIndex.hits, over all lots."""
        for lot in self.lots:
            yield from _index(lot.value).hits(texts, least, question, answer)


def benchmark_hits(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    least: float = SCORE, question: float = QUESTION, answer: float = ANSWER, index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """One row for each row of docs and test item that it holds: doc_id, item_id, score, question_overlap, answer_overlap.

    Windows of twice the item's words, starting each time that many words on, are scored over the whole text, so an item lies wholly
    in one of them, and a hit depends on no other item's length. A hit has a normalised BM25 score of `least` or more, and `question`
    and `answer` of the word pairs of both parts (the answer is the last sentence). Texts without hits, null and empty texts have no
    rows; items that are null or without words are never found; items with one text are all found; repeated rows of docs repeat
    their hits. Document frequencies and lengths are those of all items. Items are indexed in lots of about index_bytes, whatever
    their number; the documents are read once, and each slice of them meets every lot.
    """
    bench = Benchmark(items, item_id_col, item_text_col, index_bytes)

    @F.pandas_udf(f"array<struct<item_id:{bench.item_type},score:double,question_overlap:double,answer_overlap:double>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, at = [[] for _ in range(len(texts))], 0
            for part in slices(texts):
                for d, *hit in bench.hits(part, least, question, answer):
                    out[at + d].append(dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), hit, strict=True)))
                at += len(part)
            yield pd.Series(out, dtype=object)

    each = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.explode(found(F.col(text_col))).alias("hit"))
    return each.select("doc_id", "hit.*")


def without_benchmark(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    least: float = SCORE, question: float = QUESTION, answer: float = ANSWER, index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """The rows of docs that hold no test item, by the rules of benchmark_hits; each is judged by its text alone, in the pass that
    reads it. Null and empty texts stay, as do all columns, null and repeated ids and repeated rows."""
    bench = Benchmark(items, item_id_col, item_text_col, index_bytes)

    @F.pandas_udf("boolean")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts), bool)
            at = 0
            for part in slices(texts):
                for d in {d for d, *_ in bench.hits(part, least, question, answer)}:
                    out[at + d] = True
                at += len(part)
            yield pd.Series(out)

    (mark,) = free_names(docs.columns, "held")
    return docs.withColumn(mark, held(F.col(text_col))).where(~F.col(mark)).drop(mark)
