"""Repeated long passages with a logarithmic family of suffix indexes.

The suffix array of a batch is sparse: of each stretch of text it has the suffixes that start where a hash of 32 bytes is the
smallest of a match-long window, so that equal windows hold the same suffix at the same place, wherever they are. An entry has the
first 32 bytes of its suffix, as four numbers by which the array is sorted as bytes are, 128 bits of hashes of all the text that
its windows cover (ctx), how often that text was seen, and one place where it stands. A new batch gets an array, which is
merge-scanned against the arrays that exist: an equal entry is a repeat of all its windows, on both sides; entries that begin
alike with different texts around are compared window by window. Then the array joins the family, and while the two last arrays
stand for equally many batches they are merged, so that an entry is rewritten as often as the logarithm of the number of batches.
The family lives in a folder and can be opened again for the next batch.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete_folder, drop_table, let_go, materialize, shared_folder, text_key

#: Bytes of a gram, and bytes of a text that are worked on at once (longer ones in pieces that overlap).
GRAM, PIECE = 32, 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Two rolling hashes: of each the base and a number for each byte.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    return x ^ (x >> np.uint64(29))


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of a rolling hash, and of its inverse modulo 2^64."""
    if which not in _powers or len(_powers[which][0]) < n:
        size, base = max(n, PIECE + 4096), _BASES[which]
        up, down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, dtype=np.uint64)], dtype=np.uint64) for b in (base, pow(base, -1, 2**64)))
        _powers[which] = up, down
    return _powers[which]


class Rolling:
    """Hashes of any stretch of a piece of bytes, by one of two independent functions."""

    def __init__(self, raw: np.ndarray, which: int = 0):
        up, self.down = _power_tables(len(raw) + 1, which)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[which][raw] * up[: len(raw)], out=self.sums[1:], dtype=np.uint64)

    def every(self, size: int) -> np.ndarray:
        """Of all stretches of this size."""
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def sparse_suffixes(texts: list[bytes], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, lo, hi, head, ctx) for all windows of `least` bytes: those that start at lo to hi of a text (both included) share a
    suffix. head: its first 32 bytes as four longs, in the order of bytes; ctx: two hashes of bytes lo to hi + least and of where
    the suffix lies in them."""
    pieces, held = [], 0
    overlap = least - 1
    for i, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - overlap), PIECE):
            part = raw[at : at + PIECE + overlap]
            if len(part) < least:
                continue
            if pieces and held + len(part) > PIECE + overlap:
                yield _suffixes_of(pieces, least)
                pieces, held = [], 0
            pieces.append((i, at, part))
            held += len(part)
    if pieces:
        yield _suffixes_of(pieces, least)


def _suffixes_of(pieces: list[tuple[int, int, bytes]], least: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
    hashes = Rolling(raw)
    grams = hashes.every(GRAM)
    place = np.uint64((1 << 24) - 1)
    ranked = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)  # ties go to the first
    at = (_sliding_least(ranked, least - GRAM + 1) & place).astype(np.int64)  # the suffix of each window
    own = np.repeat(np.arange(len(pieces)), sizes)[: len(at)]
    good = np.arange(len(at)) + least <= ends[own]
    new = np.r_[True, (at[1:] != at[:-1]) | (own[1:] != own[:-1])] & good
    lo = np.flatnonzero(new)
    # a stretch ends before the next one starts, or with the last whole window of its piece
    hi = np.minimum(np.r_[lo[1:], len(at)], ends[own[lo]] - least + 1) - 1
    suffix = at[lo]
    where = (suffix - lo).astype(np.uint64) * _M2 + (hi - lo).astype(np.uint64)
    ctx = np.stack([hashes.of(lo, hi + least) ^ _mixed(where), Rolling(raw, 1).of(lo, hi + least) ^ _mixed(where + _M1)], axis=1)
    base = np.array([p[1] for p in pieces])[own[lo]] - (ends - sizes)[own[lo]]
    text = np.array([p[0] for p in pieces])[own[lo]]
    head = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, GRAM)[suffix]).view(">u8").astype(np.uint64)
    return text, lo + base, hi + base, (head ^ np.uint64(1 << 63)).view(np.int64), ctx.view(np.int64)


#: An entry's place is one long: the first start of its windows, and in the last bits how many starts follow.
_SPAN_BITS = 12
#: What begins a suffix, and what tells its whole stretch apart.
HEAD, CTX = ["k1", "k2", "k3", "k4"], ["c1", "c2"]
ENTRY = [*HEAD, *CTX]
_STRETCH = "head long, t long, lo long, bytes binary"
#: Texts that begin alike and are compared in one place; what more texts begin with is compared by counting each window.
TOGETHER = 10_000


def distinct_texts(texts: DataFrame, least: int) -> DataFrame:
    """(t, key, text, copies) of the different texts (text) of `least` bytes or more: t numbers them, key is 128 bits of each."""
    grouped = texts.where(F.octet_length("text") >= least).groupBy(text_key("text").alias("key")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return materialize(grouped.select(F.monotonically_increasing_id().alias("t"), "key", "text", "copies"), "distinct-texts")


def suffix_entries(texts: DataFrame, least: int) -> DataFrame:
    """One row for each suffix of the sparse array of texts (t, text, copies)."""
    if not GRAM < least <= GRAM + (1 << _SPAN_BITS):
        raise ValueError(f"least must be above {GRAM} and at most {GRAM + (1 << _SPAN_BITS)}")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t, copies = b["t"].to_numpy(), b["copies"].to_numpy()
            for text, lo, hi, head, ctx in sparse_suffixes([x.encode("utf-8", "surrogatepass") for x in b["text"]], least):
                columns = dict(zip(ENTRY, np.ascontiguousarray(np.concatenate([head, ctx], axis=1).T), strict=True))
                yield pd.DataFrame(columns | {"t": t[text], "at": (lo << _SPAN_BITS) + (hi - lo), "copies": copies[text]})

    return texts.select("t", "text", "copies").mapInPandas(cut, ", ".join(f"{c} long" for c in [*ENTRY, "t", "at", "copies"]))


def _array(entries: DataFrame, count: Column) -> DataFrame:
    """Entries as a sorted array: one row for each stretch that a suffix stands in, with its count and one place."""
    found = entries.groupBy(*ENTRY).agg(F.sum(count).alias("n"), F.first("t").alias("t"), F.first("at").alias("at"))
    return materialize(found.sortWithinPartitions(*ENTRY), "suffix-array")


def _paths(tables: list[DataFrame]) -> list[str]:
    """The folders that tables are read from, each once."""
    return list(dict.fromkeys(f.rpartition("/")[0] for t in tables for f in t.inputFiles()))


class SuffixIndexFamily:
    """Suffix arrays of 1, 2, 4 ... batches in the shared folder, and the repeats that the batches have shown.

    The tables are listed in a manifest in the family's folder, so that another job can open the family and add its batch.
    """

    def __init__(self, spark: SparkSession, least: int, folder: str):
        self.spark, self.least, self.folder = spark, least, folder
        self.levels: list[tuple[int, DataFrame]] = []  # (number of batches, array)
        self.repeats: list[DataFrame] = []  # (t, at): all windows of these places are repeated
        self.texts: list[DataFrame] = []  # (t, text, ...) of each batch

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SuffixIndexFamily:
        said = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
        family = cls(spark, said["least"], folder)
        read = spark.read.parquet
        family.levels = [(n, read(p)) for n, p in said["levels"]]
        family.repeats, family.texts = [read(p) for p in said["repeats"]], [read(p) for p in said["texts"]]
        return family

    def save(self) -> None:
        """Write the manifest, a few lines whatever the batches hold."""
        said = {"least": self.least, "levels": [[n, *_paths([t])] for n, t in self.levels], "repeats": _paths(self.repeats), "texts": _paths(self.texts)}
        self.spark.range(1).select(F.lit(json.dumps(said)).alias("value")).write.mode("overwrite").text(f"{self.folder}/manifest")

    def drop(self) -> None:
        for t in [*(t for _, t in self.levels), *self.repeats]:
            drop_table(t)
        delete_folder(self.spark, self.folder)

    def merge_equal(self) -> None:
        """Merge the last arrays while they stand for equally many batches."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * n, _array(a.unionByName(b), F.col("n"))))
            drop_table(a)
            drop_table(b)

    def add(self, texts: DataFrame) -> None:
        """Merge-scan the suffix array of a batch of distinct texts (t, text, copies; a table that stays) against all arrays, and
        add it to the family. t must tell the texts of all batches apart."""
        self.merge_equal()
        entries = materialize(suffix_entries(texts, self.least), "suffixes")
        new = _array(entries, F.col("copies"))
        same = new.where("n > 1").select(*ENTRY)
        there = []
        if self.levels:
            # both sides of each scan are sorted by their suffixes; an entry may stand in several arrays
            met = [new.select(*ENTRY).join(level.select(*ENTRY, F.col("n").alias("n_old"), F.struct("t", "at").alias("old")).hint("merge"), ENTRY) for _, level in self.levels]
            old = materialize(reduce(DataFrame.unionByName, met).groupBy(*ENTRY).agg(F.sum("n_old").alias("n_old"), F.max("old").alias("old")), "equal-entries")
            same = same.unionByName(old.select(*ENTRY)).distinct()
            # one that stood alone is a repeat now; of several each has become one before
            there = [old.where("n_old = 1").select("old.t", "old.at")]
        # written first: a join of two plain shuffles can be split where a stretch stands in very many texts
        same = materialize(same, "repeated-entries")
        here = entries.join(same, ENTRY).select("t", "at")
        self.repeats.append(materialize(reduce(DataFrame.unionByName, [here, *there]), "repeats"))
        self.levels.append((1, new))
        self.texts.append(texts)
        drop_table(entries)
        drop_table(same)
        if self.levels[:-1]:
            drop_table(old)
        self.save()
        let_go(self.spark)

    def repeated(self, last: bool = False) -> DataFrame:
        """(t, at) of all repeated windows; texts are read again where entries have to be compared. last: the arrays can go.

        From here on a hash stands for what begins a suffix: it only brings together what is then compared as bytes.
        """
        least = self.least
        head = F.xxhash64(*HEAD).alias("head")
        entries = reduce(DataFrame.unionByName, [t.select(head, *CTX, "t", "at") for _, t in self.levels])
        several = entries.groupBy("head").agg(*(f(c).alias(f"{n}_{c}") for c in CTX for n, f in (("min", F.min), ("max", F.max)))).where("min_c1 <> max_c1 OR min_c2 <> max_c2").select("head")
        asked = entries.select("head", "t", "at").join(several, "head").groupBy("t").agg(F.collect_list(F.struct("head", "at")).alias("asked"))
        asked = materialize(asked, "asked")
        if last:
            for _, t in self.levels:
                drop_table(t)
            self.levels = []
        let_go(self.spark)
        texts = reduce(DataFrame.unionByName, [t.select("t", "text") for t in self.texts])
        found = asked.join(texts, "t").select("t", "asked", "text")
        cut = materialize(found.mapInPandas(lambda it: _stretches(it, least), _STRETCH), "stretches")
        drop_table(asked)
        let_go(self.spark)
        # the few texts of most beginnings are compared in one place; where there are many, by counting each window
        many = cut.groupBy("head").agg(F.count("*").alias("texts")).where(F.col("texts") > TOGETHER).select("head")
        few = cut.join(many, "head", "left_anti").repartition("head").sortWithinPartitions("head")
        some = few.mapInPandas(lambda it: _equal_windows(it, least), "t long, at long")
        each = cut.join(many, "head").mapInPandas(lambda it: _all_windows(it, least), "w1 long, w2 long, t long, at long")
        twice = each.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
        rest = each.join(twice, ["w1", "w2"]).select("t", "at")
        marks = materialize(reduce(DataFrame.unionByName, self.repeats).unionByName(some).unionByName(rest), "marks")
        drop_table(cut)
        return marks


def _stretches(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """The bytes that the windows of each entry cover."""
    for b in batches:
        rows = []
        for t, asked, text in zip(b["t"], b["asked"], b["text"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for a in asked:
                lo, more = a["at"] >> _SPAN_BITS, a["at"] & ((1 << _SPAN_BITS) - 1)
                rows.append((a["head"], t, lo, raw[lo : lo + more + least]))
        yield pd.DataFrame(rows, columns=["head", "t", "lo", "bytes"])


class _Windows:
    """All windows of some stretches: the row, the start in its text and the place among the joined bytes of each."""

    def __init__(self, b: pd.DataFrame, least: int):
        sizes = b["bytes"].map(len).to_numpy(np.int64)
        self.raw, self.least = np.frombuffer(b"".join(b["bytes"]), dtype=np.uint8), least
        many = sizes - least + 1
        self.row = np.repeat(np.arange(len(b)), many)
        inside = np.arange(len(self.row)) - np.repeat(np.cumsum(many) - many, many)
        self.start = b["lo"].to_numpy(np.int64)[self.row] + inside
        self.at = np.repeat(np.cumsum(sizes) - sizes, many) + inside

    def hashes(self, which: int) -> np.ndarray:
        return Rolling(self.raw, which).of(self.at, self.at + self.least)

    def equal(self) -> np.ndarray:
        """Which windows stand elsewhere too: those of one hash are compared byte by byte with the first of them."""
        _, first, back, n = np.unique(self.hashes(0), return_index=True, return_inverse=True, return_counts=True)
        good = n[back] > 1
        mine, other = np.flatnonzero(good), first[back][good]
        bytes_of = np.lib.stride_tricks.sliding_window_view(self.raw, self.least)
        same = [(bytes_of[self.at[mine[i : i + 65536]]] == bytes_of[self.at[other[i : i + 65536]]]).all(axis=1) for i in range(0, len(mine), 65536)]
        if len(mine) and not np.concatenate(same).all():  # two texts with one hash
            held = pd.Series([self.raw[a : a + self.least].tobytes() for a in self.at[mine].tolist()])
            good[mine] = held.duplicated(keep=False).to_numpy()
        return good


def _all_windows(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            w = _Windows(b, least)
            yield pd.DataFrame({"w1": w.hashes(0).view(np.int64), "w2": w.hashes(1).view(np.int64), "t": b["t"].to_numpy()[w.row], "at": w.start << _SPAN_BITS})


def _equal_windows(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by the beginnings of their suffixes: a batch is compared without its last one, which goes to the next batch."""

    def compared(b: pd.DataFrame) -> pd.DataFrame:
        w = _Windows(b, least)
        good = w.equal()
        row, start = w.row[good], w.start[good]
        first = np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)] if len(row) else np.empty(0, bool)
        lo = np.flatnonzero(first)
        hi = np.r_[lo[1:], len(row)] - 1 if len(lo) else lo
        return pd.DataFrame({"t": b["t"].to_numpy()[row[lo]], "at": (start[lo] << _SPAN_BITS) + (start[hi] - start[lo])})

    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        last = b["head"].to_numpy() == b["head"].iloc[-1]
        held = b[last]
        if not last.all():
            yield compared(b[~last].reset_index(drop=True))
    if held is not None and len(held):
        yield compared(held.reset_index(drop=True))


def _kept(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text, spans in zip(b["text"], b["spans"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            removed = runs = 0
            if spans is not None and len(spans):
                at = np.asarray(spans, np.int64)
                lo, more = at >> _SPAN_BITS, at & ((1 << _SPAN_BITS) - 1)
                edge = np.bincount(lo, minlength=len(raw) + 1) - np.bincount(lo + more + least, minlength=len(raw) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((removed, runs, hashlib.sha256(raw).hexdigest(), raw))
        out = pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "kept"])
        yield pd.DataFrame({"doc_id": b["id"], "n_bytes": b["n_bytes"]} | {c: out[c] for c in out.columns})


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 200, batches: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that are left, which need
    not be whole characters).

    A byte goes if a string of `least` bytes that covers it starts anywhere else too, in the same text or another; matches are
    judged on the input and never cross texts. Null texts count as empty, texts of fewer bytes lose nothing, equal texts of
    `least` bytes or more lose all. Rows with null or repeated ids are texts like any other. An empty table gives an empty
    result; other columns are ignored. Texts are equal if 128 bits of MD5 are; stretches if their 32 first bytes and 128 bits of
    hashes are. The texts join the index in `batches` batches.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = distinct_texts(plain.select("text"), least)
    family = SuffixIndexFamily(spark, least, f"{shared_folder(spark)}/suffix-family-{uuid.uuid4().hex}")
    for b in range(batches):
        family.add(texts.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == b))
    marks = family.repeated(last=True)
    family.drop()
    spans = materialize(marks.groupBy("t").agg(F.collect_set("at").alias("spans")).join(texts.select("t", "key"), "t").select("key", "spans"), "spans")
    drop_table(marks)
    drop_table(texts)
    let_go(spark)
    keyed = plain.select("id", "text", F.octet_length("text").cast("long").alias("n_bytes"), text_key("text").alias("key"))
    joined = keyed.join(spans, "key", "left").select("id", "text", "n_bytes", "spans")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.mapInPandas(lambda it: _kept(it, least), schema)
