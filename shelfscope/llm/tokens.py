"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens; the distinct ones of a slice are held as one ragged numpy array of symbol ids. In each round
every pre-token merges all occurrences of its own lowest-ranked pair at once, until no pair of the vocabulary is left. What
survives is counted, and a text has the sum of its pre-tokens' counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Fixed value: the splitting pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of pre-tokens whose counts a worker remembers; the memory is emptied when it is full.
REMEMBERED = 4_000_000
_NONE = np.iinfo(np.int64).max


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merge ranks of a byte-level BPE file, given by its content, as sorted arrays."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, ids = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a byte-level BPE file without normalizer")
        self.of_byte = np.array([ids[c] for c in _byte_symbols()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = max(ids.values()) + 1
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.split = regex.compile(PATTERN)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}
        self.held = 0  # characters of the known pre-tokens

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merged_sizes(self, words: list[str]) -> np.ndarray:
        """Symbols that are left of each word when no pair can be merged."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ids = self.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        left = sizes.copy()
        while len(ids) > 1:
            rank = np.append(self.rank(ids[:-1], ids[1:]), _NONE)
            rank[:-1][word[:-1] != word[1:]] = _NONE
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.append(starts, len(ids)))
            chosen = (rank == np.repeat(lowest, spans)) & (rank != _NONE)
            if not chosen.any():
                break
            # in a run such as "aaa" each second pair overlaps the one before
            at = np.flatnonzero(chosen)
            heads = np.r_[True, np.diff(at) > 1]
            run = at[heads][np.cumsum(heads) - 1]
            at = at[(at - run) % 2 == 0]
            ids[at] = self.made[rank[at]]
            left -= np.bincount(word[at], minlength=len(left))
            keep = np.repeat(lowest != _NONE, spans)  # finished words leave
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        return left

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special string inside a text is one token."""
        cut, extra = [], []
        for t in texts:
            n = 0
            if self.special is not None and (found := self.special.findall(t)):
                n = len(found)
                cut.append([w for part in self.special.split(t) for w in self.split.findall(part)])
            else:
                cut.append(self.split.findall(t))
            extra.append(n)
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        new = list(set().union(*cut).difference(self.known))
        self.held += sum(map(len, new))
        at = 0
        while at < len(new):  # a bounded number of bytes at once
            size, end = 0, at
            while end < len(new) and (end == at or size < 1_000_000):
                size += len(new[end])
                end += 1
            self.known.update(zip(new[at:end], self.merged_sizes(new[at:end]).tolist(), strict=True))
            at = end
        of = self.known.__getitem__
        return [n + sum(map(of, words)) for n, words in zip(extra, cut, strict=True)]


@lru_cache(maxsize=2)
def vocabulary(content: str) -> Vocabulary:
    """Built once in each Python worker."""
    return Vocabulary(content)


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer is the path of a byte-level BPE file for the tokenizers library; the driver reads it and sends its content (a few MB,
    the size of a vocabulary) to the executors. Counts are those of that library without begin, end or added special tokens. Null
    texts count as empty (0 tokens). Whole texts are counted, however long; repeated rows each give a row; an empty table gives an
    empty table; other columns are ignored.
    """
    with open(tokenizer, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(content.value)
        for texts in batches:
            yield pd.Series([n for part in slices(texts) for n in vocab.count(part)], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
