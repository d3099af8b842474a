"""Document quality by a byte-level convolutional network in numpy.

A text is read as UTF-8 bytes in overlapping chunks that cover all of it. Learned filters run over each chunk and are max-pooled;
the pooled chunks are combined, by their mean and their maximum, into one probability. The network is trained by gradient descent
on a bounded sample of labelled rows, and applied to every row in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Bytes of a chunk, of its overlap with the next and of a filter's window; every second window is read.
CHUNK, OVERLAP, WIDTH, STEP = 512, 64, 8, 2
FILTERS, EMBED, HIDDEN = 32, 8, 16
PAD = 256
#: Labelled rows of each class that training sees at most, with their whole texts.
SAMPLE_PER_CLASS = 1500
#: Chunks that are convolved at once, when texts are scored and in training, and those whose gradients are made at once.
_BATCH, _STEP_CHUNKS, _BACK = 512, 32, 1024


def chunks_of(text: str) -> np.ndarray:
    """Chunks x bytes; the last is filled up with padding. The empty text has one chunk of padding."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    hop = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // hop))
    padded = np.full((n - 1) * hop + CHUNK, PAD, dtype=np.int16)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (hop * 2, 2))


def first_of(won: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of the chunks of a document that reach its maximum the first alone, for each filter. Chunks overlap, so one window may win twice."""
    seen = np.cumsum(won, axis=0)
    starts = np.searchsorted(doc, doc)
    return won & (seen - (seen - won)[starts] == 1)


class ByteNet:
    """Embedding of bytes, filters with max-pooling over a chunk, mean and maximum over chunks, a hidden layer, a probability."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "embed": r.normal(0, 0.5, (PAD + 1, EMBED)).astype(f),
            "conv": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(f),
            "bias": np.zeros(FILTERS, f),
            "mix": r.normal(0, (2 * FILTERS) ** -0.5, (2 * FILTERS, HIDDEN)).astype(f),
            "mix_bias": np.zeros(HIDDEN, f),
            "out": r.normal(0, HIDDEN**-0.5, HIDDEN).astype(f),
            "out_bias": np.zeros(1, f),
        }
        self.p["embed"][PAD] = 0
        self._tables = None

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """Chunks x positions x bytes of a window."""
        return np.lib.stride_tricks.sliding_window_view(chunks, WIDTH, axis=1)[:, ::STEP]

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest activation of each filter in each chunk, and its position."""
        w = self.windows(chunks)
        x = self.p["embed"][w].reshape(-1, WIDTH * EMBED)
        a = (x @ self.p["conv"]).reshape(len(chunks), w.shape[1], FILTERS)
        at = a.argmax(axis=1)
        return np.maximum(np.take_along_axis(a, at[:, None], 1)[:, 0] + self.p["bias"], 0), at

    def pooled_in_steps(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As pooled, a bounded number of chunks at once."""
        found = [self.pooled(chunks[i : i + _STEP_CHUNKS]) for i in range(0, len(chunks), _STEP_CHUNKS)]
        return np.concatenate([h for h, _ in found]), np.concatenate([at for _, at in found])

    def pooled_fast(self, chunks: np.ndarray) -> np.ndarray:
        """As pooled, from tables of what each pair of bytes adds to each filter."""
        if self._tables is None:
            conv = self.p["conv"].reshape(WIDTH, EMBED, FILTERS)
            single = np.einsum("be,wef->wbf", self.p["embed"], conv)
            pairs = [(single[k][:, None] + single[k + 1][None]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)]
            self._tables = [np.ascontiguousarray(t, dtype=np.float32) for t in pairs]
        pair = chunks[:, 0::2].astype(np.int64) * (PAD + 1) + chunks[:, 1::2]
        n = (CHUNK - WIDTH) // STEP + 1
        a = self._tables[0][pair[:, :n]]
        for k in range(1, WIDTH // 2):
            a += self._tables[k][pair[:, k : k + n]]
        return np.maximum(a.max(axis=1) + self.p["bias"], 0)

    def combine(self, h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, tuple]:
        """Logits of n documents from pooled chunks h; doc is the document of each chunk, sorted."""
        starts = np.searchsorted(doc, np.arange(n))
        counts = np.bincount(doc, minlength=n).astype(np.float32)[:, None]
        mean, most = np.add.reduceat(h, starts) / counts, np.maximum.reduceat(h, starts)
        v = np.concatenate([mean, most], axis=1)
        u = np.maximum(v @ self.p["mix"] + self.p["mix_bias"], 0)
        return u @ self.p["out"] + self.p["out_bias"][0], (v, u, counts, most)

    def score(self, texts: list[str]) -> np.ndarray:
        cut = [chunks_of(t) for t in texts]
        doc = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        h = np.empty((len(doc), FILTERS), np.float32)
        done, part, held = 0, [], 0
        for c in cut:  # a bounded number of chunks is convolved at once, however long a text is
            for at in range(0, len(c), _BATCH):
                part.append(c[at : at + _BATCH])
                held += len(part[-1])
                if held >= _BATCH:
                    h[done : done + held] = self.pooled_fast(np.concatenate(part))
                    done, part, held = done + held, [], 0
        if part:
            h[done : done + held] = self.pooled_fast(np.concatenate(part))
        logit, _ = self.combine(h, doc, len(cut))
        return 1 / (1 + np.exp(-np.clip(logit.astype(float), -30, 30)))

    def gradients(self, chunks: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of one batch of documents; through a maximum they flow to the position that won."""
        p, n = self.p, len(labels)
        h, at = self.pooled_in_steps(chunks)
        logit, (v, u, counts, most) = self.combine(h, doc, n)
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = -np.mean(labels * np.log(prob + 1e-7) + (1 - labels) * np.log(1 - prob + 1e-7))
        dl = ((prob - labels) / n).astype(np.float32)
        du = dl[:, None] * p["out"] * (u > 0)
        dv = du @ p["mix"].T
        dmean, dmost = dv[:, :FILTERS] / counts, dv[:, FILTERS:]
        dh = (dmean[doc] + dmost[doc] * first_of(h == most[doc], doc)) * (h > 0)
        dconv, dembed = np.zeros_like(p["conv"]), np.zeros_like(p["embed"])
        for i in range(0, len(chunks), _BACK):  # a bounded part of a long text at once
            part, d = chunks[i : i + _BACK], dh[i : i + _BACK]
            x = self.windows(part)[np.arange(len(part))[:, None], at[i : i + _BACK]]  # chunks x filters x bytes
            dconv += np.einsum("cf,cfk->kf", d, p["embed"][x].reshape(len(part), FILTERS, WIDTH * EMBED))
            de = (d[:, :, None] * p["conv"].T[None]).reshape(-1, EMBED)
            flat = x.reshape(-1)
            dembed += np.stack([np.bincount(flat, weights=de[:, j], minlength=PAD + 1) for j in range(EMBED)], axis=1)
        dembed[PAD] = 0
        return float(loss), {"embed": dembed, "conv": dconv, "bias": dh.sum(0), "mix": v.T @ du, "mix_bias": du.sum(0), "out": u.T @ dl, "out_bias": dl.sum(keepdims=True)}

    def fit(self, cut: list[np.ndarray], labels: np.ndarray, *, epochs: int = 12, batch: int = 32, rate: float = 4e-3, seed: int = 11) -> ByteNet:
        """Adam over a sample of documents, each given by all its chunks."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        s = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, steps = 0, epochs * -(-len(cut) // batch)
        for _ in range(epochs):
            order = r.permutation(len(cut))
            for at in range(0, len(cut), batch):
                pick = order[at : at + batch]
                doc = np.repeat(np.arange(len(pick)), [len(cut[i]) for i in pick])
                _, g = self.gradients(np.concatenate([cut[i] for i in pick]), doc, labels[pick].astype(np.float32))
                step += 1
                now = rate * 0.5 * (1 + np.cos(np.pi * step / (steps + 1)))
                for k, x in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    x -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-6)
        self._tables = None
        return self


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training must not see: crc32 of the id as text (null: the empty text) is divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> ByteNet:
    """A network fitted on the labelled rows that are not held out.

    Of each class the per_class ids with the smallest hash are used (fewer, if docs lacks some of them), with their whole texts: the
    driver holds 2 * per_class texts, whatever the size of the tables. Labels other than 0 and 1, null ids and repeated ids beyond the first are left out; null texts are empty.
    Without any labelled row the network stays untrained.
    """
    order = F.xxhash64("__id")
    known = labels.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    drawn = [known.where(F.col("__label") == c).orderBy(order, "__id").limit(per_class) for c in (0, 1)]
    sample = drawn[0].unionByName(drawn[1]).groupBy("__id").agg(F.min("__label").alias("__label"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")
    rows = rows.groupBy("__id", "__label").agg(F.min(F.coalesce("__text", F.lit(""))).alias("__text"))
    got = rows.toPandas().sort_values("__id")
    net = ByteNet()
    if len(got):
        net.fit([chunks_of(t) for t in got["__text"]], got["__label"].to_numpy())
    return net


def score_quality(docs: DataFrame, net: ByteNet, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the probability (0 to 1) that a text is of good quality, from its bytes alone.

    Null texts count as empty; empty texts have a score too. Whole texts are read, however long. Equal texts have equal scores;
    all rows and other columns stay; a column with the name of the score is replaced.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.concatenate([net.score(part) for part in slices(texts)]) if len(texts) else [], dtype="float64")

    return docs.withColumn(score_col, scored(F.col(text_col)))


def quality_report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 if score >= threshold, else 0).

    Null and empty texts have a score like any other; null ids count as the empty text when rows are held out; repeated rows each
    give a row; an empty table gives an empty result; other columns are ignored.
    """
    net = train(docs, labels, id_col=id_col, text_col=text_col)
    scored = score_quality(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), net)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
