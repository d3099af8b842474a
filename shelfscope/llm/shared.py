"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import delete_folder, drop_table, materialize, shared_folder  # noqa: F401

#: Characters of text that a task works on at once; it bounds what a Python worker holds.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(columns: list[str], *names: str) -> list[str]:
    """Names of columns for the time being, each with as many underscores before it as it takes to differ from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let_go(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects its garbage; ask for it where a step leaves many behind."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_key(text: str = "text"):
    """128 bits that stand for a text; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def slices(texts: Iterable[str | None], most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The texts in lists of some 2 million characters (one text at least); null becomes empty."""
    part, size = [], 0
    for t in texts:
        t = t or ""
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def pieces(batches: Iterable[pd.Series], most: int = SLICE_CHARS) -> Iterator[pd.Series]:
    """The same rows in order, in series of some 2 million characters, so that no more than that waits with its results."""
    for texts in batches:
        at = 0
        for part in slices(texts, most):
            yield texts.iloc[at : at + len(part)]
            at += len(part)
