"""Columns of the input keep their names and values, whatever they are called."""

from pyspark.sql import functions as F

from shelfscope.llm import decontaminate, mixing, near_dup, pii
from shelfscope.llm.shared import free_names

ODD = "key __key of id stays many hash __hash plan_of plan_below held __held pii __pii _pii Hash".split()


def test_names_are_free():
    assert free_names(["a", "_A", "B"], "a", "b", "c", "c") == ["__a", "_b", "c", "_c"]


def test_pipeline_operators_leave_columns_alone(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "s"), (2, words + " x", "s"), (3, "mail a@b.co " + words[::-1], "t"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in ODD if c.lower() != "hash"), F.lit("h").alias("hash"))
    items = spark.createDataFrame([(1, "never to be seen. anywhere")], "item_id long, text string")
    made = {
        "mix": (mixing.mix_to_targets(docs), 4),
        "near": (near_dup.keep_one_of_each(docs), 3),
        "clean": (decontaminate.without_benchmark(docs, items), 4),
        "pii": (pii.find_personal_data(docs, redacted_col="safe"), 4),
    }
    for out, n in made.values():
        got = out.collect()
        assert len(got) == n and set(docs.columns) <= set(out.columns)
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in ODD if c.lower() != "hash") and all(r["hash"] == "h" for r in got)
