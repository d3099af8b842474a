"""The passage search against a plain scan."""

import random

from shelfscope.operators.passages import passage_hits


def test_hits_equal_a_scan(spark):
    r = random.Random(1)
    words = ["a", "ab", "abc", "bca", "cab", "b", "ba\tc", "xyz"]
    texts = [(i, " ".join(r.choices(words, k=r.randint(0, 12))) + r.choice(["", " ", "\n\n"])) for i in range(150)] + [(200, None), (201, "")]
    cut = {(t := r.choice(texts[:150])[1])[(at := r.randint(0, 10)) : at + r.randint(0, 30)] for _ in range(120)}
    items = list(enumerate(sorted(cut))) + [(900, None), (901, ""), (902, "  "), (903, "\n"), (904, " "), (905, "ab"), (906, "ab")]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, n int")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(x) for x in passage_hits(docs, table).collect())
    assert got == sorted((i, d) for i, p in items for d, t in texts if p and t and p in t)
    long_ = table.where("length(text) > 25")
    assert sorted(tuple(x) for x in passage_hits(docs, long_).collect()) == [x for x in got if x[0] in {i for i, p in items if len(p or "") > 25}]
    assert passage_hits(docs, table.limit(0)).count() == 0 and passage_hits(docs.limit(0), table).count() == 0
