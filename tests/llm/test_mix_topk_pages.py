"""Mixing, exact top-k, page text and licences."""

import re

import numpy as np
import pytest

from shelfscope.llm import licenses, mixing, render, topk


def _targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = [s for s in names if s not in full]
        share = sum(weight[s] for s in left)
        rest = total - sum(most * sizes[s] for s in full)
        over = {s for s in left if rest * weight[s] > most * sizes[s] * share}
        if not over:
            return {s: float(most * sizes[s]) if s in full else rest * weight[s] / share for s in names}
        full |= over


ROWS = [(5, "a"), (100, "b"), (3, "c"), (1, None), (0, "z"), (2, "a"), (2, "a"), (40, "d"), (41, "d"), (7, "e")]


def test_targets_and_taken_words(spark):
    docs = spark.createDataFrame([(i, "w\x0bx " * n if i % 2 else "w x\t" * n, s, "q") for i, (n, s) in enumerate(ROWS)] + [(None, None, "b", "q"), (5, "w x\t" * 2, "a", "q")], "doc_id long, text string, source string, target string")
    got = mixing.mix_to_targets(docs).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = _targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in got)
    for s in sizes:
        largest = max(sum(x.size for x in got if x.doc_id == r.doc_id and x.source == s) for r in got if r.source == s)
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= largest / 2 + 1e-6
    assert sorted(map(tuple, mixing.mix_to_targets(docs.repartition(3)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix_to_targets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_top_k_equals_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in r.integers(-3, 3, 5) / 4]) for i in range(230)] + [(300, [float("nan")] * 5), (400, None), (500, [1.0, None, 0.0, 0.0, 0.0]), (None, [0.0] * 5), (100, [9.0, float("inf"), 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, score int")
    got = sorted((q, k, v, s) for q, k, v, s in topk.exact_top_k(vectors).collect())
    good = [(i, np.floor(np.array(v) * 1024).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, qv in good:
        if q % 100 == 0:
            scored = sorted((-int(qv @ v), i) for i, v in good if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    assert topk.exact_top_k(vectors.limit(0)).count() == 0


def test_top_k_with_a_hot_vector_repeated_ids_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "FIRST", 2)
    monkeypatch.setattr(topk, "GROUP", 3)
    r = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0] if i % 3 == 0 else [float(x) for x in r.normal(0, 1, 2)]) for i in range(300)]
    rows += [(100, [float(i), 0.5]) for i in range(15)] + [(7, [3.0, 3.0])] * 14 + [(200, [1.0, 2.0, 3.0]), (9, [2.0, 2.0, 2.0]), (900, [])]
    rows += [(1000 + i, [2.0**40 + i, -(2.0**41)]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.exact_top_k(vectors).collect()))
    want = []
    whole = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in rows]
    for q in sorted({i for i, _ in rows if i % 100 == 0}):
        own = min(v for i, v in whole if i == q)
        nearest = lambda s: max(min(s, 2**63 - 1024), -(2**63) + 1024) if abs(s) >= 2**63 else s
        scored = sorted((-nearest(sum(a * b for a, b in zip(own, v, strict=True))), i) for i, v in whole if i != q and len(v) == len(own))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == want


def test_page_layout():
    html = "<title>no</title><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><caption>T<tr><td>1<td>two<tr><td>three<td>4</table>x<p>p1<p>p2<div hidden>no</div><pre> a\n  b</pre><ol start=3><li>x<li>y</ol>a &amp; b<br>c<script>no</script>tail <b>bo</b>ld<span style='display: none'>no</span>"
    want = "- a\n- b\n  - c\n- d\n\nT\n1     | two\nthree | 4\n\nx\n\np1\n\np2\n\n a\n  b\n\n3. x\n4. y\n\na & b\nctail bold"
    assert render.html_to_text(html) == want


@pytest.mark.parametrize("html", ["<", "<a", "<<p>x", "</p>", "<b>" * 5000 + "x", "<table>" * 3000 + "q", "<div " * 9000, "<!--" * 9000, "<a b='" * 9000, "<ul><li>" * 3000, "&#x;" * 9000])
def test_broken_pages(html):
    assert isinstance(render.html_to_text(html), str)


def test_all_visible_words_stay():
    words = [f"w{i}" for i in range(60)]
    tags = ["p", "div", "li", "td", "b", "h2", "section", "tr", "table", "ul", "pre", "dd"]
    r = np.random.default_rng(3)
    for _ in range(200):
        html = "".join(f"<{'/' if r.random() < 0.4 else ''}{tags[r.integers(len(tags))]}>{w} " for w in words)
        assert sorted(re.findall(r"w\d+", render.html_to_text(html))) == sorted(words)


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b", "x"), (1, "<p>a<p>b", "x"), (None, None, None), (2, "", "")], "page_id long, html string, text string")
    got = sorted(map(tuple, render.extract_text(pages).collect()), key=repr)
    assert got == [(1, "a\n\nb", 4, 3), (1, "a\n\nb", 4, 3), (2, "", 0, 0), (None, "", 0, 0)]
    assert render.extract_text(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def classifier(spark):
    return licenses.train(spark)


def _scanned(classifier, rows):
    """The rules of the scan, text by text."""
    out = []
    for doc_id, text in rows:
        for k, paragraph in enumerate(re.split(r"\n[^\S\n]*\n\s*", text) if text is not None else []):
            w = licenses._plain_words(paragraph)
            named, best = {}, {}
            for at in range(0, max(0, -(-(len(w) - licenses.WINDOW) // licenses.HOP)) * licenses.HOP + 1, licenses.HOP):
                window = w[at : at + licenses.WINDOW]
                if not set(window) & set(classifier.anchors):
                    continue
                seen = classifier.seen(window)
                p = classifier.softmax(classifier.logits(seen))
                top = p.index(max(p))
                rest = classifier.softmax(classifier.logits([g for g in seen if classifier.weights[g][top] <= 0]))
                best = {c: max(best.get(c, 0), x) for c, x in zip(classifier.classes, p, strict=True)}
                some = {}
                for q in (p, rest):
                    of = dict(zip(classifier.classes, q, strict=True))
                    if 1 - of["none"] - of["unknown"] < classifier.confidence:
                        break
                    some |= {c: max(x, some.get(c, 0)) for c, x in of.items() if x >= licenses.SHARE and c not in ("none", "unknown")}
                if not some and 1 - p[classifier.classes.index("none")] >= classifier.confidence:
                    some = {"unknown": 1 - p[classifier.classes.index("none")]}
                for c, x in some.items():
                    named[c] = max(x, named.get(c, 0))
            runs = {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}
            held = [(f, t, set(t) & runs) for f, ts in licenses.TEMPLATES.items() for t in map(licenses.template_runs, ts) if t and len(set(t) & runs) >= licenses.OVERLAP * len(t)]
            found = {f for f, _, h in held if not all(any(g != f and len(h2) > len(h1) and h1 <= set(t2) for g, t2, h2 in held) for f1, _, h1 in held if f1 == f)}
            if not set(w) & set(classifier.anchors):
                assert not found and not named
            families = set(named) | found
            for f in families - ({"unknown"} if len(families) > 1 else set()):
                share = max((len(set(t) & runs) / len(t) for t in map(licenses.template_runs, licenses.TEMPLATES.get(f, [])) if t), default=0.0)
                out.append((doc_id, k, f, round(named.get(f, best.get(f, 0.0)), 6), round(share, 6), f in found))
    return sorted(out, key=repr)


AGPL = "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"
#: A text, the families that it must have, and those of them that a template must confirm.
LICENSED = [
    ("All rights reserved.", {"proprietary"}, {"proprietary"}), ("My license expired last week\nReleased under the MIT License. Enjoy", {"mit"}, {"mit"}), ("Licensed under CC BY-SA 4.0", {"cc-by-sa"}, {"cc-by-sa"}), ("licensed under CC BY 4.0.", {"cc-by"}, {"cc-by"}),
    ("long " * 3000 + "Licensed under the Apache License, Version 2.0" + " more" * 300, {"apache"}, {"apache"}), ("This is free: " + AGPL + ".", {"agpl"}, {"agpl"}), ("licensed under the GNU Lesser General Public License version 3", {"lgpl"}, {"lgpl"}), (AGPL.replace("Affero ", ""), {"gpl"}, {"gpl"}),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", {"cc-by-nc"}, {"cc-by-nc"}), ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa"}, {"cc-by-sa"}),
    ("Permission is hereby granted, free\nof charge, to any person obtaining\na copy of this software", {"mit"}, {"mit"}), ("available under the GNU GPL version 2 or later", {"gpl"}, {"gpl"}), ("Released under the MIT License, or licensed under the Apache License, Version 2.0", {"mit", "apache"}, {"mit", "apache"}),
    ("Distributed under GPLv3", {"gpl"}, set()), ("This program is GPL v2 or later", {"gpl"}, set()), ("SPDX: Apache-2.0", {"apache"}, set()), ("ISC license", {"isc"}, set()), ("under the mit license", {"mit"}, set()), ("SPDX: MIT", {"mit"}, set()), ("MIT or Apache-2.0", {"mit", "apache"}, set()),
    ("Redistribution and use in source and\nbinary forms, with or without\nmodification, are permitted provided\nthat the following conditions are met", {"bsd"}, {"bsd"}), ("licensed under the Quux Public Software License 7", {"unknown"}, set()),
]
FREE = ["", "the warranty is void", "permission to land was granted to the pilot", "she lost her driving license in may", "students of MIT released a report about the public", "word " * 400, "das Haus mit dem Garten. Mit Freude und mit Lust", "com o mit-\nund ohne licht mit"]


def test_licences(spark, classifier):
    texts = [t for t, _, _ in LICENSED] + FREE + ["Title\n\n" + LICENSED[10][0] + "\n \n" + LICENSED[0][0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, texts[0]), (77, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, family string")
    got = licenses.scan_licenses(docs, classifier).collect()
    assert sorted(((r.doc_id, r.paragraph, r.family, round(r.probability, 6), round(r.template_overlap, 6), r.confirmed) for r in got), key=repr) == _scanned(classifier, rows)
    for i, (text, families, confirmed) in enumerate(LICENSED):
        assert {r.family for r in got if r.doc_id == i} == families, text
        assert {r.family for r in got if r.doc_id == i and r.confirmed} == confirmed, text
    assert not {r.doc_id for r in got} & set(range(len(LICENSED), len(LICENSED) + len(FREE)))
    assert {(r.paragraph, r.family) for r in got if r.doc_id == len(texts) - 1} == {(1, "mit"), (2, "proprietary")}
    assert licenses.scan_licenses(docs.limit(0), classifier).count() == 0


def test_what_has_no_anchor_is_no_licence(classifier):
    none = classifier.classes.index(licenses.NONE)
    assert classifier.probabilities_of("")[none] > 1 - classifier.confidence
    for g, x in classifier.weights.items():
        assert max(x) == x[none] or set(g.split(" ")) & set(classifier.anchors)
    for t in (t for ts in licenses.TEMPLATES.values() for t in ts):
        runs = licenses.template_runs(t)
        assert not runs or sum(bool(set(r.split(" ")) & set(classifier.anchors)) for r in runs) > len(runs) * (1 - licenses.OVERLAP), t


def test_unseen_wordings_and_false_alarms(classifier):
    none = classifier.classes.index(licenses.NONE)
    unseen = [(f, classifier.probabilities_of(t)) for f, t, part in licenses.training_rows() if part == 1]
    right = [classifier.classes[p.index(max(p))] == f for f, p in unseen if f not in (licenses.NONE, licenses.UNKNOWN)]
    alarms = [1 - p[none] >= classifier.confidence for f, p in unseen if f == licenses.NONE]
    assert sum(right) >= 0.95 * len(right) and sum(alarms) <= 0.03 * len(alarms)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<a title="the hidden cost">a</a> <b class="x hidden y">b</b> <i aria-hidden=true>c</i>', "a b c"),
        ("<b hidden>no</b><b HIDDEN=''>no</b><b style='color:red; Display : none'>no</b>x<b data-style='display:none'>y</b>", "xy"),
        ("a <a href=/o'brien>b</a> c <i title=\"it's > this\">d</i> e", "a b c d e"),
        ("a<b title='never ends>c", "a"),
        ("<html><head><title>no</title><meta charset=x><p>one<p>two", "one\n\ntwo"),
        ("<head><script>no</script>\n text", "text"),
        ("<head><title>no</title></head><body>a", "a"),
        ("x <svg><title>no</title><defs/><path d='M0'/><text>one</text><text>two</text></svg> <math><mi>y</mi><annotation>no</annotation></math>", "x one two y"),
        ("<textarea>a &amp; b</textarea><xmp><b>&amp;</xmp>", "a & b\n\n<b>&amp;"),
        ("<ol data-start=7 start=3><li>x</ol>", "3. x"),
    ],
)
def test_visible_text_stays(html, want):
    got = render.html_to_text(html)
    assert re.sub("\n+", "\n", got) == re.sub("\n+", "\n", want)
