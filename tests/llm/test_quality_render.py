"""The network against a plain forward pass, rendered pages against the text that they were made from, and stages on odd tables."""

import random

import numpy as np
import pytest

import corpus_pipeline
from shelfscope.llm import quality, render

DATA = "/root/testdata/sf0.001"


def plain_score(net, text):
    """The network as its definition reads: every chunk, position and filter in turn."""
    raw = list(text.encode("utf-8", "surrogatepass"))
    hop = quality.CHUNK - quality.OVERLAP
    chunks = []
    at = 0
    while True:
        part = raw[at : at + quality.CHUNK]
        chunks.append(part + [quality.PAD] * (quality.CHUNK - len(part)))
        at += hop
        if at + quality.OVERLAP >= len(raw):
            break
    embed, conv, bias = (net.p[k].astype(float) for k in ("embed", "conv", "bias"))
    pooled = []
    for c in chunks:
        best = np.full(quality.FILTERS, -np.inf)
        for start in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STEP):
            x = np.concatenate([embed[b] for b in c[start : start + quality.WIDTH]])
            best = np.maximum(best, x @ conv)
        pooled.append(np.maximum(best + bias, 0))
    v = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    u = np.maximum(v @ net.p["mix"].astype(float) + net.p["mix_bias"], 0)
    return 1 / (1 + np.exp(-(u @ net.p["out"].astype(float) + net.p["out_bias"][0])))


def test_score_equals_a_plain_forward_pass():
    r = random.Random(2)
    texts = ["", "a", "é" * 300, "x" * 512, "y" * 513, "z" * 960, "w" * 961, "".join(chr(r.randint(32, 1200)) for _ in range(3000)), "\ud800 odd"]
    net = quality.ByteNet()
    for round_ in range(2):
        got = net.score(texts)
        assert np.allclose(got, [plain_score(net, t) for t in texts], atol=2e-5)
        if not round_:
            net.fit([quality.chunks_of(t) for t in texts], np.array([i % 2 for i in range(len(texts))]), epochs=3, batch=4)


def test_training_uses_whole_texts_within_its_bounds(spark):
    docs = spark.createDataFrame([(i, ("good words of prose " if i % 2 else "#!% buy 77 now ") * (1 + i * 40 % 300), "c") for i in range(80)] + [(None, "x", "c"), (3, "twice", "c"), (200, None, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(None, 1, 0), (200, 1, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    net = quality.train(docs, labels)
    s = net.score(["good words of prose " * 50, "#!% buy 77 now " * 50])
    assert s[0] > 0.5 > s[1]
    # one very long text doesn't keep the others out of the sample
    long_ = docs.unionByName(spark.createDataFrame([(300, "good words of prose " * 60_000, "c")], docs.schema))
    with_long = quality.train(long_, labels.unionByName(spark.createDataFrame([(300, 1, 0)], labels.schema)), per_class=200)
    s = with_long.score(["good words of prose " * 50, "#!% buy 77 now " * 50])
    assert s[0] > 0.5 > s[1]
    report = quality.quality_report(docs, labels)
    assert report.count() == docs.count() and report.columns == ["doc_id", "held_out", "score", "predicted"]
    assert quality.quality_report(docs.limit(0), labels).count() == 0 and quality.quality_report(docs, labels.limit(0)).count() == docs.count()


def made_page(r, depth=0):
    """(html, lines) of random visible and hidden content: paragraphs, lists, tables with spans, inline tags, optional end tags left out."""
    html, lines = "", []

    def inline():
        words = [f"w{r.randint(0, 999)}" for _ in range(r.randint(1, 5))]
        shown = " ".join(words)
        marked = " ".join(r.choice(("{}", "<b>{}</b>", "<i class='hidden'>{}</i>", "{}<span hidden>no</span>", "{}<!-- no -->", "<a title=\"hidden\">{}</a>")).format(w) for w in words)
        return marked, shown

    for _ in range(r.randint(1, 4)):
        kind = r.randint(0, 5)
        if kind == 0:
            marked, shown = inline()
            html += f"<p>{marked}" + r.choice(("</p>", "\n"))
            lines.append(shown)
        elif kind == 1:
            marked, shown = inline()
            html += f"<div>{marked}</div>"
            lines.append(shown)
        elif kind == 2:
            items = [inline() for _ in range(r.randint(1, 3))]
            start = r.randint(-2, 40)
            html += f"<ol start='{start}'>" + "".join(f"<li>{m}" + r.choice(("</li>", "")) for m, _ in items) + "</ol>"
            lines += [f"{start + i}. {s}" for i, (_, s) in enumerate(items)]
        elif kind == 3 and depth < 3:
            inner, shown = made_page(r, depth + 1)
            html += f"<section>{inner}</section>"
            lines += shown
        elif kind == 4:
            rows = [[inline() for _ in range(3)] for _ in range(r.randint(1, 4))]
            wide = [max(len(row[i][1]) for row in rows) for i in range(3)]
            head, text = inline()
            html += f"<table><tr><td colspan=3>{head}" + "".join("<tr>" + "".join(f"<td>{m}" + r.choice(("</td>", "")) for m, _ in row) for row in rows) + "</table>"
            lines += [text] + [" | ".join(s.ljust(w) for (_, s), w in zip(row, wide, strict=True)).rstrip() for row in rows]
        else:
            html += r.choice(("<script>no</script>", "<div style='display:none'><p>no</p></div>", "<template><p>no</template>", "<style>no</style>"))
    return html, lines


@pytest.mark.parametrize("seed", range(60))
def test_pages_give_the_text_that_they_were_made_from(seed):
    html, lines = made_page(random.Random(seed))
    for page in (html, f"<!doctype html><html><head><title>no</title><body>{html}"):
        assert [x for x in render.html_to_text(page).split("\n") if x] == lines
    # below the last level of the tree the words stay, in their order
    words = lambda t: [w for w in t.replace("|", " ").split() if w.startswith("w") or w == "no"]
    assert words(render.html_to_text(f"<div>{'<div>' * 230}{html}")) == words("\n".join(lines))


def test_spans_values_and_depth():
    assert render.html_to_text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a | b\n  | c"
    assert render.html_to_text("<ol><li>a<li value=9>b<li>c</ol>") == "1. a\n9. b\n10. c"
    assert render.html_to_text("<pre>a\n\n\n\nb<ul><li>c<li>d</ul></pre>") == "a\n\n\n\nb\nc\nd"
    assert "no" not in render.html_to_text("<div>" * 400 + "<span hidden>no</span>yes")
    long_ = "x" * 90
    assert render.html_to_text(f"<table><tr><td>{long_}<td>1<tr><td>y<td>2</table>") == f"{long_} | 1\n{'y'.ljust(90)} | 2"
    wide = render.html_to_text("<table>" + f"<tr><td>{'x' * 20000}<td>1" + "<tr><td>y<td>2" * 300 + "</table>")
    assert len(wide) < 12 * 20000 + 10000


ODD = [(None, None, "de", "s", 0), (None, "", None, None, None), (1, "word " * 4000, "en", "s", 5), (1, "another text of some words that says little else", "en", None, 1), (1, "another text of some words that says little else", "en", None, 1), (7, "mail me at a@b.example or 10.0.0.1 now", "en", "t", 2), (8, "odd \x00 text", "xx", "", -1)]


@pytest.mark.parametrize("rows", [[], ODD])
def test_stages_take_odd_tables(spark, rows):
    extra = [(*r, "k", 1, True, 0.5) for r in rows]
    docs = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, key string, n long, stays boolean, target double")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, DATA)
        got = out.collect()
        assert len(got) <= len(rows)
        if name != "mix":
            assert out.columns == docs.columns
        if name == "near_duplicates" and rows:
            assert len(got) == len(rows) - 1
        if name == "benchmark":
            assert len(got) == len(rows)
        if name == "personal_data" and rows:
            assert {r.text for r in got if r.doc_id == 7} == {"mail me at [EMAIL] or [IP] now"}
            assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    kept = corpus_pipeline.STAGES[0][1](spark, docs, DATA)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
