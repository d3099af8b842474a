"""Near duplicates, repeated passages, benchmark hits, quality and the pipeline against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfscope.llm import decontaminate, near_dup, quality, suffixes

R = random.Random(5)
WORDS = ["".join(R.choice("abcdeé") for _ in range(R.randint(1, 9))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def _classes(texts, least=0.8):
    bags = [near_dup.shingle_bag(t or "") for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] and texts[j] and (texts[i] == texts[j] or near_dup.weighted_jaccard(bags[i], bags[j]) >= least):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[find(i)].append(i)
    return {i: (min(g), len(g)) for g in groups.values() for i in g}


def test_signatures_estimate_the_weighted_similarity():
    for repeat in (1, 6):
        off = []
        for _ in range(40):
            a = [w for w in prose(60).split() for _ in range(R.randint(1, repeat))]
            b = a[: len(a) * 3 // 4] + prose(10).split()
            bags = [near_dup.shingle_bag(" ".join(x), 2) for x in (a, b)]
            s = near_dup.signatures(bags, 512)
            off.append((s[0] == s[1]).mean() - near_dup.weighted_jaccard(*bags))
        assert abs(np.mean(off)) < 0.012


def test_signatures_do_not_depend_on_the_batch():
    bags = [near_dup.shingle_bag(prose(n)) for n in (0, 1, 3, 5, 80, 900)]
    assert (near_dup.signatures(bags) == np.concatenate([near_dup.signatures([b]) for b in bags])).all()


def test_near_duplicate_classes_equal_brute_force(spark):
    base = [prose(120) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(8):
            w = b.split()
            for _ in range(R.randint(0, 6)):
                w[R.randrange(len(w))] = R.choice(WORDS)
            texts.append(" ".join(w))
    texts += [base[0]] * 5 + ["", "", None, "a b", "a b", "A  b", "x " * 800, "x " * 900, "x " * 990, "one"] + [prose(60) for _ in range(30)] + [base[1] + " " + prose(3000)]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, class_id string")
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dup.near_duplicate_classes(docs).collect()}
    assert got == _classes(texts)
    kept = {r.doc_id for r in near_dup.keep_one_of_each(docs).collect()}
    assert kept == {i for i, (c, _) in got.items() if i == c}


def test_near_duplicates_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dup.near_duplicate_classes(docs).collect()), key=repr)
    assert got == sorted([(None, 3, 3), (3, 3, 3), (3, 3, 3), (4, 4, 1)], key=repr)
    assert sorted(r.doc_id for r in near_dup.keep_one_of_each(docs).collect()) == [3, 4]
    assert near_dup.near_duplicate_classes(docs.limit(0)).count() == 0


def _kept(texts, least):
    seen, raws = Counter(), [(t or "").encode() for t in texts]
    for r in raws:
        seen.update(r[i : i + least] for i in range(len(r) - least + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                gone[i : i + least] = True
        edge = np.r_[False, gone]
        out.append((len(r), int(gone.sum()), int((edge[1:] & ~edge[:-1]).sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("together", [200, 1])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    shared = [prose(60) for _ in range(6)]
    texts = [prose(R.randint(0, 120)) for _ in range(150)]
    texts = [t[: len(t) // 2] + R.choice(shared)[R.randint(0, 60) :] + t[len(t) // 2 :] if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += ["a" * 700, "ab" * 300, "", None, texts[0], texts[0], "x" * 199, "y" * 200, "z" * 201, "é" * 100, "é" * 101, "q" * 50 + "a" * 650]
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs).collect())
    assert got == Counter(_kept(texts, 200))


def test_repeated_passages_of_an_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_family_that_is_opened_again_finds_repeats_in_what_it_held(spark, tmp_path):
    shared = prose(80)
    batches = [[f"{prose(30)} {shared} {prose(10)}", prose(90)], [prose(50), f"{shared[20:]} {prose(20)}"], [prose(70) + shared[:260]]]
    suffixes.SuffixIndexFamily(spark, 200, str(tmp_path)).save()
    numbered = 0
    for texts in batches:
        rows = [(numbered + i, t, 1) for i, t in enumerate(texts)]
        numbered += len(rows)
        table = suffixes.materialize(spark.createDataFrame(rows, "t long, text string, copies long"), "batch")
        suffixes.SuffixIndexFamily.open(spark, str(tmp_path)).add(table)
    family = suffixes.SuffixIndexFamily.open(spark, str(tmp_path))
    assert [n for n, _ in family.levels] == [2, 1]
    whole = [t.encode() for texts in batches for t in texts]
    got = {(r.t, i) for r in family.repeated().collect() for i in range(r["at"] >> 12, (r["at"] >> 12) + (r["at"] & 4095) + 1)}
    windows = Counter(x[i : i + 200] for x in whole for i in range(len(x) - 199))
    assert got == {(t, i) for t, x in enumerate(whole) for i in range(len(x) - 199) if windows[x[i : i + 200]] > 1}


def test_suffix_arrays_are_sorted_as_bytes_are():
    raw = [prose(400).encode()]
    (_, lo, hi, head, _), = suffixes.sparse_suffixes(raw, 200)
    shown = [(h, raw[0]) for h in map(tuple, head.tolist())]
    starts = [next(a for a in range(x, y + 200) if np.frombuffer(raw[0][a : a + 32], ">u8").astype(np.uint64).tolist() == [k % 2**64 ^ 2**63 for k in h]) for (h, _), x, y in zip(shown, lo, hi, strict=True)]
    assert [raw[0][a : a + 32] for _, a in sorted(zip(map(tuple, head.tolist()), starts, strict=True))] == sorted(raw[0][a : a + 32] for a in starts)


def test_suffixes_cover_every_window_once(monkeypatch):
    texts = [t.encode() for t in (prose(900), "ab" * 900, "a" * 150, prose(40))]
    for piece in (1 << 20, 500):
        monkeypatch.setattr(suffixes, "PIECE", piece)
        seen = Counter()
        for text, lo, hi, *_ in suffixes.sparse_suffixes(texts, 120):
            for t, a, b in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True):
                seen.update((t, i) for i in range(a, b + 1))
        assert seen == Counter((t, i) for t, x in enumerate(texts) for i in range(len(x) - 119))


def _index(items):
    frequency = Counter(w for _, t in items for w in set(decontaminate.words_of(t)))
    return decontaminate.ItemIndex(items, frequency, len(items), np.mean([len(decontaminate.words_of(t)) for _, t in items]))


def test_search_retrieves_all_above_the_threshold():
    items = [(i, prose(R.randint(5, 40))) for i in range(60)]
    index = _index(items)
    weights = np.zeros((len(items), len(index.term)))
    for t in range(len(index.term)):
        near = slice(index.start[t], index.start[t + 1])
        weights[index.item[near], t] = index.impact[near]
    assert np.allclose(weights.sum(axis=1), 1)
    terms = [np.array([index.term.get(w, -1) for w in decontaminate.words_of(prose(n))], dtype=np.int64) for n in (0, 3, 50, 400, 81)]
    got = {(d, at, i): s for d, at, i, s in index.search(terms, 0.1)}
    want = {}
    for d, x in enumerate(terms):
        for at in range(0, len(x), index.stride):
            found = np.unique(x[at : at + 2 * index.stride])
            score = weights[:, found[found >= 0]].sum(axis=1)
            want |= {(d, at, int(i)): score[i] for i in np.flatnonzero(score >= 0.1 - 1e-9)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_benchmark_hits(spark):
    items = [(i, prose(20) + ". " + prose(8)) for i in range(40)] + [(40, None), (41, ""), (1, "one. two")]
    clean = [prose(200) for _ in range(20)]
    texts = [f"{c} {items[i][1]} {prose(30)}" if i % 2 else c for i, c in enumerate(clean)] + [None, "", items[3][1].upper(), items[5][1].split(". ")[0]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[1], 1), (1, texts[1], 1)], "doc_id long, text string, item_id int")
    table = spark.createDataFrame(items, "item_id long, text string")
    want = Counter([(i, i) for i in range(20) if i % 2] + [(22, 3), (None, 1), (1, 1)])
    assert Counter((r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(docs, table).collect()) == want
    assert Counter((r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(docs, table, index_bytes=900).collect()) == want
    assert decontaminate.benchmark_hits(docs.limit(0), table).count() == 0
    assert decontaminate.benchmark_hits(docs, table.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.without_benchmark(docs, table).collect()} == {i for i in range(20) if i % 2 == 0} | {20, 21, 23}


@pytest.mark.parametrize("seed", range(6))
def test_gradients_agree_with_differences(seed):
    net, r = quality.ByteNet(seed), random.Random(seed)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    # the last text repeats its words, so chunks tie for a maximum
    cut = [quality.chunks_of(" ".join(r.choices(WORDS, k=n))) for n in (90, 200, 3)] + [quality.chunks_of("one two three " * 200)]
    doc = np.repeat(np.arange(4), [len(c) for c in cut])
    chunks, labels = np.concatenate(cut), np.array([0.0, 1.0, 1.0, 0.0])
    _, g = net.gradients(chunks, doc, labels)
    for k in ("conv", "bias", "mix", "mix_bias", "out", "out_bias"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        before = net.p[k][at]
        net.p[k][at] = before + 1e-6
        up = net.gradients(chunks, doc, labels)[0]
        net.p[k][at] = before - 1e-6
        down = net.gradients(chunks, doc, labels)[0]
        net.p[k][at] = before
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-3 * max(0.1, abs(g[k][at]))


def test_the_first_of_tied_chunks_wins():
    won = np.array([[True, False], [True, True], [True, True], [False, True]])
    assert quality.first_of(won, np.array([0, 0, 1, 1])).tolist() == [[True, False], [False, True], [True, True], [False, False]]


def test_quality_on_rows_it_has_not_seen(spark):
    junk = lambda n: " ".join(w + R.choice(["***", "$$$", "%%%"]) for w in prose(n).split())
    rows = [(i, prose(R.randint(20, 300)) if i % 4 else junk(R.randint(20, 300))) for i in range(600)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows] + [(None, None, 0.1), (9999, "", 0.1), (5, rows[5][1], 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.quality_report(docs, labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    unseen = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in unseen]) > 0.95
    assert quality.quality_report(docs.limit(0), labels.limit(0)).count() == 0


def test_tables_and_chunks_agree():
    net = quality.ByteNet()
    chunks = np.concatenate([quality.chunks_of(prose(n)) for n in (1, 100, 400)])
    assert np.allclose(net.pooled(chunks)[0], net.pooled_fast(chunks), atol=1e-4)
    whole = "abc" * 5000
    back = b"".join(c[: quality.CHUNK - quality.OVERLAP].astype(np.uint8).tobytes() for c in quality.chunks_of(whole)[:-1])
    assert whole.encode().startswith(back) and len(quality.chunks_of("")) == 1


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    leak = prose(25) + ". " + prose(9)
    good = [prose(150) for _ in range(120)]
    junk = [" ".join(w + "***" for w in prose(100).split()) for _ in range(40)]
    texts = good + junk + [good[0], good[1] + " x", prose(50) + " " + leak, good[3][:200] + " a@b.co " + good[3][200:], None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 120)) for i in range(160)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"out-{name}"))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len([i for i in kept["quality"] if i < 120]) >= 115 and len([i for i in kept["quality"] if 120 <= i < 160]) <= 3
    assert not {160, 161} & set(kept["near_duplicates"]) and set(kept["quality"]) - set(kept["near_duplicates"]) <= {160, 161, 163}
    assert set(kept["near_duplicates"]) - set(kept["benchmark"]) == {162} & set(kept["near_duplicates"])
    assert all("@" not in (r.text or "") and r.n_chars == len(r.text) for r in kept["personal_data"].values() if r.text is not None)
    assert all(r.copies > 0 and r.taken == r.copies * r.size for r in kept["mix"].values())


def test_only_the_copy_goes_not_other_rows_with_its_id(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "u v w x y z"), (4, "k l m n o p q"), (6, "k l m n o p q"), (6, "one two three four five six"), (6, "one two three four five six"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter([rows[1], rows[2], rows[3], rows[5], rows[7]])


def test_copies_of_a_text_do_not_multiply_marks(spark, monkeypatch):
    rows, real = {}, suffixes.materialize

    def counted(df, name, **more):
        out = real(df, name, **more)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(suffixes, "materialize", counted)
    text, other = prose(400), prose(100)
    docs = spark.createDataFrame([(i, text) for i in range(60)] + [(99, other)], "doc_id long, text string")
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs).collect())
    assert got == Counter(_kept([text] * 60 + [other], 200))
    one = sum(len(t) for t, *_ in suffixes.sparse_suffixes([text.encode()], 200))
    assert rows["repeats"] == rows["marks"] == one


def test_hits_do_not_depend_on_the_length_of_other_items():
    short, long_ = prose(30) + ". " + prose(12), prose(3000)
    w = short.replace(".", "").split()
    filler = ["zz%d" % i for i in range(4000)]
    scattered = " ".join(x for k in range(len(w) - 1) for x in (*w[k : k + 2], *filler[90 * k : 90 * k + 90]))
    held = " ".join(filler[:777]) + " " + short + " " + " ".join(filler[777:])
    texts = [scattered, held, short, " ".join(w[:-1])]
    rule = (decontaminate.SCORE, decontaminate.QUESTION, decontaminate.ANSWER)
    frequency = dict.fromkeys(decontaminate.words_of(short + " " + long_), 1)
    found = []
    for items in ([(1, short)], [(1, short), (2, long_)]):
        index = decontaminate.ItemIndex(items, frequency, 2, 100.0)
        found.append(sorted(h for h in index.hits(texts, *rule) if h[1] == 1))
    assert [h[0] for h in found[0]] == [1, 2, 3]
    assert [h[:2] for h in found[0]] == [h[:2] for h in found[1]] and np.allclose([h[2:] for h in found[0]], [h[2:] for h in found[1]])
