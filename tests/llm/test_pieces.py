"""Pieces, spans and decoding against the sentencepiece library."""

import hashlib
import random
import struct

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from shelfscope.llm import pieces  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
CONTENT = open(PATH, "rb").read()


def double_array(mapping):
    """A compiled character map for the given strings, as the library reads it."""
    pool, at = b"", {}
    for value in sorted(set(mapping.values())):
        at[value] = len(pool)
        pool += value.encode() + b"\0"
    tree = {}
    for key, value in mapping.items():
        node = tree
        for b in key.encode():
            node = node.setdefault(b, {})
        node[-1] = at[value]
    units, used, todo = {0: 0}, {0}, [(0, 0, tree)]
    while todo:
        where, label, node = todo.pop()
        places = [0 if c == -1 else c for c in node]
        base = next(b for b in range(1, 1 << 20) if all(b ^ c not in used for c in places))
        used |= {base ^ c for c in places}
        units[where] = label | (where ^ base) << 10 | (256 if -1 in node else 0)
        for c, child in node.items():
            if c == -1:
                units[base] = child | 1 << 31
            else:
                todo.append((base ^ c, c, child))
    size = -(-(max(units) + 257) // 256) * 256
    raw = b"".join(struct.pack("<I", units.get(i, 0)) for i in range(size))
    return struct.pack("<I", len(raw)) + raw + pool


MAP = {"ﬁ": "fi", "é": "é", "e": "e", "①": "1", "Ａ": "A", "­": "", "　": " ", "\t": " ", "abc": "x y ", "ab": "q"}


def library(content):
    return sentencepiece.SentencePieceProcessor(model_proto=content)


def changed(**kinds):
    """The model with another normaliser, or with some pieces of another type."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.ParseFromString(CONTENT)
    for name, value in kinds.items():
        if name == "types":
            for piece in m.pieces:
                piece.type = value.get(piece.piece, piece.type)
        elif name == "byte_fallback":
            m.trainer_spec.byte_fallback = value
            kept = [p for p in m.pieces if p.type != 6]
            del m.pieces[:]
            m.pieces.extend(kept)
        else:
            setattr(m.normalizer_spec, name, value)
    return m.SerializeToString()


def texts(r, n):
    chars = "  \n\tabcdeéﬁé①Ａ­　▁中文字ｱ🙂\U0010ffff\x00.,'"
    words = ["the", "Hello", "http://x.y/z?q=1", "abc", "aaaaaaaaaaaaaaaaaaaaaaaa", "▁▁", "</s>", "<s>", "<0x41>", "<unk>", "naïve", "中文"]
    for _ in range(n):
        if r.random() < 0.5:
            yield "".join(r.choices(chars, k=r.randint(0, 60)))
        else:
            yield r.choice(["", " ", "  "]) + r.choice([" ", "", "  ", "\n"]).join(r.choices(words, k=r.randint(0, 25)))


def spans_of(lib, text):
    """The library's ids and spans, in bytes."""
    found = lib.encode(text, return_type="proto").pieces
    return [p.id for p in found], [p.begin for p in found], [p.end for p in found]


def same(content, cases):
    ours, lib = pieces.PieceModel(content), library(content)
    for t in cases:
        ids, starts, ends = (x.tolist() for x in ours.encode(t))
        want = lib.encode(t)
        assert ids == want, t
        assert ours.decode(ids) == lib.decode(want), t
        assert (ids, starts, ends) == spans_of(lib, t), t


def test_equals_the_library():
    r = random.Random(1)
    same(CONTENT, list(texts(r, 1500)) + ["", " ", "▁", "a" * 3000, "ab" * 2000, "x" * 70 + "  " * 50, " " * 200])


def test_every_character():
    ours, lib = pieces.PieceModel(CONTENT), library(CONTENT)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 4096):
        t = "a".join(every[at : at + 4096])
        ids = ours.encode(t)[0].tolist()
        assert ids == lib.encode(t) and ours.decode(ids) == lib.decode(ids)


def test_decoding_any_ids():
    ours, lib, r = pieces.PieceModel(CONTENT), library(CONTENT), random.Random(4)
    for _ in range(3000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.choice([0, 1, 2, 29871, 259, 260])]) for _ in range(r.randint(0, 8))]
        assert ours.decode(ids) == lib.decode(ids), ids


@pytest.mark.parametrize(
    "kinds",
    [
        {"precompiled_charsmap": double_array(MAP)},
        {"precompiled_charsmap": double_array(MAP), "remove_extra_whitespaces": True},
        {"remove_extra_whitespaces": True, "add_dummy_prefix": False},
        {"add_dummy_prefix": False},
        {"types": {"the": 4, "▁Hello": 4, "ab": 4}},
        {"types": {"the": 5, "▁the": 5, "aaaa": 5, "Hello": 5}},
        {"byte_fallback": False},
    ],
    ids=["map", "map and spaces", "spaces", "no prefix", "own pieces", "unused pieces", "unknown"],
)
def test_other_models(kinds):
    same(changed(**kinds), list(texts(random.Random(7), 500)) + ["", "   ", "abcab ", "é" * 30])


def test_spans_cover_the_text():
    ours = pieces.PieceModel(CONTENT)
    for t in texts(random.Random(9), 300):
        _, starts, ends = ours.encode(t)
        raw = t.encode()
        assert b"".join(raw[a:b] for a, b in zip(starts, ends, strict=True)) == raw


def test_digest_and_odd_rows(spark):
    lib, r = library(CONTENT), random.Random(3)
    rows = list(enumerate(texts(r, 60))) + [(100, None), (101, ""), (None, "two words"), (None, None), (5, "again"), (5, "again"), (102, "long text " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pieces int, ids string")
    got = pieces.piece_digest(docs, PATH)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(e := lib.encode(t or "")), sha(",".join(map(str, e))), sha(lib.decode(e))) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert pieces.piece_digest(docs.limit(0), PATH).count() == 0
    kept = pieces.encode_pieces(docs.where("text = 'again'"), PATH)
    assert kept.columns == ["doc_id", "text", "pieces", "ids"] and kept.first().pieces.decoded == "again"
