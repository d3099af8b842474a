"""SentencePiece models of the BPE kind: encoding that keeps the place of every piece in the original bytes, and decoding.

A text is normalised by the longest prefixes of the model's compiled character map (a double array), and each byte of the result
remembers the source byte that it stands for. The normalised text is cut where no piece of the vocabulary can reach across, the
parts are merged pair by pair, the best piece first, and every piece is projected to the original bytes through that memory.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces as in_pieces

#: The mark of a space, the character for bytes that are no text, types of pieces in a model file.
SPACE, REPLACEMENT = "▁", "�"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters of parts whose pieces a worker remembers (the memory is emptied when it is full), and of the longest such part.
REMEMBERED, LONGEST = 4_000_000, 64


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            value = raw[at : at + size]
            at += size
        yield key >> 3, value


class CharMap:
    """A compiled character map: a double array over bytes, whose values are places in a pool of strings that end with a zero."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest key that starts here, and what stands for it."""
        if not self.units:
            return None
        follow = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, found = follow(self.units[0]), None
        for n in range(at, len(raw)):
            node ^= raw[n]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != raw[n]:
                break
            node ^= follow(unit)
            if unit >> 8 & 1:
                found = n + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]


class PieceModel:
    """A model file of the BPE kind, given by its content."""

    def __init__(self, content: bytes):
        self.names, self.scores, self.types = [], [], []
        trainer, norm = {}, {}
        for field, value in _fields(content):
            if field == 1:
                piece = dict(_fields(value))
                self.names.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.types.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a model of the BPE kind")
        self.char_map = CharMap(norm.get(2, b""))
        self.dummy_prefix, self.one_space, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        self.suffix, self.byte_fallback = bool(trainer.get(24, 0)), bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.names, self.types, strict=True)) if t in (NORMAL, USER_DEFINED, UNUSED)}
        self.reserved = {p: i for i, (p, t) in enumerate(zip(self.names, self.types, strict=True)) if t not in (NORMAL, USER_DEFINED, UNUSED)}
        self.unknown = self.types.index(UNKNOWN)
        self.byte_ids = [self.reserved.get(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids) if i is not None}
        self.unused = {i for i, t in enumerate(self.types) if t == UNUSED}
        own = sorted((p for p, t in zip(self.names, self.types, strict=True) if t == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile("|".join(map(re.escape, own))) if own else None
        self.own_bytes = [p.encode() for p in own]
        # characters that follow each other in some piece: a text may be cut everywhere else
        self.adjacent = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.free = own == [] and SPACE in self.ids  # parts don't act on each other
        self.words = self.free and not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._forget()
        self._table()

    def _table(self) -> None:
        """All pairs of symbols that make a piece, as sorted arrays: what they make, and its place among all scores (0 is the best)."""
        symbols = dict(self.ids)
        for c in chain.from_iterable(self.ids):
            symbols.setdefault(c, len(self.names) + len(symbols))
        self.width = 2 * (len(self.names) + len(symbols)) + 1
        self.of_point = np.full(0x110000, self.width - 1)  # a symbol that no pair has
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_point[ord(c)] = i
        place = {score: k for k, score in enumerate(sorted(set(self.scores), reverse=True))}
        rows = [
            (symbols[p[:k]] * self.width + symbols[p[k:]], place[self.scores[i]], i)
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols
        ]
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
        self.pair_keys, self.pair_places, self.pair_made = np.append(table[:, 0], np.iinfo(np.int64).max), np.append(table[:, 1], 0), np.append(table[:, 2], 0)

    # -- normalisation ---------------------------------------------------------------------------------------------------------

    def _prefix(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """How many source bytes the next step takes, and what stands for them."""
        for p in self.own_bytes:
            if raw.startswith(p, at):
                return len(p), p
        found = self.char_map.longest(raw, at)
        if found:
            return found
        first = raw[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return n, raw[at : at + n]

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its UTF-8 bytes (and its end) the byte of the source that it stands for."""
        raw = text.encode("utf-8", "replace")
        space = SPACE.encode() if self.escape else b" "
        if not raw:
            return "", np.zeros(1, dtype=np.int64)
        if not (self.char_map.units or self.one_space or self.own_bytes or self.suffix):
            # nothing but spaces changes
            wide = len(space)
            source = np.repeat(np.arange(len(raw)), np.where(np.frombuffer(raw, np.uint8) == 32, wide, 1))
            lead = np.zeros(wide if self.dummy_prefix else 0, dtype=np.int64)
            body = raw.replace(b" ", space).decode()
            return (space.decode() if self.dummy_prefix else "") + body, np.concatenate([lead, source, [len(raw)]])
        at, taken = 0, []
        if self.one_space:
            while at < len(raw):
                n, shown = self._prefix(raw, at)
                if shown != b" ":
                    break
                at += n
            if at == len(raw):
                return "", np.zeros(1, dtype=np.int64)
        if self.dummy_prefix and not self.suffix:
            taken.append((at, space))
        after_space = self.one_space
        while at < len(raw):
            n, shown = self._prefix(raw, at)
            if after_space:
                shown = shown.lstrip(b" ")
            if shown:
                after_space = shown.endswith(b" ")
                taken.append((at, shown.replace(b" ", space)))
            at += n
            if not self.one_space:
                after_space = False
        out = b"".join(s for _, s in taken)
        source = np.repeat(np.array([a for a, _ in taken], dtype=np.int64), [len(s) for _, s in taken])
        end = at
        if self.one_space:
            while out.endswith(space):
                out = out[: -len(space)]
                end = int(source[len(out)])
        source = source[: len(out)]
        if self.dummy_prefix and self.suffix:
            out, source = out + space, np.concatenate([source, np.full(len(space), end)])
        return out.decode("utf-8", "replace"), np.concatenate([source, [end]])

    # -- encoding --------------------------------------------------------------------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """The pieces of a part: the pair that makes the best piece is merged first, the left one of equal ones."""
        if self.own:
            parts, fixed, at = [], [], 0
            for m in self.own.finditer(text):
                parts += [*text[at : m.start()], m.group()]
                fixed += [False] * (m.start() - at) + [True]
                at = m.end()
            parts += text[at:]
            fixed += [False] * (len(text) - at)
        else:
            parts, fixed = list(text), None
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        halves: dict[str, tuple[str, str]] = {}
        queue: list[tuple[float, int, int, int]] = []

        def meet(left: int, right: int) -> None:
            if left < 0 or right < 0 or (fixed and (fixed[left] or fixed[right])):
                return
            both = parts[left] + parts[right]
            i = self.ids.get(both)
            if i is None:
                return
            heapq.heappush(queue, (-self.scores[i], left, right, len(both)))
            if i in self.unused:
                halves[both] = parts[left], parts[right]

        for k in range(n - 1):
            meet(k, k + 1)
        while queue:
            _, left, right, size = heapq.heappop(queue)
            if not parts[left] or not parts[right] or len(parts[left]) + len(parts[right]) != size:
                continue
            parts[left] += parts[right]
            parts[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            meet(before[left], left)
            meet(left, after[left])

        def whole(piece: str) -> list[str]:
            if self.ids.get(piece) in self.unused and piece in halves:
                a, b = halves[piece]
                return whole(a) + whole(b)
            return [piece]

        return [p for part in parts if part for p in (whole(part) if self.unused else [part])]

    def _part(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a part, and how many normalised bytes each takes (of a character given by bytes the last one takes all)."""
        ids, sizes = [], []
        for p in self._merged(text):
            i = self.ids.get(p)
            raw = p.encode()
            if i is None:
                i = self.reserved.get(p, self.unknown)
            if i == self.unknown and self.byte_fallback:
                ids += [self.byte_ids[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
            elif i == self.unknown and ids and ids[-1] == self.unknown:
                sizes[-1] += len(raw)  # a run of unknown characters is one piece
            else:
                ids.append(i)
                sizes.append(len(raw))
        return ids, sizes

    def _cut(self, text: str) -> list[str]:
        """Parts that no piece can join."""
        if not self.free:
            return [text]
        rough = _WORDS.findall(text) if self.words else [text]
        if max(map(len, rough), default=0) <= LONGEST:
            return rough
        out = []
        for part in rough:
            if len(part) <= LONGEST:
                out.append(part)
                continue
            at = 0
            for k in range(1, len(part)):
                if part[k - 1 : k + 1] not in self.adjacent:
                    out.append(part[at:k])
                    at = k
            out.append(part[at:])
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the piece that each pair makes (_NONE if it makes none), and the piece."""
        key = left * self.width + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_places[at], _NONE), self.pair_made[at]

    def _forget(self) -> None:
        """The memory: of each known part its place in two long arrays, of ids and of sizes."""
        self.known: dict[str, int] = {}
        self.held = 0
        self.begin, self.count, self.pool_ids, self.pool_sizes = (np.zeros(0, dtype=np.int64) for _ in range(4))

    def _learn(self, parts: list[str]) -> None:
        """Remember the pieces of these parts."""
        alone = not self.free or bool(self.unused)
        short = [] if alone else [p for p in parts if len(p) <= LONGEST]
        rest = parts if alone else [p for p in parts if len(p) > LONGEST]
        counts, ids, sizes = self._merge_together(short)
        each = [self._part(p) for p in rest]
        counts = np.concatenate([counts, [len(x[0]) for x in each]]).astype(np.int64)
        begin = len(self.pool_ids) + np.cumsum(counts) - counts
        self.pool_ids = np.concatenate([self.pool_ids, ids, *(x[0] for x in each)]).astype(np.int32)
        self.pool_sizes = np.concatenate([self.pool_sizes, sizes, *(x[1] for x in each)]).astype(np.int32)
        self.known.update(zip(short + rest, range(len(self.begin), len(self.begin) + len(counts)), strict=True))
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, counts])
        self.held += sum(map(len, parts))

    def _merge_together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces of each part, ids, sizes), as _part, for all parts as one ragged array of symbols: in each round every part merges
        its best pair, the left one of equal ones."""
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sym, size = self.of_point[points], 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
        part = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        at_byte = np.cumsum(size) - size
        place, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        inside = np.flatnonzero(part[:-1] == part[1:])
        place[inside], made[inside] = self._pairs(sym[inside], sym[inside + 1])
        done = [(part[:0], sym[:0], size[:0], at_byte[:0])]
        while len(sym):
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            best = np.minimum.reduceat(place << 32 | np.arange(len(sym)), starts)
            going = best >> 32 != _NONE
            keep = np.repeat(going, np.diff(np.append(starts, len(sym))))
            if not going.all():
                done.append((part[~keep], sym[~keep], size[~keep], at_byte[~keep]))
            at = best[going] & 0xFFFFFFFF
            sym[at] = made[at]
            size[at] += size[at + 1]
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1  # where the merged symbols are once the others have gone
            sym, size, part, at_byte, place, made = (x[keep] for x in (sym, size, part, at_byte, place, made))
            place[at] = _NONE
            left = np.concatenate([at[at > 0] - 1, at])
            left = left[left + 1 < len(sym)]
            left = left[part[left] == part[left + 1]]
            place[left], made[left] = self._pairs(sym[left], sym[left + 1])
        part, sym, size, at_byte = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(part, kind="stable")
        part, sym, size, at_byte = part[order], sym[order], size[order], at_byte[order]
        odd = sym >= len(self.names)  # characters that are no piece
        if odd.any():
            if self.byte_fallback:
                raw = np.frombuffer(whole.encode(), np.uint8)
                times = np.where(odd, size, 1)
                last = np.cumsum(times) - 1
                first = np.repeat(last - times + 1, times)
                byte = np.repeat(at_byte, times) + np.arange(len(first)) - first
                spread = np.repeat(odd, times)
                ids = np.repeat(sym, times)
                ids[spread] = np.array(self.byte_ids)[raw[byte[spread]]]
                sizes = np.zeros(len(first), dtype=np.int64)
                sizes[last] = size
                part, sym, size = np.repeat(part, times), ids, sizes
            else:
                sym = np.where(odd, self.unknown, sym)
        return np.bincount(part, minlength=len(parts)), sym, size

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends): the pieces of a text and the bytes of its UTF-8 form that each stands for."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """encode() of each text; parts that are new to the memory are merged together."""
        normal = [self.normalize(t) for t in texts]
        cut = [self._cut(norm) for norm, _ in normal]
        if self.held > REMEMBERED:
            self._forget()
        self._learn(list(set(chain.from_iterable(cut)).difference(self.known)))
        per_text = np.fromiter(map(len, cut), np.int64, len(cut))
        known = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, per_text.sum())
        counts = self.count[known]
        upto = np.cumsum(counts)
        at = np.repeat(self.begin[known] - (upto - counts), counts) + np.arange(upto[-1] if len(upto) else 0)
        all_ids, all_ends = self.pool_ids[at], np.cumsum(self.pool_sizes[at], dtype=np.int64)
        bounds = np.append(0, np.append(0, upto)[np.cumsum(per_text)]).tolist()
        out, base = [], 0
        for (_, source), begin, end in zip(normal, bounds[:-1], bounds[1:], strict=True):
            ids, ends = all_ids[begin:end], all_ends[begin:end] - base
            base = int(all_ends[end - 1]) if end else 0
            if not self.byte_fallback and len(ids) > 1:  # a run of unknown characters is one piece
                last = np.append((ids[1:] != self.unknown) | (ids[:-1] != self.unknown), True)
                ids, ends = ids[last], ends[last]
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            out.append((ids, source[starts].astype(np.int32), source[ends].astype(np.int32)))
        return out

    # -- decoding --------------------------------------------------------------------------------------------------------------

    @property
    def shown(self) -> list[str]:
        """The text of each piece inside a text; control pieces have none, bytes are put together first."""
        if not hasattr(self, "_shown"):
            self._shown = ["" if t == CONTROL else self.unknown_text if t == UNKNOWN else p.replace(SPACE, " ") for p, t in zip(self.names, self.types, strict=True)]
        return self._shown

    def decode(self, ids: list[int]) -> str:
        """The text of pieces: the space that the beginning was given is taken off, and bytes that are no text become U+FFFD."""
        out, at, begun = [], 0, False
        shown, byte_of, n = self.shown, self.byte_of, len(ids)
        while at < n and not begun:  # the beginning, up to the first piece with a text
            i = ids[at]
            if i in byte_of:
                break
            text = shown[i]
            if self.types[i] not in (CONTROL, UNKNOWN) and not self.suffix and (self.dummy_prefix or self.one_space) and text.startswith(" ") and self.names[i].startswith(SPACE):
                text = text[1:]
                begun = not self.one_space
            out.append(text)
            begun = begun or bool(text)
            at += 1
        while at < n:
            if ids[at] not in byte_of:
                out.append(shown[ids[at]])
                at += 1
                continue
            run = bytearray()
            while at < n and ids[at] in byte_of:
                run.append(byte_of[ids[at]])
                at += 1
            out.append(_text_of(bytes(run)))
        return "".join(out)


_NONE = 2**30  # above every place, and its product with 2**32 is a long


_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _text_of(run: bytes) -> str:
    """Bytes as text, with one U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(REPLACEMENT)
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def model_of(content: bytes) -> PieceModel:
    """Built once in each Python worker."""
    return PieceModel(content)


def encode_pieces(docs: DataFrame, model: str, *, text_col: str = "text", out_col: str = "pieces") -> DataFrame:
    """docs with a struct out_col: ids, starts and ends (arrays of int: bytes of the text's UTF-8 form, end exclusive), decoded.

    model is the path of a SentencePiece model of the BPE kind; the driver reads it and sends its content (the size of a
    vocabulary) to the executors. The ids are those of the sentencepiece library without begin or end ids and without sampling;
    decoded is what its decode gives for them. Of a character that is given byte by byte the last byte has the span. Null texts count as
    empty (no pieces, the empty text). Whole texts are encoded, however long; all rows and other columns stay, a column with the
    name of out_col is replaced; an empty table gives an empty table.
    """
    with open(model, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("ids array<int>, starts array<int>, ends array<int>, decoded string")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = model_of(content.value)
        for texts in in_pieces(batches):
            rows = pieces.encode_all([t or "" for t in texts])
            yield pd.DataFrame({"ids": [r[0] for r in rows], "starts": [r[1] for r in rows], "ends": [r[2] for r in rows], "decoded": [pieces.decode(r[0].tolist()) for r in rows]})

    return docs.withColumn(out_col, encoded(F.col(text_col)))


def piece_digest(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256.

    Rows are those of encode_pieces; nulls, repeated rows, empty tables and other columns as there.
    """
    rows = encode_pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    ids = F.array_join(F.col("pieces.ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("pieces.ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("pieces.decoded"), 256).alias("decoded_sha256"))
