"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding.

Pieces are found without a regular expression. Every code point has a class; every class is a function
from the state before a character to the state after it; composed functions are numbered, so a prefix
scan over numbers with a composition table gives the state at every character of a whole batch, and a
last table says where a piece starts. The pieces are byte slices of the batch; each is merged once
and then found in a cache.

Defined results: null text counts as empty; empty text has no ids; bad UTF-8 is read with replacement
marks; documents are processed whole, whatever their length; rows are independent of each other, so
repeated rows give equal ids; other columns stay as they are.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import by_size, strings

#: Characters handled at once; a longer document is handled alone.
BATCH_CHARS = 500_000
#: Pieces kept per worker in each of two generations, and the longest piece that is kept.
CACHE_ENTRIES, CACHE_BYTES = 120_000, 64

# Classes of characters, and states after a character.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE2, QUOTE3, END = range(8)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)

# Letters and numbers that Unicode 16.0 added to 15.1.
UNICODE_16_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
UNICODE_16_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    table[kinds == "L"], table[kinds == "N"] = LETTER, NUMBER
    for ranges, kind in ((UNICODE_16_LETTERS, LETTER), (UNICODE_16_NUMBERS, NUMBER)):
        for a, b in ranges:
            table[a : b + 1] = kind
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    return table


def _step(kind: int, state: int) -> int:
    if kind == END:
        return FRESH
    if state == TWO_LEFT:
        return ONE_LEFT
    if state == ONE_LEFT:
        return FRESH
    if kind in (QUOTE2, QUOTE3):  # a contraction only where a piece starts
        joins = state in (IN_OTHER, AFTER_SPACE)
        return IN_OTHER if joins else ONE_LEFT if kind == QUOTE2 else TWO_LEFT
    return {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SPACE: AFTER_SPACE, BLANK: AFTER_BLANK}[kind]


@lru_cache(1)
def transition_functions() -> tuple[np.ndarray, np.ndarray]:
    """All compositions of the classes' functions: their values by state, and the table of their compositions (first, then)."""
    found = [tuple(_step(kind, s) for s in range(8)) for kind in range(8)]
    number = {}
    for f in found:
        number.setdefault(f, len(number))
    assert len(number) == 8, "classes with equal functions"
    todo = list(number)
    while todo:
        f = todo.pop()
        for g in found[:8]:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    values = np.array(list(number), np.uint8)
    return values, np.array([[number[tuple(g[x] for x in f)] for g in number] for f in number], np.uint16)


def prefix_compositions(functions: np.ndarray) -> np.ndarray:
    """Element i: functions 0 to i composed. Columns of blocks advance together; the blocks' totals are scanned likewise."""
    table = transition_functions()[1]
    n, m = len(functions), table.shape[1]
    flat = table.ravel()
    if n <= 64:
        out = functions.astype(np.uint16)
        for i in range(1, n):
            out[i] = flat[int(out[i - 1]) * m + int(out[i])]
        return out
    width = max(8, int(n**0.5) // 4)
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, np.uint16)
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(blocks, width).T)
    for i in range(1, width):
        grid[i] = flat[grid[i - 1].astype(np.int32) * m + grid[i]]
    before = prefix_compositions(grid[-1])[:-1].astype(np.int32) * m
    grid[:, 1:] = flat[before[None, :] + grid[:, 1:]]
    return np.ascontiguousarray(grid.T).ravel()[:n]


@lru_cache(1)
def _starts() -> np.ndarray:
    """By state before and class: 0 inside a piece, 1 a piece starts, 2 white space after white space."""
    out = np.ones((8, 8), np.uint8)
    for state, kind in ((IN_LETTERS, LETTER), (IN_NUMBERS, NUMBER), (IN_OTHER, OTHER), (IN_OTHER, QUOTE2), (IN_OTHER, QUOTE3)):
        out[state, kind] = 0
    out[AFTER_SPACE, [LETTER, NUMBER, OTHER, QUOTE2, QUOTE3]] = 0
    out[[ONE_LEFT, TWO_LEFT], :END] = 0
    out[AFTER_SPACE, [SPACE, BLANK]] = out[AFTER_BLANK, [SPACE, BLANK]] = 2
    return out.ravel()


def piece_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions where pieces start. codes: code points; ends: positions of marks that end a document, which stand alone."""
    kinds = classes()[codes]
    quotes = np.flatnonzero(codes == 0x27)
    if len(quotes):
        one, two = (codes[np.minimum(quotes + k, len(codes) - 1)] for k in (1, 2))
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kinds[quotes[short]], kinds[quotes[pair]] = QUOTE2, QUOTE3
    kinds[ends] = END
    state = transition_functions()[0][prefix_compositions(kinds), FRESH]
    before = np.empty_like(state)
    before[0], before[1:] = FRESH, state[:-1]
    found = _starts()[before.astype(np.int16) * 8 + kinds]
    solid = np.ones(len(kinds), bool)  # whether a character other than white space follows
    solid[:-1] = (kinds[1:] < SPACE) | (kinds[1:] == QUOTE2) | (kinds[1:] == QUOTE3)
    return np.flatnonzero((found == 1) | (found == 2) & solid)


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one piece: the adjacent pair of lowest rank, leftmost first, is joined until none is left.

    A heap of pairs and links between parts: in proportion to the length, but for a logarithm.
    """
    if (one := ranks.get(piece)) is not None:
        return (one,)
    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # start of the next and last part, by start
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or after[j] != end:
            continue
        alive[j], after[i] = False, end
        if end < n:
            before[end] = i
            if (r := get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (h := before[i]) >= 0 and (r := get(piece[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    return tuple(ranks[piece[i : after[i]]] for i in range(n) if alive[i])


class Pairs:
    """Which pairs of ids join to which id, for whole arrays: tables by multiplied keys, each for those the one before had no place for."""

    SLOT_BITS, NONE = 18, np.int32(1 << 30)

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        joins = {a << 32 | b: i for t, i in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None}
        keys, ids = np.array(list(joins), np.uint64), np.array(list(joins.values()), np.int32)
        self.tables = []
        while len(keys):
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED2701 * len(self.tables))
            slot = self._slot(keys, factor)
            first = np.unique(slot, return_index=True)[1]
            table, value = np.full(1 << self.SLOT_BITS, 0xFFFFFFFFFFFFFFFF, np.uint64), np.full(1 << self.SLOT_BITS, self.NONE)
            table[slot[first]], value[slot[first]] = keys[first], ids[first]
            self.tables.append((factor, table, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ids = keys[rest], ids[rest]

    def _slot(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((keys * factor) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The joined ids, NONE for pairs that do not join."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint32)
        out = np.full(keys.shape, self.NONE)
        for factor, table, value in self.tables:
            slot = self._slot(keys, factor)
            hit = table[slot] == keys
            out[hit] = value[slot[hit]]
        return out

    def merged(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of short pieces, all at once: each turn joins the best pair of every piece that has one, then all are a part shorter."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        costs = np.full((len(pieces), max(1, width - 1)), self.NONE)
        costs[:, : width - 1][inside[:, 1:]] = self.of(ids[:, :-1][inside[:, 1:]], ids[:, 1:][inside[:, 1:]])
        done, rows = [()] * len(pieces), np.arange(len(pieces))
        while True:
            at = costs.argmin(1)
            each = np.arange(len(rows))
            best = costs[each, at]
            ended = best == self.NONE
            if ended.any():
                counts = (ids[ended] >= 0).sum(1).tolist()
                for r, own, n in zip(rows[ended].tolist(), ids[ended].tolist(), counts, strict=True):
                    done[r] = tuple(own[:n])
                going = ~ended
                ids, costs, rows, at, best = ids[going], costs[going], rows[going], at[going], best[going]
                each = np.arange(len(rows))
            if not len(rows):
                return done
            place = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, place + (place > at[:, None]), 1)
            ids[each, at] = best
            place = np.arange(max(1, costs.shape[1] - 1))
            costs = np.take_along_axis(costs, np.minimum(place + (place >= at[:, None]), costs.shape[1] - 1), 1)
            if ids.shape[1] == 1:
                costs[:] = self.NONE
                continue
            left = np.flatnonzero(at > 0)
            costs[left, at[left] - 1] = self.of(ids[left, at[left] - 1], best[left])
            right = np.flatnonzero(at < ids.shape[1] - 1)
            costs[right, at[right]] = np.where(ids[right, at[right] + 1] >= 0, self.of(best[right], ids[right, at[right] + 1]), self.NONE)


@lru_cache(2)
def worker_encoder(path: str) -> Encoder:
    """The encoder of this worker: tasks that follow find the pieces of earlier ones."""
    return Encoder(read_ranks(path))


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's table: a Base64 token and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Encoder:
    """Encodes lists of texts; keeps merged pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs, self.cache, self.older = ranks, Pairs(ranks), {}, {}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def _fill(self, found: list, pieces: list[bytes]) -> None:
        """Puts ids where `found` has none: from the older generation, or merged; both are kept."""
        missing = [i for i, x in enumerate(found) if x is None]
        new = set(map(pieces.__getitem__, missing))
        own = {p: x for p in new if (x := self.older.get(p)) is not None}
        whole = [p for p in new if p not in own]
        own.update({p: (i,) for p in whole if (i := self.ranks.get(p)) is not None})
        for least, most in ((0, 8), (8, 16), (16, CACHE_BYTES)):
            if some := [p for p in whole if least < len(p) <= most and p not in own]:
                own.update(zip(some, self.pairs.merged(some), strict=True))
        own.update({p: merged(p, self.ranks) for p in whole if p not in own})
        for i in missing:
            found[i] = own[pieces[i]]
        if len(self.cache) + len(own) > CACHE_ENTRIES:
            self.cache, self.older = {}, self.cache
        self.cache.update((p, x) for p, x in own.items() if len(p) <= CACHE_BYTES)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, the byte in its text where each begins, and the number of ids of each text."""
        joined = "\n".join([*texts, ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
        data = joined.encode("utf-8", "replace")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = piece_starts(codes, ends)
        at = np.append(starts, len(codes))
        if len(data) != len(codes):
            width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
            at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))[at]
        cuts = at.tolist()
        pieces = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        found = list(map(self.cache.get, pieces))
        self._fill(found, pieces)
        per_piece = np.fromiter(map(len, found), np.int64, len(found))
        first = np.concatenate(([0], np.cumsum(per_piece)))
        ids = np.fromiter(chain.from_iterable(found), np.int32, first[-1])
        marks = np.searchsorted(starts, ends)  # the pieces that are end marks
        stop = first[marks]
        begin = np.concatenate(([0], first[marks + 1][:-1]))
        offsets = np.concatenate(([0], np.cumsum(self.lengths[ids], dtype=np.int64)))
        keep = np.ones(len(ids), bool)
        for m in range(int(per_piece[marks].max())):  # an end mark has one id or, in other vocabularies, more
            keep[first[marks][per_piece[marks] > m] + m] = False
        counts = stop - begin
        own = (offsets[:-1][keep] - np.repeat(offsets[begin], counts)).astype(np.int32)
        return ids[keep], own, counts


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("offsets", T.ArrayType(T.IntegerType(), False))])


def _list(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    item = pa.field("element", pa.int32(), False)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()), type=pa.list_(item))


def encoder(path: str):
    """An Arrow function: text to the ids of its tokens and the byte offsets where they start."""

    @F.arrow_udf(ENCODED)
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = worker_encoder(path)
        for column in columns:
            texts = strings(column)
            parts = [own.encode(texts[a:b]) for a, b in by_size([len(t) + 1 for t in texts], BATCH_CHARS)]
            ids, offsets, counts = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (zip(*parts, strict=True) if parts else ((), (), ())))
            lists = [_list(ids, counts), _list(offsets, counts)]
            yield pa.StructArray.from_arrays(lists, fields=[pa.field(f.name, x.type) for f, x in zip(ENCODED.fields, lists, strict=True)])

    return encode


class Decoder:
    """Bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.token[i] = t

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each text whose ids end at `ends`; lists of ids are made for one text at a time."""
        find, cuts = self.token.__getitem__, [0, *ends.tolist()]
        return [b"".join(map(find, ids[a:b].tolist())) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(2)
def worker_decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def decoder(path: str):
    """An Arrow function: ids to the bytes they stand for."""

    @F.arrow_udf("binary")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = worker_decoder(path)
        for column in columns:
            offsets = column.offsets.to_numpy()
            yield pa.array(own.decode(column.values.to_numpy()[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]), pa.binary())

    return decode


CHECKED = T.StructType([*ENCODED.fields, T.StructField("decoded", T.BinaryType())])


def round_tripper(path: str):
    """An Arrow function: text to ids, offsets, and the bytes that the ids decode to, by one worker."""

    @F.arrow_udf(CHECKED)
    def round_trip(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forth, back = worker_encoder(path), worker_decoder(path)
        for column in columns:
            texts, parts, decoded = strings(column), [], []
            for a, b in by_size([len(t) + 1 for t in texts], BATCH_CHARS):
                parts.append(forth.encode(texts[a:b]))
                decoded += back.decode(parts[-1][0], np.cumsum(parts[-1][2]))
            ids, offsets, counts = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (zip(*parts, strict=True) if parts else ((), (), ())))
            columns_out = [_list(ids, counts), _list(offsets, counts), pa.array(decoded, pa.binary())]
            yield pa.StructArray.from_arrays(columns_out, fields=[pa.field(f.name, x.type) for f, x in zip(CHECKED.fields, columns_out, strict=True)])

    return round_trip


def encode(df: DataFrame, ranks: str, text: str = "text", into: str = "tokens") -> DataFrame:
    """`df` with column `into`, a structure of ids and byte offsets; a column of that name is replaced."""
    return df.withColumn(into, encoder(ranks)(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, ranks: str, ids: Column | str = "tokens.ids", into: str = "decoded") -> DataFrame:
    """`df` with column `into`, the decoded bytes of `ids`; null ids give no bytes."""
    return df.withColumn(into, decoder(ranks)(F.coalesce(F.col(ids) if isinstance(ids, str) else ids, F.array().cast("array<int>"))))


def round_trip(df: DataFrame, ranks: str, text: str = "text", into: str = "tokens") -> DataFrame:
    """`df` with column `into`: ids, offsets, and the bytes decoded from the ids. As encode and decode, with half the workers."""
    return df.withColumn(into, round_tripper(ranks)(F.coalesce(F.col(text), F.lit(""))))


def digests(df: DataFrame, ranks: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by commas) and of the decoded bytes."""
    both = round_trip(df.select("doc_id", "text"), ranks).select("doc_id", "tokens")
    ids = F.col("tokens.ids")
    return both.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("tokens.decoded"), 256).alias("decoded_sha256"),
    )
