"""Byte-level BPE encoding and decoding.

Where a pre-token starts is found without a regular expression.  Each code point gets a class by
table; with what follows it (white space or not, the rest of a contraction) that is one of nine
symbols of an automaton of eight states.  A symbol is a function from states to states, and such functions
compose associatively: blocks of BLOCK symbols are composed side by side, the blocks' functions
are scanned by doubling, and then every block is walked from its start state, again side by side.  The
slices go through a cache of pair merging, and their byte offsets stay for decoding.

Defined cases: null and empty texts have no tokens; bytes that aren't UTF-8 are read as U+FFFD;
a null doc_id stays null; repeated rows come out repeated; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_out, plain

TEXT_BYTES, BLOCK, CACHE = 1 << 19, 256, 200_000
#: White space as Unicode has it; what may follow an apostrophe in a contraction.
SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SHORT, LONG = "stmd", ("re", "ve", "ll")
LETTER, NUMBER, OTHER, SPACE = range(4)
S_L, S_N, S_O, S_A2, S_A3, S_IN, S_SP, S_WS, S_END = range(9)
START, IN_L, IN_N, IN_O, IN_W, IN_SP, C1, C2 = range(8)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, by the Unicode tables of the tokenizer library itself (Python's
    are of another Unicode version), asked once for all code points."""
    import tiktoken

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = bytes(tiktoken.Encoding("classes", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    table[list(SPACES)] = SPACE
    return table


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """By symbol * 8 + state: the next state, and whether a token starts at the symbol."""
    to, new = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, state in ((S_L, IN_L), (S_N, IN_N), (S_O, IN_O)):
        to[symbol] = state
        new[symbol, [state, IN_SP]] = False
    to[S_A2], to[S_A3] = C1, C2
    for symbol in (S_A2, S_A3):
        to[symbol, [IN_O, IN_SP]] = IN_O
        new[symbol, [IN_O, IN_SP]] = False
    to[:S_IN, C1], to[:S_IN, C2], new[:S_IN, C1], new[:S_IN, C2] = START, C1, False, False
    to[S_IN], new[S_IN, IN_W] = IN_W, False
    to[S_SP], to[S_WS], to[S_END] = IN_SP, START, START
    new[S_END] = False
    return to.ravel(), new.ravel()


def symbols(points: np.ndarray) -> np.ndarray:
    """points: code points of texts, each text followed by one 0x110000."""
    real = points < 0x110000
    kind = np.full(len(points) + 3, 9, np.uint8)
    kind[: len(points)][real] = classes()[points[real]]
    cp = np.zeros(len(points) + 3, np.uint32)
    cp[: len(points)] = points
    k, after = kind[: len(points)], kind[1 : len(points) + 1]
    out = np.full(len(points), S_END, np.uint8)
    out[k == LETTER], out[k == NUMBER], out[k == OTHER] = S_L, S_N, S_O
    white, last = k == SPACE, after < SPACE
    out[white] = S_IN
    out[white & last] = S_WS
    out[white & last & (points == 32)] = S_SP
    at = np.flatnonzero(points == 39)
    one, two = cp[at + 1], cp[at + 2]
    out[at[np.isin(one, [ord(c) for c in SHORT])]] = S_A2
    for pair in LONG:
        out[at[(one == ord(pair[0])) & (two == ord(pair[1]))]] = S_A3
    return out


def starts(points: np.ndarray) -> np.ndarray:
    """Where tokens start, in code points."""
    to, new = automaton()
    sym = symbols(points).astype(np.intp) * 8
    n = len(sym)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, S_END * 8, np.intp)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    own = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        own = to[column[:, None] + own]
    step = 1
    while step < rows:
        later = own.copy()
        later[step:] = np.take_along_axis(own[step:], own[:-step].astype(np.intp), 1)
        own, step = later, 2 * step
    state = np.full(rows, START, np.uint8)
    state[1:] = own[:-1, START]
    flags = np.empty((BLOCK, rows), bool)
    for j, column in enumerate(grid):
        at = column + state
        flags[j] = new[at]
        state = to[at]
    return np.flatnonzero(flags.T.ravel()[:n])


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one slice: the adjacent pair of lowest rank merges first, the leftmost of equals; a heap keeps long slices near linear."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Bpe:
    """ranks: bytes to rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.words = ranks, {v: k for k, v in ranks.items()}
        self.cache: dict[bytes, bytes] = {}

    def slices(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text its slices' first and last byte offsets."""
        raw = "\0".join(texts) + "\0"
        points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        points[ends] = 0x110000
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        width[ends] = 0
        offset = np.concatenate([[0], np.cumsum(width)])
        at = starts(points)
        cuts = np.searchsorted(at, np.concatenate([[0], ends]))
        out = []
        for i in range(len(texts)):
            base = offset[0 if not i else ends[i - 1]]
            own = (offset[at[cuts[i] : cuts[i + 1]]] - base).tolist()
            out.append(list(zip(own, [*own[1:], int(offset[ends[i]] - base)], strict=True)) if own else [])
        return out

    def encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
        """For each text its ids as little-endian 32-bit integers, and its slices."""
        cache = self.cache
        texts = [t.decode("utf-8", "replace") for t in texts]
        for text, cuts in zip(texts, self.slices(texts), strict=True):
            raw, ids = text.encode(), []
            if len(cache) > CACHE:
                cache.clear()
            for a, b in cuts:
                piece = raw[a:b]
                got = cache.get(piece)
                if got is None:
                    got = np.array(merged(piece, self.ranks), "<u4").tobytes()
                    if len(piece) <= 64:
                        cache[piece] = got
                ids.append(got)
            yield b"".join(ids), cuts

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def tokenizer(path: str) -> Bpe:
    return Bpe(load_ranks(path))


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_slices. path: a file of ranks that every executor has."""

    def run(batches):
        own = tokenizer(path)
        for ids, texts in chunks(batches, TEXT_BYTES):
            rows = [(len(e) // 4, hashlib.sha256(e).hexdigest(), hashlib.sha256(own.decode(e)).hexdigest(), len(s)) for e, s in own.encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_slices"])

        own.cache.clear()  # the worker may go on to other tasks

    out = plain(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_slices long")
    return out.withColumn("doc_id", id_out())


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int32)))


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), offsets (array of int: each slice's first byte): what training reads.  Ids are decoded in the same pass; it fails if they don't give the text."""

    def run(batches):
        own = tokenizer(path)
        for ids, texts in chunks(batches, TEXT_BYTES):
            done = list(own.encode(texts))
            for i, t, (e, _) in zip(ids.tolist(), texts, done, strict=True):
                if (back := own.decode(e)) != t and back != t.decode("utf-8", "replace").encode():
                    raise ValueError(f"the ids of document {i} don't decode to its text")
            lists = [lists_of([np.frombuffer(e, "<i4") for e, _ in done]), lists_of([np.fromiter((a for a, _ in s), np.int32, len(s)) for _, s in done])]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *lists], names=["doc_id", "ids", "offsets"])
        own.cache.clear()

    return plain(docs).mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>").withColumn("doc_id", id_out())


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text, from doc_id and ids."""

    def run(batches):
        own = tokenizer(path)
        for batch in batches:
            texts = [own.decode(np.asarray(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
