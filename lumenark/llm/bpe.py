"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding with offsets.

Pre-tokens are found without a regular expression. Each code point gets a class (letter, number, other, and white space
by what follows it; an apostrophe by whether a contraction follows). A table says for each class how it maps the state
of a scan to the next state. Such maps compose, and composition is associative, so the state before every character is
found by a blocked scan: maps of whole blocks are composed side by side, the block maps are chained, and the states
inside all blocks follow in step. A pre-token starts where the state and class say so.

The slices feed a cache from pre-token to ids; on a miss the lowest-ranked adjacent pair is merged until none is left.
Ids keep the byte offset of each token, so ids decode to bytes and to slices of the text.

Defined results: null texts are empty and have no ids; lone surrogates cannot occur in UTF-8 columns; any other text
round-trips exactly, whatever its length; of equal ranks of adjacent pairs the leftmost merges first; repeated rows are each
returned; an empty table gives an empty result; columns beyond the named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import blocks

#: Classes of code points, before context.
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Symbols of the scan: the four kinds of context are resolved before it.
OTHER, LETTER, NUMBER, RUN_SPACE, LAST_SPACE, LAST_BLANK, SHORT_CUT, LONG_CUT, EDGE = range(9)
#: States: at rest, in letters, in numbers, in others, in white space, after a blank, with one or two letters of a contraction to go.
REST, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, AFTER_BLANK, ONE_MORE, TWO_MORE = range(8)
CACHE_ENTRIES = 300_000
_SCAN = 128


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """For each symbol and state: the next state, and whether a pre-token starts at the character."""
    to, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        to[symbol] = state
        starts[symbol, [state, AFTER_BLANK]] = False
    to[LETTER, ONE_MORE], to[LETTER, TWO_MORE] = REST, ONE_MORE
    starts[LETTER, [ONE_MORE, TWO_MORE]] = False
    to[RUN_SPACE] = IN_SPACE
    starts[RUN_SPACE, IN_SPACE] = False
    to[LAST_SPACE], to[LAST_BLANK], to[EDGE] = REST, AFTER_BLANK, REST
    to[SHORT_CUT], to[LONG_CUT] = ONE_MORE, TWO_MORE
    for cut in (SHORT_CUT, LONG_CUT):  # an apostrophe within others, or after a blank, is one of them
        to[cut, [IN_OTHERS, AFTER_BLANK]] = IN_OTHERS
        starts[cut, [IN_OTHERS, AFTER_BLANK]] = False
    starts[EDGE] = False
    return to, starts


NEXT, STARTS = _machine()
_classes: list[np.ndarray] = []


def code_point_classes() -> np.ndarray:
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            kind = unicodedata.category(chr(i))[0]
            if kind == "L":
                table[i] = _LETTER
            elif kind == "N":
                table[i] = _NUMBER
            elif kind == "Z":
                table[i] = _SPACE
        table[[*range(0x09, 0x0E), 0x85]] = _SPACE
        _classes.append(table)
    return _classes[0]


def scan(symbols: np.ndarray, block: int = _SCAN) -> np.ndarray:
    """The state before each symbol, from rest, by composing the symbols' maps."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.uint8)
    rows = -(-n // block)
    grid = np.full(rows * block, EDGE, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    flat = NEXT.reshape(-1)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))  # the map of each block, composed symbol by symbol
    for row in grid:
        whole = flat[(row.astype(np.uint16) << 3)[:, None] + whole]
    state, entry = REST, np.empty(rows, np.uint8)
    for i, mapped in enumerate(whole.tolist()):  # chained
        entry[i] = state
        state = mapped[state]
    out = np.empty((block, rows), np.uint8)
    for j, row in enumerate(grid):
        out[j] = entry
        entry = flat[(row.astype(np.uint16) << 3) + entry]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def pre_token_starts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens start; ``edges`` marks separators between texts, which belong to none."""
    kinds = code_point_classes()[points]
    n = len(points)
    symbols = np.array([OTHER, LETTER, NUMBER, RUN_SPACE], np.uint8)[kinds]
    solid = np.zeros(n, bool)  # a character other than white space follows, in the same text
    solid[:-1] = (kinds[1:] != _SPACE) & ~edges[1:]
    last = (kinds == _SPACE) & solid
    symbols[last] = np.where(points[last] == 0x20, LAST_BLANK, LAST_SPACE)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        follow = np.concatenate((points, np.zeros(2, points.dtype)))
        a, b = follow[at + 1], follow[at + 2]
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbols[at[short]], symbols[at[long]] = SHORT_CUT, LONG_CUT
    symbols[edges] = EDGE
    return np.flatnonzero(STARTS.reshape(-1)[(symbols.astype(np.uint16) << 3) + scan(symbols)])


class Encoder:
    """Ids of pre-tokens by merge ranks, with a bounded cache."""

    def __init__(self, ranks: dict[bytes, int], entries: int = CACHE_ENTRIES):
        self.ranks, self.entries = ranks, entries
        self.pieces = {i: b for b, i in ranks.items()}
        self.names = {i: str(i) for i in self.pieces}
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > 400:
            return self._merge_long(piece)
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        scores = [ranks.get(piece[i : i + 2], 1 << 30) for i in range(len(piece) - 1)]
        while scores:
            low = min(scores)
            if low == 1 << 30:
                break
            i = scores.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges with a heap and links, for pre-tokens of any length."""
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(piece)
        ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            j = ends[i] if alive[i] else n
            if j >= n or ends[j] != end:
                continue
            alive[j] = False
            ends[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : ends[end]])) is not None:
                    heappush(heap, (r, i, ends[end]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heappush(heap, (r, h, end))
        return tuple(ranks[piece[i : ends[i]]] for i in range(n) if alive[i])

    def __call__(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token; of two generations of entries the older one goes when full."""
        got = self.cache.get(piece)
        if got is None:
            got = self.older.pop(piece, None)
            if got is None:
                got = self.merge(piece)
            if len(piece) <= 64:
                if len(self.cache) >= self.entries // 2:
                    self.cache, self.older = {}, self.cache
                self.cache[piece] = got
        return got

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 of the token and its rank, a line each."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pre_tokens(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """``(first row, pre-tokens of each text)`` of blocks of rows."""
    for lo, hi, buf, offsets in blocks(texts):
        lead = (buf & 0xC0) != 0x80  # bytes that start a code point
        n_points = np.concatenate(([0], np.cumsum(lead)))
        data = buf.tobytes()
        decoded = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        # one separator behind each text
        ends = n_points[offsets[1:]]
        points = np.insert(decoded, ends, 0)
        edges = np.zeros(len(points), bool)
        edges[ends + np.arange(hi - lo)] = True
        starts = pre_token_starts(points, edges)
        text_of = np.cumsum(edges)[starts] if len(starts) else np.zeros(0, np.int64)  # separators before it
        byte_at = np.flatnonzero(lead)[starts - text_of] if len(starts) else np.zeros(0, np.int64)
        bounds = [*byte_at.tolist(), len(data)]
        first = np.searchsorted(text_of, np.arange(hi - lo + 1)).tolist()
        out = []
        for i in range(hi - lo):
            own = bounds[first[i] : first[i + 1]]
            out.append([data[a:b] for a, b in zip(own, [*own[1:], int(offsets[i + 1])], strict=True)] if own else [])
        yield lo, out


def encode_batch(texts: pa.Array, encoder: Encoder) -> Iterator[list[int]]:
    for _, rows in pre_tokens(texts):
        for own in rows:
            yield [i for piece in own for i in encoder(piece)]


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(load_ranks(path))
    return _encoders[path]


def encode(documents: DataFrame, path: str) -> DataFrame:
    """ids and the byte offset of each token for each row of ``documents`` (doc_id, text); ``path``: a file that every worker has."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = list(encode_batch(part.column(1), encoder))
                offsets = [np.concatenate(([0], np.cumsum([len(encoder.pieces[i]) for i in x])))[:-1].tolist() if x else [] for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64()))], names=["doc_id", "ids", "offsets"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, offsets array<bigint>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The bytes of each row of ``encoded`` (doc_id, ids)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")


def round_trip(documents: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Digests of the ids of each row of ``documents`` (doc_id, text), and of the bytes they decode to; the ids on demand."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in batches:
            at = 0
            for _, rows in pre_tokens(batch.column(1)):
                counts, ids_sha, bytes_sha, kept = [], [], [], []
                for own in rows:
                    flat = [i for piece in own for i in encoder(piece)]
                    counts.append(len(flat))
                    ids_sha.append(hashlib.sha256(",".join(map(encoder.names.__getitem__, flat)).encode()).hexdigest())
                    bytes_sha.append(hashlib.sha256(encoder.decode(flat)).hexdigest())
                    if with_ids:
                        kept.append(flat)
                columns = [batch.column(0).slice(at, len(rows)), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string()), pa.array(kept, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns[: 4 + with_ids], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])
                at += len(rows)

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
