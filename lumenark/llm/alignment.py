"""Alignment of two tokenizers over the same texts: a byte-level BPE (A) and a piece BPE with byte fallback (B).

Both tokenizers run over the whole text first. Where a token of A and one of B begin with a blank at the same byte, the
tokens before them end together: these verified ends are anchors, which cut the token sequences into windows of about a
word. A window is known by its two tuples of ids; its alignment (groups between shared ends, and links of tokens that end
together) is found once and remembered, in a bounded cache. A text is aligned only if the bytes of both sequences are the
blank and the text.

How often a link's pair of ids is linked in all texts takes a join of pairs. It is made by blocks of texts: a task keeps,
for a block of about four megabytes, the block's distinct pairs with their counts, and the documents' pairs as numbers into
them. So the shuffles move a row for each distinct pair of a block, not for each token, and the most frequent pair has a row
a block. The counts come back to the block as one list, as long as its distinct pairs.

Defined results: null and empty texts, and those whose tokens do not give back the blank and the text, have no tokens,
zeros and an empty digest; special tokens' strings in texts are plain text; texts of any length are tokenised whole;
among pairs of one B id with equal counts all are best; repeated rows count as often as they are there, and each is
returned; null ids are ids like others; an empty table gives an empty result; columns beyond the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BLOCK_BYTES = 4 << 20
#: Bound of the cache of windows, and tokens of those that are kept.
CACHE_ENTRIES, CACHED_TOKENS = 300_000, 48
#: Longer texts are cut into pre-tokens without a regular expression, which may not hold endless runs of white space.
LONG_TEXT = 100_000
_SHIFT = 32


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Tokenizes by both vocabularies and aligns; ``path_a``: a tokenizers JSON file, ``path_b``: a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        from .bpe import Encoder

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in entry): i for entry, i in spec["model"]["vocab"].items() if entry not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level pre-tokens of the file
        self.fast, self.slow = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), Encoder(ranks, 20_000)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes_a[i] = piece
        self.bytes_b = [self._bytes_of(self.pieces.id_to_piece(i), self.pieces.is_byte(i)) for i in range(self.pieces.get_piece_size())]
        self.size_a, self.size_b = ([len(x) for x in t] for t in (self.bytes_a, self.bytes_b))
        self.len_a, self.len_b = np.array(self.size_a, np.int64), np.array(self.size_b, np.int64)
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.marked_a, self.marked_b = (np.array([x[:1] == b" " for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.kind = np.uint16 if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else np.uint32
        self.cache: dict[tuple[bytes, bytes], tuple[str, tuple[int, ...]]] = {}

    @staticmethod
    def _bytes_of(piece: str, is_byte: bool) -> bytes:
        return bytes([int(piece[3:-1], 16)]) if is_byte else piece.replace("▁", " ").encode()

    def packed(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of each text by A and by B; None where there are none."""
        from .bpe import encode_batch

        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True):
            if not text:
                yield None
                continue
            whole = " " + text
            a = self.fast.encode_ordinary(whole) if len(text) <= LONG_TEXT else next(encode_batch(pa.array([whole]), self.slow))
            raw = whole.encode()
            ok = b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
            yield (np.array(a, self.kind), np.array(b, self.kind)) if ok else None

    def tokens(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """The same as lists."""
        for found in self.packed(texts):
            yield found and (found[0].tolist(), found[1].tolist())

    def anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the first A and B tokens of each window, and the numbers of all tokens."""
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        # a token begins where the one before it ends; the first begins a window anyway
        shared = np.intersect1d(ends_a[:-1][self.marked_a[a[1:]]], ends_b[:-1][self.marked_b[b[1:]]], assume_unique=True)
        return (np.concatenate(([0], np.searchsorted(ends, shared) + 1, [len(ends)])) for ends in (ends_a, ends_b))

    def windows(self, a: list[int], b: list[int]) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
        """Tuples of ids between anchors."""
        at_a, at_b = self.anchors(np.array(a), np.array(b))
        for i, k, j, m in zip(at_a, at_a[1:], at_b, at_b[1:], strict=False):
            yield tuple(a[i:k]), tuple(b[j:m])

    def aligned(self, a: np.ndarray, b: np.ndarray) -> list[tuple[str, tuple[int, ...]]]:
        """What ``window`` gives for each window of a text, in its order; id tuples are looked up as packed numbers, all in one go."""
        at_a, at_b = self.anchors(a, b)
        keys = []
        for ids, at in ((a, at_a), (b, at_b)):
            data, bounds = ids.tobytes(), (at * ids.itemsize).tolist()
            keys.append([data[i:k] for i, k in zip(bounds, bounds[1:], strict=False)])
        found = list(map(self.cache.get, zip(*keys, strict=True)))
        if None in found:
            all_a, all_b, first_a, first_b = a.tolist(), b.tolist(), at_a.tolist(), at_b.tolist()
            for n, x in enumerate(found):
                if x is None:
                    packed = keys[0][n], keys[1][n]
                    found[n] = self.cache.get(packed) or self._found(packed, all_a[first_a[n] : first_a[n + 1]], all_b[first_b[n] : first_b[n + 1]])
        return found

    def groups(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """Shortest runs of A and B tokens that end together; ``a`` and ``b`` do."""
        if len(a) == 1 or len(b) == 1:
            return [(a, b)]
        out, i, j, k, m = [], 0, 0, 0, 0
        end_a = end_b = 0
        size_a, size_b = self.size_a, self.size_b
        while k < len(a) or m < len(b):
            if end_a <= end_b and k < len(a):
                end_a += size_a[a[k]]
                k += 1
            else:
                end_b += size_b[b[m]]
                m += 1
            if end_a == end_b:
                out.append((a[i:k], b[j:m]))
                i, j = k, m
        return out

    def _found(self, packed: tuple[bytes, bytes], a: Sequence[int], b: Sequence[int]) -> tuple[str, tuple[int, ...]]:
        """The groups of a window as text, and the pair of ids of each link; remembered unless the window is long."""
        name, size_a, size_b = self.names, self.size_a, self.size_b
        texts, links = [], []
        ids_a, ids_b, end_a, end_b, m, y = [], [], 0, 0, 0, 0
        for x in a:
            end_a += size_a[x]
            ids_a.append(name[x])
            while end_b < end_a:
                y = b[m]
                m += 1
                end_b += size_b[y]
                ids_b.append(name[y])
            if end_a == end_b:
                texts.append(",".join(ids_a) + "|" + ",".join(ids_b))
                links.append(x << _SHIFT | y)
                ids_a, ids_b = [], []
        got = ";".join(texts), tuple(links)
        if len(a) + len(b) <= CACHED_TOKENS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[packed] = got
        return got

    def window(self, key: tuple[tuple[int, ...], tuple[int, ...]]) -> tuple[str, tuple[int, ...]]:
        packed = tuple(np.array(ids, self.kind).tobytes() for ids in key)
        return self.cache.get(packed) or self._found(packed, *key)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """``(first row, texts)`` of runs of rows of about ``BLOCK_BYTES``."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = (np.cumsum(sizes) - sizes) // BLOCK_BYTES
    bounds = [*np.flatnonzero(np.diff(number, prepend=-1)).tolist(), len(sizes)]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        yield lo, [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]


_DOC = "n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string"


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, texts in _blocks(batch.column(1)):
                docs, pairs, times, ends = [], [], [], []
                total = 0
                for tokens in own.packed(texts):
                    if tokens is None:
                        docs.append((0, 0, 0, 0, ""))
                    else:
                        found = own.aligned(*tokens)
                        links = np.fromiter(chain.from_iterable(x[1] for x in found), np.int64)
                        one, n = np.unique(links, return_counts=True)
                        pairs.append(one)
                        times.append(n)
                        total += len(one)
                        docs.append((len(tokens[0]), len(tokens[1]), len(links), len(links), hashlib.sha256(";".join([x[0] for x in found]).encode()).hexdigest()))
                    ends.append(total)
                flat, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs, times))
                distinct, local = np.unique(flat, return_inverse=True)
                ids = batch.column(0).slice(lo, len(texts))
                names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
                rows = pa.StructArray.from_arrays([ids, *(pa.array(c, pa.string() if k == "groups_sha256" else pa.int64()) for k, c in zip(names, zip(*docs, strict=True), strict=True))], names=["doc_id", *names])
                one_row = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                ints = lambda x: one_row(pa.array(x.astype(np.int32), pa.int32()))
                counts = np.bincount(local, weights=n, minlength=len(distinct)) if len(distinct) else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), one_row(rows), ints(distinct >> _SHIFT), ints(distinct & 0xFFFFFFFF), one_row(pa.array(counts.astype(np.int64))), ints(np.array(ends, np.int64)), ints(local), ints(n)],
                    names=["block", "docs", "a", "b", "n", "ends", "pairs", "times"],
                )
                number += 1

    return run


def blocks_of(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each block of ``documents`` (doc_id, text): its documents' numbers, its distinct pairs (a, b, n), and which of these each document has how often."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"block long, docs array<struct<doc_id: {kind}, {_DOC}>>, a array<int>, b array<int>, n array<bigint>, ends array<int>, pairs array<int>, times array<int>"
    return documents.select("doc_id", "text").mapInArrow(_aligned(path_a, path_b), schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links of all documents hold a pair, and whether no other A id is linked with the B id more often."""
    rows = blocks.select(F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("x.*")
    # a B id has as many rows as A has ids at most
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n")).withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            docs, ends, pairs, times, counts = (batch.column(i)[row].values for i in range(5))
            n, best = np.zeros(0, np.int64), np.zeros(0, bool)
            if counts is not None:
                at = counts.field("at").to_numpy()
                n, best = np.empty(len(at), np.int64), np.empty(len(at), bool)
                n[at], best[at] = counts.field("n").to_numpy(), counts.field("best").to_numpy(zero_copy_only=False)
            pairs, times, ends = pairs.to_numpy(), times.to_numpy().astype(np.int64), ends.to_numpy()
            sums = [np.concatenate(([0], np.cumsum(x))) for x in (times * best[pairs], times * n[pairs])]
            before = np.concatenate(([0], ends[:-1]))
            columns = [pa.array(s[ends] - s[before]) for s in sums]
            for lo in range(0, len(docs), 5_000):
                part = docs.slice(lo, 5_000)
                fields = [part.field(i) for i in range(part.type.num_fields)]
                yield pa.RecordBatch.from_arrays([*fields[:5], *(c.slice(lo, 5_000) for c in columns), fields[5]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def alignment(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``documents`` (doc_id, text)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    blocks = written(blocks_of(documents, path_a, path_b), "aligned")
    counts = written(pair_counts(blocks), "pairs")
    asked = blocks.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("at", "x")).select("block", "at", "x.a", "x.b")
    told = asked.join(counts.hint("merge"), ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("counts"))
    return blocks.join(told.hint("merge"), "block", "left").select("docs", "ends", "pairs", "times", "counts").mapInArrow(
        _scored, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )


def token_groups(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The groups of each row of ``documents`` (doc_id, text): ids of A and of B, and the bytes they span in the blank and the text."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    group = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64), []
                for tokens in own.tokens([t or "" for t in part.column(1).to_pylist()]):
                    end, rows = 0, []
                    for key in own.windows(*tokens) if tokens else ():
                        for a, b in own.groups(*key):
                            start, end = end, end + sum(len(own.bytes_a[i]) for i in a)
                            rows.append({"a": a, "b": b, "start": start, "end": end})
                    out.append(rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(group))], names=["doc_id", "groups"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, groups array<struct<a: array<int>, b: array<int>, start: bigint, end: bigint>>")
