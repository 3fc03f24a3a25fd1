"""Repeated passages by recompression.

The words of a text are named by hashes, and rounds then name runs of equal symbols and pairs of neighbours (a pair is
named where a bit of the first symbol is 0 and that of the second 1). A name is a hash of what it stands for, so it is
the same in every document and every task. What a round does with a symbol depends on its direct neighbours alone;
with the spans of runs capped, the parses of two equal stretches differ at most within ``EDGE`` words of their ends, and
symbols span at most ``SPAN`` words.

So every window of 50 words has an interior that is parsed alike wherever it occurs. Of the high-level symbols that
start in each ``RUN`` words the one of least hash is an anchor; each window has one in its interior, and with the words
around it, as many as any window with this anchor must hold, it gives a key. Documents that share a key are candidates;
of these the windows around shared anchors are hashed (96 bits), and the smallest document of each hash is found. Windows
are compared with all documents, not with one partner, so no repeat is lost.

Exact copies of a document are set aside first: all but the smallest lose every word if there is a window at all.

Defined results: null texts have no words; texts of fewer than 50 words lose none; rows that repeat an id (with its text)
are returned as often, and do not count as copies of each other; rows that repeat an id with other texts are each judged by their own;
rows with a null id are neither sources nor cut; texts of any length are read whole; an empty table gives an empty result;
columns beyond the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import NOT_SPACE, blocks, mix, slice_hashes, windows, word_bounds
from .shared import written

WINDOW = 50
#: Caps on the words of a run by round; two rounds.
RUN_CAPS = (2, 4)
#: Words at either end of a stretch whose parse may differ: in each round a capped run and one symbol.
EDGE = (2 + 2) + (4 + 4)
SPAN = 8
#: Symbols that start in so many consecutive words compete; those that start within [EDGE, EDGE + RUN) of a window end in its interior.
RUN = WINDOW - 2 * EDGE - SPAN
#: Words of a key after the start of its anchor; EDGE words before it belong to it too.
AFTER = WINDOW - EDGE - RUN + 1


def recompressed(words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the last round and the words at which they start; nothing is merged across texts."""
    symbol, start, span = words, np.arange(len(words)), np.ones(len(words), np.int64)
    for r, cap in enumerate(RUN_CAPS):
        if len(symbol) < 2:
            break
        same = text_of[start[1:]] == text_of[start[:-1]]
        head = np.flatnonzero(np.concatenate(([True], ~((symbol[1:] == symbol[:-1]) & same))))  # of runs
        size, total = np.diff(np.append(head, len(symbol))), np.add.reduceat(span, head)
        fold = (size > 1) & (total <= cap)
        if fold.any():
            keep = np.ones(len(symbol), bool)
            keep[np.repeat(fold, size)] = False
            keep[head[fold]] = True
            symbol, span = symbol.copy(), span.copy()
            symbol[head[fold]] = mix(symbol[head[fold]] ^ mix(size[fold].astype(np.uint64), 50 + r), 51 + r)
            span[head[fold]] = total[fold]
            symbol, start, span = symbol[keep], start[keep], span[keep]
        bit = (symbol >> np.uint64(20 + 7 * r)) & np.uint64(1)
        same = text_of[start[1:]] == text_of[start[:-1]]
        first = np.flatnonzero((bit[:-1] == 0) & (bit[1:] == 1) & same)
        if len(first):
            keep = np.ones(len(symbol), bool)
            keep[first + 1] = False
            symbol, span = symbol.copy(), span.copy()
            symbol[first] = mix(mix(symbol[first], 60 + r) ^ symbol[first + 1], 61 + r)
            span[first] += span[first + 1]
            symbol, start, span = symbol[keep], start[keep], span[keep]
    return symbol, start


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the anchors of texts that have a window, and their keys."""
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    symbol, start = recompressed(words, text_of)
    rank = np.full(len(words), np.uint64(0xFFFFFFFFFFFFFFFF))
    rank[start] = mix(symbol, 70) >> np.uint64(1)
    if len(rank) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = rank[: len(rank) - RUN + 1].copy()
    for j in range(1, RUN):
        np.minimum(low, rank[j : j + len(low)], out=low)
    chosen = np.zeros(len(rank), bool)
    for j in range(RUN):
        chosen[j : j + len(low)] |= rank[j : j + len(low)] == low
    at = np.flatnonzero(chosen & (rank != np.uint64(0xFFFFFFFFFFFFFFFF)))
    text = text_of[at]
    at = at[(at - EDGE >= first[text]) & (at + AFTER <= first[text + 1]) & (first[text + 1] - first[text] >= WINDOW)]
    return at, windows(words, EDGE + AFTER)[at - EDGE]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in blocks(batch.column(1)):
            starts, ends, first = word_bounds(buf, offsets, NOT_SPACE)
            words = slice_hashes(buf, starts, ends)
            at, keys = anchors(words, first)
            one, two, sha = [], [], []
            for i in range(hi - lo):
                a, b = int(first[i]), int(first[i + 1])
                whole = windows(words[a:b], b - a) if b > a else np.zeros(1, np.uint64)
                one.append(int(whole[0].astype(np.int64)))
                two.append(int(mix(words[a:b] ^ mix(np.arange(b - a, dtype=np.uint64), 80), 81).sum(dtype=np.uint64).astype(np.int64)))
                sha.append(joined_digest(buf, starts[a:b], ends[a:b]))
            # a key once for each text, with all its places: runs of a word have the same key at every word
            texts = np.searchsorted(first, at, "right") - 1
            order = np.lexsort((at, keys, texts))
            at, keys, texts = at[order], keys[order], texts[order]
            head = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])))) if len(at) else np.zeros(0, np.int64)
            bounds = pa.array(np.searchsorted(texts[head], np.arange(hi - lo + 1)).astype(np.int32))
            places = pa.ListArray.from_arrays(pa.array(np.append(head, len(at)).astype(np.int32)), pa.array((at - first[texts]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sha), pa.ListArray.from_arrays(bounds, pa.array(keys[head].view(np.int64))), pa.ListArray.from_arrays(bounds, places)],
                names=["doc_id", "t", "n_words", "k1", "k2", "sha", "keys", "places"],
            )


def joined_digest(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """SHA-256 of the words joined by blanks."""
    if not len(starts):
        return hashlib.sha256(b"").hexdigest()
    own = buf[starts[0] : ends[-1]]
    gap = np.ones(len(own) + 1, np.int64)  # how many words cover or follow a byte; kept: bytes of words and one blank after each
    gap[:] = 0
    np.add.at(gap, starts - starts[0], 1)
    np.add.at(gap, ends - starts[0], -1)
    inside = np.cumsum(gap[:-1]) > 0
    keep = inside.copy()
    keep[ends[:-1] - starts[0]] = True  # the byte after a word stands for the blank
    return hashlib.sha256(np.where(inside, own, 0x20)[keep].astype(np.uint8).tobytes()).hexdigest()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows around the shared anchors of each document."""
    for batch in batches:
        for lo, hi, buf, offsets in blocks(batch.column(1)):
            starts, ends, first = word_bounds(buf, offsets, NOT_SPACE)
            words = slice_hashes(buf, starts, ends)
            wanted = np.zeros(len(words) + 1, np.int64)
            for i, places in enumerate(batch.column(3).slice(lo, hi - lo)):
                a, n = int(first[i]), int(first[i + 1] - first[i])
                at = np.asarray(places.values.to_numpy(zero_copy_only=False), np.int64)
                low, high = np.maximum(at - EDGE - RUN + 1, 0), np.minimum(at - EDGE, n - WINDOW) + 1  # the windows in whose interior it lies
                ok = low < high
                np.add.at(wanted, a + low[ok], 1)
                np.add.at(wanted, a + high[ok], -1)
            at = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
            if not len(at):
                continue
            one, two = windows(words, WINDOW)[at], windows(mix(words, 90), WINDOW)[at]
            text = np.searchsorted(first, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text + lo)), batch.column(2).take(pa.array(text + lo)), pa.array((at - first[text]).astype(np.int32)), pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                names=["doc_id", "v", "at", "h", "g"],
            )


def _covered(first: np.ndarray, i: int, at: np.ndarray) -> np.ndarray:
    n = int(first[i + 1] - first[i])
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + WINDOW, n), -1)
    return np.cumsum(cover[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of removed words and digest of the rest, from the starts of repeated windows; the kept text too."""
    for batch in batches:
        for lo, hi, buf, offsets in blocks(batch.column(1)):
            starts, ends, first = word_bounds(buf, offsets, NOT_SPACE)
            removed, sha, texts = [], [], []
            for i, places in enumerate(batch.column(3).slice(lo, hi - lo)):
                gone = _covered(first, i, np.asarray(places.values.to_numpy(zero_copy_only=False), np.int64))
                s, e = starts[first[i] : first[i + 1]][~gone].tolist(), ends[first[i] : first[i + 1]][~gone].tolist()
                text = b" ".join(buf[a:b].tobytes() for a, b in zip(s, e, strict=True))
                removed.append(int(gone.sum()))
                texts.append(text.decode())
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(removed, pa.int64()), pa.array(sha), pa.array(texts)], names=["doc_id", "v", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of ``documents`` (doc_id, text)."""
    parsed, cut = repeats(documents)
    copies = parsed.where(f"n_words >= {WINDOW} and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("source"))
    out = parsed.select("doc_id", "v", "n_words", "k1", "k2", "sha").join(copies, ["k1", "k2"], "left").join(cut.select("doc_id", "v", "n_removed", "kept_sha256"), ["doc_id", "v"], "left")
    copy = F.coalesce(F.col("source") < F.col("doc_id"), F.lit(False))
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


#: Ids with several texts are broadcast up to so many, and joined beyond, with the same rows.
BROADCAST_IDS = 100_000


def _told_apart(parsed: DataFrame):
    """Adds ``v`` to rows with an id and a hash ``t`` of their text: which of the texts of its id a row has; 0 where an id has one.

    So it costs next to nothing where ids are unique, and a row is known by (doc_id, v).
    """
    several = written(parsed.where("doc_id is not null").groupBy(F.col("doc_id").alias("lk_id")).agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("lk_id"), "several")
    few = several.count() <= BROADCAST_IDS
    side = F.broadcast(several) if few else several.hint("merge")
    return lambda rows: rows.join(side, F.col("doc_id") == F.col("lk_id"), "left").withColumn("v", F.when(F.col("lk_id").isNotNull(), F.col("t")).otherwise(F.lit(0).cast("long"))).drop("lk_id", "t")


def repeats(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parsed table, and for each document that loses words without being a copy what is left of it; rows are known by (doc_id, v)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("t"))
    parsed = written(docs.mapInArrow(_parsed, f"doc_id {kind}, t long, n_words long, k1 long, k2 long, sha string, keys array<bigint>, places array<array<int>>"), "parsed")
    told = _told_apart(parsed)
    parsed, docs = told(parsed), told(docs)
    named = parsed.where(f"n_words >= {WINDOW} and doc_id is not null")
    sources = named.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "v")).alias("s"), F.first("keys").alias("keys"), F.first("places").alias("places"))
    found = sources.select("s.*", F.explode(F.arrays_zip("keys", "places")).alias("x")).select("doc_id", "v", F.col("x.keys").alias("key"), F.col("x.places").alias("places"))
    found = written(found, "anchors")
    shared = found.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key", "low")
    near = found.join(shared, "key").groupBy("doc_id", "v").agg(F.flatten(F.collect_list("places")).alias("places"), F.max(F.col("low") < F.col("doc_id")).alias("later"))
    wanted = written(docs.join(near, ["doc_id", "v"]).select("doc_id", "text", "v", "places", "later").dropDuplicates(["doc_id", "v"]), "candidates")
    spans = written(wanted.select("doc_id", "text", "v", "places").mapInArrow(_windows, f"doc_id {kind}, v long, at int, h long, g int"), "windows")
    # as a table, so that the join deals both sides itself and Spark can split a window that very many documents have
    lowest = written(spans.groupBy("h", "g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "g", "low"), "lowest")
    again = spans.join(lowest, ["h", "g"]).where("low < doc_id").groupBy("doc_id", "v").agg(F.collect_list("at").alias("at"))
    cut = wanted.where("later").select("doc_id", "text", "v").join(again, ["doc_id", "v"]).select("doc_id", "text", "v", "at").mapInArrow(_cut, f"doc_id {kind}, v long, n_removed long, kept_sha256 string, kept_text string")
    return parsed, cut
