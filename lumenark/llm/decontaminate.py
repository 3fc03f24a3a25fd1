"""Benchmark decontamination by winnowing.

Of the hashes of ``K`` consecutive words, the minimum of each run of ``W`` consecutive ones is kept (the rightmost of
equal ones), so that two texts that share a span of ``K + W - 1`` words share a kept fingerprint. Fingerprints of the
test items are matched with those of the documents, and the matches are extended: every full window of 10 words around
a matched fingerprint is looked up among the windows of the items. With ``K + W - 1 = 10`` no shared window is missed.
Items of fewer than 10 words are one window each; for them every window of that length is a fingerprint.

Where the fingerprints and windows of the test set are at most ``max_broadcast`` (a checked bound), they travel to the
tasks and the documents are never shuffled. Beyond it, fingerprints and windows are joined by key.

Defined results: a null or empty text has no words, ``n_hit`` 0 and no items; items that are null or have no words find
nothing; items with a null id hit words as any other, but are neither counted nor named, as they have no id; repeated rows
are each returned, and each is judged by its own text; equal items each count; texts of any length are read whole; columns
beyond the named ones are kept by ``decontaminated`` and ignored elsewhere, whatever their names. An empty benchmark leaves
every document clean, an empty table of documents gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import ALNUM, LOWER, blocks, in_one_text, mix, slice_hashes, windows, word_bounds
from .shared import written

WINDOW, K, W = 10, 5, 6
#: Entries (windows of items) up to which the test set is sent to the tasks: at 16 bytes each, 32 MB.
MAX_BROADCAST = 2_000_000
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def winnowed(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minimum of each ``w`` consecutive hashes, the rightmost of equal ones."""
    if len(grams) < w:
        return np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(grams[::-1], w)  # reversed: argmin takes the first of equal ones
    at = np.argmin(runs, axis=1) + np.arange(len(runs))
    return np.unique(len(grams) - 1 - at)


def fingerprint_mask(grams: np.ndarray, w: int) -> np.ndarray:
    """Whether each hash is the minimum of some ``w`` consecutive ones (all equal minima; a superset of ``winnowed``)."""
    low = grams[: len(grams) - w + 1].copy()
    for j in range(1, w):
        np.minimum(low, grams[j : j + len(low)], out=low)
    kept = np.zeros(len(grams), bool)
    for j in range(w):
        kept[j : j + len(low)] |= grams[j : j + len(low)] == low
    return kept


def _salted(hashes: np.ndarray, length: int) -> np.ndarray:
    """Windows of different lengths never meet."""
    return mix(hashes, 1000 + length)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of test items with the fingerprints that find them: item_id, length, window, fingerprint."""
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, buf, offsets in blocks(batch.column(1)):
            starts, ends, first = word_bounds(buf, offsets, ALNUM)
            words = slice_hashes(buf, starts, ends, LOWER)
            item, length, window, print_ = [], [], [], []
            for i in range(hi - lo):
                own = words[first[i] : first[i + 1]]
                if not len(own):
                    continue
                n = min(WINDOW, len(own))
                full = _salted(windows(own, n), n)
                if n < WINDOW:
                    item.append(i + lo), length.append(n), window.append(full[0]), print_.append(full[0])
                    continue
                grams = windows(own, K)
                for j, h in enumerate(full):
                    at = j + int(winnowed(grams[j : j + W], W)[0])
                    item.append(i + lo), length.append(n), window.append(h), print_.append(grams[at])
            if item:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(item)), pa.array(length, pa.int32()), pa.array(np.array(window, np.uint64).view(np.int64)), pa.array(np.array(print_, np.uint64).view(np.int64))],
                    names=["item_id", "length", "window", "fingerprint"],
                )


class _Finder:
    """The windows of the test items, sorted, in a task."""

    def __init__(self, lengths: np.ndarray, found: np.ndarray, prints: np.ndarray):
        self.short = {int(n): np.unique(found[lengths == n]) for n in np.unique(lengths) if n < WINDOW}
        self.full = np.unique(found[lengths == WINDOW])
        self.prints = np.unique(prints[lengths == WINDOW])

    @staticmethod
    def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(table, values), len(table) - 1)
        return table[at] == values

    def hits(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(length, positions, windows)`` of the item windows that occur."""
        for n, table in self.short.items():
            here = _salted(windows(words, n), n)
            at = np.flatnonzero(in_one_text(first, n) & self.among(here, table)) if len(here) else np.zeros(0, np.int64)
            yield n, at, here[at]
        if len(words) < WINDOW or not len(self.full):
            return
        grams = windows(words, K)
        kept = np.flatnonzero(fingerprint_mask(grams, W))
        kept = kept[self.among(grams[kept], self.prints)]
        if not len(kept):
            return
        near = np.zeros(len(words) - WINDOW + 1, bool)  # extension: windows that hold a matched fingerprint
        for j in range(W):
            at = kept - j
            near[at[(at >= 0) & (at < len(near))]] = True
        at = np.flatnonzero(near & in_one_text(first, WINDOW))
        here = _salted(windows(words, WINDOW), WINDOW)[at]
        held = self.among(here, self.full)
        yield WINDOW, at[held], here[held]


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _documents_against(table: dict):
    """For each document, its hits among all test items; ``table`` has the windows and their item ids."""
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            v = table.value if hasattr(table, "value") else table
            order = np.argsort(v["window"], kind="stable")
            state.update(finder=_Finder(v["length"], v["window"], v["fingerprint"]), windows=v["window"][order], items=v["item"][order], names=v["names"])
        finder, keys, items, names = state["finder"], state["windows"], state["items"], state["names"]
        for batch in batches:
            n_words, n_hit, found = [], [], []
            for lo, hi, buf, offsets in blocks(batch.column(1)):
                starts, ends, first = word_bounds(buf, offsets, ALNUM)
                words = slice_hashes(buf, starts, ends, LOWER)
                cover, which = np.zeros(len(words) + 1, np.int64), [set() for _ in range(hi - lo)]
                for n, at, here in finder.hits(words, first):
                    np.add.at(cover, at, 1), np.add.at(cover, at + n, -1)
                    for doc, a, b in zip(np.searchsorted(first, at, "right") - 1, np.searchsorted(keys, here, "left"), np.searchsorted(keys, here, "right"), strict=True):
                        which[doc].update(items[a:b].tolist())
                for items_of in which:
                    items_of.discard(-1)
                inside = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
                n_words += np.diff(first).tolist()
                n_hit += (inside[first[1:]] - inside[first[:-1]]).tolist()
                found += which
            digests = [items_digest([names[i] for i in w]) for w in found]
            yield pa.RecordBatch.from_arrays(
                [*(c for c in batch.columns[:1]), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(w) for w in found], pa.int64()), pa.array(digests), pa.array([h > 0 for h in n_hit])],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def item_windows(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.select("item_id", "text").where("text is not null")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(_item_rows, f"item_id {kind}, length int, window long, fingerprint long").distinct()


def _sent(spark: SparkSession, items: DataFrame):
    """The windows of the test items, broadcast; the caller has checked their number."""
    got = items.withColumn("item_id", F.col("item_id").cast("string")).toArrow()
    names = sorted(set(got["item_id"].to_pylist()) - {None})
    number = {x: i for i, x in enumerate(names)}
    column = lambda c: np.asarray(got[c].to_numpy(), np.int64).view(np.uint64)
    return spark.sparkContext.broadcast({
        "names": names, "item": np.array([number.get(x, -1) for x in got["item_id"].to_pylist()], np.int32),
        "length": got["length"].to_numpy().astype(np.int32), "window": column("window"), "fingerprint": column("fingerprint"),
    })


def contamination(documents: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): words, words inside item windows, items found, and their digest."""
    docs, items = documents.select("doc_id", "text"), written(item_windows(benchmark), "items")
    if items.count() > max_broadcast:
        return _joined(docs, items)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_documents_against(_sent(documents.sparkSession, items)), f"doc_id {kind}, {RESULT}")


def decontaminated(documents: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``documents`` in which no window of the test items occurs, with all their columns."""
    items = written(item_windows(benchmark), "items")
    if items.count() > max_broadcast:
        # the whole row is one column, so that no name of the table can clash with ours
        rows = written(documents.select(F.expr("uuid()").alias("row"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("kept")), "rows")
        hit = _hits(rows.select("row", F.col("kept.text").alias("text")), items).select("row").distinct()
        return rows.join(hit, "row", "left_anti").select(*[F.col(f"kept.`{c}`").alias(c) for c in documents.columns])
    judge, at = _documents_against(_sent(documents.sparkSession, items)), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at)], names=["doc_id", "text"])
            for judged in judge(iter([plain])):
                yield batch.filter(pa.compute.invert(judged.column(5)))

    return documents.mapInArrow(run, documents.schema)


def _prints(lengths: list[int]):
    """Fingerprints of documents: row, fingerprint; all windows of the short ``lengths``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            for lo, _, buf, offsets in blocks(batch.column(1)):
                starts, ends, first = word_bounds(buf, offsets, ALNUM)
                words = slice_hashes(buf, starts, ends, LOWER)
                at, prints = [], []
                if len(words) >= WINDOW:
                    grams = windows(words, K)
                    kept = np.flatnonzero(fingerprint_mask(grams, W) & in_one_text(first, K))
                    at.append(kept), prints.append(grams[kept])
                for n in lengths:
                    here = _salted(windows(words, n), n)
                    ok = np.flatnonzero(in_one_text(first, n)) if len(here) else np.zeros(0, np.int64)
                    at.append(ok), prints.append(here[ok])
                if at:
                    row = np.searchsorted(first, np.concatenate(at), "right") - 1 + lo
                    both = np.unique(np.stack([row.astype(np.int64), np.concatenate(prints).view(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([rows.take(pa.array(both[0])), pa.array(both[1])], names=["row", "fingerprint"])

    return run


def _windows_of(lengths: list[int]):
    """Every window of matched documents: row, position, length, window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            for lo, _, buf, offsets in blocks(batch.column(1)):
                starts, ends, first = word_bounds(buf, offsets, ALNUM)
                words = slice_hashes(buf, starts, ends, LOWER)
                for n in {*lengths, WINDOW}:
                    here = _salted(windows(words, n), n)
                    at = np.flatnonzero(in_one_text(first, n)) if len(here) else np.zeros(0, np.int64)
                    doc = np.searchsorted(first, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [rows.take(pa.array(doc + lo)), pa.array(at - first[doc], pa.int64()), pa.array(np.full(len(at), n, np.int32)), pa.array(here[at].view(np.int64))],
                        names=["row", "at", "length", "window"],
                    )

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: list[int] = []
        for _, _, buf, offsets in blocks(batch.column(2)):
            n += np.diff(word_bounds(buf, offsets, ALNUM)[2]).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["row", "doc_id", "n_words"])


def _hits(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Windows of the test items in ``rows`` (row, text), by shuffled joins: row, at, length, window."""
    lengths = sorted(r.length for r in items.where(f"length < {WINDOW}").select("length").distinct().collect())  # 9 values at most
    prints = rows.mapInArrow(_prints(lengths), "row string, fingerprint long")
    matched = prints.join(items.select("fingerprint").distinct(), "fingerprint", "left_semi").select("row").distinct()
    spans = rows.join(matched, "row", "left_semi").mapInArrow(_windows_of(lengths), "row string, at long, length int, window long")
    return written(spans.join(items.select("length", "window").distinct(), ["length", "window"], "left_semi"), "hits")


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same result with the test set in a shuffled join, for a test set of any size.

    Items that share a window are a set with one name, and documents with the same sets share one digest, so a window
    that all items have isn't multiplied by the documents that hold it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(docs.select(F.expr("uuid()").alias("row"), "doc_id", "text"), "rows")
    hits = _hits(rows.select("row", "text"), items)
    covered = hits.select("row", F.explode(F.sequence("at", F.expr("at + length - 1"))).alias("word")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    owners = items.groupBy("length", "window").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("owners"))
    owners = written(owners.withColumn("owned", F.sha1(F.array_join(F.transform("owners", F.hex), ","))), "owners")
    held = hits.select("row", "length", "window").distinct().join(owners.select("length", "window", "owned"), ["length", "window"])
    held = held.groupBy("row").agg(F.sort_array(F.collect_set("owned")).alias("sets"))
    held = written(held.withColumn("sets_id", F.sha1(F.array_join("sets", ","))), "held")
    each = held.groupBy("sets_id").agg(F.first("sets").alias("sets")).select("sets_id", F.explode("sets").alias("owned"))
    items_of = each.join(owners.groupBy("owned").agg(F.first("owners").alias("owners")), "owned").select("sets_id", F.explode("owners").alias("item")).distinct()
    found = items_of.groupBy("sets_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = found.select("sets_id", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    named = held.select("row", "sets_id").join(found, "sets_id").drop("sets_id")
    base = rows.select("row", "doc_id", "text").mapInArrow(_counted, f"row string, doc_id {kind}, n_words long")
    n_hit, none = F.coalesce("n_hit", F.lit(0).cast("long")), F.lit(0).cast("long")
    return base.join(covered, "row", "left").join(named, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
