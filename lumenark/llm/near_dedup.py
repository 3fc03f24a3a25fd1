"""Near-duplicate documents: fast similarity sketches, banding, and exact verification.

A document is the set of its distinct shingles of ``words_per_shingle`` words. Its sketch has ``BINS`` coordinates and
is filled in rounds: in each of the first ``BINS`` rounds every shingle is hashed to a bin and a value, and an empty
bin takes the least value placed in it; in the rounds after those, all shingles go to one given bin, so that every
coordinate is filled. Coordinates of two sketches agree with the probability of the sets' similarity, concentrated as
for independent ones. Bands of coordinates are keys, of as many rows as miss a pair at the threshold with a probability
of at most ``MISS``: 24 bands of 5 for 0.85 (8e-7), 30 bands of 4 for 0.8 (1.4e-7).

Equal sets are one class with a number of its own, so copies never meet in a band. Within a band, classes are linked to
a hub, the most central class, instead of to each other. A pair is a candidate only if the sizes allow a link and long
one-bit sketches (``BITS`` coordinates) put the similarity within five standard errors of the threshold or above;
candidates are confirmed on the full sets. A hub with many partners is dealt over several tasks, each with its text once.
What a hub leaves apart is compared within the family of its hub (the classes that share a band with it), in blocks:
first by the sketches alone, then, of classes with a candidate in another component, by their texts; what a link joins
needs no other link. Every other pair is confirmed, excluded, or known to be in one component already.

Defined results: texts that are null or have no words are alone; texts of fewer words are one shingle; texts of any length
are read whole; rows that repeat an id are returned as often, each with the component of its own text, where the least id
of the component names it; of equally central classes the one of the least number is the hub, which changes no result; a
null id is never linked and is kept; an empty table gives an empty result; columns beyond the named ones are ignored, and
kept by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import LOWER, NOT_SPACE, blocks, mix, slice_hashes, windows, word_bounds
from .shared import passing, written

BINS, MISS = 120, 1e-6
WORDS, PERCENT = 5, 80
STAR_ROUNDS = 2
#: Partners of a hub that one task confirms.
PARTNERS = 500
#: Coordinates of the long sketches, of which a bit each is kept.
BITS = 2048
#: Members of a family, and bytes of their texts, that are compared in one part.
PART, PART_BYTES = 4000, 16 << 20


def most_apart(percent: int) -> int:
    """Bits in which two long sketches may differ: those of sets at the threshold, and five standard errors."""
    alike = (1 + percent / 100) / 2
    return round(BITS * (1 - alike + 5 * (alike * (1 - alike) / BITS) ** 0.5))


def rows_per_band(percent: int, bins: int = BINS, miss: float = MISS) -> int:
    """The most rows a band may have so that a pair at the threshold shares none with a probability of ``miss`` at most."""
    return max((r for r in range(1, 9) if (1 - (percent / 100) ** r) ** (bins // r) <= miss), default=1)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each text, a block of texts at a time."""
    for lo, hi, buf, offsets in blocks(texts):
        starts, ends, first = word_bounds(buf, offsets, NOT_SPACE)
        words = slice_hashes(buf, starts, ends, LOWER)
        grams, out = windows(words, k), []
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            out.append(np.unique(grams[a : b - k + 1]) if b - a >= k else windows(words[a:b], b - a) if b > a else words[:0])
        yield out


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Sketch of each set (sets x bins); sets must not be empty.

    Rounds are taken several at a time where little is left to place: the earliest round and then the least value counts.
    """
    n, value_bits = len(sets), np.uint64(32)
    round_bits = np.uint64((2 * bins).bit_length())
    if (n * bins).bit_length() + int(round_bits) + 32 > 64:
        half = n // 2
        return np.concatenate((sketches(sets[:half], bins), sketches(sets[half:], bins)))
    sketch, filled = np.zeros(n * bins, np.uint64), np.zeros(n * bins, bool)
    owner, items = np.repeat(np.arange(n, dtype=np.uint64), [len(s) for s in sets]), np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    low = np.uint64((1 << 32) - 1)
    r = 0
    while r < 2 * bins and len(items):
        many = 1 if r == 0 else max(1, min(20_000 // len(items), (bins if r < bins else 2 * bins) - r))
        rounds = np.arange(r, r + many, dtype=np.uint64)[:, None]
        h = mix(items[None, :] ^ mix(rounds, 6), 7)
        at = owner[None, :] * np.uint64(bins) + ((h >> np.uint64(40)) % np.uint64(bins) if r < bins else rounds - np.uint64(bins))
        keys = np.sort(((((at << round_bits) | rounds) << value_bits) | (h & low)).reshape(-1))
        slot = (keys >> (round_bits + value_bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        slot, least = slot[first], keys[first] & ((np.uint64(1) << (round_bits + value_bits)) - np.uint64(1))
        new = ~filled[slot]
        sketch[slot[new]] = least[new]
        filled[slot] = True
        r += many
        open_ = ~filled.reshape(n, bins).all(axis=1)
        keep = open_[owner.astype(np.int64)]
        owner, items = owner[keep], items[keep]
    return sketch.reshape(n, bins)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A key of each band of each sketch; bands differ in their keys."""
    n, bins = sketch.shape
    bands = bins // rows
    out = np.tile(np.arange(bands, dtype=np.uint64) << np.uint64(8), (n, 1))
    for j in range(rows):
        out = mix(out ^ sketch[:, j : bands * rows : rows], 31 + j)
    return out


def _sketched(k: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(1), k):
                have = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                for i, x in zip(have, band_keys(sketches([sets[i] for i in have], bins), rows).view(np.int64), strict=True):
                    keys[i] = x
                with np.errstate(over="ignore"):
                    one, two = ([int(mix(s, seed).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None for s in sets] for seed in (3, 4))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sets)), batch.column(2).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "hash", "n_shingles", "k1", "k2", "bands"],
                )
                at += len(sets)

    return run


def _enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(k: int, percent: int):
    """Links of hubs to partners: rows come in order, the text of the hub ``a`` (``b`` is null) before those of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            at, left, right = 0, [], []
            ids, partners = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for sets in shingle_sets(batch.column(2), k):
                for x in sets:
                    a, b = ids[at], partners[at]
                    at += 1
                    if b is None:
                        hub, own = a, x
                    elif a != hub:
                        raise ValueError("a partner came before its hub")
                    elif _enough(own, x, percent):
                        left.append(a), right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _bits(k: int):
    """Long one-bit sketches of the sets: an array of 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(1), k):
                for lo in range(0, len(sets), 32):
                    some = sets[lo : lo + 32]
                    bits = mix(sketches(some, BITS), 91) & np.uint64(1)
                    words = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * words.shape[1], pa.int32()), pa.array(words.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), lists], names=["id", "bits"])
                    at += len(some)

    return run


def _near(asks: pa.Table, offers: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates of two blocks in different components, some rows at a time: places in either block, and bits apart."""

    def words(t: pa.Table) -> np.ndarray:
        return t["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(t.num_rows, -1)

    if not asks.num_rows or not offers.num_rows:
        return
    x, y, m, n = words(asks), words(offers), offers["n"].to_numpy()[None, :], asks["n"].to_numpy()
    mine, theirs, most = asks["component"].to_numpy(), offers["component"].to_numpy(), most_apart(percent)
    step = max(1, (1 << 22) // len(y))
    for lo in range(0, len(x), step):
        part = slice(lo, lo + step)
        apart = np.zeros((len(x[part]), len(y)), np.uint16)
        for j in range(x.shape[1]):
            apart += np.bitwise_count(x[part, j, None] ^ y[None, :, j])
        size = n[part, None]
        i, j = np.nonzero((mine[part, None] != theirs[None, :]) & (100 * np.minimum(size, m) >= percent * np.maximum(size, m)) & (apart <= most))
        yield i + lo, j, apart[i, j]


def _plausible(percent: int):
    """(family, id) of the members of two blocks that have a candidate."""

    def run(asks: pa.Table, offers: pa.Table) -> pa.Table:
        left, right = np.zeros(asks.num_rows, bool), np.zeros(offers.num_rows, bool)
        for i, j, _ in _near(asks, offers, percent):
            left[i] = right[j] = True
        parts = [t.select(["family", "id"]).filter(pa.array(at)) for t, at in ((asks, left), (offers, right)) if t.num_rows]
        return pa.concat_tables(parts)

    return run


def _linked(k: int, percent: int):
    """Confirmed links that join what is apart in two blocks of bounded size."""

    def run(asks: pa.Table, offers: pa.Table) -> pa.Table:
        def set_of(t: pa.Table, i: int, known: dict[int, np.ndarray]) -> np.ndarray:
            if i not in known:
                known[i] = next(shingle_sets(t["text"].slice(i, 1), k))[0]
            return known[i]

        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        left, right, sets, others = [], [], {}, {}
        mine, theirs, a_id, b_id = (t[c].to_numpy() for c in ("component", "id") for t in (asks, offers))
        for i, j, apart in _near(asks, offers, percent):
            for at in np.argsort(apart, kind="stable"):
                a, b = int(i[at]), int(j[at])
                p, q = find(int(mine[a])), find(int(theirs[b]))
                if p != q and _enough(set_of(asks, a, sets), set_of(offers, b, others), percent):
                    root[max(p, q)] = min(p, q)
                    left.append(int(a_id[a])), right.append(int(b_id[b]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _blocks(members: DataFrame, size: Column, most: int, *kept: str) -> tuple[GroupedData, GroupedData]:
    """Who asks and who offers in a family, cut into parts of bounded ``size``; the largest component of a family doesn't ask."""
    # sums are taken by component first, and written, so that a hot family is dealt by Spark
    sizes = written(members.groupBy("family", "component").agg(F.count("*").alias("c"), F.sum(size).alias("size")), "sizes")
    parts = F.greatest(F.ceil(F.sum("c") / PART), F.ceil(F.sum("size") / most)).cast("int").alias("parts")
    main = written(sizes.groupBy("family").agg(F.max_by("component", F.struct("c", "component")).alias("main"), parts), "mains")
    rich = members.join(main, "family").withColumn("mine", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asks = rich.where("component <> main").select("family", F.col("mine").alias("p"), every.alias("q"), *kept)
    offers = rich.select("family", every.alias("p"), F.col("mine").alias("q"), *kept).toDF("family", "p", "q", *kept)
    return asks.groupBy("family", "p", "q"), offers.groupBy("family", "p", "q")


def _rows(documents: DataFrame, k: int, percent: int, bins: int) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, component_id, component (its number; null without a set or an id) of each row of ``documents``."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    with passing(documents.sparkSession):
        made = docs.select("doc_id", "text", "hash").mapInArrow(_sketched(k, bins, rows_per_band(percent, bins)), f"doc_id {kind}, hash long, n_shingles long, k1 long, k2 long, bands array<bigint>")
        table = written(made, "sketches")
        named = table.where("k1 is not null and doc_id is not null")
        classes = named.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "hash")).alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        # numbers are given once, as the table is written
        classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "least.doc_id", "least.hash", "n", "bands"), "classes")
        keys = classes.select("id", "n", F.explode("bands").alias("key"))
        # tables where a join follows, here and below: it then deals both sides itself, and Spark can split a hot key
        buckets = written(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
        members = written(keys.join(buckets, "key"), "members")
        labels = None if members.isEmpty() else _labels(docs, classes.select("id", "doc_id", "hash"), members, k, percent)
        rep = classes.select("id", "k1", "k2", "doc_id")
        if labels is None:
            rep = rep.select("k1", "k2", F.col("id").alias("component"), F.col("doc_id").alias("component_id"))
        else:
            rep = written(rep.join(labels, "id", "left").select("k1", "k2", "doc_id", F.coalesce("component", "id").alias("component")), "roots")
            first = written(rep.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")).where("size > 1").drop("size"), "components")
            rep = rep.join(first, "component", "left").select("k1", "k2", "component", F.coalesce("component_id", "doc_id").alias("component_id"))
        rep = written(rep, "named")
        out = table.select("doc_id", "hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("k1")).alias("k1"), "k2").join(rep, ["k1", "k2"], "left")
        return written(out.select("doc_id", "hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component"), "near-duplicates", result=True)


def near_duplicates(documents: DataFrame, words_per_shingle: int = WORDS, percent: int = PERCENT, bins: int = BINS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``documents`` (doc_id, text)."""
    rows = _rows(documents, words_per_shingle, percent, bins)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _labels(docs: DataFrame, classes: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame | None:
    """(id, component) of the classes that are linked to another; None if there are no links."""
    ids = written(members.groupBy("id").agg(F.sum("size").alias("central")), "ids")
    asked = written(classes.join(ids.select("id"), "id", "left_semi"), "asked")
    # a merge at any size: what is asked grows with the corpus, and is not to be broadcast while it is small
    texts = written(docs.join(asked.hint("merge"), ["doc_id", "hash"]).select("id", "text"), "texts")
    if texts.count() > asked.count():  # rows that repeat an id and a text
        texts = written(texts.dropDuplicates(["id"]), "texts")
    bits = written(texts.mapInArrow(_bits(k), "id long, bits array<bigint>"), "bits")
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    apart_bits = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "star-pairs").join(bits.toDF("b", "y"), "b")
        pairs = written(pairs.join(bits.toDF("a", "x"), "a").where(apart_bits <= most_apart(percent)).select("a", "b"), "pairs")
        hubs = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")), "hubs")
        hub_rows = hubs.join(texts.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
        asks = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
        asks = asks.join(texts.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "text")
        dealt = hub_rows.union(asks).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return written(dealt.select("a", "b", "text").mapInArrow(_confirmed(k, percent), "a long, b long"), "confirmed")

    placed = written(members.join(ids, "id").select("id", "n", "key", "central", F.col("id").alias("component")), "placed")
    most_central = F.max_by(F.struct("id", "n", "component"), F.struct("central", F.negative("id"))).alias("hub")
    # the hub of a bucket is its most central class; a family has all classes that share a bucket with its hub
    hubs = written(placed.groupBy("key").agg(most_central), "hubs")
    families = written(placed.join(hubs, "key").select(F.col("hub.id").alias("family"), "id", "n").distinct(), "families")
    labels: DataFrame | None = None
    for _ in range(STAR_ROUNDS):
        pairs = placed.join(hubs, "key").where("component <> hub.component")
        pairs = pairs.select(F.col("hub.id").alias("a"), F.col("id").alias("b"), F.col("hub.n").alias("m"), "n").where(fits)
        pairs = pairs.groupBy(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("h")).agg(F.first("a").alias("a"), F.first("b").alias("b")).select("a", "b")
        before, labels = labels, _relabelled(labels, confirm(pairs))
        if labels is before:
            break
        placed = _still_apart(placed, "key", labels)
        if placed.isEmpty():
            return labels
        # next, the most central one outside the component of the first
        first = written(placed.groupBy("key").agg(most_central), "hubs")
        hubs = written(placed.join(first, "key").where("component <> hub.component").groupBy("key").agg(most_central), "hubs")
    apart = _still_apart(families.withColumn("component", F.col("id")), "family", labels)
    if apart.isEmpty():
        return labels
    kept = ("id", "n", "component", "bits")
    asks, offers = _blocks(written(apart.join(bits, "id"), "apart-bits"), F.lit(1), PART, *kept)
    plausible = written(asks.cogroup(offers).applyInArrow(_plausible(percent), "family long, id long").distinct(), "plausible")
    rich = apart.join(plausible, ["family", "id"]).join(bits, "id").join(texts, "id")
    asks, offers = _blocks(written(rich, "apart-texts"), F.octet_length("text"), PART_BYTES, *kept, "text")
    return _relabelled(labels, written(asks.cogroup(offers).applyInArrow(_linked(k, percent), "a long, b long"), "confirmed"))


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels with the components that the links join made one; the same object if they join none."""
    if links.isEmpty():
        return labels
    if labels is None:
        return written(connected_components(links), "labels")
    named = links.join(labels.toDF("a", "x"), "a", "left").join(labels.toDF("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b")
    roots = written(connected_components(named), "roots")
    old = labels.join(roots.toDF("component", "root"), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return written(old.union(roots.join(labels.select("id"), "id", "left_anti")), "labels")


def _still_apart(placed: DataFrame, group: str, labels: DataFrame | None) -> DataFrame:
    """Members of the groups in which more than one component is left, with their components."""
    if labels is not None:
        placed = written(placed.drop("component").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    apart = written(placed.groupBy(group).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select(group), "apart-groups")
    return written(placed.join(apart, group, "left_semi"), "apart")


def deduplicated(documents: DataFrame, words_per_shingle: int = WORDS, percent: int = PERCENT, bins: int = BINS) -> DataFrame:
    """``documents`` with one row of each group of near duplicates: that of the least id, and of its texts that of the least hash.

    Rows that repeat an id with texts of different groups are each the row of their group; of rows that repeat an id and a
    text one stays, and so does one of those with an id and without words. All rows without an id stay.
    """
    rows = _rows(documents, words_per_shingle, percent, bins).where("doc_id is not null")
    # components of different texts of one id have different numbers
    kept = rows.groupBy("component", F.when(F.col("component").isNull(), F.col("doc_id"))).agg(F.min(F.struct("doc_id", "hash")).alias("least")).select("least.doc_id", "least.hash")
    # the row is one column, so that no name of the table can clash with ours
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    whole = F.xxhash64(*[F.col(f"row.`{c}`") for c, t in documents.dtypes if "map<" not in t and t not in ("void", "variant")])
    own = documents.select(row).select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("hash"), whole.alias("whole"))
    # of rows with one id and text that differ in other columns the one with the least hash stays: it is chosen among hashes, and rows are read again for it
    kept = written(kept.join(own.groupBy("doc_id", "hash").agg(F.min("whole").alias("whole")), ["doc_id", "hash"]), "kept")
    one = own.join(kept.hint("merge"), ["doc_id", "hash", "whole"], "left_semi").dropDuplicates(["doc_id", "hash", "whole"])
    return one.select("row").union(own.where("doc_id is null").select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
