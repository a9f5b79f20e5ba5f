"""Jaccard join of word n-gram sets in size-banded tiles with hashed bitmaps.

A document's set is its distinct five-word shingles; two sets link when their
Jaccard similarity reaches the threshold.  Equal sets form a class and are
compared once.  Of each class the shingles that come first in a global order
(frequent ones last) are its prefix; two similar sets share one of them.  Every
shingle has a centre, the smallest class with it in its prefix; a tile holds
the classes that share a shingle with one centre and are of one band of set
sizes, with those of the band below as guests.  Inside a tile bit counts of
bitmaps bound the overlap from above; what passes is decided by intersecting
sorted arrays.

Tiles are worked in rounds.  First every class is compared with one of its
centres and linked classes are labelled.  Then the pairs of a tile that still
have different labels are compared, large tiles in blocks: the likeliest pairs
of each class, and in the last round all that are left.  No link between
components is lost, and groups of copies are not expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import discard, map_batches, materialize
from ._text import Words, distinct_in_doc, mix, signed, slabs
from .components import components

WORDS = 5
PERCENT = 80
#: One document in so many is looked at to find frequent shingles, which only set the order of prefixes.
SAMPLE_EVERY = 12
#: A shingle is frequent from this count in the sample on; no more than so many (8 bytes each) are sent to the workers.
FREQUENT_LEAST, FREQUENT_MOST = 3, 1 << 21
#: Classes that one cell compares with each other.
BLOCK = 256
#: Pairs tried a class in each later round; the last round tries all that are left.
ROUNDS = (1, 4, None)
#: Bits of the broadcast filter that says which documents' arrays are wanted; it may name too many, never too few.
WANTED_BITS = 1 << 26
_SLAB = 1 << 20


def shingles(w: Words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of every distinct shingle by text and ascending key; fewer than `size` words are one shingle."""
    at, key = w.grams(size)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            more = w.counts[short] > k
            whole[more] = mix(whole[more] + w.key[w.ptr[short[more]] + k] + np.uint64(k + 1))
        doc, key = np.concatenate([doc, short]), np.concatenate([key, mix(whole ^ np.uint64(0x51ED270B))])
    return distinct_in_doc(doc, key)


def _bitmaps(doc: np.ndarray, key: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A bitmap of each set, of the power of two of bits that is at least four times its size (64 at least)."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(4 * size, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(bits)])
    flags = np.zeros(int(first[-1]), bool)
    flags[first[doc] + ((key >> np.uint64(8)).astype(np.int64) & (bits[doc] - 1))] = True
    packed = np.packbits(flags, bitorder="little")
    cut = (first // 8).tolist()
    return [packed[a:b].tobytes() for a, b in zip(cut, cut[1:])]


def _class_keys(doc: np.ndarray, key: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, whatever the order; 0 for empty sets."""
    out = np.zeros(len(ptr) - 1, np.uint64)
    some = np.flatnonzero(np.diff(ptr) > 0)
    if len(some):
        a = np.add.reduceat(mix(key + np.uint64(0x632BE59BD9B4E019)), ptr[some])
        b = np.bitwise_xor.reduceat(mix(key ^ np.uint64(0x9E6C63D0876A9A47)), ptr[some])
        out[some] = mix(a + mix(b))
    return out


def need(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT):
    """Least overlap with which sets of these sizes link: percent * union <= 100 * overlap."""
    return -(-percent * (a + b) // (100 + percent))


def _fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] | bitmap[half:]
    return bitmap


def overlap_bound(na: int, a: bytes, nb: int, b: bytes) -> int:
    """The most elements that two sets can share, by the bits that only one bitmap has."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    x, y = _fold(x, size), _fold(y, size)
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def overlap(a: bytes, b: bytes) -> int:
    """Size of the intersection of two sorted arrays."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _frequent(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that are frequent in a sample of the documents, the most frequent ones if there are too many."""
    sample = docs.where(F.pmod("row", F.lit(SAMPLE_EVERY)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slabs(batch.column(0), _SLAB):
                _, key = shingles(Words(batch.column(0).slice(lo, hi - lo)), size)
                unique, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(unique)), pa.array(n)], ["sh", "n"])

    counted = map_batches(sample, run, "sh long, n long").groupBy("sh").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_LEAST)
    counted = materialize(counted.withColumn("n", F.least("n", F.lit(1 << 16))), "frequent")  # small: what a sample repeats
    room, least = FREQUENT_MOST, (1 << 16) + 1
    for r in sorted(counted.groupBy("n").agg(F.count("*").alias("k")).collect(), reverse=True):  # at most 2^16 rows
        if r.k > room:
            break
        room, least = room - r.k, r.n
    out = np.sort(counted.where(F.col("n") >= least).select("sh").toArrow().column("sh").to_numpy().view(np.uint64))
    discard(counted)
    return out


def _sets(docs: DataFrame, frequent: np.ndarray, size: int, percent: int) -> DataFrame:
    """(doc_id, row, n, cls, bits, prefix) of every document."""
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("row", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("cls", T.LongType()),
            T.StructField("bits", T.BinaryType()),
            T.StructField("prefix", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slabs(batch.column(2), _SLAB):
                w = Words(batch.column(2).slice(lo, hi - lo))
                doc, key = shingles(w, size)
                ptr = np.searchsorted(doc, np.arange(w.n + 1))
                n = np.diff(ptr)
                cls = _class_keys(doc, key, ptr)
                common = np.zeros(len(key), np.int64)
                if len(frequent) and len(key):
                    common = (frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key).astype(np.int64)
                order = np.argsort(doc * 2 + common, kind="stable") if common.any() else np.arange(len(key))
                length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                chosen = np.arange(len(key)) - ptr[doc] < length[doc]  # order keeps texts in place
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(signed(key[order][chosen]))
                )
                arrays = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(signed(cls))]
                arrays += [pa.array(_bitmaps(doc, key, n), pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return map_batches(docs, run, schema)


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps allow a link, with both sizes."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    sized = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ok = need(na, nb, percent) <= np.minimum(na, nb)
            for i in np.flatnonzero(ok).tolist():
                most = overlap_bound(int(na[i]), batch.column(4)[i].as_py(), int(nb[i]), batch.column(5)[i].as_py())
                ok[i] = most >= need(int(na[i]), int(nb[i]), percent)
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(ok))

    return map_batches(sized, run, "a long, b long, na long, nb long")


def _verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that link, by intersecting the sorted shingles of both."""
    spark = docs.sparkSession
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    rows = materialize(sets.select("cls", "row").join(wanted, "cls"), "wanted")
    place = F.pmod(F.xxhash64("row"), F.lit(WANTED_BITS))
    filled = rows.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit"))
    parts = filled.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()  # WANTED_BITS / 8 bytes at most
    width = 32768
    first = int(min(parts.column("part").to_pylist(), default=0))
    bits = np.zeros((WANTED_BITS // width + 2, width // 8), np.uint8)
    for part, blob in zip(parts.column("part").to_pylist(), parts.column("bits")):
        bits[part - first] = np.frombuffer(blob.as_buffer(), np.uint8)
    shared = spark.sparkContext.broadcast((first, bits))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, wanted_bits = shared.value
        for batch in batches:
            part, bit = batch.column(2).to_numpy() - begin, batch.column(3).to_numpy()
            inside = (part >= 0) & (part < len(wanted_bits))
            part = np.where(inside, part, 0)
            hit = inside & ((wanted_bits[part, bit >> 3] >> (bit & 7)) & 1 == 1)
            chosen = batch.filter(pa.array(hit))
            for lo, hi in slabs(chosen.column(1), _SLAB):
                w = Words(chosen.column(1).slice(lo, hi - lo))
                doc, key = shingles(w, size)
                cut = np.searchsorted(doc, np.arange(w.n + 1))
                cls = _class_keys(doc, key, cut)
                cut = cut.tolist()
                arrays = [chosen.column(0).slice(lo, hi - lo), pa.array(signed(cls)), pa.array([key[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "cls", "keys"])

    spot = F.pmod(F.xxhash64("row"), F.lit(WANTED_BITS))
    asked = docs.select("row", "text", F.bitmap_bucket_number(spot).alias("part"), F.bitmap_bit_position(spot).alias("bit"))
    got = map_batches(asked, fetch, "row long, cls long, keys binary").join(rows, ["row", "cls"], "left_semi").dropDuplicates(["cls"]).drop("row")
    arrays = materialize(got, "arrays")
    both = pairs.join(arrays.withColumnsRenamed({"cls": "a", "keys": "keys_a"}), "a").join(arrays.withColumnsRenamed({"cls": "b", "keys": "keys_b"}), "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = need(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            keep = [overlap(x.as_py(), y.as_py()) >= m for x, y, m in zip(batch.column(4), batch.column(5), least.tolist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = materialize(map_batches(both.select("a", "b", "na", "nb", "keys_a", "keys_b"), exact, "a long, b long"), "links")
    discard(rows, arrays)
    return out


def _met(reps: DataFrame) -> DataFrame:
    """(a, b, times): every class b with each centre a that it shares prefix shingles with, and with how many.

    The centre of a shingle is the smallest class that has it in its prefix.
    Minima come from partial aggregates and counts are added before they move.
    The centres are a table of their own, so that the join has nothing but two
    shuffled tables and Spark splits a frequent shingle's classes among tasks.
    """
    posts = reps.select(F.explode("prefix").alias("sh"), "cls")
    least = posts.groupBy("sh").agg(F.min("cls").alias("a"), F.max("cls").alias("last")).where("a < last").select("sh", "a")
    centres = materialize(least, "centres")
    return posts.join(centres, "sh").where("cls <> a").groupBy("a", F.col("cls").alias("b")).agg(F.count("*").alias("times"))


def _first_round(met: DataFrame) -> DataFrame:
    """(a, b): every class b with the centre that it shares most shingles with."""
    return met.groupBy("b").agg(F.max(F.struct("times", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")


def _tiles(met: DataFrame, labels: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The cells of all tiles that hold different labels, and the tables that they are made from.

    A tile is a centre's classes of one size band and, as guests, those of the
    band below; two similar sets are in bands that are equal or next to each
    other.  The classes of a tile that bear its centre's label are not compared
    with each other.  The others are dealt into blocks, and every block meets
    every block of either kind in a cell (i, j) of its own.

    A centre of very many classes is no single task's: what is known of a
    centre, and of a tile, is added up in parts and written before its classes
    are joined with it, so that Spark can split them.
    """
    members = met.select("a", F.col("b").alias("cls")).unionByName(met.select("a", F.col("a").alias("cls")).distinct())
    named = labels.select(F.col("node").alias("cls"), "label")
    joined = members.join(named, "cls", "left").join(sets.select("cls", "n"), "cls")
    known = materialize(joined.select("a", "cls", "n", F.coalesce("label", "cls").alias("label")), "known")
    own_label = F.max(F.when(F.col("a") == F.col("cls"), F.col("label"))).alias("main")
    of_centre = known.groupBy("a").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), own_label)
    mixed = materialize(of_centre.where("lo < hi").select("a", "main"), "mixed")
    marked = known.join(mixed, "a").withColumn("other", (F.col("label") != F.col("main")).cast("int"))
    band = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    homes = F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own")))
    homed = marked.select("a", "cls", "n", "label", "other", F.explode(homes).alias("home"))
    housed = materialize(homed.select("a", "home.band", "home.own", "cls", "n", "label", "other"), "housed")
    counts = housed.groupBy("a", "band").agg(
        F.sum("other").alias("n_other"), F.sum(1 - F.col("other")).alias("n_main"), F.count_if("own").alias("n_own"), F.count("*").alias("n_all")
    )
    blocks = counts.where("n_own > 0 AND n_all > 1 AND n_other > 0").select(
        "a", "band", *[F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int").alias(b) for c, b in (("n_other", "b_other"), ("n_main", "b_main"))]
    )
    blocks = materialize(blocks, "blocks")
    dealt = housed.join(blocks, ["a", "band"])
    mine = F.pmod(F.xxhash64("cls"), F.when(F.col("other") == 1, F.col("b_other")).otherwise(F.col("b_main"))).cast("int")
    dealt = dealt.withColumn("mine", mine)
    others, mains = F.sequence(F.lit(0), F.col("b_other") - 1), F.sequence(F.lit(0), F.col("b_main") - 1)
    with_main = F.transform(mains, lambda j: F.struct(F.col("mine").alias("i"), (-1 - j).alias("j")))
    with_other = F.transform(others, lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")))
    as_main = F.transform(others, lambda i: F.struct(i.alias("i"), (-1 - F.col("mine")).alias("j")))
    cells = F.when(F.col("other") == 1, F.concat(with_main, with_other)).otherwise(as_main)
    block = F.when(F.col("other") == 1, F.col("mine")).otherwise(-1 - F.col("mine"))
    placed = dealt.select("a", "band", "own", "cls", "n", "label", block.alias("block"), F.explode(cells).alias("at"))
    return placed.select("a", "band", "at.i", "at.j", "own", "cls", "n", "label", "block"), [known, mixed, housed, blocks]


def _cell_pairs(label, own, block, n, cls, i: int, j: int, bits: list[np.ndarray], percent: int, best: int | None) -> tuple[set[tuple[int, int]], bool]:
    """Pairs of one cell with different labels whose sizes and bitmaps allow a link; of each class the `best` likeliest alone, if given.

    Also whether some were left out.
    """
    found: list[np.ndarray] = []
    rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for r in rows.tolist():
        to = cols[(label[cols] != label[r]) & (own[cols] | own[r]) & (need(n[cols], n[r], percent) <= np.minimum(n[cols], n[r]))]
        if i == j:
            to = to[to > r]
        width = np.array([len(bits[c]) for c in to.tolist()])
        for size in np.unique(width).tolist():
            same = to[width == size]
            least = min(size, len(bits[r]))
            left = _fold(bits[r], least)
            right = np.stack([_fold(bits[c], least) for c in same.tolist()])
            of_left = n[r] - np.bitwise_count(left & ~right).sum(axis=1, dtype=np.int64)
            of_right = n[same] - np.bitwise_count(right & ~left).sum(axis=1, dtype=np.int64)
            spare = (np.minimum(of_left, of_right) - need(n[same], n[r], percent)) * 1000 // n[r]
            fits = spare >= 0
            found.append(np.stack([np.full(int(fits.sum()), r), same[fits], spare[fits]]))
    if not found:
        return set(), False
    left, right, spare = np.concatenate(found, axis=1)
    keep = np.ones(len(left), bool)
    if best is not None:
        keep[:] = False
        for side in (left, right):
            order = np.lexsort((-spare, side))
            first = np.searchsorted(side[order], side[order])
            keep[order[np.arange(len(order)) - first < best]] = True
    a, b = cls[left[keep]], cls[right[keep]]
    return set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())), not keep.all()


def _later_round(met: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, best: int | None) -> DataFrame:
    """(a, b): pairs of a tile with different labels whose sizes and bitmaps allow a link; and (centre, null) where more pairs are left."""
    tiles, spent = _tiles(met, labels, sets)
    placed = tiles.join(sets.select("cls", "bits"), "cls")
    cell = ["a", "band", "i", "j"]
    columns = [*cell, "own", "cls", "n", "label", "block", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def work(table: pa.Table) -> pa.RecordBatch:
            a, band, i, j, own, cls, n, label, block = (table.column(k).to_numpy() for k in range(9))
            bits = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column(9)]
            cut = np.flatnonzero((a[1:] != a[:-1]) | (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            found: set[tuple[int, int | None]] = set()
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(a)]):
                if hi - lo > 1:
                    part = slice(lo, hi)
                    pairs, left = _cell_pairs(label[part], own[part], block[part], n[part], cls[part], int(i[lo]), int(j[lo]), bits[part], percent, best)
                    found |= pairs
                    if left:
                        found.add((int(a[lo]), None))
            x, y = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in cell])
            last = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0)).max(initial=-1)) + 1  # a cell may go on in the next batch
            held = table.slice(last)
            if last:
                yield work(table.slice(0, last))
        if held is not None:
            yield work(held)

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.select(columns).repartition(parts, *cell).sortWithinPartitions(*cell)
    out = materialize(map_batches(ordered, run, "a long, b long").distinct(), "found")
    discard(*spent)
    return out


def _row(key: str, text: str) -> Column:
    """A hash of key and text; equal for equal rows only."""
    return F.xxhash64(F.col(key).cast("string"), F.coalesce(F.col(text).cast("string"), F.lit("")))


def labelled(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, n, label) of every document; label is the same for all that links connect."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.col(key).alias("doc_id"), _row(key, text).alias("row"), body.alias("text"))
    whole = materialize(_sets(own, _frequent(own, words), words, percent), "sets")
    some = whole.where("n > 0")
    first = some.groupBy("cls").agg(F.min("row").alias("row"))
    reps = materialize(some.drop("doc_id").join(first, ["cls", "row"]).dropDuplicates(["cls"]), "classes")
    sets = materialize(whole.select("doc_id", "row", "n", "cls"), "sets")
    discard(whole)
    narrow = reps.select("cls", "row", "n", "bits")
    met = materialize(_met(reps), "met")
    pairs = materialize(_bounded(_first_round(met), narrow, percent), "pairs")
    links = _verified(own, pairs, narrow, words, percent)
    labels = components(links, "a", "b")
    discard(links)
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    sizes = narrow.select("cls", "n")
    spent = [reps, met, pairs]
    for best in ROUNDS:
        found = _later_round(met, labels, narrow, percent, best)
        more = found.where("b IS NOT NULL").join(tried, ["a", "b"], "left_anti")
        sized = more.join(sizes.withColumnsRenamed({"cls": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"cls": "b", "n": "nb"}), "b")
        rest = materialize(sized.select("a", "b", "na", "nb"), "pairs")
        if rest.limit(1).count():
            links = _verified(own, rest, narrow, words, percent)
            before, labels = labels, components(links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))), "a", "b")
            discard(before, links)
            tried = tried.unionByName(rest.select("a", "b"))
        spent += [found, rest]
        met = materialize(met.join(found.where("b IS NULL").select("a"), "a", "left_semi"), "met")
        spent.append(met)
        if not met.limit(1).count():
            break  # every pair that could link is tried or joined already
    known = sets.select("doc_id", "row", "n", "cls").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    out = materialize(known.select("doc_id", "row", "n", F.coalesce("label", "cls").alias("label")), "labels")
    discard(sets, labels, *spent)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id.

    component_id is the smallest key that can be reached by links.  A document
    without words (or text) has no shingle and links with nothing; so it is its
    own component.  Equal texts are always linked if they have a word.  Rows of
    one key count as documents of their own; a null key is passed over when a
    component's smallest key is sought, and is null if there is no other.
    """
    found = labelled(docs, text, key, words, percent)
    grouped = found.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    smallest = materialize(grouped.where("size > 1").select("label", "least"), "least")  # written, so that Spark can split a large component in the join
    out = found.join(smallest, "label", "left")
    component = F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows and columns of `docs`, one of each component: the smallest key, null last.

    Rows without words all stay; of equal rows with words one stays.
    """
    found = labelled(docs, text, key, words, percent).where("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    chosen = found.groupBy("label").agg(F.min(order).alias("x")).select(F.col("x.row").alias("row"))
    several = found.groupBy("row").agg((F.count("*") > 1).alias("several"))
    wordless = ~F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # columns get names of their own, so that none of the caller's can clash
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], _row(key, text).alias("row"), wordless.alias("wordless"))
    marked = own.join(materialize(chosen.join(several, "row"), "chosen"), "row", "left")
    # only rows that occur more than once are made distinct, so that no aggregate has to hold the others' texts
    kept = marked.where("wordless OR NOT several").unionByName(marked.where("several AND NOT wordless").dropDuplicates(["row"]))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: shingle counts and components of all documents.

    Nulls, short texts, equal rows and empty tables: as in near_duplicates.
    """
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i+4] END AS g
      FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""
