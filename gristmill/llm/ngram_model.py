"""Language-model scores from a log-frequency Bloom filter.

Counts of all words and word pairs of the training texts are quantised on a
logarithmic scale.  An n-gram of level j is put into a Bloom filter together
with each of the levels 1..j, so its count is read back by probing the levels
in turn until one is missing.  Every counted n-gram is in it, at every size of
input: the filter grows with them.  It is made of groups of segments.  Up to a
given size it is broadcast; a larger one stays a table of its groups, and the distinct n-grams of a few megabytes
of text at a time are shuffled to the groups that tell their levels, and the
levels back to the texts, so the work grows with the texts and not with the
filter.  Both ways make the same probes and give the same levels.

A word's probability after another is the pair's share of the context's count,
smoothed by a Dirichlet prior around the word's own probability.  The prior's
strength is fitted on the training counts: unseen pairs get as much of the
whole as the pairs seen once have (Good and Turing's estimate).

Exact word counts serve the base score: the most frequent words (a bounded
number) are looked up in the scoring pass, all others by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import BATCH_BYTES, discard, map_batches, materialize
from ._text import Words, mix, slabs

#: Largest filter that is broadcast where the caller names none (bits): 8 MiB, below Spark's own bound for tables that joins broadcast.
FILTER_BITS = 1 << 26
SEGMENT_BITS = 1 << 19
#: Segments of a group of the filter, and the bytes of texts whose probes a group should be asked at once.
GROUP, ASKED_BYTES = 16, 16 << 20
PROBES = 6
#: Bits that the filter should have for each entry.
BITS_PER_ENTRY = 9.6
#: Base of the logarithmic scale.
SCALE = 1.3
#: Bounds of the fitted strength of the prior.
LEAST_PRIOR, MOST_PRIOR = 1e-3, 1e9
#: Words whose exact counts travel to every worker (16 bytes each); the rest is joined.
HEAD_WORDS = 1 << 20
#: Groups in which n-grams are counted, of documents up to a few million.
_BUCKETS = 512
_FLUSH = 2_000_000
_END = np.uint64(0x5BD1E9955BD1E995)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xA0761D6478BD642F)


#: Powers of SCALE (from 0 on) between which and the next there is a whole number; only these are levels.
_STEPS = np.array([k for k in range(200) if np.ceil(SCALE**k - 1e-9) < np.ceil(SCALE ** (k + 1) - 1e-9)])


def level_of(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and one more for every factor SCALE, where that is another whole number."""
    power = np.floor(np.log(np.maximum(count, 1)) / np.log(SCALE) + 1e-9)
    return np.searchsorted(_STEPS, power.astype(np.int64)) + 1


def count_at(level: np.ndarray) -> np.ndarray:
    """A count for a level: the middle of the whole numbers it stands for; 0 for level 0."""
    power = _STEPS[np.maximum(level, 1) - 1].astype(float)
    low = np.ceil(SCALE**power - 1e-9)
    high = np.maximum(low, np.ceil(SCALE ** (power + 1) - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


def fit_prior(contexts: list[tuple[float, float]], n_single: float) -> float:
    """The K at which sum over contexts of c * K / (c + K) is the number of pairs seen once.

    contexts: (number of words, their mean count c).  The sum grows with K, from 0
    to all pairs; K is kept between LEAST_PRIOR and MOST_PRIOR.
    """
    low, high = np.log(LEAST_PRIOR), np.log(MOST_PRIOR)
    for _ in range(60):
        k = np.exp((low + high) / 2)
        if sum(n * c * k / (c + k) for n, c in contexts) < n_single:
            low = np.log(k)
        else:
            high = np.log(k)
    return float(np.exp((low + high) / 2))


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every token: the words of each text and one end."""
    at = w.ptr[1:] + np.arange(w.n)
    key = np.full(len(w.key) + w.n, _END, np.uint64)
    inner = np.ones(len(key), bool)
    inner[at] = False
    key[inner] = w.key
    doc = np.repeat(np.arange(w.n), w.counts + 1)
    return doc, key


def pair_keys(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, key of context and token) for every token; the first token of a text follows an end."""
    context = np.concatenate([[_END], key[:-1]]).astype(np.uint64)
    return context, mix(context * _ODD + key)


def _word_entry(key: np.ndarray) -> np.ndarray:
    """The filter's key of a word, apart from those of pairs."""
    return mix(key ^ _STEP)


def _planes(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences, first bytes first: the leading bytes are zeros, which a shuffle compresses away."""
    return np.diff(keys, prepend=keys.dtype.type(0)).view(np.uint8).reshape(-1, keys.dtype.itemsize).T.tobytes()


def _of_planes(blob: pa.Scalar, kind: type) -> np.ndarray:
    """The keys of _planes."""
    planes = np.frombuffer(blob.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _packed(order: int, keys: np.ndarray, counts: np.ndarray, sub: int) -> list[tuple]:
    """Rows (order, bucket, part, keys, counts) of sorted keys, cut by their leading bits."""
    shift = np.uint64(64 - (_BUCKETS * sub - 1).bit_length())
    ids = (keys >> shift).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(keys))
    return [(order, int(ids[a]), _planes(keys[a:b]), counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(cut, ends)]


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[], [], [], []]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["order", "bucket", "keys", "counts"])


_PACKED = "order int, bucket long, keys binary, counts binary"


def count_ngrams(docs: DataFrame, text: str) -> DataFrame:
    """Counts of all words and pairs, as packed rows by a range of the key.

    Tasks add up a few million tokens before they send them.  Buckets grow in
    number with the documents, so that none grows in size.
    """
    sub = 1 << max(0, docs.count() // 4_000_000).bit_length()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[np.ndarray] = []
        pairs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            out = []
            for order, parts in ((1, words), (2, pairs)):
                out += _packed(order, *np.unique(np.concatenate(parts), return_counts=True), sub)
            return _rows(out)

        for batch in batches:
            for lo, hi in slabs(batch.column(0)):
                doc, key = tokens(Words(batch.column(0).slice(lo, hi - lo)))
                words.append(key)
                pairs.append(pair_keys(doc, key)[1])
                held += len(key)
                if held >= _FLUSH:
                    yield flush()
                    words.clear(), pairs.clear()
                    held = 0
        if held:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        order, bucket = table.column("order")[0].as_py(), table.column("bucket")[0].as_py()
        keys = np.concatenate([_of_planes(b, np.uint64) for b in table.column("keys")])
        counts = np.concatenate([np.frombuffer(b.as_buffer(), np.uint32) for b in table.column("counts")]).astype(np.int64)
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(counts, first)
        return pa.table({"order": pa.array([order], pa.int32()), "bucket": pa.array([bucket], pa.int64()), "keys": [_planes(keys[first])], "counts": [total.tobytes()]})

    sent = map_batches(docs.select(F.col(text).cast("string").alias("text")), emit, _PACKED)
    return sent.groupBy("order", "bucket").applyInArrow(add, _PACKED)


def _unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        keys = _of_planes(batch.column(2)[i], np.uint64)
        yield batch.column(0)[i].as_py(), keys, np.frombuffer(batch.column(3)[i].as_buffer(), np.int64)


def segment_of(key: np.ndarray, n_segments: int) -> np.ndarray:
    """The segment of every key, by its leading bits."""
    return (((key >> np.uint64(32)) * np.uint64(n_segments)) >> np.uint64(32)).astype(np.int64)


def rests(key: np.ndarray) -> np.ndarray:
    """What tells keys of one group apart: 32 bits that do not tell the group.

    A group has some 600,000 keys at every size of input, so two of them, or one
    of them and a key that was never counted, share a rest once in some 7000 times.
    """
    return key.astype(np.uint32)


def by_group_and_rest(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order of keys by group and then by rest."""
    return np.argsort((group.astype(np.uint64) << np.uint64(32)) | rests(key), kind="stable")


def spread(rest: np.ndarray) -> np.ndarray:
    """The keys by which a group's filter knows the rests."""
    return mix(rest.astype(np.uint64) * _ODD)


@dataclass(frozen=True)
class BloomCounts:
    """The bits of n_groups groups of GROUP segments: of a whole filter, or of one group of it."""

    bits: np.ndarray
    n_groups: int

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Level of every key of the whole filter."""
        return self.levels_of(segment_of(key, self.n_groups), rests(key))

    def levels_of(self, group: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Level of every rest in its group: probes of level 1, 2, ... until one misses."""
        key = spread(rest)
        level = np.zeros(len(key), np.uint8)
        at, j = np.arange(len(key)), 0
        base = (group * GROUP + segment_of(key, GROUP)) * SEGMENT_BITS
        while len(at):
            j += 1
            entry, step = _entry(key[at], j)
            for i in range(PROBES):
                spot = base + _place(entry, step, i)
                hit = np.flatnonzero((self.bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1)
                if len(hit) < len(at):
                    at, base, entry, step = at[hit], base[hit], entry[hit], step[hit]
            level[at] = j
        return level


def _entry(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the entry (key, level), and what each further probe adds to it."""
    entry = mix(key + np.uint64(level * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
    return entry, (entry >> np.uint64(32)) | np.uint64(1)


def _place(entry: np.ndarray, step: np.ndarray, probe: int) -> np.ndarray:
    """Where in its segment the entry is looked for."""
    return ((entry + np.uint64(probe) * step) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)


def positions(key: np.ndarray, level: int) -> Iterator[np.ndarray]:
    """Places inside its segment of the entry (key, level), one array for each probe."""
    entry, step = _entry(key, level)
    for i in range(PROBES):
        yield _place(entry, step, i)


def build_filter(counts: DataFrame, hist: dict[tuple[int, int], tuple[int, int]], filter_bits: int) -> tuple[BloomCounts | None, int, DataFrame | None]:
    """The filter of all counted n-grams (none where it has more than filter_bits bits), its number of groups, and else the table of its groups."""
    total = sum(v[0] * j * BITS_PER_ENTRY for (_, j), v in hist.items())
    n_groups = max(1, int(np.ceil(total / SEGMENT_BITS / GROUP)))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for order, keys, total in _unpack(batch):
                level = level_of(total).astype(np.uint8)
                if order == 1:
                    keys = _word_entry(keys)
                group = segment_of(keys, n_groups)
                by = by_group_and_rest(group, keys)
                keys, level = rests(keys[by]), level[by]
                ids, cut = np.unique(group[by], return_index=True)
                ends = np.append(cut[1:], len(keys))
                yield _rows([(order, g, _planes(keys[a:b]), level[a:b].tobytes()) for g, a, b in zip(ids.tolist(), cut, ends)])

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(GROUP * SEGMENT_BITS, bool)
        keys = spread(np.concatenate([_of_planes(k, np.uint32) for k in table.column("keys")]))
        level = np.concatenate([np.frombuffer(v.as_buffer(), np.uint8) for v in table.column("counts")])
        base = segment_of(keys, GROUP) * SEGMENT_BITS
        for j in range(1, int(level.max(initial=0)) + 1):
            keys, base, level = keys[level >= j], base[level >= j], level[level >= j]
            for place in positions(keys, j):
                bits[base + place] = True
        return pa.table({"bucket": table.column("bucket")[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    groups = map_batches(counts, choose, _PACKED).groupBy("bucket").applyInArrow(fill, "bucket long, bits binary")
    if n_groups * GROUP * SEGMENT_BITS > filter_bits:
        return None, n_groups, materialize(groups, "filter")
    bits = np.zeros((n_groups, GROUP * SEGMENT_BITS // 8), np.uint8)
    for r in groups.toArrow().to_batches():
        for b, blob in zip(r.column(0).to_pylist(), r.column(1)):
            bits[b] = np.frombuffer(blob.as_buffer(), np.uint8)
    return BloomCounts(bits.reshape(-1), n_groups), n_groups, None


@dataclass(frozen=True)
class NgramModel:
    """What the scoring pass needs: the filter, exact counts of frequent words, the totals and the prior's strength.

    segments: the table of the filter's groups, where it is too large to travel to the workers; then filter is None.
    """

    filter: BloomCounts | None
    n_groups: int
    head_keys: np.ndarray
    head_counts: np.ndarray
    n_tokens: int
    n_types: int
    prior: float
    segments: DataFrame | None = None

    def log_prob(self, levels: np.ndarray) -> np.ndarray:
        """log10 probability of every token after the one before it, from its levels; the last token is an end."""
        denominator = self.n_tokens + self.n_types + 1
        seen = count_at(levels[:, 0])
        before = np.concatenate([seen[-1:], seen[:-1]])
        plain = (seen + 1) / denominator
        together = np.minimum(count_at(levels[:, 1]), np.minimum(seen, before))
        return np.log10((together + self.prior * plain) / (before + self.prior))


@dataclass(frozen=True)
class Probes:
    """The tokens of some texts, and the distinct n-grams whose levels they need.

    words, which: distinct tokens, and each token's among them; entries: keys of
    the words and then of the pairs in the filter; pair: each token's pair among
    the entries.
    """

    texts: Words
    doc: np.ndarray
    key: np.ndarray
    words: np.ndarray
    which: np.ndarray
    entries: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Probes:
        w = Words(column)
        doc, key = tokens(w)
        words, which = _distinct(key)
        pairs, pair = _distinct(pair_keys(doc, key)[1])
        return cls(w, doc, key, words, which, np.concatenate([_word_entry(words), pairs]), pair + len(words))

    def by_group(self, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
        """(group of every entry, order of the entries by group)."""
        group = segment_of(self.entries, n_groups)
        return group, by_group_and_rest(group, self.entries)

    def per_token(self, level: np.ndarray) -> np.ndarray:
        """Levels of the entries as two columns, of every token and of its pair with the one before."""
        return np.column_stack([level[self.which], level[self.pair]])


def _slabs(texts: DataFrame) -> DataFrame:
    """Some megabytes of rows at a time in one row, whose number `slab` is the first of the numbers of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = TaskContext.get().partitionId() << 33
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([slab]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slab", "rows"])
            slab += batch.num_rows

    return materialize(map_batches(texts, run, "slab long, rows binary"), "slabs")


def _slab(value: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def _asked(slabs_: DataFrame, at: int, n_groups: int, groups: DataFrame) -> DataFrame:
    """Levels (slab, bucket, levels) of the entries of every slab, in the order of Probes.by_group; the text is column `at`.

    A group of the filter is asked in as many parts as its probes need, each with a copy of its bits.
    """
    parts = int(np.ceil(max(1, slabs_.count()) * BATCH_BYTES / n_groups / ASKED_BYTES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                probes = Probes.of(_slab(value).column(at))
                group, by = probes.by_group(n_groups)
                keys = rests(probes.entries[by])
                ids, cut = np.unique(group[by], return_index=True)
                blobs = [_planes(keys[a:b]) for a, b in zip(cut, np.append(cut[1:], len(keys)))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), slab)), pa.array(ids), pa.array(blobs, pa.binary())], ["slab", "bucket", "keys"])

    def tell(asked: pa.Table, group: pa.Table) -> pa.Table:
        if asked.num_rows == 0:
            return pa.table({"slab": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "levels": pa.array([], pa.binary())})
        keys = [_of_planes(k, np.uint32) for k in asked.column("keys")]
        ends = np.cumsum([0, *map(len, keys)])
        level = np.zeros(ends[-1], np.uint8)
        if group.num_rows:
            bits = np.frombuffer(group.column("bits")[0].as_buffer(), np.uint8)
            level = BloomCounts(bits, 1).levels_of(np.zeros(ends[-1], np.int64), np.concatenate(keys))
        return pa.table({"slab": asked.column("slab"), "bucket": asked.column("bucket"), "levels": pa.array([level[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())})

    asked = map_batches(slabs_, ask, "slab long, bucket long, keys binary")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("slab", "bucket"), F.lit(parts).cast("long")))
    copies = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    told = asked.groupBy("bucket", "part").cogroup(copies.groupBy("bucket", "part")).applyInArrow(tell, "slab long, bucket long, levels binary")
    return materialize(told, "levels")


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the place of each key among them."""
    coded = pa.array(key).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def train(docs: DataFrame, text: str = "text", filter_bits: int | None = None) -> tuple[NgramModel, DataFrame]:
    """Learns from every row; also gives the exact counts (word, n) of the words that the model does not carry.

    filter_bits: the largest filter that is broadcast, to be chosen by the memory
    of the driver and of each Python worker (FILTER_BITS if not given).  It
    decides how levels are looked up, not what they are.
    """
    counts = materialize(count_ngrams(docs, text), "ngrams")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for order, keys, total in _unpack(batch):
                level = level_of(total)
                types, mass = np.bincount(level), np.bincount(level, weights=total)
                out += [(order, j, int(types[j]), int(mass[j])) for j in np.flatnonzero(types)]
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["order", "level", "types", "mass"])

    grouped = map_batches(counts, tally, "order long, level long, types long, mass long").groupBy("order", "level").agg(F.sum("types").alias("types"), F.sum("mass").alias("mass"))
    hist = {(r.order, r.level): (r.types, r.mass) for r in grouped.collect()}
    n_tokens = sum(m for (o, _), (_, m) in hist.items() if o == 1)
    n_types = sum(t for (o, _), (t, _) in hist.items() if o == 1)
    head_level, room = max((j for o, j in hist if o == 1), default=0) + 1, HEAD_WORDS
    while head_level > 1 and room >= hist.get((1, head_level - 1), (0, 0))[0]:
        head_level -= 1
        room -= hist.get((1, head_level), (0, 0))[0]

    def as_rows(head: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for order, keys, total in _unpack(batch):
                    if order == 1:
                        of = (level_of(total) >= head_level) == head
                        yield pa.RecordBatch.from_arrays([pa.array(keys[of].view(np.int64)), pa.array(total[of])], ["word", "n"])

        return map_batches(counts, run, "word long, n long")

    head = as_rows(True).toArrow()
    keys = head.column("word").to_numpy().view(np.uint64)
    by = np.argsort(keys)
    bloom, n_groups, segments = build_filter(counts, hist, FILTER_BITS if filter_bits is None else filter_bits)
    prior = fit_prior([(t, m / t) for (o, _), (t, m) in hist.items() if o == 1], hist.get((2, 1), (0, 0))[0])
    rare = materialize(as_rows(False), "rare")
    discard(counts)
    return NgramModel(bloom, n_groups, keys[by], head.column("n").to_numpy()[by], n_tokens, n_types, prior, segments), rare


def score(docs: DataFrame, model: NgramModel, rare: DataFrame, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """One row for each document: columns `keep`, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end token alone.  Repeated rows are scored each.
    If nothing was learned every token is unknown and has probability 1.
    """
    named = [c if isinstance(c, Column) else F.col(c) for c in keep]
    picked = docs.select(*named, F.col(text).cast("string").alias("__text"))
    kept = picked.schema.fields[:-1]
    extra = [("n_tokens", T.LongType()), ("n_head", T.LongType()), ("head_score", T.DoubleType()), ("score", T.DoubleType())]
    extra += [("row", T.LongType()), ("rare", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType()))]
    schema = T.StructType([*[T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)], *[T.StructField(n, t) for n, t in extra]])
    denominator, n_groups = model.n_tokens + model.n_types + 1, model.n_groups
    # filter_bits / 8 + 16 * HEAD_WORDS bytes at most
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, segments=None))

    def scored(part: pa.RecordBatch, probes: Probes, level: np.ndarray, row: int) -> list[pa.Array]:
        known, doc, key, n = shared.value, probes.doc, probes.key, part.num_rows
        place = np.minimum(np.searchsorted(known.head_keys, probes.words), max(len(known.head_keys) - 1, 0))
        in_head = known.head_keys[place] == probes.words if len(known.head_keys) else np.zeros(len(probes.words), bool)
        head = in_head[probes.which]
        value = np.zeros(len(probes.words))
        value[in_head] = np.log10((known.head_counts[place[in_head]] + 1) / denominator)
        base = value[probes.which[head]]
        tail, tail_doc = key[~head], doc[~head]
        by = np.lexsort((tail, tail_doc))
        tail, tail_doc = tail[by], tail_doc[by]
        new = np.ones(len(by), bool)
        new[1:] = (tail[1:] != tail[:-1]) | (tail_doc[1:] != tail_doc[:-1])
        times = np.diff(np.append(np.flatnonzero(new), len(by)))
        bounds = pa.array(np.searchsorted(tail_doc[new], np.arange(n + 1)).astype(np.int32))
        rare_words = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (tail[new].view(np.int64), times)]
        arrays = part.columns[: len(kept)]
        arrays += [pa.array(probes.texts.counts + 1), pa.array(np.bincount(doc[head], minlength=n))]
        arrays += [pa.array(np.bincount(doc[head], weights=base, minlength=n).astype(float))]
        arrays += [pa.array(np.bincount(doc, weights=known.log_prob(probes.per_token(level)), minlength=n).astype(float))]
        return [*arrays, pa.array(np.arange(row, row + n)), *rare_words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi in slabs(batch.column(len(kept))):
                part = batch.slice(lo, hi - lo)
                probes = Probes.of(part.column(len(kept)))
                yield pa.RecordBatch.from_arrays(scored(part, probes, shared.value.filter.levels(probes.entries), row), schema.names)
                row += hi - lo

    def finish(slab: pa.Table, told: pa.Table) -> pa.Table:
        part = _slab(slab.column("rows")[0])
        probes = Probes.of(part.column(len(kept)))
        level = np.empty(len(probes.entries), np.uint8)
        blobs = told.sort_by("bucket").column("levels")
        level[probes.by_group(n_groups)[1]] = np.concatenate([np.frombuffer(b.as_buffer(), np.uint8) for b in blobs])
        return pa.Table.from_arrays(scored(part, probes, level, slab.column("slab")[0].as_py()), schema.names)

    if model.segments is None:
        first = materialize(map_batches(picked, run, schema), "scores")
    else:
        texts = _slabs(picked.toDF(*schema.names[: len(kept)], "text"))
        told = _asked(texts, len(kept), n_groups, model.segments)
        first = materialize(texts.groupBy("slab").cogroup(told.groupBy("slab")).applyInArrow(finish, schema), "scores")
        discard(texts, told)
    shared.destroy()
    left = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    found = left.join(rare, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per_row = found.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_rare"),
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(float(denominator)))).alias("rare_score"),
    )
    out = first.join(per_row, "row", "left")
    return out.select(
        *[F.col(f"k{i}").alias(f.name) for i, f in enumerate(kept)],
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op3_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: learned where crc32(doc_id) mod 7 is not 2, scored for every document.

    A row without doc_id has no remainder: it is not learned from and not held out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    model, rare = train(docs.where(part != 2))
    return score(docs, model, rare, keep=("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out")))
