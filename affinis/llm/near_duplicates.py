"""Near duplicates by consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles, weight tf * idf, with
inverse document frequencies scaled to 1 (in all texts) to 2 (in one): what a
group of copies shares must not count for nothing against an edit. Each of
``HASHES`` samples of improved consistent weighted sampling agrees between two
texts with a probability equal to their weighted Jaccard similarity. Bands of
``ROWS`` samples give candidates; the similarity of every pair that may join
two classes is then computed from the sets themselves.

Document frequencies are counted exactly, per shingle: chunks of texts send
their distinct shingles, sorted and packed, to ranges of the hash, and get back
the counts of those that several texts have. A table of fixed length counts by
hash slot first; it only says where to cut the ranges. Samples and verification
use the same weights.

Equal texts are one text throughout. In a bucket every text is compared with a
leader; texts of one class need no further comparison. A second round with
other leaders compares only across classes. What is left of a bucket is compared
whole, buckets of more than ``LARGE_BUCKET`` texts in tiles of ``TILE`` by
``TILE``: a text goes once to each of its tiles, all pairs across classes that
agree in as many samples as all but one in a thousand similar pairs do are
compared there, and of the similar ones only those leave a tile that join two
of its classes, fewer than it has texts.

Defined cases: null and texts without words are in no group but their own, with
equal non-empty texts together; texts of under five words are one shingle;
equal rows are rows of one class; the representative is the row with the
smallest id, null ids come last, and of rows with equal id and text any one; an
input column named like an output column is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.components import component_labels
from affinis.llm.frames import broadcast_if, fits, shuffles_dropped, without_clashes
from affinis.llm.text import bounded, mix, utf8, words
from affinis.runtime import cut_lineage, cut_lineage_counting

SHINGLE_WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 4, 12
HASHES = ROWS * BANDS
#: Slots of the table by which shingles are dealt to ranges.
SLOT_BITS = 20
SLOT_BLOCK = 1 << 14
#: Bytes of text whose shingles are packed together.
CHUNK_BYTES = 4 << 20
#: Pairs of a text and a shingle in one range of hashes, about.
RANGE_PAIRS = 1 << 21
#: Texts on each side of a tile of a large bucket, about, and bytes of their counts.
TILE = 512
TILE_BYTES = 4 << 20
#: A bucket of more texts is cut into tiles.
LARGE_BUCKET = 2 * TILE
#: Bytes of the texts and counts that a task compares at a time, about.
DEAL_BYTES = 16 << 20
#: Ids that are sent to all tasks instead of being joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Quantile tables of the random variables that the samples draw from.
QUANTILES = 4096
#: Shingles whose values for one sample are computed at once, unless one text has more; they stay in cache.
CELLS = 1 << 16
_U64 = np.uint64


@dataclass(frozen=True)
class Frequencies:
    """Pairs of a text and a shingle by hash slot, and the number of texts counted."""

    slots: np.ndarray
    texts: int

    def idf(self, counts: np.ndarray) -> np.ndarray:
        """Of shingles that are in so many texts each."""
        return idf(counts, self.texts)

    def edges(self) -> np.ndarray:
        """First hashes of consecutive ranges of about RANGE_PAIRS pairs, whole slots each."""
        before = np.cumsum(self.slots) - self.slots
        first = np.flatnonzero(np.diff(before // RANGE_PAIRS, prepend=-1))
        return first.astype(_U64) << _U64(64 - SLOT_BITS)


def idf(counts: np.ndarray, texts: int) -> np.ndarray:
    rarity = np.log((1.0 + texts) / np.clip(counts, 1, max(1, texts)))
    return 1.0 + rarity / np.log(1.0 + max(1, texts))


def shingles(column: pa.Array, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle occurrence, in row order."""
    hashes, bounds = words(column)
    size = np.diff(bounds)
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.int64), hashes
    base = _U64(0x100000001B3)
    total = hashes.copy()
    for step in range(1, min(width, n)):
        total[: n - step] *= base
        total[: n - step] += hashes[step:]
    whole = np.ones(n, dtype=bool)
    for step in range(1, width):  # words with fewer than ``width`` to the end of their row
        whole[(bounds[1:] - step)[size >= step]] = False
    short = np.flatnonzero((size > 0) & (size < width))
    first = bounds[:-1][short]
    one = hashes[first]
    for step in range(1, width):
        more = size[short] > step
        one[more] = one[more] * base + hashes[first[more] + step]
    total[first], whole[first] = one, True
    count = np.where(size < width, np.minimum(size, 1), size - width + 1)
    return np.repeat(np.arange(len(size)), count), mix(total[whole])


def _counted_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, occurrences), by row and shingle."""
    row, key = shingles(column)
    if not len(row):
        return row, key, row
    new = np.ones(len(row), dtype=bool)
    new[1:] = row[1:] != row[:-1]
    edges = np.append(np.flatnonzero(new), len(row)).tolist()
    for start, stop in zip(edges[:-1], edges[1:], strict=True):
        key[start:stop].sort()
    new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return row[first], key[first], np.diff(np.append(first, len(row)))


def weighted_sets(column: pa.Array, counts: pa.Array, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight), by row and shingle; ``counts`` as from ``_sketches``."""
    row, key, tf = _counted_sets(column)
    found = utf8(counts)[0].view("<i4")
    return row, key, (tf * idf(found, texts)).astype(np.float32)


def document_frequencies(texts: DataFrame) -> Frequencies:
    """Of all ``texts`` (text). Each task sums its texts; the table has a fixed size."""
    blocks = (1 << SLOT_BITS) // SLOT_BLOCK

    def count(batches):
        slots, seen = np.zeros(1 << SLOT_BITS, dtype=np.int64), 0
        for batch in bounded(batches, 0):
            key = _counted_sets(batch.column(0))[1]
            slots += np.bincount((key >> _U64(64 - SLOT_BITS)).astype(np.int64), minlength=len(slots))
            seen += len(batch)
        used = [at for at, part in enumerate(slots.reshape(blocks, SLOT_BLOCK)) if part.any()]
        rows = [slots[at * SLOT_BLOCK : (at + 1) * SLOT_BLOCK].astype("<i4") for at in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *used], pa.int32()), pa.array([np.array([seen], dtype="<i4").tobytes(), *(x.tobytes() for x in rows)], pa.binary())],
            names=["block", "counts"],
        )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(one.as_buffer(), dtype="<i4").astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums.keys(), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"]
        )

    schema = "block int, counts binary"
    summed = texts.select("text").mapInArrow(count, schema).repartition(blocks, "block").mapInArrow(add, schema)
    slots, seen = np.zeros(1 << SLOT_BITS, dtype=np.int64), 0
    for block, counts in ((row["block"], np.frombuffer(row["counts"], dtype="<i8")) for row in summed.collect()):
        if block < 0:
            seen = int(counts[0])
        else:
            slots[block * SLOT_BLOCK : (block + 1) * SLOT_BLOCK] = counts
    return Frequencies(slots, seen)


def _pack(keys: np.ndarray) -> bytes:
    """Ascending hashes: steps, by byte, so that the leading zeros compress."""
    return np.diff(keys, prepend=_U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(packed: list[bytes]) -> np.ndarray:
    parts = [np.cumsum(np.ascontiguousarray(np.frombuffer(one, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=_U64) for one in packed]
    return np.concatenate([np.zeros(0, dtype=_U64), *parts])


def _counts_of(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype="<i4").astype(np.int64)


def _chunks(texts: DataFrame) -> DataFrame:
    """(chunk, id, text, n) of ``texts`` (id, text): equal texts of a chunk once, with their number."""

    def cut(batches):
        at, task = 0, TaskContext.get().partitionId()
        for batch in bounded(batches, 1, CHUNK_BYTES):
            names = batch.column(0).to_pylist()
            times = Counter(names)
            first = {name: place for place, name in reversed(list(enumerate(names)))}
            one = batch.take(pa.array([first[name] for name in times], pa.int64()))
            chunk = pa.array(np.full(len(one), task << 32 | at, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([chunk, *one.columns, pa.array(times.values(), pa.int64())], names=["chunk", "id", "text", "n"])
            at += 1

    return texts.select("id", "text").mapInArrow(cut, "chunk long, id binary, text string, n long")


def _packs(chunks: DataFrame, edges: np.ndarray) -> DataFrame:
    """(part, chunk, keys, counts): the distinct shingles of each chunk by range, with the number of texts that have them."""

    def pack(batches):
        for batch in bounded(batches, 1):
            chunk = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                own = batch.slice(start, stop - start)
                row, key, _ = _counted_sets(own.column(1))
                order = np.argsort(key)
                key, times = key[order], own.column(2).to_numpy()[row[order]]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
                counts = np.add.reduceat(times, first).astype("<i4") if len(key) else times
                key = key[first]
                bounds = np.append(np.searchsorted(key, edges), len(key))
                used = np.flatnonzero(np.diff(bounds)).tolist()
                spans = [slice(bounds[part], bounds[part + 1]) for part in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int32()),
                        pa.array([int(chunk[start])] * len(used), pa.int64()),
                        pa.array([_pack(key[span]) for span in spans], pa.binary()),
                        pa.array([counts[span].tobytes() for span in spans], pa.binary()),
                    ],
                    names=["part", "chunk", "keys", "counts"],
                )

    return chunks.select("chunk", "text", "n").mapInArrow(pack, "part int, chunk long, keys binary, counts binary")


def _shared_counts(table: pa.Table) -> pa.Table:
    """Of one range: the shingles of each chunk that more than one text has, with their counts over all chunks."""
    packed = table["keys"].to_pylist()
    keys, counts = _unpack(packed), _counts_of(table["counts"].to_pylist())
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    total = np.empty(len(keys), dtype=np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(keys))))
    rows = {"chunk": [], "keys": [], "counts": []}
    at = 0
    for chunk, one in zip(table["chunk"].to_pylist(), packed, strict=True):
        span = slice(at, at + len(one) // 8)
        at = span.stop
        several = total[span] > 1
        if several.any():
            rows["chunk"].append(chunk)
            rows["keys"].append(_pack(keys[span][several]))
            rows["counts"].append(total[span][several].astype("<i4").tobytes())
    return pa.table({"chunk": pa.array(rows["chunk"], pa.int64()), "keys": pa.array(rows["keys"], pa.binary()), "counts": pa.array(rows["counts"], pa.binary())})


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, by Newton's method."""
    p = (np.arange(QUANTILES) + 0.5) / QUANTILES
    x = np.full(QUANTILES, 1.7)
    for _ in range(60):
        x = np.maximum(x - ((1 - (1 + x) * np.exp(-x)) - p) / np.maximum(x * np.exp(-x), 1e-12) * 0.7, 1e-6)
    return x


def samples(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int, count: int = HASHES, skip: int = 0) -> np.ndarray:
    """``rows`` x ``count`` sample codes, those numbered ``skip`` and on; rows without shingles get zeros."""
    gamma = _gamma_quantiles()
    r_table, log_c_table = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
    unit = ((np.arange(QUANTILES) + 0.5) / QUANTILES).astype(np.float32)
    low = _U64(QUANTILES - 1)
    out = np.zeros((rows, count), dtype=np.int64)
    seeds = mix(np.arange(1 + skip, 1 + skip + count, dtype=_U64)) | _U64(1)
    log_w = np.log(weight).astype(np.float32)
    edges = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.zeros(0, dtype=np.int64)
    ends = np.append(edges[1:], len(row))
    at = 0
    while at < len(edges):
        stop = max(at + 1, int(np.searchsorted(ends, edges[at] + CELLS, side="right")))
        span = slice(edges[at], ends[stop - 1])
        first, size = edges[at:stop] - edges[at], ends[at:stop] - edges[at:stop]
        k, lw = key[span], log_w[span]
        group = np.repeat(np.arange(stop - at), size)
        bits, part = np.empty_like(k), np.empty_like(k)
        place = part.view(np.int64)
        for j in range(count):
            np.multiply(k, seeds[j], out=bits)
            np.bitwise_xor(bits, np.right_shift(bits, _U64(29), out=part), out=bits)
            np.multiply(bits, _U64(0xBF58476D1CE4E5B9), out=bits)
            np.bitwise_xor(bits, np.right_shift(bits, _U64(32), out=part), out=bits)
            np.bitwise_and(bits, low, out=part)
            r = r_table.take(place)
            np.bitwise_and(np.right_shift(bits, _U64(12), out=part), low, out=part)
            log_a = log_c_table.take(place)
            np.bitwise_and(np.right_shift(bits, _U64(24), out=part), low, out=part)
            beta = unit.take(place)
            t = np.floor(lw / r + beta)
            # log a = log c - r (t - beta) - r
            np.subtract(t, beta, out=beta)
            np.multiply(beta, r, out=beta)
            np.subtract(log_a, beta, out=log_a)
            np.subtract(log_a, r, out=log_a)
            least = np.minimum.reduceat(log_a, first)
            hit = np.flatnonzero(log_a == least[group])
            # Of shingles with equal values the one with the smallest hash counts; keys ascend in a row.
            one = hit[np.flatnonzero(np.diff(group[hit], prepend=-1))]
            code = mix(k[one] + t[one].astype(np.int64).view(_U64) * _U64(0x9E3779B97F4A7C15))
            out[row[edges[at:stop]], j] = code.view(np.int64)
        at = stop
    return out


def _bands(codes: np.ndarray) -> np.ndarray:
    """A band is one long: 16 bits of each of its samples."""
    bands = np.zeros((len(codes), BANDS), dtype=_U64)
    for j in range(ROWS):
        bands = (bands << _U64(16)) | (codes[:, j::ROWS].view(_U64) & _U64(0xFFFF))
    return bands


def _sketched(texts: pa.Table, shared: pa.Table, total: int) -> pa.Table:
    """id, bands and counts of the texts of one chunk that have words; a shingle that is not ``shared`` is in one text."""
    keys, found = _unpack(shared["keys"].to_pylist()), _counts_of(shared["counts"].to_pylist())
    order = np.argsort(keys)
    keys, found = keys[order], found[order]
    schema = pa.schema([("id", pa.binary()), ("bands", pa.list_(pa.int64())), ("counts", pa.binary())])
    out = []
    for batch in bounded(texts.select(["id", "text"]).combine_chunks().to_batches(), 1):
        row, key, tf = _counted_sets(batch.column(1))
        counts = np.ones(len(key), dtype="<i4")
        if len(keys):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            counts = np.where(keys[at] == key, found[at], 1).astype("<i4")
        bands = _bands(samples(row, key, (tf * idf(counts, total)).astype(np.float32), len(batch)))
        some = np.unique(row)
        edges = np.searchsorted(row, np.append(some, len(batch)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(bands[some].reshape(-1).view(np.int64)))
        column = pa.array([counts[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
        out.append(pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), lists, column], schema=schema))
    return pa.Table.from_batches(out, schema)


def _sketches(chunks: DataFrame, frequencies: Frequencies) -> DataFrame:
    """(id, bands, counts) of each text that has words; equal texts repeat once per chunk.
    counts has, as 32-bit integers, the number of texts with each distinct shingle, by hash."""
    total = frequencies.texts
    with shuffles_dropped(chunks.sparkSession):
        packs = _packs(chunks, frequencies.edges())
        shared = cut_lineage(packs.groupBy("part").applyInArrow(_shared_counts, "chunk long, keys binary, counts binary"))
        both = chunks.select("chunk", "id", "text").groupBy("chunk").cogroup(shared.groupBy("chunk"))
        return cut_lineage(both.applyInArrow(lambda texts, own: _sketched(texts, own, total), "id binary, bands array<long>, counts binary"))


def weighted_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two sets: ascending keys ``a`` and ``b``, weights ``x`` and ``y``."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    common = np.minimum(x[same], y[at[same]]).sum(dtype=np.float64)
    return float(common / (x.sum(dtype=np.float64) + y.sum(dtype=np.float64) - common))


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(broadcast_if(ids, fits(ids, BROADCAST_IDS)), "id", "left_semi")


def _similar(pairs: DataFrame, texts: DataFrame, total: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least so similar."""

    def compare(batches):
        for batch in bounded(bounded(batches, 2), 3):
            sets = []
            for column in (2, 3):
                row, key, weight = weighted_sets(batch.column(column), batch.column(column + 2), total)
                edges = np.searchsorted(row, np.arange(len(batch) + 1))
                sets.append([(key[i:j], weight[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)])
            alike = [at for at, (left, right) in enumerate(zip(*sets, strict=True)) if weighted_jaccard(*left, *right) >= similarity]
            yield batch.select([0, 1]).take(pa.array(alike, pa.int64()))

    asked = cut_lineage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    sides = _only(texts, asked)
    return (
        pairs.join(sides.select(F.col("id").alias("a"), F.col("text").alias("x"), F.col("counts").alias("x_counts")), "a")
        .join(sides.select(F.col("id").alias("b"), F.col("text").alias("y"), F.col("counts").alias("y_counts")), "b")
        .select("a", "b", "x", "y", "x_counts", "y_counts")
        .mapInArrow(compare, "a binary, b binary")
    )


def _several(rows: DataFrame) -> DataFrame:
    """The rows (bucket, id, class) of buckets with more than one class."""
    mark = F.xxhash64("class")
    mixed = rows.groupBy("bucket").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low != high")
    return rows.join(mixed.select("bucket"), "bucket", "left_semi")


def _agreeing(x: str, y: str) -> Column:
    """Samples in which two arrays of bands agree."""
    apart = [F.col(x)[at].bitwiseXOR(F.col(y)[at]) for at in range(BANDS)]
    lanes = ((F.shiftrightunsigned(bits, 16 * row).bitwiseAND(F.lit(0xFFFF)) == 0).cast("int") for bits in apart for row in range(ROWS))
    return reduce(lambda total, one: total + one, lanes)


def _leader_pairs(members: DataFrame, sketches: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Each member of a bucket with the bucket's leader of this turn, across classes, if enough samples agree."""
    order = F.struct(F.xxhash64("id", F.lit(turn)).alias("at"), "id", "class")
    leaders = members.groupBy("bucket").agg(F.min(order).alias("leader"))
    pairs = (
        members.join(leaders, "bucket")
        .filter(F.col("leader.class") != F.col("class"))
        .select(F.least("id", "leader.id").alias("first"), F.greatest("id", "leader.id").alias("second"))
        .distinct()
    )
    bands = cut_lineage(_only(sketches, cut_lineage(members.select("id").distinct())).dropDuplicates(["id"]))
    left = bands.select(F.col("id").alias("first"), F.col("bands").alias("x"))
    right = bands.select(F.col("id").alias("second"), F.col("bands").alias("y"))
    enough = _agreeing("x", "y") >= least_agreement(similarity)
    return pairs.join(left, "first").join(right, "second").filter(enough).select(F.col("first").alias("a"), F.col("second").alias("b"))


def least_agreement(similarity: float) -> int:
    """Samples in which all but about one in a thousand pairs of this similarity agree."""
    return max(ROWS, math.floor(HASHES * similarity - 3.2 * math.sqrt(HASHES * similarity * (1 - similarity))))


def _tiled(rows: DataFrame) -> DataFrame:
    """``rows`` once for each tile that they are in; a tile is a pair of blocks of a bucket, smaller number first."""
    tiled = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiled = tiled.withColumn("across", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return tiled.withColumns({"first": F.least("own", "across"), "second": F.greatest("own", "across")}).drop("blocks", "across")


def _candidate_rows(members: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """The rows of ``members`` with their bands, once for each tile in which they have a pair to compare.

    The texts of a pair are of different classes and agree in ``least`` samples;
    a pair counts in the bucket of the first band that it shares.
    """
    sketches = cut_lineage(_only(sketches, cut_lineage(members.select("id").distinct())).dropDuplicates(["id"]))
    rows = members.join(sketches, "id")
    parts = F.greatest(F.when(F.count(F.lit(1)) > LARGE_BUCKET, F.count(F.lit(1)) / TILE), F.sum("size") / TILE_BYTES)
    large = rows.groupBy("bucket").agg(F.ceil(parts).cast("int").alias("blocks")).filter("blocks > 1")
    rows = rows.drop("size").join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    left = cut_lineage(_tiled(rows))
    right = left.toDF(*(f"other_{name}" for name in left.columns))
    shared = F.coalesce(*(F.when(F.col("bands")[at] == F.col("other_bands")[at], F.lit(at)) for at in range(BANDS)))
    candidate = (
        reduce(lambda one, two: one & two, (F.col(name) == F.col(f"other_{name}") for name in ("bucket", "first", "second")))
        & (F.col("class") != F.col("other_class"))
        & ((F.col("first") == F.col("second")) | (F.col("own") != F.col("other_own")))
        & (F.col("band") == shared)
        & (_agreeing("bands", "other_bands") >= least)
    )
    return left.join(right, candidate, "left_semi")


class _Sets:
    """Weighted sets of the texts of a tile, with shingles numbered inside the tile."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        sizes = np.array([len(key) for key, _ in sets])
        self._first, self._sizes = np.cumsum(sizes) - sizes, sizes
        known, self._shingle = np.unique(np.concatenate([key for key, _ in sets]), return_inverse=True)
        self._weight = np.concatenate([weight for _, weight in sets]).astype(np.float64)
        self._sum = np.add.reduceat(self._weight, self._first)
        self._own = np.zeros(len(known))

    def similarities(self, one: int, others: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of one set to others."""
        span = slice(self._first[one], self._first[one] + self._sizes[one])
        self._own[self._shingle[span]] = self._weight[span]
        size = self._sizes[others]
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(self._first[others] - first, size)
        common = np.add.reduceat(np.minimum(self._own[self._shingle[at]], self._weight[at]), first)
        self._own[self._shingle[span]] = 0.0
        return common / (self._sum[one] + self._sum[others] - common)


def _joining(bands: np.ndarray, band: np.ndarray, side: np.ndarray, label: np.ndarray, similar, least: int) -> list[tuple[int, int]]:
    """Similar pairs of a tile that join classes, no more than it has classes less one.

    ``similar`` tells of one text and others which of these are similar;
    ``side`` is 0 and 1 for the two blocks of a tile, 0 throughout in one block.
    """
    links, label = [], label.copy()
    two = side.any()
    for one in range(len(bands) - 1):
        others = np.arange(one + 1, len(bands))
        others = others[(label[others] != label[one]) & (~two | (side[others] != side[one]))]
        if not len(others):
            continue
        apart = bands[others] ^ bands[one]
        equal = apart == 0
        close = (np.argmax(equal, axis=1) == band[one]) & equal[:, band[one]]
        close &= (apart.view(np.uint16) == 0).sum(axis=1) >= least
        others = others[close]
        if not len(others):
            continue
        for other in others[similar(one, others)].tolist():
            if label[other] != label[one]:
                links.append((one, other))
                label[label == label[other]] = label[one]
    return links


def _tile_links(rows: DataFrame, texts: DataFrame, total: int, similarity: float, least: int) -> DataFrame:
    """(a, b): similar pairs across classes in the tiles of ``rows`` that join all their similar classes.

    Every pair of a tile that is not joined yet is compared; a tile gives back
    fewer links than it has texts.
    """

    def compare(table: pa.Table) -> pa.Table:
        coded = table["id"].combine_chunks().dictionary_encode()
        text_of, ids = coded.indices.to_numpy(), coded.dictionary
        firsts = pa.array(np.unique(text_of, return_index=True)[1])
        sets: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in bounded(table.select(["text", "counts"]).take(firsts).combine_chunks().to_batches(), 0):
            row, key, weight = weighted_sets(batch.column(0), batch.column(1), total)
            edges = np.searchsorted(row, np.arange(len(batch) + 1))
            sets += [(key[i:j], weight[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        label = table["class"].combine_chunks().dictionary_encode().indices.to_numpy()
        bands = np.asarray(table["bands"].combine_chunks().flatten()).view(_U64).reshape(len(table), BANDS)
        bucket, first, second, own, band = (table[name].to_numpy() for name in ("bucket", "first", "second", "own", "band"))
        order = np.lexsort((text_of, second, first, bucket))
        tile = np.stack([bucket, first, second])[:, order]
        cuts = np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1
        a, b = [], []
        for at in np.split(order, cuts):
            numbered: list[_Sets] = []

            def similar(one: int, others: np.ndarray) -> np.ndarray:
                if not numbered:  # Most tiles are small; without a pair to compare their shingles are not numbered.
                    numbered.append(_Sets([sets[k] for k in text_of[at]]))
                return numbered[0].similarities(one, others) >= similarity

            side = (own[at] != first[at]).astype(np.int8)
            for one, other in _joining(bands[at], band[at], side, label[at], similar, least):
                a.append(text_of[at[one]])
                b.append(text_of[at[other]])
        return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})

    asked = cut_lineage(rows.select("id").distinct())
    sides = cut_lineage(_only(texts, asked).withColumn("size", F.octet_length("text").cast("long") + F.octet_length("counts")))
    times = rows.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    size = times.join(sides.select("id", "size"), "id").agg(F.sum(F.col("times") * F.col("size"))).first()[0] or 0
    deals = max(8 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(size / DEAL_BYTES))
    deal = F.pmod(F.xxhash64("bucket", "first", "second"), F.lit(deals)).cast("int")
    full = rows.join(sides.drop("size"), "id").withColumn("deal", deal)
    return full.groupBy("deal").applyInArrow(compare, "a binary, b binary")


def _links(texts: DataFrame, similarity: float, rounds: int) -> DataFrame:
    """Rows (id, class): the texts (id, text) in classes of more than one."""
    frequencies = document_frequencies(texts)
    total = frequencies.texts
    chunks = cut_lineage(_chunks(texts))
    counted = _sketches(chunks, frequencies)
    sketches = counted.select("id", "bands", F.octet_length("counts").alias("size"))
    spread = sketches.select("id", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "band", "id")
    members = cut_lineage(_several(spread.withColumn("class", F.col("id"))).distinct())
    # Only texts that meet another one in some bucket are looked at again.
    met = cut_lineage(members.select("id").distinct())
    counts = _only(counted.select("id", "counts"), met).dropDuplicates(["id"])
    texts = cut_lineage(_only(chunks.select("id", "text"), met).dropDuplicates(["id"]).join(counts, "id"))
    links, classes = None, None

    def linked(found: DataFrame) -> bool:
        """Adds the similar pairs to the links; whether there were any."""
        nonlocal links, classes
        found, count = cut_lineage_counting(found)
        if count:
            links = found if links is None else links.unionByName(found)
            classes = component_labels(links)
        return count > 0

    for turn in range(rounds):
        pairs, count = cut_lineage_counting(_leader_pairs(members, sketches, turn, similarity))
        if count and linked(_similar(pairs, texts, total, similarity)):
            merged = members.drop("class").join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
            members = cut_lineage(_several(merged))
    least = least_agreement(similarity)
    rows, count = cut_lineage_counting(_candidate_rows(members, sketches, least))
    if count:
        with shuffles_dropped(rows.sparkSession):
            linked(_tile_links(rows, texts, total, similarity, least))
    if classes is None:
        classes = texts.sparkSession.createDataFrame([], "id binary, class binary")
    return classes


def _named(documents: DataFrame) -> DataFrame:
    made = ("class_id", "is_representative", "text_id", "class", "keeper")
    rows = without_clashes(documents, ("doc_id", "text"), made)
    return rows.withColumn("text_id", F.when(F.length("text") > 0, F.unhex(F.substring(F.sha2("text", 256), 1, 32))))


def _classes(named: DataFrame, similarity: float, rounds: int) -> DataFrame:
    """(text_id, doc_id, class): one row per row with a text; class is a text_id."""
    texts = named.filter(F.col("text_id").isNotNull()).select(F.col("text_id").alias("id"), "text")
    classes = _links(texts, similarity, rounds).withColumnRenamed("id", "text_id")
    rows = named.filter(F.col("text_id").isNotNull()).select("text_id", "doc_id")
    return rows.join(classes, "text_id", "left").withColumn("class", F.coalesce("class", "text_id"))


def _keepers(classes: DataFrame) -> DataFrame:
    """(class, keeper): the row of each class with the smallest id; null ids come last."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id")
    return classes.groupBy("class").agg(F.min(order).alias("keeper"), F.count(F.lit(1)).alias("class_rows"))


def near_duplicate_classes(documents: DataFrame, similarity: float = SIMILARITY, rounds: int = 2) -> DataFrame:
    """One row per row of ``documents``: doc_id, class_id, class_rows and is_representative.

    class_id is the smallest doc_id of the class; rows without a text have
    their own id and one row. Only the first of rows with equal id and text is
    marked by ``deduplicate``; here all of them are representative.
    """
    named = _named(documents)
    classes = _classes(named, similarity, rounds)
    marked = classes.join(_keepers(classes), "class").select(
        "doc_id",
        F.col("keeper.doc_id").alias("class_id"),
        "class_rows",
        (F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.text_id") == F.col("text_id"))).alias("is_representative"),
    )
    alone = named.filter(F.col("text_id").isNull()).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_rows"), F.lit(True).alias("is_representative")
    )
    return marked.unionByName(alone)


def deduplicate(documents: DataFrame, similarity: float = SIMILARITY, rounds: int = 2) -> DataFrame:
    """``documents`` with one row of each class; rows without a text stay."""
    named = _named(documents)
    keepers = _keepers(_classes(named, similarity, rounds)).select("keeper.text_id", F.col("keeper.doc_id").alias("keeper"))
    with_text = named.filter(F.col("text_id").isNotNull())
    same = (with_text["text_id"] == keepers["text_id"]) & with_text["doc_id"].eqNullSafe(keepers["keeper"])
    kept = with_text.join(keepers, same).drop(keepers["text_id"]).dropDuplicates(["text_id", "doc_id"]).drop("text_id", "keeper")
    return kept.unionByName(named.filter(F.col("text_id").isNull()).drop("text_id"))
