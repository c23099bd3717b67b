"""Long repeated passages, found in a logarithmic family of suffix arrays.

A byte is repeated if a string of ``LENGTH`` bytes that covers it also starts
somewhere else, in the same or another document.

**Suffixes.** Not every suffix is indexed. Of the ``SEED``-byte strings inside
a window of ``LENGTH`` bytes the one with the smallest hash (the leftmost of
equals) is the window's anchor. Equal windows have their anchors at the same
place, so two windows can only be equal if the suffixes at their anchors agree
in ``SEED`` bytes. About one suffix in 150 is an anchor. A suffix array holds
the anchors in the order of two fingerprints: of the seed, then of the whole
stretch covered by the anchor's windows. Neighbours with equal seeds are the
candidates for long matches.

**Levels.** Each new batch of documents gets a suffix array of its own and is
scanned against the arrays of all existing levels for seeds that occur in both,
and within itself. Then two levels of one size merge into one of the next, so
there are at most logarithmically many, and each suffix is rewritten that often.

**Matches.** Anchors whose whole stretch occurs twice are settled. Where
stretches of one seed differ, one of each kind is compared window by window.
Seeds with more kinds than a task should hold are divided first: their
stretches are cut into narrower ones, which have longer seeds in common, down
to single windows.

Two windows count as equal if 128 bits of fingerprints agree.

Defined cases: null is the empty text; texts shorter than ``LENGTH`` bytes have
no repeats; equal rows repeat each other; an input column named like an output
column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.frames import broadcast_if, fits, without_clashes
from affinis.llm.text import bounded, mix, powers, signed, utf8
from affinis.runtime import cut_lineage

LENGTH, SEED = 400, 100
#: Seeds of one window.
WINDOW = LENGTH - SEED + 1
#: Bytes looked at in one step; longer texts are cut at multiples of it, counted from their start.
CHUNK_BYTES = 1 << 19
#: Differing stretches of one seed that are compared in one task.
KINDS = 20_000
#: A stretch of a seed with more of them is cut into so many parts.
PARTS = 8
#: Documents with repeats that are told to all tasks, so that the others need no shuffle.
BROADCAST_DOCUMENTS = 1_000_000
#: Partitions that rows of one seed are dealt to.
SALTS = 32
#: Batches of a one-off search.
BATCHES = 4
_U64 = np.uint64


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from minima towards both ends of blocks."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=_U64)
    padded[: len(values)] = values
    table = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(table, axis=1).reshape(-1)
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[:count], forward[width - 1 : width - 1 + count])


def _chunks(offsets: np.ndarray):
    """(first byte, one past the last window start, last byte) of chunks: whole texts together, or parts of a long one."""
    row = 0
    while row < len(offsets) - 1:
        start, end = int(offsets[row]), int(offsets[row + 1])
        if end - start > CHUNK_BYTES:
            for at in range(start, end, CHUNK_BYTES):
                yield at, min(at + CHUNK_BYTES, end), min(at + CHUNK_BYTES + LENGTH - 1, end)
            row += 1
            continue
        last = int(np.searchsorted(offsets, start + CHUNK_BYTES, side="right")) - 1
        yield start, int(offsets[last]), int(offsets[last])
        row = last


class Fingerprints:
    """Fingerprints of any stretch of one chunk."""

    def __init__(self, raw: np.ndarray):
        value, up, self._down = powers(len(raw))
        self._total = np.zeros(len(raw) + 1, dtype=_U64)
        np.cumsum(value[raw] * up[: len(raw)], out=self._total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._total[end] - self._total[start]) * self._down[start])


@dataclass
class Anchors:
    """Parallel arrays; ``low`` and ``high`` are the first and last window start of the anchor, counted from the row's start, ``ahead`` its distance from ``low``."""

    row: list = field(default_factory=list)
    low: list = field(default_factory=list)
    high: list = field(default_factory=list)
    seed: list = field(default_factory=list)
    stretch: list = field(default_factory=list)
    ahead: list = field(default_factory=list)

    def arrays(self) -> list[np.ndarray]:
        parts = (self.row, self.low, self.high, self.seed, self.stretch, self.ahead)
        return [np.concatenate(part) if part else np.zeros(0, dtype=np.int64) for part in parts]


def anchors(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """(row, low, high, seed, stretch, ahead) of every anchor."""
    found = Anchors()
    for begin, stop, end in _chunks(offsets):
        if end - begin < LENGTH:
            continue
        prints = Fingerprints(raw[begin:end])
        places = np.arange(end - begin - SEED + 1)
        seeds = prints.of(places, places + SEED)
        # The place in the low bits makes the leftmost of equals the smallest.
        order = (seeds & ~_U64((1 << 20) - 1)) | places.astype(_U64)
        anchor = (_least(order, WINDOW) & _U64((1 << 20) - 1)).astype(np.int64)
        start = np.arange(len(anchor)) + begin
        row = np.searchsorted(offsets, start, side="right") - 1
        valid = (start + LENGTH <= offsets[row + 1]) & (start < stop)
        anchor, start, row = anchor[valid], start[valid], row[valid]
        if not len(anchor):
            continue
        first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
        low, high = start[first], start[np.append(first[1:], len(start)) - 1]
        stretch = prints.of(low - begin, high + LENGTH - begin)
        ahead = anchor[first] + begin - low
        stretch = mix(stretch + (ahead * 1024 + (high - low)).astype(_U64))
        base = offsets[row[first]]
        found.row.append(row[first])
        found.low.append(low - base)
        found.high.append(high - base)
        found.seed.append(seeds[anchor[first]])
        found.stretch.append(stretch)
        found.ahead.append(ahead)
    return found.arrays()


def suffix_array(documents: DataFrame) -> DataFrame:
    """Anchors of ``documents`` (k1, k2, text), sorted within each partition."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            row, low, high, seed, stretch, ahead = anchors(*utf8(batch.column(2)))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(seed.astype(_U64))),
                    pa.array(signed(stretch.astype(_U64))),
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(low, pa.int64()),
                    pa.array(high - low, pa.int32()),
                    pa.array(ahead, pa.int32()),
                ],
                names=["seed", "stretch", "k1", "k2", "low", "more", "ahead"],
            )

    schema = "seed long, stretch long, k1 long, k2 int, low long, more int, ahead int"
    return _sorted(documents.select("k1", "k2", "text").mapInArrow(find, schema))


def _sorted(suffixes: DataFrame) -> DataFrame:
    """In order within partitions; a seed that very many texts share is dealt to several."""
    return suffixes.repartition("seed", F.pmod("k1", F.lit(SALTS))).sortWithinPartitions("seed", "stretch")


class SuffixArrayFamily:
    """Suffix arrays of geometrically growing sizes, and the seeds found to repeat so far."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self._repeated: list[DataFrame] = []

    def add(self, documents: DataFrame) -> None:
        """Index a batch, scan it against every level, then merge levels of one size."""
        fresh = cut_lineage(suffix_array(documents))
        seeds = fresh.groupBy("seed").agg(F.count(F.lit(1)).alias("times"))
        found = seeds.filter("times > 1").select("seed")
        for _, level in self.levels:
            found = found.unionByName(level.select("seed").distinct().join(seeds.select("seed"), "seed"))
        self._repeated.append(cut_lineage(found.distinct()))
        self.levels.append((1, fresh))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, left), (_, right) = self.levels[-2:]
            self.levels[-2:] = [(2 * size, cut_lineage(_sorted(left.unionByName(right))))]

    def matches(self) -> DataFrame:
        """All anchors whose seed occurs more than once."""
        suffixes, seeds = self.levels[0][1], self._repeated[0]
        for _, level in self.levels[1:]:
            suffixes = suffixes.unionByName(level)
        for more in self._repeated[1:]:
            seeds = seeds.unionByName(more)
        # A written table on the other side lets Spark split the rows of a hot seed.
        return suffixes.join(cut_lineage(seeds.distinct()), "seed", "left_semi")


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows of stretches that occur twice, one row of each kind of the seeds that have several)."""
    same = [F.first(name).alias(name) for name in ("ahead", "text") if name in rows.columns]
    kinds = rows.groupBy("seed", "stretch").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k1", "k2", "low", "more")).alias("one"), *same)
    kinds = cut_lineage(kinds)
    twice = kinds.filter("times > 1").select("seed", "stretch")
    marks = rows.join(twice, ["seed", "stretch"], "left_semi").select("k1", "k2", "low", "more")
    several = cut_lineage(kinds.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    names = [name for name in ("ahead", "text") if name in rows.columns]
    return marks, kinds.select("seed", "stretch", "one.*", *names).join(several, "seed")


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of each window, number of the stretch it is in)."""
    prints, numbers, row = [], [], 0
    at = batch.schema.get_field_index("text")
    for part in bounded([batch], at, CHUNK_BYTES):
        raw, offsets = utf8(part.column(at))
        count = np.diff(offsets) - LENGTH + 1
        number = np.repeat(np.arange(len(count)), count)
        start = offsets[:-1][number] + np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count)
        prints.append(Fingerprints(raw).of(start, start + LENGTH))
        numbers.append(number + row)
        row += len(part)
    return np.concatenate(prints), np.concatenate(numbers)


def _runs(flags: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first, last) of the runs of flagged windows; windows count from their stretch's start."""
    head = np.append(True, number[1:] != number[:-1])
    begin = np.flatnonzero(head)
    before = np.append(False, flags[:-1]) & ~head
    after = np.append(flags[1:], False) & ~np.append(head[1:], True)
    first, last = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after)
    base = begin[np.searchsorted(begin, first, side="right") - 1]
    return number[first], first - base, last - base


def _shared(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Runs of windows that two stretches of a seed have in common."""
    window, number = _windows(batch)
    seed = batch.column("seed").to_numpy()[number]
    order = np.lexsort((window, seed))
    same = (window[order][1:] == window[order][:-1]) & (seed[order][1:] == seed[order][:-1])
    flags = np.zeros(len(window), dtype=bool)
    flags[order[1:][same]] = flags[order[:-1][same]] = True
    stretch, first, last = _runs(flags, number)
    at = pa.array(stretch)
    low = batch.column("low").to_numpy()[stretch] + first
    return pa.RecordBatch.from_arrays(
        [batch.column("k1").take(at), batch.column("k2").take(at), pa.array(low), pa.array((last - first).astype(np.int32))],
        names=["k1", "k2", "low", "more"],
    )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_shared`` of rows sorted by seed; the last seed of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        joined = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        seed = joined.column("seed").to_numpy()
        edges = np.flatnonzero(seed[1:] != seed[:-1]) + 1
        if len(edges):
            yield _shared(joined.slice(0, int(edges[-1])))
        held = [joined.slice(int(edges[-1]) if len(edges) else 0)]
    for rest in held:
        yield _shared(rest)


def _divide(rows: DataFrame, width: int) -> DataFrame:
    """Stretches cut into parts of ``width`` windows, each with the seed that a part's windows share.

    Parts are counted from the place of the old seed, so equal windows are in equal parts.
    """

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 6):
            out = {name: [] for name in ("seed", "stretch", "k1", "k2", "low", "more", "text", "ahead")}
            for seed, k1, k2, low, more, ahead, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                for part in range((ahead - more) // width, ahead // width + 1):
                    first, last = max(0, ahead - (part + 1) * width + 1), min(more, ahead - part * width)
                    core = text[ahead - part * width : ahead - (part + 1) * width + 1 + LENGTH]
                    own = text[first : last + LENGTH]
                    name = b"%d %d " % (seed, part)
                    for kind, content in (("seed", core), ("stretch", b"%d " % (ahead - first) + own)):
                        digest = hashlib.blake2b(name + content, digest_size=8).digest()
                        out[kind].append(int.from_bytes(digest, "little", signed=True))
                    for kind, value in (("k1", k1), ("k2", k2), ("low", low + first), ("more", last - first), ("ahead", ahead - first), ("text", own)):
                        out[kind].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[name], kind) for name, kind in zip(out, kinds, strict=True)], names=list(out)
            )

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
    given = rows.select("seed", "k1", "k2", "low", "more", "ahead", "text")
    return given.mapInArrow(divide, "seed long, stretch long, k1 long, k2 int, low long, more int, text binary, ahead int")


def _named(documents: DataFrame) -> DataFrame:
    """With k1 and k2, digests of id and text; equal rows share them."""
    made = ("k1", "k2", "spans", "kept", "marks")
    rows = without_clashes(documents, ("doc_id", "text"), made)
    parts = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))]
    return rows.withColumn("k1", F.xxhash64(*parts)).withColumn("k2", F.hash(*parts))


def repeated_windows(named: DataFrame, batches: int = BATCHES, kinds: int = KINDS) -> DataFrame:
    """(k1, k2, low, more): runs of windows, by their first start and how many follow, that occur elsewhere."""
    family = SuffixArrayFamily()
    texts = named.select("k1", "k2", "text").filter(F.octet_length("text") >= LENGTH)
    for number in range(batches):
        family.add(texts.filter(F.pmod("k1", F.lit(batches)) == number))
    marks, chosen = _settled(cut_lineage(family.matches()))
    found = [cut_lineage(marks)]
    piece = F.substring(F.col("text").cast("binary"), F.col("low").cast("int") + 1, F.col("more") + LENGTH)
    chosen = chosen.join(texts, ["k1", "k2"]).withColumn("text", piece)
    width = WINDOW
    while True:
        chosen = cut_lineage(chosen)
        few = chosen.filter(F.col("kinds") <= kinds).select("seed", "k1", "k2", "low", "more", "text")
        shared = few.repartition("seed").sortWithinPartitions("seed").mapInArrow(_compare, "k1 long, k2 int, low long, more int")
        found.append(cut_lineage(shared))
        many = chosen.filter(F.col("kinds") > kinds)
        if width == 1 or many.isEmpty():
            break
        width = -(-width // PARTS)
        marks, chosen = _settled(cut_lineage(_divide(many, width)))
        found.append(cut_lineage(marks))
    marks = found[0]
    for more in found[1:]:
        marks = marks.unionByName(more)
    return marks


def _kept(batches: Iterator[pa.RecordBatch], text_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds spans and the bytes outside them; the last column holds (first window start, further ones)."""
    for batch in bounded(batches, text_at):
        raw, offsets = utf8(batch.column(text_at))
        spans, kept = [], []
        for row, marks in enumerate(batch.column(len(names)).to_pylist()):
            text = raw[offsets[row] : offsets[row + 1]]
            if not marks:
                spans.append([])
                kept.append(text.tobytes())
                continue
            edge = np.zeros(len(text) + 1, dtype=np.int32)
            for mark in marks:
                edge[mark["low"]] += 1
                edge[mark["low"] + mark["more"] + LENGTH] -= 1
            covered = np.cumsum(edge[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)])
            kept.append(text[~covered].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [*batch.columns[: len(names)], pa.array(spans, kind), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "spans", "kept"])


def remove_repeats(documents: DataFrame, batches: int = BATCHES, kinds: int = KINDS) -> DataFrame:
    """All columns of ``documents``, ``spans`` (start, end in bytes) of what repeats, and ``kept``, the other bytes."""
    named = _named(documents)
    names = [name for name in named.columns if name not in ("k1", "k2")]
    marks = repeated_windows(named, batches, kinds)
    per_document = cut_lineage(marks.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "more")).alias("marks")))
    schema = named.select(*names).schema.simpleString()[len("struct<") : -1] + ",spans:array<struct<start:bigint,end:bigint>>,kept:binary"
    at = names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _kept(batches, at, names)

    marked = per_document.select("k1", "k2")
    marked = broadcast_if(marked, fits(marked, BROADCAST_DOCUMENTS))
    touched = named.join(marked, ["k1", "k2"], "left_semi").join(per_document, ["k1", "k2"]).select(*names, "marks")
    whole = named.join(marked, ["k1", "k2"], "left_anti").select(*names, F.lit(None).cast(per_document.schema["marks"].dataType).alias("marks"))
    return touched.unionByName(whole).mapInArrow(keep, schema)
