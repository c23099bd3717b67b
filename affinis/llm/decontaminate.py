"""Benchmark passages in training texts, found in a positional inverted index.

The index is split by documents: each row holds the postings of some documents,
sorted by term, as arrays of positions. Building it needs no shuffle. A search
sends the windows of the test items, in blocks of bounded size, to every row.
For each window the positions of its terms are shifted by their place in the
window, so that an occurrence is one start common to all lists; the shortest
list is taken first and the others can only shorten it. Starts that all lists
have exactly are phrase matches; starts that all lists have within ``slop``
words are proximity matches.

A window is ``width`` consecutive words of an item; an item of fewer words is
one window, an item without words has none.

Defined cases: null has no words; repeated items and documents count each;
matches never cross documents; an empty table gives no hits; an input column
named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from affinis.llm.frames import broadcast_if, fits, pick, without_clashes
from affinis.llm.text import bounded, words
from affinis.runtime import cut_lineage

WIDTH = 10
SLOP = 2
#: Words of one index row; a longer document is a row of its own.
SHARD_WORDS = 1 << 21
#: Words of the test items that are sent to the tasks at once.
BLOCK_WORDS = 1 << 18
#: Rows that are sent to all tasks instead of being joined by shuffle.
BROADCAST_ROWS = 500_000

PACKED = ("starts", "terms", "counts", "positions")


def _shard(sizes: list[int], hashes: list[np.ndarray], gap: int) -> list[bytes]:
    """The packed columns of one row. Documents are laid out one behind the other, ``gap`` places apart."""
    size = np.array(sizes, dtype=np.int64)
    starts = np.cumsum(np.append(0, size + gap))[:-1]
    term = np.concatenate(hashes)
    place = np.arange(len(term)) + np.repeat(np.arange(len(size)) * gap, size)
    order = np.argsort(term, kind="stable")
    term, place = term[order], place[order]
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(term)))
    # Positions ascend within a term; their differences are small and compress well.
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    return [array.astype(kind).tobytes() for array, kind in ((starts, "<i8"), (term[first], "<u8"), (counts, "<i4"), (step, "<i4"))]


def build_index(documents: DataFrame, gap: int = WIDTH + SLOP) -> DataFrame:
    """Postings of every word of ``documents`` (key, text), written as a table.

    Columns: shard (number of the row), keys and sizes (words) of its
    documents, and the packed places of documents and terms.
    """
    kind = documents.schema["key"].dataType
    schema = StructType(
        [StructField("keys", ArrayType(kind)), StructField("sizes", ArrayType(IntegerType())), *(StructField(name, BinaryType()) for name in PACKED)]
    )

    def row(keys, sizes, hashes):
        columns = [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(keys))]
        columns.append(pa.array([sizes], pa.list_(pa.int32())))
        columns += [pa.array([x], pa.binary()) for x in _shard(sizes, hashes, gap)]
        return pa.RecordBatch.from_arrays(columns, names=["keys", "sizes", *PACKED])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, hashes, held = [], [], [], 0
        for batch in bounded(batches, 1):
            found, bounds = words(batch.column(1))
            for at, size in enumerate(np.diff(bounds).tolist()):
                if held and held + size > SHARD_WORDS:
                    yield row(keys, sizes, hashes)
                    keys, sizes, hashes, held = [], [], [], 0
                keys.append(batch.column(0).slice(at, 1))
                sizes.append(size)
                hashes.append(found[bounds[at] : bounds[at + 1]])
                held += size
        if sizes:
            yield row(keys, sizes, hashes)

    rows = documents.select("key", "text").mapInArrow(build, schema)
    return cut_lineage(rows.withColumn("shard", F.monotonically_increasing_id()))


class Windows:
    """The distinct windows of some items, and which items have each."""

    def __init__(self, names: list[str], column: pa.Array, width: int):
        hashes, bounds = words(column)
        by_text: dict[bytes, list[int]] = {}
        for at in range(len(names)):
            item = hashes[bounds[at] : bounds[at + 1]]
            for start in range(max(1, len(item) - width + 1) if len(item) else 0):
                by_text.setdefault(item[start : start + width].tobytes(), []).append(at)
        self.names = names
        self.windows = [np.frombuffer(text, dtype=np.uint64).tolist() for text in by_text]
        self.items = [sorted(set(items)) for items in by_text.values()]
        self.terms = np.unique(hashes)


def _nearest(wanted: np.ndarray, place: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending ``place``: whether one lies within ``slop`` of each wanted place, and whether it is there exactly."""
    after = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
    before = np.maximum(after - 1, 0)
    away = np.minimum(np.abs(place[after] - wanted), np.abs(place[before] - wanted))
    return away <= slop, away == 0


def _matches(postings: dict[int, np.ndarray], window: list[int], slop: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(starts of phrase matches, a place inside each proximity match)."""
    lists = [postings.get(term) for term in window]
    if any(one is None for one in lists):
        return None
    order = sorted(range(len(lists)), key=lambda at: len(lists[at]))
    start = lists[order[0]] - order[0]
    exact = np.ones(len(start), dtype=bool)
    for at in order[1:]:
        near, same = _nearest(start + at, lists[at], slop)
        start, exact = start[near], (exact & same)[near]
        if not len(start):
            return None
    return start[exact], start + order[0]


def _search_shard(packed: dict[str, memoryview], windows: Windows, slop: int):
    """For each document with a match: (its place in the row, hit word numbers, phrase items, proximity items)."""
    starts = np.frombuffer(packed["starts"], dtype="<i8")
    term, counts = np.frombuffer(packed["terms"], dtype="<u8"), np.frombuffer(packed["counts"], dtype="<i4")
    steps = np.frombuffer(packed["positions"], dtype="<i4")
    edges = np.append(0, np.cumsum(counts, dtype=np.int64))
    wanted = np.flatnonzero(np.isin(term, windows.terms))
    postings = {int(term[k]): np.cumsum(steps[edges[k] : edges[k + 1]], dtype=np.int64) for k in wanted}
    hit, phrase, near = {}, {}, {}
    for window, items in zip(windows.windows, windows.items, strict=True):
        if (found := _matches(postings, window, slop)) is None:
            continue
        for places, table in zip(found, (phrase, near), strict=True):
            for document in np.unique(np.searchsorted(starts, places, side="right") - 1).tolist():
                table.setdefault(document, set()).update(items)
        documents = np.searchsorted(starts, found[0], side="right") - 1
        for document, start in zip(documents.tolist(), (found[0] - starts[documents]).tolist(), strict=True):
            hit.setdefault(document, set()).update(range(start, start + len(window)))
    for document in sorted(near):
        yield document, hit.get(document, set()), phrase.get(document, set()), near[document]


def search_index(index: DataFrame, windows: Windows, slop: int = SLOP) -> DataFrame:
    """(shard, place, words, items, near_items) of the documents with a match.

    ``place`` is the document's place in its index row, ``words`` the numbers of
    its words inside phrase matches, ``items`` and ``near_items`` the items with
    phrase and with proximity matches.
    """
    sent = index.sparkSession.sparkContext.broadcast(windows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in batches:
            for at in range(len(batch)):
                packed = {name: batch.column(name)[at].as_buffer() for name in PACKED}
                found = list(_search_shard(packed, asked, slop))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("shard")[at].as_py()] * len(found), pa.int64()),
                        pa.array([x[0] for x in found], pa.int32()),
                        pa.array([sorted(x[1]) for x in found], pa.list_(pa.int32())),
                        *(pa.array([[asked.names[k] for k in x[kind]] for x in found], pa.list_(pa.string())) for kind in (2, 3)),
                    ],
                    names=["shard", "place", "words", "items", "near_items"],
                )

    schema = "shard long, place int, words array<int>, items array<string>, near_items array<string>"
    return index.select("shard", *PACKED).mapInArrow(search, schema)


def item_blocks(benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> Iterator[Windows]:
    """The items in blocks of at most so many words, streamed through the driver one block at a time."""
    names, texts, held = [], [], 0
    for row in pick(benchmark, "item_id", "text").filter("item_id is not null and text is not null").toLocalIterator():
        size = len(row["text"]) // 2 + 1  # no text has more words
        if names and held + size > block_words:
            yield Windows(names, pa.array(texts, pa.string()), width)
            names, texts, held = [], [], 0
        names.append(str(row["item_id"]))
        texts.append(row["text"])
        held += size
    if names:
        yield Windows(names, pa.array(texts, pa.string()), width)


def find_contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP) -> DataFrame:
    """One row per row of ``documents`` (key, text): key, n_words, n_hit, items, near_items."""
    index = build_index(documents, width + slop)
    found = None
    for windows in item_blocks(benchmark, width):
        matches = search_index(index, windows, slop)
        found = matches if found is None else found.unionByName(matches)
    rows = index.select("shard", F.posexplode(F.arrays_zip("keys", "sizes")).alias("place", "row")).select(
        "shard", "place", F.col("row.keys").alias("key"), F.col("row.sizes").cast("long").alias("n_words")
    )
    none = F.lit(None).cast("array<string>")
    if found is None:
        rows = rows.withColumns({"n_hit": F.lit(0).cast("long"), "items": none, "near_items": none})
    else:
        merged = found.groupBy("shard", "place").agg(
            *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name) for name in ("words", "items", "near_items"))
        )
        merged = cut_lineage(merged.withColumn("n_hit", F.size("words").cast("long")).drop("words"))
        rows = rows.join(broadcast_if(merged, fits(merged, BROADCAST_ROWS)), ["shard", "place"], "left")
    empty = F.array().cast("array<string>")
    return rows.select(
        "key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), *(F.coalesce(name, empty).alias(name) for name in ("items", "near_items"))
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``documents`` without those that hold a window of an item."""
    rows = without_clashes(documents, ("doc_id", "text"), ("key",))
    # Rows with equal id and text are judged alike, so their digest identifies what to drop.
    digest = F.unhex(F.sha2(F.concat_ws(" ", F.col("doc_id").isNull().cast("string"), F.col("doc_id").cast("string"), F.col("text")), 256))
    keyed = rows.withColumn("key", digest)
    hits = find_contamination(keyed, benchmark, width).filter("n_hit > 0").select("key").distinct()
    hits = cut_lineage(hits)
    return keyed.join(broadcast_if(hits, fits(hits, BROADCAST_ROWS)), "key", "left_anti").drop("key")
