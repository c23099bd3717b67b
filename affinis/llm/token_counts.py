"""Token counts of texts from the piece counts of their distinct pre-tokens.

For tokenizers that drop white space and never merge across it. A pre-token is
a run without ASCII white space, also cut between an ASCII letter and one of
``. , ; : ! ?``: the tokenizer's own pre-tokens never cross these places, and no
special token holds them. Each distinct pre-token is tokenized once; a text's
count is the sum over its pre-tokens. Token ids are never kept.

The piece counts of the most frequent pre-tokens, as many as a fixed bound, go
to every task. Occurrences of others are joined by shuffle, which is then free
of hot keys.

Defined cases: null is the empty text, with 0 tokens; repeated rows are counted
each; special tokens inside texts count as the tokenizer's default has it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from affinis.llm.frames import fits, text_or_empty, without_clashes
from affinis.llm.text import Lookup, bounded, hash_spans, lists, rows_of, signed, utf8
from affinis.runtime import cut_lineage

TOKEN_LIMIT = 2048
#: Pre-tokens whose counts are sent to all tasks (12 bytes each).
BROADCAST_PIECES = 4_000_000
#: Bytes of text cut at once, and of pre-tokens given to the tokenizer at once.
SLICE_BYTES, ENCODE_BYTES = 4 << 20, 1 << 16
_SAME = np.arange(256, dtype=np.uint8)


def _kinds() -> np.ndarray:
    """0 white space, 1 ASCII letter, 2 cutting punctuation, 3 other."""
    table = np.full(256, 3, dtype=np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[65:91] = table[97:123] = 1
    table[[ord(c) for c in ".,;:!?"]] = 2
    return table


KINDS = _kinds()


def pretokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, row boundaries) of the pre-tokens of a column."""
    raw, offsets = utf8(column)
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return raw, none, none, np.zeros(len(offsets), dtype=np.int64)
    kind = KINDS[raw]
    before, after = kind[:-1], kind[1:]
    cut = np.ones(len(raw) + 1, dtype=bool)
    cut[1:-1] = ((before == 0) != (after == 0)) | ((before == 1) & (after == 2)) | ((before == 2) & (after == 1))
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    kept = kind[starts] != 0
    starts, ends = starts[kept], ends[kept]
    return raw, starts, ends, np.searchsorted(starts, offsets)


def piece_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(key, seen, pieces) of every distinct pre-token of ``documents`` (text)."""
    definition = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 0, SLICE_BYTES):
            raw, starts, ends, _ = pretokens(batch.column(0))
            keys, first, seen = np.unique(hash_spans(raw, starts, ends, _SAME), return_index=True, return_counts=True)
            texts = [raw[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            columns = [pa.array(signed(keys)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(seen)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "pretoken", "seen"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        # Spark already runs a task per core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = Tokenizer.from_str(definition.value)
        model.no_truncation()
        model.no_padding()
        for batch in bounded(batches, 1, ENCODE_BYTES):
            pieces = [len(one) for one in model.encode_batch(batch.column(1).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pieces, pa.int32())], names=["key", "seen", "pieces"])

    distinct = (
        documents.select("text")
        .mapInArrow(collect, "key long, pretoken string, seen long")
        .groupBy("key", "pretoken")
        .agg(F.sum("seen").alias("seen"))
    )
    return cut_lineage(distinct.mapInArrow(count, "key long, seen long, pieces int"))


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = TOKEN_LIMIT, broadcast_pieces: int = BROADCAST_PIECES) -> DataFrame:
    """All columns of ``documents``, n_bytes, n_tokens and over_limit."""
    rows = without_clashes(documents, ("text",), ("n_bytes", "n_tokens", "over_limit", "rest", "row_no", "more"))
    pieces = piece_counts(rows, tokenizer)
    whole = fits(pieces, broadcast_pieces)
    sent = pieces if whole else pieces.orderBy(F.desc("seen"), "key").limit(broadcast_pieces)
    table = sent.select("key", "pieces").toArrow()
    keys = table.column("key").to_numpy().astype(np.int64).view(np.uint64)
    lookup = rows.sparkSession.sparkContext.broadcast(Lookup(keys, table.column("pieces").to_numpy().astype(np.int32)))
    names, at = rows.columns, rows.columns.index("text")
    added = [StructField("n_tokens", LongType())] + ([] if whole else [StructField("rest", ArrayType(LongType()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_pieces = lookup.value
        for batch in bounded(batches, at, SLICE_BYTES):
            raw, starts, ends, bounds = pretokens(batch.column(at))
            asked, row = hash_spans(raw, starts, ends, _SAME), rows_of(bounds)
            value, known = known_pieces.find(asked)
            total = np.bincount(row, weights=value, minlength=len(batch)).astype(np.int64)
            columns = [*batch.columns, pa.array(total)]
            if not whole:
                columns.append(lists(signed(asked[~known]), np.searchsorted(row[~known], np.arange(len(batch) + 1)), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(field.name for field in added)])

    counted = rows.mapInArrow(add, StructType([*rows.schema.fields, *added]))
    if not whole:
        counted = cut_lineage(counted.withColumn("row_no", F.monotonically_increasing_id()))
        others = pieces.select("key", "pieces").join(sent.select("key"), "key", "left_anti")
        more = (
            counted.select("row_no", F.explode("rest").alias("key"))
            .groupBy("row_no", "key")
            .agg(F.count(F.lit(1)).alias("times"))
            .join(others, "key")
            .groupBy("row_no")
            .agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
        )
        total = (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens")
        counted = counted.join(more, "row_no", "left").select(*names, total)
    return counted.select(
        *names, F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
