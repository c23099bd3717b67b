"""SimHash fingerprints of texts, and all pairs of them within a Hamming radius.

A text's terms are its pairs of neighbouring words (the first word is paired
with nothing), each with a weight from 1 to 4 by the length of the two words.
Every occurrence votes with its weight on each of 128 bits: for the bit if its
hash has it, against it otherwise. Votes are counted four to a long, in pieces
of a text short enough that no count runs over.

Fingerprints within ``RADIUS`` bits agree in at least two of five blocks,
whichever bits differ. Ten tables, one for each two blocks, therefore find every
such pair among the distinct fingerprints.

All expressions are built-in functions.

Defined cases: null is the empty text; texts without words have fingerprint 0;
equal texts have equal fingerprints; in the order of ids nulls come first, equal
ids follow the hash of their text, and equal rows count as one; a single text
is followed by itself.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from affinis.llm.frames import pick, shuffles_dropped
from affinis.runtime import cut_lineage

BITS, RADIUS, BLOCKS = 128, 3, 5
#: Terms of one piece of a text: with weights up to 4, 15 bits hold the votes.
PIECE = 4096
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LANES = 0x0001000100010001


def terms(text: Column) -> Column:
    """Hashes of the terms of a text; the two lowest bits are the weight less one."""
    words = F.filter(F.split(F.translate(text, _UPPER, _UPPER.lower()), NOT_WORD), lambda word: word != "")

    def term(before: Column, word: Column) -> Column:
        size = F.length(before) + F.length(word)
        weight = (size > 6).cast("long") + (size > 10).cast("long") + (size > 15).cast("long")
        return F.xxhash64(before, word).bitwiseAND(F.lit(-4)).bitwiseOR(weight)

    pairs = F.transform(F.array(words), lambda all_words: F.zip_with(F.slice(F.concat(F.array(F.lit("")), all_words), 1, F.size(all_words)), all_words, term))
    return F.element_at(pairs, 1)


def fingerprints(texts: DataFrame, *keys: str, together: bool = False) -> DataFrame:
    """``keys``, high and low: the two longs of the fingerprint of each text; ``keys`` must be unique.

    ``together``: equal keys are in one partition already.
    """
    pieces = texts.select(*keys, F.posexplode_outer(terms(F.col("text"))).alias("at", "term"))
    pieces = pieces.select(*keys, (F.col("at") / PIECE).cast("int").alias("piece"), "term", F.xxhash64("term").alias("second"))
    weight = F.col("term").bitwiseAND(F.lit(3)) + 1
    # The lowest bits of the first hash hold the weight; votes come from a hash of it, too.
    first = F.xxhash64("term", F.lit(1))
    votes = pieces.select(*keys, "piece", first.alias("first"), "second", weight.alias("weight"))
    lanes = [
        F.sum(F.shiftrightunsigned(name, shift).bitwiseAND(F.lit(_LANES)) * F.col("weight")).alias(f"{name}_{shift}")
        for name in ("first", "second")
        for shift in range(16)
    ]
    counted = votes.groupBy(*keys, "piece").agg(F.sum("weight").alias("weight"), *lanes)
    if not together:  # the packed votes are moved, not the four times wider ones below
        counted = counted.repartition(*keys)
    wide = [
        F.sum(F.shiftrightunsigned(f"{name}_{shift}", 16 * lane).bitwiseAND(F.lit(0xFFFF))).alias(f"{name}_{shift}_{lane}")
        for name in ("first", "second")
        for shift in range(16)
        for lane in range(4)
    ]
    summed = counted.groupBy(*keys).agg(F.sum("weight").alias("weight"), *wide)

    def bits(name: str) -> Column:
        chosen = [
            F.when(2 * F.col(f"{name}_{shift}_{lane}") > F.col("weight"), F.lit(1 << (shift + 16 * lane) if shift + 16 * lane < 63 else -(1 << 63))).otherwise(F.lit(0))
            for shift in range(16)
            for lane in range(4)
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), chosen)

    return summed.select(*keys, bits("first").alias("high"), bits("second").alias("low"))


def distance(high: str, low: str, other_high: str, other_low: str) -> Column:
    return F.bit_count(F.col(high).bitwiseXOR(F.col(other_high))) + F.bit_count(F.col(low).bitwiseXOR(F.col(other_low)))


def _blocks() -> list[Column]:
    """Five blocks of the two longs: 25 or 26 bits each, one of them across both."""
    def field(name: str, start: int, width: int) -> Column:
        return F.shiftrightunsigned(name, start).bitwiseAND(F.lit((1 << width) - 1))

    across = F.shiftleft(field("high", 52, 12), 13).bitwiseOR(field("low", 51, 13))
    return [field("high", 0, 26), field("high", 26, 26), across, field("low", 0, 26), field("low", 26, 25)]


def close_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(high, low, n_links) of each distinct fingerprint of ``prints`` (high, low, one row per text).

    n_links counts the other texts whose fingerprint is within ``radius`` (at most 3) bits.
    """
    distinct = cut_lineage(prints.groupBy("high", "low").agg(F.count(F.lit(1)).alias("texts")))
    blocks = _blocks()
    tables = F.array(*(F.struct(F.lit(number).alias("number"), a.alias("a"), b.alias("b")) for number, (a, b) in enumerate(combinations(blocks, 2))))
    spread = distinct.select("high", "low", "texts", F.explode(tables).alias("t")).select("high", "low", "texts", F.xxhash64("t").alias("place"))
    shared = spread.groupBy("place").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("place")
    spread = cut_lineage(spread.join(shared, "place", "left_semi"))
    other = spread.select("place", F.col("high").alias("other_high"), F.col("low").alias("other_low"), F.col("texts").alias("other_texts"))
    same = (F.col("high") == F.col("other_high")) & (F.col("low") == F.col("other_low"))
    pairs = (
        spread.join(other, "place")
        .filter(~same & (distance("high", "low", "other_high", "other_low") <= radius))
        .select("high", "low", "other_high", "other_low", "other_texts")
        .distinct()
    )
    found = pairs.groupBy("high", "low").agg(F.sum("other_texts").alias("others"))
    return distinct.join(found, ["high", "low"], "left").select("high", "low", (F.col("texts") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def successors(rows: DataFrame) -> DataFrame:
    """Each distinct (doc_id, text_hash) with the next in order, the first after the last.

    Keys are range-partitioned and sorted; the last of a partition is followed by
    the first of the next partition, of which the driver sees one key each.
    """
    spark = rows.sparkSession
    keys = rows.select("doc_id", "text_hash").distinct()
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(keys.repartitionByRange(count, F.col("doc_id").asc_nulls_first(), "text_hash").withColumn("part", F.spark_partition_id()))
    # Structs order nulls first, as the range partitioning does.
    key = F.struct("doc_id", "text_hash")
    firsts = ordered.groupBy("part").agg(F.min(key).alias("first")).orderBy("part").collect()
    within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "text_hash")
    led = ordered.withColumn("following", F.lead(key).over(within))
    if not firsts:
        return led.select("doc_id", "text_hash", F.col("doc_id").alias("next_id"), F.col("text_hash").alias("next_hash"))
    after = [(row["part"], firsts[(at + 1) % len(firsts)]["first"]["doc_id"], firsts[(at + 1) % len(firsts)]["first"]["text_hash"]) for at, row in enumerate(firsts)]
    kind = ordered.schema["doc_id"].dataType.simpleString()
    wrapped = spark.createDataFrame(after, f"part int, first_id {kind}, first_hash long")
    chosen = led.join(F.broadcast(wrapped), "part", "left")
    last = F.col("following").isNull()
    return chosen.select(
        "doc_id",
        "text_hash",
        F.when(last, F.col("first_id")).otherwise(F.col("following.doc_id")).alias("next_id"),
        F.when(last, F.col("first_hash")).otherwise(F.col("following.text_hash")).alias("next_hash"),
    )


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of texts, and of texts whose second half is the beginning of the next text.

    Columns: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint
    (hexadecimal), near_edited and near_next (share of equal bits), n_links
    (other documents within ``RADIUS`` bits).
    """
    rows = pick(documents, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    narrow = rows.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), half.alias("half")).distinct()
    spark = documents.sparkSession
    # Disk is short here: what is shuffled for a table goes once the table is written.
    with shuffles_dropped(spark):
        order = successors(rows)
    before = order.join(narrow, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))).select(
        F.col("next_id").alias("to_id"), F.col("next_hash").alias("to_hash"), F.col("doc_id").alias("for_id"), F.col("text_hash").alias("for_hash"), F.col("half").alias("for_half")
    )
    with shuffles_dropped(spark):
        before = cut_lineage(before)
    # Each text goes once to where its predecessor is known, and from there in two parts:
    # its first half to its own row, its beginning to its predecessor's.
    placed = rows.join(before, F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.col("text_hash") == F.col("to_hash")))

    def part(own: bool, doc_id: str, text_hash: str, size: Column) -> Column:
        place = [F.lit(own).alias("own"), F.col(doc_id).alias("doc_id"), F.col(text_hash).alias("text_hash")]
        return F.struct(*place, "n_chars", F.col("text_hash").alias("part_hash"), F.col("text").substr(F.lit(1), size).alias("part"))

    first_half = F.col("n_chars").cast("int") - half
    parts = placed.select(F.inline(F.array(part(True, "doc_id", "text_hash", first_half), part(False, "for_id", "for_hash", F.col("for_half")))))
    own, other = F.col("own"), ~F.col("own")
    met = parts.groupBy("doc_id", "text_hash").agg(
        F.count_if(own).alias("copies"),
        F.max(F.when(own, F.col("n_chars"))).alias("n_chars"),
        F.max(F.when(other, F.col("n_chars"))).alias("next_chars"),
        F.max(F.when(other, F.col("part_hash"))).alias("next_hash"),
        F.concat(F.max(F.when(own, F.col("part"))), F.max(F.when(other, F.col("part")))).alias("text"),
    )
    keys = ["doc_id", "text_hash", "n_chars", "copies", "next_chars", "next_hash", "edited_sha256"]
    edited = fingerprints(met.withColumn("edited_sha256", F.sha2("text", 256)), *keys, together=True)
    edited = edited.withColumnsRenamed({"high": "edited_high", "low": "edited_low"})
    # Equal texts have one fingerprint, so they need not be told apart.
    numbered = rows.select(F.monotonically_increasing_id().alias("row_no"), "text_hash", "n_chars", "text")
    with shuffles_dropped(spark):
        prints = cut_lineage(fingerprints(numbered, "row_no", "text_hash", "n_chars").drop("row_no").distinct())
    nexts = prints.select(*(F.col(name).alias(f"next_{name}") for name in ("high", "low")), F.col("text_hash").alias("next_hash"), F.col("n_chars").alias("next_chars"))
    joined = edited.join(prints, ["text_hash", "n_chars"]).join(nexts, ["next_hash", "next_chars"])
    with shuffles_dropped(spark):
        joined = cut_lineage(joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))
    joined = joined.join(close_counts(joined.select("high", "low")), ["high", "low"])

    def text_of(high: str, low: str) -> Column:
        return F.lower(F.concat(*(F.lpad(F.hex(name), 16, "0") for name in (high, low))))

    def likeness(high: str, low: str) -> Column:
        return 1.0 - distance("high", "low", high, low) / F.lit(float(BITS))

    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of("high", "low").alias("fingerprint"),
        text_of("edited_high", "edited_low").alias("edited_fingerprint"),
        likeness("edited_high", "edited_low").alias("near_edited"),
        likeness("next_high", "next_low").alias("near_next"),
        "n_links",
    )
