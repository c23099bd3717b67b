"""Phrases whose words occur together more often than apart.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends and
into words at blanks. Each task counts the phrases of one to three words of a
shard of text, sorts them and builds count automata, one for each range of
hashed prefixes (first words). The automata of a range are united and their
counts added up. Ranges that turn out to hold more phrases than one task should
are dealt again, by whole phrases.

A phrase of two or three words with at least ``least`` occurrences is a
candidate, and so are then all its parts frequent. Each range asks the ranges of
the parts for their counts, once per part; the asked phrases, as an automaton,
are composed with the counts there. A question about a part inside a longer
candidate also says how often the longer one occurs, which decides whether the
part is dropped. All arithmetic on counts is in whole numbers of any length.

Only the totals per language and one number of phrases per range reach the
driver. A word or phrase that is very common is one arc per automaton, and
one question per range.

Defined cases: null lang is ``und``; null, empty and blank texts have no words;
a piece of one word has no phrases; equal rows count each; ties of the lowest
cut go to the earlier cut, ties of rank to the more frequent phrase and then to
the phrase that is first in byte order; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.llm.automata import LEVELS, CountAutomaton, Phrases, joint_alphabet, keys, summed, union
from affinis.llm.frames import pick
from affinis.llm.text import FOLD, bounded, hash_spans, mix, pair_key, spans, utf8
from affinis.runtime import cut_lineage

LEAST, BEST, SHARE, UNIT = 10, 2000, 50, 1_000_000
NO_LANGUAGE = "und"
#: Bytes of text whose phrases one range holds on average, and phrases it may hold before it is dealt again.
RANGE_BYTES, RANGE_PHRASES = 12 << 20, 6_000_000
#: Bytes of text and words counted together in a task.
SHARD_BYTES, SHARD_WORDS = 6 << 20, 1_000_000
BATCH_BYTES = 8 << 20

_PUNCTUATION, _BLANK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BLANK[[ord(" "), ord("\t")]] = True
_SAME = np.arange(256, dtype=np.uint8)
_U64 = np.uint64
#: Phrases whose hashes are computed at once.
_STEP = 1 << 17

_FRAGMENTS = "bucket int, lang string, phrases long, automaton binary"
_UNITED = "bucket int, lang string, origin int, part string, number long, automaton binary"
_ANSWERS = "bucket int, lang string, part string, number long, longer long"
_SCORED = "lang string, phrase string, a long, l long, r long, score long"


def _language(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() or b"\0", dtype=np.uint8)
    return hash_spans(data, np.array([0]), np.array([len(data)]), _SAME)[0]


class Ranges:
    """Ranges of the hash order of prefixes, and the pieces of those that are dealt again."""

    def __init__(self, count: int, pieces: dict[int, int] | None = None):
        self.count = count
        self._pieces = np.ones(count, dtype=np.int64)
        for bucket, number in (pieces or {}).items():
            self._pieces[bucket] = number
        self._more = count + np.cumsum(self._pieces - 1) - (self._pieces - 1)

    def of(self, lang: str, phrases: Phrases) -> np.ndarray:
        """The range of each phrase."""
        raw, edges = utf8(phrases.alphabet)
        word = np.append(hash_spans(raw, edges[:-1], edges[1:], _SAME) if len(phrases.alphabet) else np.zeros(0, dtype=_U64), _U64(0))
        out, language = np.empty(len(phrases), dtype=np.int32), _language(lang)
        for at in range(0, len(out), _STEP):
            first, second, third = (word[phrases.words[at : at + _STEP, level]] for level in range(LEVELS))
            prefix = mix(first ^ language)
            bucket = ((prefix >> _U64(33)) * _U64(self.count) >> _U64(31)).astype(np.int64)
            piece = (pair_key(pair_key(prefix, second), third) % self._pieces[bucket].astype(_U64)).astype(np.int64)
            out[at : at + _STEP] = np.where(piece > 0, self._more[bucket] + piece - 1, bucket)
        return out


# ---- counting a shard -------------------------------------------------------------------------------


def count_phrases(texts: pa.Array) -> Iterator[Phrases]:
    """The phrases of texts with their counts, at most SHARD_WORDS words at a time."""
    raw, offsets = utf8(texts)
    raw = FOLD[raw]
    breaks = _PUNCTUATION[raw]
    inside = ~(breaks | _BLANK[raw])
    starts, ends = spans(inside, offsets)
    if not len(starts):
        return
    # Two words share a piece if neither a row nor punctuation begins between them.
    rows, marks = (np.searchsorted(edges, starts, side="right") for edges in (offsets, np.flatnonzero(breaks)))
    joined = np.append((rows[1:] == rows[:-1]) & (marks[1:] == marks[:-1]), [False, False])
    for low in range(0, len(starts), SHARD_WORDS):
        # The next two words may end a phrase that begins here.
        high, more = min(low + SHARD_WORDS, len(starts)), min(low + SHARD_WORDS + 2, len(starts))
        stretch = slice(starts[low], ends[more - 1])
        edges = np.concatenate([[0], np.cumsum(ends[low:more] - starts[low:more])])
        data = raw[stretch][inside[stretch]]
        words = pa.Array.from_buffers(pa.large_binary(), more - low, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
        alphabet, (number,) = joint_alphabet([words])
        count, size = high - low, len(alphabet) + 1
        number = np.append(number, np.array([-1, -1], dtype=np.int32)) + np.int32(1)
        two = np.flatnonzero(joined[low:high])
        three = two[joined[low + 1 : high + 1][two]]
        # A phrase is a number in base ``size``, 0 after its end, so that numbers sort as phrases do.
        key = np.empty(count + len(two) + len(three), dtype=np.int64)
        for part, begin in ((key[:count], np.arange(count)), (key[count : count + len(two)], two), (key[count + len(two) :], three)):
            np.multiply(number[begin], size * size, out=part, dtype=np.int64)
        key[count:] += number[np.concatenate([two, three]) + 1].astype(np.int64) * size
        key[count + len(two) :] += number[three + 2]
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.diff(np.append(first, len(key)))
        key = key[first]
        out = np.empty((len(key), LEVELS), dtype=np.int32)
        for level in range(LEVELS - 1, -1, -1):
            rest = key // size
            out[:, level] = key - rest * size - 1
            key = rest
        yield Phrases(out, total, alphabet)


def _dealt(lang: str, phrases: Phrases, ranges: Ranges) -> Iterator[tuple[int, str, int, bytes]]:
    """Fragment rows: an automaton for each range that has some of the phrases."""
    bucket = ranges.of(lang, phrases)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(bucket[rows[0]]), lang, len(rows), CountAutomaton.build(phrases.select(rows)).to_bytes()


def _batches(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is bytes, as batches of about ``most`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most:
            yield _batch(held, kinds)
            held, size = [], 0
    if held:
        yield _batch(held, kinds)


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = [pa.array(list(column), kind) for column, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in kinds])


_FRAGMENT_KINDS = [("bucket", pa.int32()), ("lang", pa.string()), ("phrases", pa.int64()), ("automaton", pa.binary())]


def _give_back() -> None:
    """Freed memory goes back to the system: the worker lives on beside other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextmanager
def _small_batches(spark: SparkSession):
    """Texts reach Python in batches of BATCH_BYTES meanwhile."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _shard_kernel(ranges: Ranges):
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict[str, list[pa.Array]] = {}
        size = 0

        def flush() -> Iterator[tuple]:
            for lang in sorted(held):
                for phrases in count_phrases(pa.concat_arrays(held[lang])):
                    yield from _dealt(lang, phrases, ranges)
            held.clear()

        for batch in bounded(batches, 1, SHARD_BYTES):
            coded = batch.column(0).fill_null(NO_LANGUAGE).dictionary_encode()
            texts = batch.column(1).fill_null("").cast(pa.large_string())
            size += texts.nbytes
            for number, lang in enumerate(coded.dictionary.to_pylist()):
                held.setdefault(lang, []).append(texts.filter(pc.equal(coded.indices, number)))
            if size >= SHARD_BYTES:
                yield from flush()
                size = 0
        yield from flush()
        _give_back()

    return lambda batches: _batches(shard(batches), _FRAGMENT_KINDS)


def _redeal_kernel(ranges: Ranges):
    def redeal(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for lang, automaton in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                yield from _dealt(lang, CountAutomaton.from_bytes(automaton.as_py()).phrases(), ranges)

    return lambda batches: _batches(redeal(batches), _FRAGMENT_KINDS)


# ---- uniting a range, and asking others -------------------------------------------------------------


def _parts(candidates: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(words of the part, candidate rows, lies in a longer candidate) of the sides of every cut."""
    length, words = candidates.lengths(), candidates.words
    for size, sides in ((2, ((0, 1), (1, 2))), (3, ((0, 1), (1, 3), (0, 2), (2, 3)))):
        rows = np.flatnonzero(length == size)
        for begin, end in sides:
            part = np.full((len(rows), LEVELS), -1, dtype=np.int32)
            part[:, : end - begin] = words[rows, begin:end]
            yield part, rows, end - begin > 1


def _questions(candidates: Phrases) -> Phrases:
    """Distinct parts, each with the count of the most frequent candidate around it that may drop it."""
    parts, longer = [], []
    for part, rows, inside in _parts(candidates):
        parts.append(part)
        longer.append(candidates.numbers[rows] if inside else np.zeros(len(rows), dtype=np.int64))
    return summed(np.concatenate(parts), np.concatenate(longer), candidates.alphabet, np.maximum)


def _by_language(table: pa.Table, column: str = "automaton") -> dict[str, list[bytes]]:
    found: dict[str, list[bytes]] = {}
    for lang, data in zip(table["lang"].to_pylist(), table[column], strict=True):
        if data.is_valid:
            found.setdefault(lang, []).append(data.as_py())
    return found


def _union_kernel(ranges: Ranges, least: int):
    """Function of the fragments of a range: totals (bucket -1), frequent phrases and questions."""

    def unite(table: pa.Table) -> pa.Table:
        own, out = table["bucket"][0].as_py(), []
        for lang, fragments in sorted(_by_language(table).items()):
            frequent, words = union(fragments, least)
            out.append(pa.table([[-1], [lang], [own], [""], [words], [None]], schema=_UNITED_KIND))
            if not len(frequent):
                continue
            out.append(pa.table([[own], [lang], [own], [""], [len(frequent)], [CountAutomaton.build(frequent).to_bytes()]], schema=_UNITED_KIND))
            asked = _questions(frequent.select(np.flatnonzero(frequent.lengths() > 1)))
            if len(asked):
                rest = [pa.array([lang] * len(asked), pa.string()), pa.array(np.full(len(asked), own, dtype=np.int32)), asked.texts().cast(pa.string())]
                columns = [pa.array(ranges.of(lang, asked)), *rest, pa.array(asked.numbers), pa.nulls(len(asked), pa.binary())]
                out.append(pa.Table.from_arrays(columns, schema=_UNITED_KIND))
        _give_back()
        return pa.concat_tables(out)

    return unite


_UNITED_KIND = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("origin", pa.int32()), ("part", pa.string()), ("number", pa.int64()), ("automaton", pa.binary())])
_ANSWER_KIND = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("part", pa.string()), ("number", pa.int64()), ("longer", pa.int64())])
_SCORED_KIND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())])


def _spelled(texts: pa.Array, numbers: np.ndarray) -> tuple[Phrases, np.ndarray]:
    """(distinct phrases with the largest of their numbers, row of each text among them)."""
    split = pc.split_pattern(texts.cast(pa.large_binary()), b" ")
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    alphabet, (number,) = joint_alphabet([split.flatten()])
    words = np.full((len(texts), LEVELS), -1, dtype=np.int32)
    row = np.repeat(np.arange(len(texts)), lengths)
    words[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = number
    phrases = summed(words, numbers, alphabet, np.maximum)
    return phrases, np.searchsorted(keys(phrases.words, len(alphabet)), keys(words, len(alphabet)))


def _answer_kernel(table: pa.Table) -> pa.Table:
    """Answers to the questions a range got; the asked phrases run through its counts."""
    out = [_ANSWER_KIND.empty_table()]
    own = {lang: data[0] for lang, data in _by_language(table).items()}
    asked = table.filter(pc.is_null(table["automaton"]))
    for lang in sorted(set(asked["lang"].to_pylist())):
        rows = asked.filter(pc.equal(asked["lang"], lang)).combine_chunks()
        texts = rows["part"].combine_chunks() if isinstance(rows["part"], pa.ChunkedArray) else rows["part"]
        phrases, at = _spelled(texts, rows["number"].to_numpy())
        # A part of a frequent phrase is frequent, so its range has counts of this language.
        counts = CountAutomaton.from_bytes(own[lang]).compose(phrases)
        origins = rows["origin"].combine_chunks() if isinstance(rows["origin"], pa.ChunkedArray) else rows["origin"]
        none = pa.array(np.zeros(len(rows), dtype=np.int64))
        out.append(pa.Table.from_arrays([origins, pa.array([lang] * len(rows), pa.string()), texts, pa.array(counts[at]), none], schema=_ANSWER_KIND))
        inside = np.flatnonzero(phrases.numbers > 0)
        if len(inside):
            # What lies in a longer candidate is told to the range itself.
            marked = phrases.select(inside)
            here = pa.array(np.full(len(inside), table["bucket"][0].as_py(), dtype=np.int32))
            columns = [here, pa.array([lang] * len(inside), pa.string()), marked.texts().cast(pa.string()), pa.array(np.zeros(len(inside), dtype=np.int64)), pa.array(marked.numbers)]
            out.append(pa.Table.from_arrays(columns, schema=_ANSWER_KIND))
    return pa.concat_tables(out)


def _score_kernel(unit: int, share: int):
    """Function of (a range's frequent phrases, the answers it got): scored candidates that are not dropped."""

    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = [_SCORED_KIND.empty_table()]
        for lang, data in sorted(_by_language(own).items()):
            rows = answers.filter(pc.equal(answers["lang"], lang)).combine_chunks()
            frequent = CountAutomaton.from_bytes(data[0]).phrases()
            candidates = frequent.select(np.flatnonzero(frequent.lengths() > 1))
            if not len(candidates):
                continue
            texts = rows["part"].combine_chunks() if isinstance(rows["part"], pa.ChunkedArray) else rows["part"]
            counts = CountAutomaton.build(_spelled(texts, rows["number"].to_numpy())[0])
            told = CountAutomaton.build(_spelled(texts, rows["longer"].to_numpy())[0])
            sides = [np.zeros((4, len(candidates)), dtype=np.int64), np.zeros((4, len(candidates)), dtype=np.int64)]
            for turn, (part, at, _) in enumerate(_parts(candidates)):
                # Of two words sides 0 and 1, of three words 2 to 5: first and rest, cut by cut.
                cut = 0 if turn < 2 else turn // 2 - 1
                sides[turn % 2][cut, at] = counts.compose(Phrases(part, np.zeros(len(part), dtype=np.int64), candidates.alphabet))
            longer = told.compose(Phrases(candidates.words, candidates.numbers, candidates.alphabet))
            kept = []
            for row, (a, size, around) in enumerate(zip(candidates.numbers.tolist(), candidates.lengths().tolist(), longer.tolist(), strict=True)):
                if 100 * around >= share * a and around:
                    continue
                cuts = [(unit * a * a // (int(sides[0][k, row]) * int(sides[1][k, row])), k) for k in range(size - 1)]
                value, k = min(cuts)
                kept.append((row, a, int(sides[0][k, row]), int(sides[1][k, row]), value))
            if kept:
                chosen, a, left, right, value = zip(*kept, strict=True)
                phrase = candidates.texts().cast(pa.string()).take(pa.array(chosen))
                out.append(pa.Table.from_arrays([pa.array([lang] * len(kept), pa.string()), phrase, *(pa.array(x, pa.int64()) for x in (a, left, right, value))], schema=_SCORED_KIND))
        return pa.concat_tables(out)

    return score


def _hot_ranges(fragments: DataFrame, most: int) -> dict[int, int]:
    """Pieces of the ranges with more than ``most`` phrases in their fragments."""
    sums = fragments.groupBy("bucket").agg(F.sum("phrases").alias("phrases")).filter(F.col("phrases") > most)
    return {row["bucket"]: math.ceil(row["phrases"] / most) for row in sums.collect()}


def collocations(
    documents: DataFrame,
    least: int = LEAST,
    best: int = BEST,
    share: int = SHARE,
    unit: int = UNIT,
    range_bytes: int = RANGE_BYTES,
    range_phrases: int = RANGE_PHRASES,
) -> DataFrame:
    """The ``best`` collocations of each language of ``documents`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    ``a``, ``l`` and ``r`` count the phrase and the two sides of its weakest cut,
    ``score`` is unit a a / (l r), floored, and ``n`` counts the language's
    words. Phrases inside a longer candidate with ``share`` per cent of their
    occurrences or more are left out.
    """
    texts = pick(documents, "lang", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = Ranges(max(1, math.ceil(size / range_bytes)))
    with _small_batches(texts.sparkSession):
        fragments = cut_lineage(texts.mapInArrow(_shard_kernel(ranges), _FRAGMENTS))
    hot = _hot_ranges(fragments, range_phrases)
    if hot:
        ranges = Ranges(ranges.count, hot)
        is_hot = F.col("bucket").isin(list(hot))
        fragments = fragments.filter(~is_hot).unionByName(fragments.filter(is_hot).mapInArrow(_redeal_kernel(ranges), _FRAGMENTS))
    united = cut_lineage(fragments.groupBy("bucket").applyInArrow(_union_kernel(ranges, least), _UNITED))
    counted = united.filter("bucket >= 0")
    answers = counted.groupBy("bucket").applyInArrow(_answer_kernel, _ANSWERS)
    own = counted.filter(F.col("automaton").isNotNull())
    scored = own.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_score_kernel(unit, share), _SCORED)
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Where the session's windowGroupLimitThreshold is at least ``best``, each task drops what is not among its own first ones.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = scored.withColumn("rank", place).filter(F.col("rank") <= best).withColumn("rank", F.col("rank").cast("long"))
    totals = united.filter("bucket < 0").groupBy("lang").agg(F.sum("number").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
