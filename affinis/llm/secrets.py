"""Secrets in texts: fixed patterns, and tokens that pass randomness tests.

Tokens are long runs of characters that encodings use. The smallest alphabet
that holds a token is taken as its encoding; tokens of letters only or digits
only are words and numbers. Three tests ask whether a token could be a uniform
draw from its alphabet: chi-squared of the character counts, the number of runs
in the lower and upper half of the alphabet, and the serial correlation of
neighbours. Fisher's method makes one p-value of them.

P-values of random tokens are uniform, those of ordinary tokens lie near zero.
Among the distinct tokens of one encoding and length, the number of random ones
follows from the p-values above one half; what lies above a threshold beyond
their share is false. The lowest threshold with a false-discovery rate of at
most ``RATE`` is used for that encoding and length, so short tokens, on which
the tests have little power, need more. Where none reaches the rate, the tests
find nothing.

All expressions are built-in functions; nothing is shuffled but the distinct
tokens, and the driver gets one count per encoding, length class and p-value
class.

Defined cases: null is the empty text; spans count code points, ends are
exclusive; found tokens that overlap a pattern's span are left out; an input
column named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.frames import text_or_empty, without_clashes

# Kinds of secrets and their patterns, in the order of the kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LENGTH = 8

TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Alphabets by size; a token's encoding is the first that holds it.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "upper_hex": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "upper_base36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
#: Lower ends of the length classes.
LENGTHS = (20, 32, 48, 80)
#: Classes of p-values, and the false-discovery rate that is allowed.
BINS, RATE = 20, 0.1
MARK = "[SECRET]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array, in blocks of about the root of its length."""

    def sums(array: Column, width: Column) -> Column:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(array) - 1) / width).cast("int")),
                lambda block: let(
                    F.aggregate(F.slice(array, 1, block * width), F.lit(0), lambda a, b: a + b),
                    lambda before: let(
                        F.slice(array, block * width + 1, width),
                        lambda own: F.transform(
                            own, lambda _, at: before + F.aggregate(F.slice(own, 1, at + 1), F.lit(0), lambda a, b: a + b)
                        ),
                    ),
                ),
            )
        )

    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(numbers).cast("double"))).cast("int"))
    filled = let(numbers, lambda array: sums(array, width))
    return F.when(F.size(numbers) > 0, filled).otherwise(F.array().cast("array<int>"))


def found_spans(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None, extra: Column | None = None) -> Column:
    """array<struct<start, kind_no, end, token>> of the matches of ``pattern``; ``keep`` filters by ``extra``."""
    rule, number = F.lit(pattern), F.lit(KINDS.index(kind))
    matched = F.regexp_extract_all(text, rule, F.lit(0))
    # The pieces between matches give the places: each start is the length of all that lies before it.
    gaps = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))

    def spans(tokens: Column) -> Column:
        sizes = F.transform(tokens, lambda token: F.length(token))
        before = F.concat(F.array(F.lit(0)), sizes)
        starts = running_sums(F.slice(F.zip_with(gaps, before, lambda a, b: a + b), 1, F.size(tokens)))
        return F.zip_with(
            starts,
            tokens,
            lambda start, token: F.struct(
                start.alias("start"), number.alias("kind_no"), (start + F.length(token)).alias("end"), token.alias("token")
            ),
        )

    found = let(matched, spans)
    if keep is not None:
        kept = F.filter(F.zip_with(found, extra, lambda span, value: F.struct(span.alias("span"), value.alias("value"))), lambda x: keep(x["value"]))
        found = F.transform(kept, lambda x: x["span"])
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,token:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def base_spans(text: Column) -> Column:
    assigned = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return F.array_sort(
        F.concat(
            found_spans(text, ASSIGN, "assign", lambda value: F.length(value) >= ASSIGN_LENGTH, assigned),
            found_spans(text, ACCESS, "access"),
            found_spans(text, HEX, "hex"),
        )
    )


def encoding(token: Column) -> Column:
    """Name of the encoding, or null."""
    body = F.regexp_replace(token, "=+$", "")
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    chain = F.when(~mixed, F.lit(None).cast("string"))
    for name, alphabet in ENCODINGS.items():
        chain = chain.when(body.rlike(f"^[{alphabet.replace('-', '') + ('-' if '-' in alphabet else '')}]+$"), F.lit(name))
    return chain


def _length_class(token: Column) -> Column:
    return reduce(lambda so_far, least: so_far + (F.length(token) >= least).cast("int"), LENGTHS[1:], F.lit(0))


def _upper_tail(z: Column) -> Column:
    """Of the normal distribution, to about 1e-4; never 0."""
    bounded = F.least(F.greatest(z, F.lit(-7.0)), F.lit(7.0))
    return 1.0 / (1.0 + F.exp(1.5976 * bounded + 0.07056 * bounded * bounded * bounded))


def p_value(token: Column, name: Column) -> Column:
    """Of uniformity over the alphabet of the encoding ``name``."""
    by_name = [(key, alphabet) for key, alphabet in ENCODINGS.items()]

    def choose(value: Callable[[str], Column]) -> Column:
        return F.coalesce(*(F.when(name == key, value(alphabet)) for key, alphabet in by_name))

    def halves(body: Column, alphabet: str) -> Column:
        middle = len(alphabet) // 2
        return F.translate(body, alphabet, "L" * middle + "H" * (len(alphabet) - middle))

    def tests(body: Column) -> Column:
        n = F.length(body).cast("double")
        alphabet = choose(F.lit)
        k = F.length(alphabet).cast("double")
        symbols = F.filter(F.split(alphabet, ""), lambda c: c != "")
        squares = F.aggregate(
            symbols, F.lit(0.0), lambda total, c: total + F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0))
        )
        freedom = k - 1
        cube = F.pow((k / n * squares - n) / freedom, F.lit(1.0 / 3.0))
        chi = (cube - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))

        def runs(half: Column) -> Column:
            low = F.length(F.replace(half, F.lit("H"), F.lit(""))).cast("double")
            count = F.length(F.regexp_replace(half, "L+|H+", "x"))
            mean = 2 * low * (n - low) / n + 1
            spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
            return F.when((low > 0) & (low < n), (count - mean) / spread).otherwise(F.lit(7.0))

        values = F.transform(
            F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.position(c, alphabet).cast("double") - (k + 1) / 2
        )
        products = let(
            values,
            lambda x: F.aggregate(
                F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b
            ),
        )
        serial = products / F.sqrt(n - 1) / ((k * k - 1) / 12)
        both_sides = lambda z: F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))
        logs = F.log(_upper_tail(chi)) + F.log(both_sides(let(choose(lambda a: halves(body, a)), runs))) + F.log(both_sides(serial))
        return let(-logs, lambda x: F.exp(-x) * (1 + x + x * x / 2))

    return let(F.regexp_replace(token, "=+$", ""), tests)


def _class_of(p: Column) -> Column:
    return F.least(F.floor(p * BINS).cast("int"), F.lit(BINS - 1))


def thresholds(documents: DataFrame) -> dict[tuple[str, int], float]:
    """Lowest p-value of a discovery, by encoding and length class; absent where there is none."""
    text = text_or_empty()
    tokens = (
        documents.select(F.explode(F.when(text.rlike(TOKEN), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))).alias("token"))
        .select("token", encoding(F.col("token")).alias("encoding"))
        .filter("encoding is not null")
        .distinct()
    )
    counted = (
        tokens.select("encoding", _length_class(F.col("token")).alias("size"), _class_of(p_value(F.col("token"), F.col("encoding"))).alias("bin"))
        .groupBy("encoding", "size", "bin")
        .count()
        .collect()
    )
    table: dict[tuple[str, int], list[int]] = {}
    for row in counted:
        table.setdefault((row["encoding"], row["size"]), [0] * BINS)[row["bin"]] += row["count"]
    chosen = {}
    for key, counts in table.items():
        random = 2 * sum(counts[BINS // 2 :])
        for low in range(1, BINS // 2 + 1):
            above = sum(counts[low:])
            false = max(0.0, above - random * (1 - low / BINS)) + 1
            if above and false / above <= RATE:
                chosen[key] = low / BINS
                break
    return chosen


def random_spans(text: Column, limits: dict[tuple[str, int], float]) -> Column:
    """Spans of the tokens that pass, as ``found_spans``."""
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,token:string>>")
    if not limits:
        return none

    def passes(token: Column, name: Column) -> Column:
        size = _length_class(token)
        cases = [F.when((name == key) & (size == number), F.lit(limit)) for (key, number), limit in limits.items()]
        limit = F.coalesce(*cases)
        return F.when(limit.isNotNull(), p_value(token, name) >= limit).otherwise(F.lit(False))

    def judge(token: Column) -> Column:
        return F.coalesce(let(encoding(token), lambda name: passes(token, name)), F.lit(False))

    return F.filter(found_spans(text, TOKEN, "random"), lambda span: judge(span["token"]))


def scan_secrets(documents: DataFrame, limits: dict[tuple[str, int], float] | None = None) -> DataFrame:
    """All columns of ``documents``, ``base`` and ``spans``: arrays of (start, kind_no, end, token).

    ``limits``: from ``thresholds``; of these documents if not given.
    """
    limits = thresholds(documents) if limits is None else limits
    rows = without_clashes(documents, ("text",), ("base", "spans", "added"))
    rows = rows.withColumn("base", base_spans(text_or_empty())).withColumn("added", random_spans(text_or_empty(), limits))
    apart = F.filter("added", lambda one: ~F.exists("base", lambda own: (own["start"] < one["end"]) & (one["start"] < own["end"])))
    merged = F.when(F.size("added") > 0, F.array_sort(F.concat("base", apart))).otherwise(F.col("base"))
    return rows.withColumn("spans", merged).drop("added")


def described(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*(F.lit(kind) for kind in KINDS))
    return F.array_join(
        F.transform(spans, lambda one: F.concat_ws(":", F.element_at(names, one["kind_no"] + 1), one["start"].cast("string"), one["end"].cast("string"))), ","
    )


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with every secret replaced by a mark; overlapping spans get one."""
    scanned = scan_secrets(documents)

    def step(done: Column, span: Column) -> Column:
        new = span["start"] >= done["at"]
        piece = F.concat(done["out"], F.col("text").substr(done["at"] + 1, span["start"] - done["at"]), F.lit(MARK))
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.when(new, piece).otherwise(done["out"]).alias("out"))

    rest = lambda done: F.concat(done["out"], F.col("text").substr(done["at"] + 1, F.length("text")))
    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    return scanned.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))).drop("base", "spans")
