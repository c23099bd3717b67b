"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.collocations import collocations
from affinis.llm.decontaminate import find_contamination
from affinis.llm.fingerprints import edited_fingerprints
from affinis.llm.html_extraction import extract_main_text
from affinis.llm.near_duplicates import near_duplicate_classes
from affinis.llm.packing import pack
from affinis.llm.repeats import remove_repeats
from affinis.llm.secrets import described, scan_secrets
from affinis.llm.token_counts import count_tokens
from affinis.llm.toxicity import fit_toxicity, score_toxicity
from affinis.llm.url_filters import judge_urls
from affinis.llm.warc import derive, responses
from affinis.llm.whitening import whiten

# The rules of the url query, as (verdict, host/path).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, one: total + one["end"] - one["start"])
    return found.select(
        "doc_id",
        (F.octet_length("kept") + removed).alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (removed > 0).alias("repeats"),
    )


def warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(_read(spark, sf_dir, "pages")))


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(_read(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score", F.array_join("tokens", " ").alias("tokens"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_read(spark, sf_dir, "documents"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(documents, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit_toxicity(documents.filter(~held_out), _read(spark, sf_dir, "labels"))
    return score_toxicity(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int):
        return F.size(F.filter("base", lambda one: one["kind_no"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(described(F.col("base")), 256).alias("base_sha256"),
        described(F.col("spans")).alias("spans"),
    )


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    found = find_contamination(documents, _read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whiten(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return whitened.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_read(spark, sf_dir, "documents").select("lang", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": repeats,
    "op2_packing": packing,
    "op3_toxicity": toxicity,
    "op4_warc_derivatives": warc_derivatives,
    "op5_url_filters": url_filters,
    "op6_fingerprints": fingerprints,
    "op7_token_counts": token_counts,
    "op8_secrets": secrets,
    "op9_decontamination": decontamination,
    "op10_near_duplicates": near_duplicates,
    "op11_html_extraction": html_extraction,
    "op12_embedding_whitening": embedding_whitening,
    "op13_phrase_collocations": phrase_collocations,
    "pipeline": pipeline,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES: dict[str, str] = {
    "op9_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS win, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT row_no, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT row_no, s, n, item_id FROM places JOIN windows USING (win, n)),
words AS (SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(s, s + n)) AS p FROM hits) GROUP BY row_no),
items AS (
  SELECT row_no, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT row_no, item_id FROM hits) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_no) LEFT JOIN items USING (row_no)
""",
    "op13_phrase_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(s, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
g AS (
  SELECT lang, array_to_string(list_slice(w, s, s + n - 1), ' ') AS phrase, n
  FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM p, (VALUES (1), (2), (3)) sizes(n) WHERE len(w) >= n)),
f AS (SELECT lang, phrase, n, count(*) AS f FROM g GROUP BY lang, phrase, n),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE n = 1 GROUP BY lang),
c AS (SELECT lang, phrase, n, f AS a, string_split(phrase, ' ') AS w FROM f WHERE n > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, n, a, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, n), ' ') AS rest
  FROM (SELECT *, unnest(range(1, n)) AS k FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.n, a, k, x.f AS l, y.f AS r,
    CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + 1), ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE n = 3) GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.phrase = lowest.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, totals.n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
""",
}
