"""Main text of pages, whitening and collocations."""

import html
import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from plain import collocations as plain_collocations
from pyspark.sql import functions as F

from affinis.llm import collocations as mining
from affinis.llm.automata import CountAutomaton, Phrases, keys, union
from affinis.llm.html_extraction import extract_main_text, main_text
from affinis.llm.whitening import counts_above, leading_eigenpairs, spectrum, tridiagonal, whiten

FOLDER = "/root/testdata/sf0.001"
FRAME = """<html><body><header class="site-header"><h1>My Site</h1></header><div id="wrap" class="has-sidebar"><div class="sidebar"><p>Side text that
goes on, and on, and on for a while, really.</p></div>%s<div class="comments"><p>Reader, comment, that is long, and full of commas, and more,
and more, and more.</p></div></div><div class="cookie-notice">We use cookies, and other things, for reasons of our own, to be told.</div>
<footer>The foot, of the page, with many, many commas.</footer></body></html>"""
BODY = """<p>Para one, with <a href=x>link</a>, commas, and more words than&nbsp;twenty five.</p><p>Short.</p><ul><li>item   one<li>item
two</ul><ul><li><a href=1>menu 1</a></li><li><a href=2>menu 2</a></li></ul><pre>code  here</pre><table><tr><td>a<td>b<tr><td>c</table>
<form><input><label>Email</label></form><script>var a = "<p>no</p>";</script><style>p {}</style><!-- <p>no</p> --><p>Tom &amp; Jerry &lt;3<br>end"""
LINES = ["Para one, with link, commas, and more words than twenty five.", "Short.", "item one", "item two", "code here", "a", "b", "c", "Tom & Jerry <3 end"]


@pytest.mark.parametrize(
    "article",
    [
        '<article class="post category-ads"><header><h1>Title</h1></header>%s</article>',
        '<main><h1>Title</h1><section>%s</section></main>',
        '<div class="post"><h1>Title</h1><div class="entry-content">%s</div></div>',
        '<form action=/><article><h1>Title</h1>%s</article></form>',
    ],
)
def test_article_inside_a_frame(article):
    assert main_text(FRAME % (article % BODY)) == "\n".join(["Title", *LINES])


def test_siblings_of_the_best_container_are_kept():
    page = '<body><nav><a href=1>Home</a></nav><div><div><p>%s</p><p>%s</p></div><div><p>%s</p></div><p>An ending, of the article.</p><div>x</div></div></body>'
    parts = [", ".join(["words of a part"] * n) for n in (30, 25, 20)]
    assert main_text(page % tuple(parts)).split("\n")[:3] == parts
    assert "An ending, of the article." in main_text(page % tuple(parts)) and "Home" not in main_text(page % tuple(parts))


def test_pages_of_the_table_equal_their_article_element(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    for row in extract_main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*)</article>", row.html, re.S)[1]
        blocks = (re.sub("<[^>]*>", lambda tag: " " if tag[0] == "<br>" else "", part) for part in re.split("</?(?:p|h1)>", article))
        lines = [line for line in (" ".join(html.unescape(block).split()) for block in blocks) if line]
        assert row.text == "\n".join(lines) and row.n_chars == len(row.text)


def test_odd_pages(spark):
    odd = [None, "", "   ", "plain text &lt; only", "<p>cut off <a hr", "a < b <script>x", "<!-- no end", "<p>é𝒳</p>", "<p>é𝒳</p>", "<nav>menu only, nothing else</nav>"]
    expected = ["", "", "", "plain text < only", "cut off", "a < b", "", "é𝒳", "é𝒳", ""]
    rows = spark.createDataFrame([(k, page, "own", "own") for k, page in enumerate(odd)], "page_id int, HTML string, text string, n_chars string")
    found = sorted(extract_main_text(rows).collect())
    assert [tuple(r) for r in found] == [(k, text, len(text)) for k, text in enumerate(expected)]
    assert extract_main_text(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page", ["<p><b>" * 50_000, '<a href="' * 50_000, "<!--" * 50_000, "<" * 99_999, "</p>" * 99_999, "<li>" * 50_000, "<table><tr><td>" * 20_000, "<p title='" * 50_000, "<div>" * 50_000]
)
def test_hostile_pages_end_soon(page):
    began = time.monotonic()
    assert main_text(page + "<p>x</p>") is not None
    assert time.monotonic() - began < 20


def covariances():
    draw = np.random.default_rng(3)
    for size in (1, 2, 3, 30):
        yield np.cov(draw.standard_normal((3 * size + 2, size)).T, bias=True).reshape(size, size)
    yield np.eye(10)
    yield np.diag([5.0, 5.0, 5.0, 1.0])
    yield np.outer(np.arange(5.0), np.arange(5.0))
    yield np.diag(np.concatenate([[2.0], np.ones(40)]))
    yield np.diag(np.concatenate([[2.0], 1 + 1e-7 * np.arange(40)]))
    yield np.zeros((3, 3))


@pytest.mark.parametrize("a", list(covariances()))
def test_leading_eigenpairs(a):
    expected = np.linalg.eigvalsh(a)[::-1]
    values, vectors = leading_eigenpairs(a, 4)
    assert len(values) == min(4, (expected > 1e-12 * expected[0]).sum())
    assert np.allclose(values, expected[: len(values)], rtol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)
    assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-12 * max(1.0, expected[0])


def test_inertia_counts_eigenvalues():
    a = np.random.default_rng(4).standard_normal((25, 25))
    a, form = a + a.T, tridiagonal(a + a.T)
    expected = np.linalg.eigvalsh(a)[::-1]
    shifts = np.linspace(expected[-1] - 1, expected[0] + 1, 40)
    assert counts_above(*form, shifts).tolist() == [(expected > shift).sum() for shift in shifts]
    assert np.allclose(spectrum(*form), expected, atol=1e-10)


VECTORS = "vec_id int, embedding array<float>"


@pytest.mark.parametrize("shift", [0.0, 400.0, 1e8])
def test_whitening_equals_dense_algebra(spark, shift):
    draw = np.random.default_rng(5)
    base = draw.standard_normal((60, 6)) * [5, 3, 2, 1, 0.5, 0.2] + shift
    vectors = [*base.tolist(), *base[:5].tolist(), base[0].tolist()]
    odd = [None, [], [1.0] * 6 + [2.0], [None] + [1.0] * 5, [math.nan] + [1.0] * 5, [math.inf] + [1.0] * 5, [1e30] + [1.0] * 5]
    rows = spark.createDataFrame([*enumerate(vectors), *((None, v) for v in odd)], VECTORS.replace("float", "double"))
    for name in ("n", "whitened", "x", "COMPONENT"):
        rows = rows.withColumn(name, F.lit("own"))
    found = whiten(rows).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(256 * np.array(vectors)).astype(np.int64)
    fit = np.unique(x, axis=0)
    apart = fit - fit.mean(axis=0)
    values, directions = np.linalg.eigh(apart.T @ apart / len(fit))
    values, directions = values[::-1], directions[:, ::-1]
    expected = (x - fit.mean(axis=0)) @ directions[:, :4] / np.sqrt(values[:4])
    got = found.whitened.to_numpy().reshape(len(vectors), 4)
    assert np.allclose(np.abs(got), np.abs(expected), rtol=1e-6, atol=1e-6)
    assert all(abs(a @ b) == pytest.approx(abs(a) @ abs(b)) for a, b in zip(got.T, expected.T, strict=True))
    assert np.allclose(found.explained.to_numpy().reshape(-1, 4)[0], values[:4] / values.sum(), rtol=1e-9)
    assert found.identity_error.nunique() == 1 and found.identity_error.max() < 1e-6 and set(found.n) == {len(fit)}
    sums = fit.astype(object).sum(axis=0)
    deviation = [int(((len(fit) * row.astype(object) - sums) ** 2).sum()) for row in x]
    assert found[found.component == 1].deviation.tolist() == deviation


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[]] * 3, [None]])
def test_whitening_without_variance(spark, vectors):
    rows = spark.createDataFrame(list(enumerate(vectors)), VECTORS)
    assert whiten(rows).count() == 0


def test_whitening_of_rank_one(spark):
    rows = spark.createDataFrame([(k, [float(k), float(k)]) for k in range(4)], VECTORS)
    found = whiten(rows).collect()
    assert [r.component for r in found] == [1] * 4 and found[0].explained == pytest.approx(1.0)


def phrases(rows):
    """Phrases of {words: number}."""
    alphabet = sorted({word for key in rows for word in key})
    words = np.array([[alphabet.index(w) for w in key] + [-1] * (3 - len(key)) for key in rows], dtype=np.int32).reshape(-1, 3)
    order = np.argsort(keys(words, len(alphabet)))
    return Phrases(words[order], np.array(list(rows.values()), dtype=np.int64)[order], pa.array(alphabet, pa.large_binary()))


def spelled(found):
    return {tuple(text.split(b" ")): number for text, number in zip(found.texts().to_pylist(), found.numbers.tolist(), strict=True)}


@pytest.mark.parametrize("most_words", [1 << 20, 2])
def test_automata_hold_unite_and_look_up_phrases(monkeypatch, most_words):
    monkeypatch.setattr("affinis.llm.automata.RUN", 7)
    draw = np.random.default_rng(6)
    tables = []
    for _ in range(3):
        keys_ = {tuple(b"abcdefgh"[k : k + 1] for k in draw.integers(0, 8, draw.integers(1, 4))) for _ in range(200)}
        tables.append({key: int(draw.integers(1, 3)) for key in keys_})
    built = [phrases(table) for table in tables]
    automata = [CountAutomaton.build(one).to_bytes() for one in built]
    # With few words phrases are sorted by one key, with very many column by column.
    monkeypatch.setattr("affinis.llm.automata.MOST_WORDS", most_words)
    for table, automaton in zip(tables, automata, strict=True):
        assert spelled(CountAutomaton.from_bytes(automaton).phrases()) == table
    total = {}
    for table in tables:
        for key, number in table.items():
            total[key] = total.get(key, 0) + number
    united, single = union(automata)
    assert spelled(united) == total and single == sum(number for key, number in total.items() if len(key) == 1)
    assert spelled(union(automata, 3)[0]) == {key: number for key, number in total.items() if number >= 3}
    monkeypatch.setattr("affinis.llm.automata.MOST_WORDS", 1 << 20)
    asked = phrases(dict.fromkeys([*total, (b"z",), (b"a", b"z"), (b"z", b"a", b"b")], 1))
    found = CountAutomaton.build(phrases(total)).compose(asked)
    assert found.tolist() == [total.get(tuple(text.split(b" ")), 0) for text in asked.texts().to_pylist()]


def test_states_with_equal_arcs_exist_once():
    many = {(bytes([a]), b"x", c): 1 for a in range(97, 117) for c in (b"y", b"z")}
    automaton = CountAutomaton.build(phrases(many))
    # The root, one state after the first words and one after the second.
    assert len(automaton.bounds) - 1 == 3 and len(automaton.label) == 20 + 1 + 2


LANGUAGES = "lang string, text string"
ODD = [(None, "A b. a B c"), ("en", None), ("en", ""), ("xx", "   "), ("xx", "solo"), ("und", "a b\tc" * 30), ("", "x y " * 20), ("en", "é É ß x, é É\n" * 5)]


def test_shards_of_any_size_count_the_same(monkeypatch):
    texts = pa.array(["a b c d. b c", "", "x", "b c d, a b", "a b c"] * 3, pa.large_string())
    (whole,) = mining.count_phrases(texts)
    for words in (1, 2, 5):
        monkeypatch.setattr(mining, "SHARD_WORDS", words)
        shards = list(mining.count_phrases(texts))
        assert len(shards) > 5
        assert spelled(union([CountAutomaton.build(one).to_bytes() for one in shards])[0]) == spelled(whole)


@pytest.mark.parametrize("range_bytes, range_phrases", [(8 << 20, 8_000_000), (20_000, 500)])
def test_collocations_equal_dictionaries(spark, range_bytes, range_phrases):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang", "text").unionByName(spark.createDataFrame(ODD, LANGUAGES))
    found = mining.collocations(rows.withColumn("score", F.lit("own")), least=4, best=50, range_bytes=range_bytes, range_phrases=range_phrases)
    assert sorted(map(tuple, found.collect())) == plain_collocations([tuple(r) for r in rows.collect()], 4, 50)


def test_collocations_of_nothing(spark):
    assert mining.collocations(spark.createDataFrame([], LANGUAGES)).count() == 0
    assert mining.collocations(spark.createDataFrame([("en", None), (None, " . ")], LANGUAGES)).count() == 0
