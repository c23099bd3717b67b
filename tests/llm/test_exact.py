"""Operators with one right answer, against plain Python."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from plain import contamination, fold, repeats
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from affinis.llm import decontaminate, fingerprints, packing, secrets, token_counts, url_filters, warc
from affinis.llm.repeats import LENGTH, remove_repeats

FOLDER = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string"
ODD = [(None, "no id"), (901, None), (902, ""), (903, "   "), (904, "same row"), (904, "same row"), (905, "é 𝒳 ünï" * 60)]


def documents(spark, more=()):
    own = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    return own.unionByName(spark.createDataFrame([*ODD, *more], TEXTS))


def clashing(df):
    """Further columns with the names that operators use themselves."""
    for name in ("score", "key", "rest", "row_no", "spans", "base", "kept", "n_tokens", "k1", "marks", "class_id", "TEXT_ID", "host", "record"):
        df = df.withColumn(name, F.lit("own"))
    return df


def passages():
    draw = random.Random(5)
    shared = "".join(draw.choice("abcdefgh ij") for _ in range(900))
    other = lambda: "".join(draw.choice("klmnop q") for _ in range(draw.randrange(600)))
    rows = [(1000 + k, other() + shared[draw.randrange(200) : draw.randrange(500, 900)] + other()) for k in range(40)]
    return [*rows, (1100, "a" * 1500), (1101, "ab" * 700), (1102, shared), (1102, shared), (1103, "xyz" * 133 + "x"), (1104, "é" * 450)]


@pytest.mark.parametrize("kinds", [20_000, 3])
def test_repeats_equal_all_windows(spark, kinds):
    rows = documents(spark, passages())
    found = remove_repeats(rows, kinds=kinds).select("doc_id", "spans", F.sha2("kept", 256).alias("sha")).collect()
    got = [(r.doc_id, tuple((s.start, s.end) for s in r.spans), r.sha) for r in found]
    expected = repeats([tuple(r) for r in rows.collect()], LENGTH)
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_repeats_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], TEXTS)).count() == 0


@pytest.mark.parametrize("sent", [4_000_000, 500, 0])
def test_token_counts_equal_the_library(spark, sent):
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = "don't stop,'s<|endoftext|>x <|STARTOFTEXT|>.<|startoftext|>, é.é,́ a.b;c 12.5\u2003x\x1cy ΑΣ.\u00a0x"
    rows = documents(spark, [(990, odd), (991, "'s'T'RE I'll, we'D! ..'s ,.'t")])
    model = Tokenizer.from_file(path)
    expected = sorted(((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "", add_special_tokens=False).ids)) for r in rows.collect()), key=str)
    found = token_counts.count_tokens(clashing(rows), path, broadcast_pieces=sent)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found.collect()), key=str) == expected
    assert found.filter("over_limit <> (n_tokens > 2048)").count() == 0


def test_contamination_equals_all_windows(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(5000, "three short words"), (5001, ""), (5002, None), (5003, "Three, SHORT words")]
    rows = documents(spark, [(990, "x three short. Words y"), (991, items[0][1] + " " + items[1][1]), (992, items[2][1][:-20])])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(rows.withColumnRenamed("doc_id", "key"), benchmark)
    got = sorted((str((r.key, r.n_words, r.n_hit, list(r["items"]))) for r in found.collect()))
    plain = [contamination([row], items, decontaminate.WIDTH) for row in map(tuple, rows.collect())]
    assert got == sorted(str((name, *value)) for one in plain for name, value in one.items())
    clean = decontaminate.decontaminate(clashing(rows), benchmark)
    hit = {name for one in plain for name, value in one.items() if value[1]}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows.collect()} - hit


def test_contamination_in_blocks_and_proximity(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 8)
    item = "one two three four five six seven eight nine ten eleven"
    near = item.replace("five", "five extra")
    rows = spark.createDataFrame([(1, item), (2, near), (3, "one two three"), (4, "ten nine eight")], "key long, text string")
    benchmark = spark.createDataFrame([(1, item), (2, "ten nine")], "item_id long, text string")
    found = {r.key: (r.n_hit, list(r["items"]), list(r.near_items)) for r in decontaminate.find_contamination(rows, benchmark).collect()}
    assert found[1] == (11, ["1"], ["1", "2"]) and found[2] == (0, [], ["1", "2"])
    assert found[3] == (0, [], []) and found[4] == (2, ["2"], ["2"])


def test_contamination_without_items(spark):
    rows = spark.createDataFrame([(1, "a b")], "key long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in decontaminate.find_contamination(rows, none).collect()] == [(1, 2, 0)]


ASSIGN = re.compile(
    "(" + "|".join("".join(f"[{c}{c.upper()}]" for c in word) for word in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[kind]}:{a}:{b}" for a, kind, b in sorted(found))


def test_secrets(spark):
    draw = random.Random(3)
    token = lambda alphabet, size: "".join(draw.choice(alphabet) for _ in range(size))
    base62 = secrets.ENCODINGS["base62"]
    more = [(2000 + k, f"id 𝒳 {token(base62, 40)} end") for k in range(40)]
    more += [(2100 + k, "word" + "ab1" * 12) for k in range(40)]
    more += [
        (2200, 'password: abcdefgh12 AKIAABCDEFGHIJKL0 token="short" SECRET = zzzzzzzzzz ſecret=abcdefghij'),
        (2201, "token=a. " * 300 + 'api_key: "abcdefgh" ' * 300),
        (2202, "password: secret: abcdefghijk " + token("0123456789abcdef", 64)),
    ]
    rows = documents(spark, more)
    scanned = secrets.scan_secrets(clashing(rows)).select("doc_id", "text", *(secrets.described(F.col(c)).alias(c) for c in ("base", "spans"))).collect()
    assert all(r.base == base_spans(r.text) for r in scanned)
    by_id = {r.doc_id: r for r in scanned}
    random_found = [k for k in range(2000, 2040) if "random:" in by_id[k].spans]
    assert len(random_found) >= 30
    assert not any("random:" in by_id[k].spans for k in range(2100, 2140))
    assert by_id[random_found[0]].spans.split(":")[1:] == ["5", "45"]
    redacted = {r.doc_id: r.text for r in secrets.redact(rows).collect()}
    assert redacted[2200] == 'x'.replace("x", '[SECRET] [SECRET] token="short" [SECRET] ſecret=abcdefghij')
    assert redacted[901] is None and redacted[902] == "" and redacted[903] == "   "
    assert redacted[2201].count("[SECRET]") == 300


def test_running_sums(spark):
    row = spark.createDataFrame([(list(range(1, 200)), [])], "a array<int>, b array<int>").select(
        secrets.running_sums(F.col("a")).alias("a"), secrets.running_sums(F.col("b")).alias("b")
    ).first()
    assert row.a == [n * (n + 1) // 2 for n in range(1, 200)] and row.b == []


def test_edited_texts(spark):
    rows = documents(spark)
    found = fingerprints.edited_fingerprints(clashing(rows)).collect()
    assert len(found) == rows.count()
    digest = lambda text: format_hash(text)
    ordered = sorted({(r.doc_id, r.text or "") for r in rows.collect()}, key=lambda r: (r[0] is not None, r[0] or 0))
    expected = {}
    for at, (name, text) in enumerate(ordered):
        half, following = len(text) // 2, ordered[(at + 1) % len(ordered)][1]
        expected[name] = digest(text[: len(text) - half] + following[:half])
    assert {r.doc_id: r.edited_sha256 for r in found} == expected
    same = {}
    for row, text in ((r, dict(ordered)[r.doc_id]) for r in found):
        assert same.setdefault(text, row.fingerprint) == row.fingerprint
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    far = [r for r in found if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in far) > 0.95 * len(far)


def format_hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_close_fingerprints_equal_all_pairs(spark):
    draw = random.Random(8)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for _ in range(60):
        value = draw.getrandbits(128)
        rows += [value] * draw.choice((1, 1, 3))
        for _ in range(3):
            rows.append(value ^ sum(1 << bit for bit in draw.sample(range(128), draw.randrange(1, 6))))
    table = spark.createDataFrame([(signed(v >> 64), signed(v & (2**64 - 1))) for v in rows], "high long, low long")
    found = {(r.high, r.low): r.n_links for r in fingerprints.close_counts(table).collect()}
    for value in set(rows):
        links = sum((value ^ other).bit_count() <= fingerprints.RADIUS for other in rows) - 1
        assert found[(signed(value >> 64), signed(value & (2**64 - 1)))] == links


def test_packing(spark):
    rows = documents(spark, [(990, "word " * 20_000)])
    found = packing.pack(clashing(rows), block_tokens=20_000).toPandas()
    plain = {r.doc_id: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x21-\x7e]", fold(r.text or ""))) for r in rows.filter("doc_id != 904").collect()}
    totals = found.groupby("doc_id").piece_tokens.sum()
    assert all(totals[name] == size for name, size in plain.items() if name is not None)
    assert len(found[found.doc_id == 904]) == 2 and found[found.piece_tokens == 0].bin.isna().all()
    placed = found.dropna(subset=["bin"])
    for _, pieces in placed.groupby("bin"):
        ordered = pieces.sort_values("bin_offset")
        assert list(ordered.bin_offset) == [0, *ordered.piece_tokens.cumsum()[:-1]]
        used, capacity = ordered.piece_tokens.sum(), ordered.bin_capacity.iloc[0]
        assert capacity == min(c for c in packing.CAPACITIES if c >= used)
    bins = placed.groupby("bin").bin_capacity.first()
    assert placed.piece_tokens.sum() > 0.9 * bins.sum()
    long = found[found.doc_id == 990].sort_values("piece")
    assert list(long.piece_start) == [0, 8192, 16384] and list(long.piece_tokens) == [8192, 8192, 3616]
    assert packing.pack(spark.createDataFrame([], TEXTS)).count() == 0


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = fold(host)
    best = None
    for _, rule in RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_url_rules_and_words(spark):
    odd = [None, "nohost", "", "http://A.Example.NET", "x://y.NET/a?b", "http://example.net/EN/x#y", "a://b/c://d.net/", "http://x.org/fr/\n1", "http://ÉX.net/"]
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html")
    pages = pages.unionByName(spark.createDataFrame([(5000 + k, url, None) for k, url in enumerate([*odd, *odd])], "page_id long, url string, html string"))
    found = url_filters.judge_urls(clashing(pages), RULES).collect()
    assert len(found) == pages.count()
    actions = {rule: action for action, rule in RULES}
    for row in found:
        assert (row.host, row.path, row.rule) == rule_of(row.url)
        assert row.verdict == actions[row.rule] if row.rule else row.verdict in ("allow", "block")
    assert all(r.verdict == "allow" for r in found if not r.tokens and r.rule is None)
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_segmenter_and_bayes(spark):
    model = url_filters.Segmenter({"free": 50, "bets": 20, "the": 500, "re": 30}, 10)
    assert model.split("freebets") == ["free", "bets"]
    assert model.split("thezzz") == ["the", "zzz"]
    rows = [(k, f"http://{name}{k % 7}.example.net/a", "<p>free bets casino win garden tools</p>" * 5) for k in range(30) for name in ("freebets", "casinowin")]
    rows += [(100 + k, f"http://gardentools{k % 7}.example.org/fr/a", None) for k in range(30)]
    rows += [(200, "http://winbets.example.com/a", None), (201, "http://tools.example.com/a", None)]
    found = {r.page_id: r for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert found[200].verdict == "block" and "h:win" in found[200].tokens
    assert found[201].verdict == "allow" or found[201].score < found[200].score


def parse(record):
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    assert lines[0] == "WARC/1.1" and rest[size:] == b"\r\n\r\n"
    return headers, rest[:size]


def test_warc_derivatives(spark):
    page = '<html lang="en"><head><title>A &amp; B</title><script>x("</p>")</script></head><body><!-- no --><p>One <b>t</b>wo<p>é<a href="/x?a=1&amp;b">l</a></body>'
    rows = [(1, "http://a/", page), (2, None, None), (3, "http://b/", ""), (1, "http://a/", page)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    sources = {r.record_id: r for r in warc.responses(pages).collect()}
    found = warc.derive(warc.responses(pages)).collect()
    assert len(found) == 8 and len(sources) == 3
    for row in found:
        headers, block = parse(row.record)
        source = sources[row.refers_to]
        assert headers["WARC-Type"] == row.record_type and headers["WARC-Refers-To"] == source.record_id
        assert headers["WARC-Block-Digest"] == row.block_digest == warc.digest(block) and row.content_length == len(block)
        assert headers["WARC-Refers-To-Payload-Digest"] == source.payload_digest == warc.digest(warc.split_http(source.block)[1])
        assert headers.get("WARC-Target-URI") == source.target_uri and headers["WARC-Date"] == source.date
    texts = {r.page_id: parse(r.record)[1].decode() for r in found if r.record_type == "conversion"}
    assert texts == {1: "A & B\nOne two\nél", 2: "", 3: ""}
    metadata = next(parse(r.record)[1].decode() for r in found if r.record_type == "metadata" and r.page_id == 1)
    assert metadata.split("\r\n")[:2] == ["http-status: HTTP/1.1 200 OK", "http-header: Content-Type: text/html; charset=utf-8"]
    assert "title: A & B\r\nlanguage: en\r\noutlink: /x?a=1&b\r\n" in metadata


def test_votes_of_long_and_of_many_equal_texts(spark):
    long = " ".join(f"internationalisation{k % 97}" for k in range(30_000))
    rows = [(k, "one and the same text with a few words") for k in range(3000)] + [(5000, long), (5001, long)]
    found = fingerprints.edited_fingerprints(spark.createDataFrame(rows, TEXTS)).collect()
    assert len(found) == 3002
    prints = {r.doc_id: r.fingerprint for r in found}
    alone = fingerprints.edited_fingerprints(spark.createDataFrame([(0, rows[0][1]), (1, long)], TEXTS)).collect()
    assert {prints[k] for k in range(3000)} == {next(r.fingerprint for r in alone if r.doc_id == 0)}
    assert prints[5000] == prints[5001] == next(r.fingerprint for r in alone if r.doc_id == 1)
    # The votes themselves, counted one by one.
    own = spark.createDataFrame([(1, long)], "k int, text string")
    votes = [0] * 128
    for row in own.select(F.explode(fingerprints.terms(F.col("text"))).alias("t")).select("t", F.xxhash64("t", F.lit(1)).alias("a"), F.xxhash64("t").alias("b")).collect():
        weight = (row.t & 3) + 1
        for bit in range(64):
            votes[bit] += weight if row.a >> bit & 1 else -weight
            votes[64 + bit] += weight if row.b >> bit & 1 else -weight
    value = sum((votes[bit] > 0) << bit for bit in range(64)) << 64 | sum((votes[64 + bit] > 0) << bit for bit in range(64))
    assert prints[5000] == f"{value:032x}"


def test_rules_of_fingerprints_hold_for_words(spark):
    texts = spark.createDataFrame([("The cat",), ("the CAT!",), ("cat the",), ("",)], "text string")
    hashes = [tuple(r[0]) for r in texts.select(fingerprints.terms(F.col("text"))).collect()]
    assert hashes[0] == hashes[1] != hashes[2] and hashes[3] == () and len(hashes[0]) == 2
