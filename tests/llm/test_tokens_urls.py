import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from odd_rows import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vertexloom.llm import bpe, columns, pretokens, token_counts, url_filter

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [*map(chr, range(256)), *"  \n\t''srtvemld" * 6, "日", "я", "́", " ", "\U0001f600", "\u0558", "\u2028"]
TRICKY = ["", " ", "  a", "a  ", "I'll've we're 'S 's", "\r\n\r\n x", "x" * 3000, " " * 800, "=-" * 500, "<|endoftext|>", "a<|endoftext|><|endoftext|>b ", "\x1c\x1d\x85\xa0 ²¼"]


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(SIGNS, k=rnd.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pretokens_are_those_of_the_library():
    split = Tokenizer.from_file(JSON).pre_tokenizer.pre_tokenize_str
    for text in [*TRICKY, *random_texts(3000, 1), *(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}{chr(c)}x" for c in range(256))]:
        cuts = sorted({b for _, (_, b) in split(text)} - {0})
        assert pretokens.pretokens(text) == [text[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def test_ids_are_those_of_the_library(library):
    for text in [*TRICKY, *random_texts(3000, 2), *(str(r[1]) for r in ODD)]:
        ids = bpe.encode_text(MULTI, text)
        assert ids == library.encode_ordinary(text)
        assert bpe.decode_ids(MULTI, ids) == text.encode()


def test_appending_and_editing_equal_encoding_anew():
    v, rnd = bpe.pieces(MULTI).vocabulary, random.Random(3)
    for _ in range(200):
        data = bytes(rnd.choices(b"the cat andis oing ", k=rnd.randint(0, 90)))
        cut = rnd.randint(0, len(data))
        table = bpe.PrefixTable(v, data[:cut])
        table.append(data[cut:])
        assert table.last == bpe.PrefixTable(v, data).last
        start = rnd.randint(0, len(data))
        stop, new = rnd.randint(start, len(data)), bytes(rnd.choices(b"xthe ", k=rnd.randint(0, 6)))
        table.splice(start, stop, new)
        assert table.last == bpe.PrefixTable(v, data[:start] + new + data[stop:]).last
    long = bpe.PrefixTable(v, b"the cat sat on the mat " * 60)
    assert long.splice(100, 103, b"dog") < 300  # and not to the end


def test_encode_decode_and_digests(table, library):
    docs = table([*ODD, *enumerate(TRICKY, 50)], extra=True)
    encoded = bpe.encode(docs, MULTI)
    assert set(encoded.columns) == set(docs.columns)
    rows = bpe.decode(encoded, MULTI).collect()
    assert all(r.decoded == (r.text or "").encode() and r.ids == library.encode_ordinary(r.text or "") for r in rows) and len(rows) == docs.count()
    want = Counter()
    for r in rows:
        want[r.doc_id, len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, MULTI).collect())) == want
    assert bpe.round_trip(table([]), MULTI).count() == 0 and bpe.encode(table([]), MULTI).count() == 0
    assert bpe.decode(encoded.withColumn("ids", F.lit(None).cast("array<int>")), MULTI).filter("decoded IS NULL").count() == len(rows)


def test_unreachable_tokens_are_never_used():
    """A token whose merges never happen is only given for a pre-token that equals it."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"xabc": 259}
    v = bpe.Vocabulary(ranks)
    library = tiktoken.Encoding("own", pat_str=r"[a-z]+|[^a-z]+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "aabc", "abcabc", "xabc", "xxabc", "bcbcab", "abab"):
        got = [ranks[text.encode()]] if text.encode() in ranks else bpe.PrefixTable(v, text.encode()).tokens()
        assert got == library.encode_ordinary(text)


def test_pretokens_of_a_slice_are_encoded_together(library, monkeypatch):
    """Few pre-tokens, the longest, are encoded by themselves; small caches change nothing."""
    alone = []

    class Counted(bpe.PrefixTable):
        def __init__(self, vocabulary, data=b""):
            alone.append(data)
            super().__init__(vocabulary, data)

    monkeypatch.setattr(bpe, "PrefixTable", Counted)
    rnd = random.Random(5)
    words = ["".join(rnd.choices(["th", "an", "er", "ou", "qx", "é", "я", "日"], k=rnd.randint(3, 9))) for _ in range(3000)]
    bpe.encode_text(MULTI, " ".join(words))
    assert len(alone) < 64 < len(set(words))
    texts = [*TRICKY, *random_texts(2000, 6), *(" ".join(rnd.choices(words, k=40)) for _ in range(300)), "x" * 20_000, None]
    want = [library.encode_ordinary(t or "") for t in texts]
    for room in (bpe.PIECES, 50):
        alone.clear()
        whole = bpe.Pieces(bpe.pieces(MULTI).vocabulary)
        whole.room = room
        assert whole.texts(texts) == want and len(alone) < bpe.FEW and b"x" * 20_000 in alone
        assert [ids for at in range(0, len(texts), 100) for ids in whole.texts(texts[at : at + 100])] == want
        assert len(whole) <= room and len(whole.old) <= room and max(map(len, whole)) <= bpe.MAX_PIECE


@pytest.mark.parametrize("seed", range(8))
def test_columns_with_any_merges(seed):
    """Vocabularies of arbitrary merges, many of which never happen, against the library; merging in order of rank must do."""
    rnd, ranks, known = random.Random(seed), {bytes([b]): b for b in range(256)}, [b"a", b"b", b"c"]
    for _ in range(400):
        new = rnd.choice(known) + rnd.choice(known)
        if new in ranks or len(new) > 8:
            continue
        more = bpe.Vocabulary(ranks | {new: len(ranks)})
        if all(more.made(t) or len(more._merged(b, bpe.LATE)) > 1 for b, t in more.ranks.items()):
            ranks = more.ranks
            known.append(new)
    v = bpe.Vocabulary(ranks)
    library = tiktoken.Encoding("own", pat_str=r"[a-z]+|[^a-z]+", mergeable_ranks=ranks, special_tokens={})
    texts = {"".join(rnd.choices("abcd", weights=[4, 3, 3, 1], k=rnd.randint(1, 24))) for _ in range(2000)}
    texts = sorted((t for t in texts if t.encode() not in ranks), key=len, reverse=True)
    got = columns.Columns(v).encode([t.encode() for t in texts])
    assert list(map(list, got)) == [library.encode_ordinary(t) for t in texts] and len(ranks) > 270


@pytest.mark.parametrize("cache", [token_counts.CACHE_SIZE, 5])
def test_counts_are_those_of_the_library(table, monkeypatch, cache):
    monkeypatch.setattr(token_counts, "CACHE_SIZE", cache)
    t = Tokenizer.from_file(JSON)
    rows = [*ODD, *enumerate([*TRICKY, *random_texts(300, 4)], 50)]
    tiers = token_counts.Lengths(JSON, {"The": 1, " cat": 1})
    texts = [str(r[1]) for r in rows]
    for at in range(0, len(texts), 50):
        assert tiers.counts(texts[at : at + 50]) == [len(t.encode(x, add_special_tokens=False)) for x in texts[at : at + 50]]
    got = token_counts.count_tokens(table(rows, extra=True), JSON).collect()
    want = Counter()
    for r in rows:
        n = len(t.encode(r[1] or "", add_special_tokens=False))
        want[r[0], len((r[1] or "").encode()), n, n > 512] += 1
    assert Counter(map(tuple, got)) == want
    assert token_counts.count_tokens(table([]), JSON).count() == 0


def test_the_first_tier_is_bounded_and_frequent(table, monkeypatch):
    once = ["q" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(2000)]
    rows = [(i, "often seldom" if i % 2 else f"often {once[i]}") for i in range(2000)]
    docs = table([*rows, (9999, None), (9998, ""), (9997, "z" * 100)], files=5)
    got = token_counts.frequent_lengths(docs, JSON, size=2)
    assert set(got) == {"often", " seldom"} and all(got[p] == token_counts.lengths(JSON, [p])[0] for p in got)
    assert "z" * 100 not in token_counts.frequent_lengths(docs, JSON)
    few = token_counts.frequent_lengths(docs, JSON, sample_rows=100)
    assert {"often", " seldom"} <= set(few) and 20 < len(few) < 200
    assert token_counts.frequent_lengths(table([]), JSON) == {}


def test_very_long_pretokens_are_right_and_not_kept(library):
    """Neither worker's cache holds pre-tokens beyond its bound."""
    text = "x" * 100_000 + " " + "日本" * 20_000 + " short"
    t = Tokenizer.from_file(JSON)
    tiers = token_counts.Lengths(JSON, {})
    assert tiers.counts([text, text]) == [len(t.encode(text, add_special_tokens=False))] * 2
    assert max(map(len, tiers.cache)) <= token_counts.MAX_PIECE
    assert bpe.encode_text(MULTI, text) == library.encode_ordinary(text)
    assert max(map(len, bpe.pieces(MULTI))) <= bpe.MAX_PIECE and bpe.decode_ids(MULTI, bpe.encode_text(MULTI, text)) == text.encode()


def test_counting_moves_no_pretokens(table):
    docs = table([(i, f"word{i} and more") for i in range(50)])
    plan = token_counts.count_tokens(docs, JSON)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_a_full_summary_keeps_what_is_frequent():
    seen = Counter({"a": 50, "b": 3, "c": 1, "d": 1, "e": 1})
    assert token_counts.lightened(seen) == {"a": 49, "b": 2}
    assert token_counts.lightened(Counter("abc")) == {}


def slow_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        end = min([i for i in (rest.find(c, cut) for c in "?#") if i >= 0], default=len(rest))
        path = rest[cut:end]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[3:] if fits else (None, default))


@pytest.mark.parametrize("case", [0, 1, 2])
def test_urls_against_every_rule(spark, case):
    rnd = random.Random(case)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "example-x.org", "organic", "com", "x.com", "ex.com", "", "example.org.", "..", "É.org", "A.Example.ORG"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/en/1/x", "/fr/", "/fr/x", "/de/", "/DE/", "/é"]
    rules = url_filter.RULES if case == 0 else [(rnd.choice(["allow", "block"]), rnd.choice(hosts[:9]), rnd.choice(paths)) for _ in range(25)]
    urls = [f"{rnd.choice(['http', 'HTTPS', ''])}://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=/es/", "#/es/", "?a://b")] + [None, "", "org/es/", "no scheme", "http:/x.org/", "a://b.org/\nx?", "://", "x://a.org/fr/://c.com/de/"]
    rows = [(i, u) for i, u in enumerate(urls)] * 2 + [(None, "http://a.org/"), (-1, "http://hot.com/de/")] + [(-1, "http://hot.com/de/")] * 300
    pages = spark.createDataFrame([(*r, "<p>", "k", "p", "v") for r in rows], "page_id long, url string, html string, `key` string, path string, verdict string").repartition(5)
    want = Counter((i, *slow_verdict(u, rules)) for i, u in rows)
    assert Counter(map(tuple, url_filter.filter_urls(pages, rules).collect())) == want
    asked = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert Counter(map(tuple, url_filter.filter_urls(pages, asked, parts=37).collect())) == want
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, [], default="block").collect()} == {"block"}


def test_bounds_carry_open_rules(spark, monkeypatch):
    """Every place is a bound, and bounds hold only the beginnings of paths."""
    monkeypatch.setattr(url_filter, "PER_BOUND", 1000)
    monkeypatch.setattr(url_filter, "BOUND_SIZE", 3)
    rnd = random.Random(9)
    rules = [(rnd.choice(["allow", "block"]), rnd.choice(["a", "b.a", ""]), "/" + "".join(rnd.choices("xy", k=rnd.randint(0, 5)))) for _ in range(40)]
    rows = [(i, f"s://{rnd.choice(['a', 'b.a', 'c.b.a', 'z'])}/" + "".join(rnd.choices("xy", k=rnd.randint(0, 7)))) for i in range(300)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules, parts=150).collect()
    assert Counter(map(tuple, got)) == Counter((i, *slow_verdict(u, rules)) for i, u in rows)


def test_many_rules_below_one_host_and_hosts_of_many_labels(spark):
    n = 100_000
    rules = spark.range(n).selectExpr("CASE WHEN id % 2 = 0 THEN 'block' ELSE 'allow' END AS verdict", "'com' AS host", "concat('/p', id, '/') AS path")
    urls = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id, '.com/p', id * 7, '/q') AS url")
    long = spark.createDataFrame([(-1, "http://" + "a." * 50_000 + "com/p4/" + "x" * 100_000)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(urls.unionByName(long), rules).collect()}
    assert got.pop(-1) == ("com/p4/", "block")
    assert got == {i: (f"com/p{i * 7}/", "allow" if i * 7 % 2 else "block") for i in range(3000)}
