"""Nulls, empty and long texts, ties, repeats, empty tables and clashing extra columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import bpe, fingerprint, html_extract, line_dedup, mixing, ngram_join, quality, token_files, topk, url_filter
from tidelog.llm.components import connected_components
from tidelog.llm.queries import BYTE_TOKENIZER, END_ID, URL_RULES, WORD_TOKENIZER, tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
LINE = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    """Every awkward case, with extra columns that clash with names used inside."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "b", 0),
        (3, "  \n\t ", None, "b", 5),
        (4, LONG, "en", "a", len(LONG)),
        (5, LINE, "en", "a", len(LINE)),
        (6, f"own line\n{LINE}\n\nlast", "en", None, 0),
        (7, "ça va ÉTÉ <|endoftext|> \u00a0x\u2003y ﬁ", "fr", "é", 30),
        (8, "One two three", "en", "b", 13),
        (8, "One two three", "en", "b", 13),
        (9, "one TWO three", "en", "c", 13),
    ]
    df = spark.createDataFrame(rows, DOCS)
    extra = {c: F.lit(i) for i, c in enumerate(("node", "key", "size", "taken", "score", "ids", "id", "_id", "spans", "part", "h", "grp", "offset", "z", "a", "b"))}
    return df.withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_top_k(spark):
    nan = float("nan")
    v = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (2, [1.0, 0.0]), (None, [1.0, 1.0]), (9, [])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("g", F.lit(2))
    got = [(r["rank"], r["vec_id"], r["score"]) for r in rows(topk.exact_top_k(df.filter("vec_id = 1"), df, 5).orderBy("rank"))]
    assert got == [(1, 2, 65536), (2, 2, 65536), (3, 3, 32768)]
    assert rows(topk.exact_top_k(df.limit(0), df, 5)) == [] and rows(topk.exact_top_k(df.filter("vec_id = 1"), df.limit(0), 5)) == []


def brute_top_k(ids, x, q_ids, q, k):
    whole = lambda m: [[int(v) for v in column] for column in m.T]
    limit = lambda v: max(-(2**63), min(2**63 - 1, v))
    xs = whole(x)
    return [sorted((-limit(sum(a * b for a, b in zip(v, w, strict=True))), int(i)) for i, w in zip(ids, xs, strict=True) if i != own)[:k] for own, v in zip(q_ids, whole(q), strict=True)]


@pytest.mark.parametrize("kind", ["clustered", "one outlier", "huge", "few values", "repeats"])
def test_top_k_prunes_exactly(kind):
    """Blocks one after the other against whole numbers; ids tie and repeat, a query meets its own row."""
    r = np.random.default_rng(1)
    centres = 40 * r.normal(size=(64, 12)) * (np.arange(64)[:, None] < 16)
    x = np.floor(256 * (centres[:, r.integers(0, 12, 3000)] / 40 + 0.1 * r.normal(size=(64, 3000))))
    q = np.floor(256 * (centres[:, r.integers(0, 12, 9)] / 40 + 0.1 * r.normal(size=(64, 9))))
    if kind == "one outlier":
        x[:, 1700] *= 2.0**40
    elif kind == "huge":
        x[5, ::7], q[5, ::2] = 2.0**62, -(2.0**62)
    elif kind == "few values":
        x, q = np.sign(x) * (np.abs(x) > 200), np.sign(q)
    ids = r.permutation(3000).astype(np.int64)
    if kind == "repeats":
        ids = ids // 3
    q_ids = np.arange(9, dtype=np.int64)
    best, shares = [[] for _ in q_ids], []
    for lo in range(0, 3000, 1000):
        shares.append(topk.block_search(ids[lo : lo + 1000], x[:, lo : lo + 1000], q_ids, q, 7, best))
    assert best == brute_top_k(ids, x, q_ids, q, 7)
    assert kind != "clustered" or (shares[0] < 0.8 and shares[-1] < 0.5), shares


def test_top_k_of_huge_components(spark):
    """Beyond 64 bits a component takes its vector out and a score stays at the limit."""
    v = [(1, [2.0**32]), (2, [2.0**32]), (3, [3.4e38]), (4, [1e307]), (5, [-(2.0**32)]), (6, [2.0**20]), (7, [1.7e308])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in rows(topk.exact_top_k(df.filter("vec_id = 1"), df, 5).orderBy("rank"))]
    assert got == [(1, 2, 2**63 - 1), (2, 6, 2**63 - 1), (3, 5, -(2**63))]
    floats = df.select("vec_id", F.col("embedding").cast("array<float>"))
    assert len(rows(topk.exact_top_k(floats, floats, 2))) == 8


def test_bpe(odd, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file(WORD_TOKENIZER))
    got = rows(bpe.bpe_encode_decode(odd, tokenizer_file(WORD_TOKENIZER)))
    texts = {r["doc_id"]: r["text"] for r in rows(odd)}
    assert len(got) == 10
    for r in got:
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids and r["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert rows(bpe.bpe_encode_decode(none, tokenizer_file(WORD_TOKENIZER))) == []


def test_bpe_automaton_on_random_words():
    import random

    from tokenizers import Tokenizer

    lib, own, r = Tokenizer.from_file(tokenizer_file(WORD_TOKENIZER)), bpe.codec(tokenizer_file(WORD_TOKENIZER)), random.Random(4)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "aaab", "theinrgo", "ab<|>'é漢🎉1\x1c\x85\u00a0 ́Σς"):
        for _ in range(500):
            s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            ids = lib.encode(s, add_special_tokens=False).ids
            assert np.frombuffer(own.encode(s), "<u4").tolist() == ids, s


def test_mixing(odd, none):
    plan = rows(mixing.plan_mix(odd))
    assert len(plan) == 10 and {r["source"] for r in plan} == {"a", "b", "c", "é", None}
    for s in {r["source"] for r in plan}:
        mine = [r for r in plan if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1 and all(r["taken"] <= 3 * r["size"] for r in mine)
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
    assert all(r["taken"] == 0 for r in plan if r["size"] == 0)
    assert rows(mixing.plan_mix(none)) == [] and rows(mixing.mix(none)) == []
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert sum(len((r["text"] or "").split()) for r in rows(mixed.filter("doc_id != 7"))) == sum(r["taken"] for r in plan if r["doc_id"] != 7)


def test_curriculum_positions(spark):
    docs = spark.createDataFrame([(i, " ".join("w" * (i % 9 + 1)), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    plan = mixing.plan_mix(docs, schedule=[[3, 1, 0], [1, 1, 1], [0, 1, 3]])
    order = rows(mixing.training_order(plan))
    positions = [r["position"] for r in order]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert sum(r["words"] for r in order) == sum(r["taken"] for r in rows(plan))
    early = sum(r["position"] < 0.5 for r in order if r["source"] == "s0") / sum(r["source"] == "s0" for r in order)
    late = sum(r["position"] < 0.5 for r in order if r["source"] == "s2") / sum(r["source"] == "s2" for r in order)
    assert early > 0.7 and late < 0.3


@pytest.mark.parametrize(("width", "least"), [(4, 85), (5, 80)])
def test_ngram_join(spark, odd, none, width, least):
    import random

    from tests.llm.test_contracts import brute_components

    sim = ngram_join.Similarity(least, 100)
    assert rows(ngram_join.ngram_components(none, width, sim)) == []
    got = rows(ngram_join.ngram_components(odd, width, sim))
    assert len(got) == 10
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3) and by_id[8] == (1, 8) and by_id[9] == (1, 8)
    assert sorted(r["doc_id"] for r in rows(ngram_join.keep_one(odd, width, sim)))[-2:] == [8, 8]
    r, words = random.Random(width), [f"w{i}" for i in range(2_000)]
    texts, base = {}, [r.choice(words) for _ in range(250)]
    for i in range(90):  # a chain of near copies: far ends are not alike, all are one component
        base = base[:]
        base[r.randrange(250)] = r.choice(words)
        texts[i] = " ".join(base)
    passage = [r.choice(words) for _ in range(100)]
    for i in range(100, 180):  # a passage that many share doesn't make them alike
        n = r.choice((20, 40, 80, 300))
        texts[i] = " ".join(passage + [r.choice(words) for _ in range(n)])
    for i in range(200, 300):
        w = [r.choice(words) for _ in range(r.choice((3, 6, 9, 14, 40, 700)))]
        for k in range(2):
            texts[i + 200 * k] = " ".join(w[: len(w) - k])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows(ngram_join.ngram_components(df, width, sim))} == brute_components(texts, width, least, 100)


def test_ngram_join_by_blocks(spark, monkeypatch):
    """Groups beyond the bound are compared as blocks of outlines."""
    import random

    from tests.llm.test_contracts import brute_components

    monkeypatch.setattr(ngram_join, "GROUP", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 1)
    r, words = random.Random(8), [f"w{i}" for i in range(500)]
    texts, base = {}, [r.choice(words) for _ in range(120)]
    for i in range(40):
        base = base[:]
        for _ in range(r.choice((1, 1, 6))):
            base[r.randrange(120)] = r.choice(words)
        texts[i] = " ".join(base)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows(ngram_join.ngram_components(df, 4, ngram_join.Similarity(85, 100)))}
    assert got == brute_components(texts, 4, 85, 100)


def test_components_by_rounds(spark):
    import random

    r, links = random.Random(1), [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    links += [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(90)]
    df = spark.createDataFrame(links, "a long, b long")
    one = {(x["node"], x["root"]) for x in rows(connected_components(df))}
    assert one == {(x["node"], x["root"]) for x in rows(connected_components(df, one_task=0))}
    assert dict(one)[40] == 0 and dict(one)[159] == 100
    assert rows(connected_components(df.limit(0))) == []


def test_line_dedup(odd, none):
    got = rows(line_dedup.dedup_lines(odd))
    assert line_dedup.dedup_lines(odd).columns == odd.columns and len(got) == 10
    by_id = {r["doc_id"]: r["text"] for r in got}
    assert by_id[1] is None and by_id[2] == "" and by_id[3] == "  \n\t " and by_id[4] == LONG and by_id[5] == LINE
    assert by_id[6] == "own line\n\nlast" and by_id[8] == "One two three"
    assert rows(line_dedup.dedup_lines(none)) == []


def test_line_dedup_runs(spark):
    """Runs of several lines, blank lines inside, repeats inside a document and runs too short to count."""
    from tests.llm.test_contracts import brute_line_dedup

    block = "\n".join(" ".join(f"b{k}_{j}" for j in range(9)) for k in range(8))
    texts = {i: f"head {i}\n{block}\n\ntail {i}" for i in range(3)}
    texts |= {10: block + "\n" + block, 11: block.replace("\n", "\n\n"), 12: "\n".join(block.split("\n")[:5]), 13: "a b c\n" * 60, 14: "\n".join(["x " * 30] * 7)}
    got = {r["doc_id"]: r["text"] for r in rows(line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))}
    assert got == brute_line_dedup(texts, 50)
    assert got[1] == "head 1\n\ntail 1" and got[12] == texts[12]


def test_url_filter(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Example.com/en/x?q=1#t"), (5, "http://a.net/fr/1"), (6, "http://net/es/"), (7, "x://anet/es/2"), (8, "http://casino-bets.example.org/"), (8, "http://casino-bets.example.org/"), (9, "http://thonered.example.org/en/7"), (10, "http://" + "a" * 20_000)]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("rule", F.lit(1))
    model = url_filter.UrlModel(spark)
    got = {r["page_id"]: r for r in rows(url_filter.filter_urls(df, URL_RULES, model))}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[3]["host"]) == ("", "", None, "")
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[5]["rule"], got[5]["verdict"]) == ("net/fr/", "block") and got[6]["rule"] == "net/es/" and got[7]["rule"] is None
    assert got[8]["verdict"] == "block" and got[9]["verdict"] == "allow"
    assert url_filter.filter_urls(df, URL_RULES, model).count() == 11 and rows(url_filter.filter_urls(df.limit(0), URL_RULES, model)) == []
    held = url_filter.labelled_urls(400, seed=77)
    told = {r["page_id"]: r["verdict"] for r in rows(url_filter.filter_urls(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string"), (), model))}
    assert np.mean([(told[i] == "block") == bool(y) for i, (_, y) in enumerate(held)]) > 0.93


def test_html_extraction(spark):
    page = "<html><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><article><h1>A &amp; B</h1><p>First <b>bold</b>\n  text&nbsp;here.<br>More words follow, and more of them.</p><p>Second &lt;p&gt; block, of some length.<script>var p='<p>no</p>';</script></p></article><footer>&copy; nobody</footer></body></html>"
    want = "A & B\nFirst bold text here. More words follow, and more of them.\nSecond <p> block, of some length."
    cases = [(1, "u", None), (2, None, ""), (3, "u", "<<<>>> & &am"), (4, "u", page), (4, "u", page), (5, "u", "<div>" * 3_000 + "deep"), (6, "u", "<!-- only a comment"), (7, "u", "<script>never closed")]
    df = spark.createDataFrame(cases, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("_html", F.lit(1))
    got = rows(html_extract.extract_main_text(df.drop("_html")))
    assert len(got) == 8 and [r["text"] for r in got if r["page_id"] == 4] == [want, want]
    assert {r["text"] for r in got if r["page_id"] in (1, 2, 6, 7)} == {""} and html_extract.extract_main_text(df.limit(0)).count() == 0


def test_html_extraction_on_hand_written_pages():
    """Pages of twelve shapes that the composer has no hand in."""
    from tests.llm.pages import PAGES

    trees, shared, kept_all, wanted_all = html_extract.train(), 0, 0, 0
    for name, source in PAGES.items():
        page = html_extract.parse(source)
        want = {k for k in range(1, len(page.tag)) if page.tag[k] == "#text" and page.label[k] == 1}
        kept = set(html_extract.decode(page, trees.log_odds(html_extract.features(page))))
        assert 2 * len(want & kept) >= 0.6 * (len(want) + len(kept)), name
        shared, kept_all, wanted_all = shared + len(want & kept), kept_all + len(kept), wanted_all + len(want)
    print(f"precision {shared / kept_all:.3f}, recall {shared / wanted_all:.3f}")
    assert 2 * shared >= 0.95 * (kept_all + wanted_all)


@pytest.mark.parametrize("piece", ["<", "<a", "<a '", "<!", "</", "<!--", "<a b='", "<a b='<a c=\"", "<script>", "<template>", "<div>", "<li><div></p>", "<tr><table><div></tr>", "&#9", "&", "<p>x", "a"])
def test_broken_pages_take_one_pass(piece):
    """1 MB of each, and one tag name of 1 MB."""
    import time

    began = time.process_time()
    for source in (piece * (1_000_000 // len(piece)), "<" + piece.strip("<&") * (1_000_000 // len(piece))):
        html_extract.parse(source)
    assert time.process_time() - began < 6


def test_broken_markup_loses_no_text():
    texts = lambda source: [t for t in html_extract.parse(source).text if t]
    assert texts("a < b <p>c<3 d") == ["a < b", "c<3 d"]
    assert texts("<p>one<p title='x>y'>two<p title='x>three</p>four") == ["one", "two", "three", "four"]
    assert texts("<html><head><title>T</title><article><p>kept</article>") == ["kept"]
    assert texts("<p>one <video>two <object>three</object> <noscript>four</noscript> five") == ["one two three", "four", "five"]
    assert texts("<p>one<script>var a='<p>no</p>'</SCRIPT >two<template><p>no</template>three<template>four") == ["onetwothreefour"]
    assert texts("<!-->a<!--b--!>c<!--d") == ["ac"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert texts("<p>&#" + "9" * 5000 + "; &#x0000000041; &#0000065; &amp;lt;</p><p>cut <b") == ["\ufffd A A &lt;", "cut"]


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    lib, path = Tokenizer.from_file(tokenizer_file(BYTE_TOKENIZER)), tokenizer_file(BYTE_TOKENIZER)
    got = sorted(rows(token_files.token_files(odd, path, END_ID)), key=lambda r: r["start"])
    at = 0
    for r, d in zip(got, sorted(rows(odd), key=lambda d: d["doc_id"]), strict=True):
        ids = [*lib.encode(d["text"] or "", add_special_tokens=False).ids, END_ID]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d["doc_id"], at, len(ids)) and np.frombuffer(r["token_ids"], "<u4").tolist() == ids
        at += len(ids)
    assert rows(token_files.token_files(none, path, END_ID, str(tmp_path / "f"))) == []


def test_simple_8b():
    r = np.random.default_rng(3)
    for _ in range(60):
        lengths = r.choice([0, 1, 7, 300, 9_000], size=r.integers(1, 5)).tolist()
        n = sum(lengths)
        ids = np.where(r.random(n) < 0.2, 0, r.integers(0, 2 ** r.choice([1, 4, 11, 17, 33, 59], size=n), dtype=np.int64)).astype(np.uint64)
        at = 0
        for length, payload in zip(lengths, token_files.pack_all(ids, lengths), strict=True):
            assert (token_files.unpack(payload) == ids[at : at + length]).all()
            if length:
                last = (length - 1) // token_files.BLOCK
                assert (token_files.unpack_part(payload, last)[: length - last * token_files.BLOCK] == ids[at + last * token_files.BLOCK : at + length]).all()
            at += length
    with pytest.raises(ValueError):
        token_files.pack(np.array([2**60], np.uint64))


def test_fingerprints(odd, none):
    got = rows(fingerprint.edit_report(odd))
    assert len(got) == 10 and rows(fingerprint.edit_report(none)) == []
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_chars"] == 0 and by_id[1]["near_edited"] == 1.0 and by_id[1]["near_next"] == 1.0
    assert by_id[8]["fingerprint"] == by_id[9]["fingerprint"] and sorted(r["near_next"] for r in got if r["doc_id"] == 8) == [1.0, 1.0]
    groups = {r["doc_id"]: r["group_id"] for r in rows(fingerprint.exact_groups(odd))}
    assert groups[9] == 8 and groups[8] == 8 and groups[2] == groups[3] == groups[1] == 1 and groups[5] == 5
    assert fingerprint.canonical("ﬁ  Straße\u00a0X") == fingerprint.canonical("FI strasse x ")
    assert {r["doc_id"]: r["canonical_bytes"] for r in rows(fingerprint.fingerprints(odd))}[8] == 13


def test_fingerprint_collisions_are_told_apart(spark, monkeypatch):
    """With a digest that collides the bytes decide."""
    assert fingerprint.likeness(b"a", b"b") == 0.0 and fingerprint.likeness(b"a", b"a") == 1.0
    monkeypatch.setattr(fingerprint, "digest", lambda form: "same")
    assert fingerprint.likeness(b"a", b"b") == 0.0
    found = spark.createDataFrame([("same", b"a", 1, 2), ("same", b"b", 2, 2), ("other", None, 3, 1)], "fingerprint string, z binary, group_id long, forms long")
    import zstandard

    press = zstandard.ZstdCompressor(level=fingerprint.LEVEL).compress
    found = found.withColumn("z", F.when(F.col("group_id") == 1, F.lit(press(b"a"))).when(F.col("group_id") == 2, F.lit(press(b"b"))))
    docs = spark.createDataFrame([(1, "same", "A"), (2, "same", "b "), (3, "other", "c"), (4, "same", " a")], "doc_id long, fingerprint string, text string")
    assert {r["doc_id"]: r["group_id"] for r in rows(fingerprint.with_groups(docs, found, text="text"))} == {1: 1, 2: 2, 3: 3, 4: 1}


def test_groups_of_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "A b"), (5, "a  B"), (None, "only"), (7, None), (6, " ")], "doc_id long, text string")
    got = {(r["doc_id"], r["group_id"]) for r in rows(fingerprint.exact_groups(docs))}
    assert got == {(None, 5), (5, 5), (None, None), (7, 6), (6, 6)}


def test_quality(spark, odd, none):
    good = [f"the {w} of many {w}s was seen by all, and it went on as before" for w in ("house", "river", "school", "garden", "market", "letter", "window", "summer")]
    bad = [f"{w}*** {w}%%% {w}### ===" for w in ("buy", "win", "cash", "free", "click", "deal", "bonus", "sale")]
    model = quality.fit_quality(bad * 3 + [b + " !!!" for b in bad], good * 3 + [g + " again" for g in good], 0.5)
    assert model.scores([good[0] + " and on"])[0] > 0.5 > model.scores([bad[0] + " $$$"])[0]
    scored = rows(quality.score_quality(odd, model))
    assert len(scored) == 10 and all(0 <= r["score"] <= 1 for r in scored)
    assert rows(quality.score_quality(none, model)) == [] and quality.filter_quality(odd, model, 0.0).count() == 10
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (99, 0), (8, None), (9, 7)], "doc_id long, quality int")
    few = quality.train_quality(odd, labels)
    assert all(0 <= r["score"] <= 1 for r in rows(quality.score_quality(odd, few)))
    empty = quality.train_quality(none, labels.limit(0))
    assert {r["score"] for r in rows(quality.score_quality(odd, empty))} == {0.5}
