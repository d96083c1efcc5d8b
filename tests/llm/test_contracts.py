"""Each query against a plain brute-force version of its contract."""

import hashlib
import math
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelog.llm import queries as q
from tidelog.llm import url_filter

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in rows(spark.read.parquet(f"{SF}/documents.parquet"))}


def test_op1(spark):
    vectors = {r["vec_id"]: np.floor(256 * np.array(r["embedding"], float)).astype(int) for r in rows(spark.read.parquet(f"{SF}/embeddings.parquet"))}
    want = set()
    for query in (i for i in vectors if i % 50 == 0):
        scored = sorted((-int(vectors[query] @ v), i) for i, v in vectors.items() if i != query)[:5]
        want |= {(query, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(q.op1_exact_top_k(spark, SF))} == want


def test_op2(spark, documents):
    lib = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = {r["doc_id"]: r for r in rows(q.op2_bpe(spark, SF))}
    assert got.keys() == documents.keys()
    for k, r in documents.items():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_op8(spark, documents):
    lib = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = {r["doc_id"]: r for r in rows(q.op8_token_files(spark, SF))}
    at = 0
    for k in sorted(documents):
        ids = [*lib.encode(documents[k]["text"] or "", add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(documents)


def test_op9(spark, documents):
    got = {r["doc_id"]: r for r in rows(q.op9_fingerprints(spark, SF))}
    order = sorted(documents)
    assert sorted(got) == order
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    by_text, form = {}, lambda s: " ".join(nfkc(nfkc(s).casefold()).split())
    first = {}
    for k in order:
        first.setdefault(form(documents[k]["text"] or ""), k)
    for k, after in zip(order, order[1:] + order[:1], strict=True):
        text, other = documents[k]["text"] or "", documents[after]["text"] or ""
        n = len(text)
        edited = text[: n - n // 2] + other[: n // 2]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (float(form(text) == form(edited)), float(form(text) == form(other)))
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (r["near_edited"] == 1.0) and r["group_id"] == first[form(text)]


def test_op10(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in rows(spark.read.parquet(f"{sf}/labels.parquet"))}
    got = rows(q.op10_quality(spark, sf))
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(got) == 10_000 and all(0 <= r["score"] <= 1 and math.isfinite(r["score"]) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    right = np.mean([r["predicted"] == labels[r["doc_id"]] for r in held])
    good = np.mean([r["predicted"] for r in held if labels[r["doc_id"]] == 1])
    assert right > 0.97 and good > 0.98


def test_op3(spark, documents):
    import re

    got = {r["doc_id"]: r for r in rows(q.op3_mixing(spark, SF))}
    assert got.keys() == documents.keys()
    size = {k: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for k, r in documents.items()}
    sources = sorted({r["source"] for r in documents.values()}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[k] for k, r in documents.items() if r["source"] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, capped = {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        shares = sum(weight[s] for s in sources if s not in capped)
        target = {s: 3 * total[s] if s in capped else left * weight[s] / shares for s in sources}
        over = {s for s in sources if s not in capped and target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    taken = dict.fromkeys(sources, 0)
    for k, r in got.items():
        s = documents[k]["source"]
        assert (r["size"], r["source_size"]) == (size[k], total[s]) and r["target"] == pytest.approx(target[s], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * size[k]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sources)
    assert rows(q.op3_mixing(spark, SF).orderBy("doc_id")) == rows(q.op3_mixing(spark, SF).orderBy("doc_id"))


def brute_line_dedup(texts, min_words):
    """All runs of min_words words or more, later copies deleted; {id: text} -> {id: text}."""
    lines = {i: [(k, " ".join(x.split())) for k, x in enumerate((t or "").split("\n")) if x.split()] for i, t in texts.items()}
    first, runs, gone = {}, [], {}
    for i in sorted(lines):
        own = lines[i]
        for s in range(len(own)):
            words = 0
            for e in range(s, len(own)):
                words += len(own[e][1].split(" "))
                if words >= min_words:
                    key = tuple(x for _, x in own[s : e + 1])
                    first.setdefault(key, (i, s))
                    runs.append((i, s, e, key))
    for i, s, e, key in runs:
        if first[key][0] != i or s >= first[key][1] + len(key):
            gone.setdefault(i, set()).update(range(lines[i][s][0], lines[i][e][0] + 1))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) if i in gone else t for i, t in texts.items()}


def test_op5(spark, documents):
    want = brute_line_dedup({k: r["text"] for k, r in documents.items()}, 50)
    got = {r["doc_id"]: r for r in rows(q.op5_line_dedup(spark, SF))}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_op6(spark):
    pages = {r["page_id"]: r["url"] for r in rows(spark.read.parquet(f"{SF}/pages.parquet"))}
    got = {r["page_id"]: r for r in rows(q.op6_url_filter(spark, SF))}
    assert got.keys() == pages.keys()
    model = url_filter.default_model(spark)
    trees, suffix_rates = read_trees(model.trees), model.suffix_rates
    assert len(trees) == 12
    for k, url in pages.items():
        rest = (url or "").partition("://")[2]
        cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))]
        fits = [(len(h + p), h + p, v) for v, h, p in q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        told = "block" if by_hand(url or "", trees, suffix_rates) else "allow"
        assert r["verdict"] == (max(fits)[2] if fits else told)


def url_features(url, suffix_rates):
    """The trees' features, counted without Spark."""
    rest = url.partition("://")[2]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))]
    before, mark, query = url.partition("#")[0].partition("?")
    name = host.rpartition(".")[0] if "." in host else host
    n = max(len(name), 1)
    shares = [name.count(c) / n for c in set(name)]
    digits = lambda t: sum(c in "0123456789" for c in t)
    return [
        len(url), len(host), len(path), host.count("."), path.count("/"), digits(url) / max(len(url), 1), digits(host), -sum(x * math.log2(x) for x in shares),
        query.count("&") + 1 if query else 0, host.count("-"), sum(c in "aeiou" for c in name) / n, suffix_rates.get(host.rpartition(".")[2], 0.5),
    ]


def read_trees(model):
    """[(weight, nested (feature, threshold, below, above) or value)] from the model's printed form."""
    import re

    lines = [x.strip() for x in model.toDebugString.splitlines()]
    trees, at = [], 0

    def node():
        nonlocal at
        if m := re.fullmatch(r"Predict: (\S+)", lines[at]):
            at += 1
            return float(m[1])
        m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", lines[at])
        at += 1
        below = node()
        at += 1  # the line of the other branch
        return int(m[1]), float(m[2]), below, node()

    while at < len(lines):
        m = re.fullmatch(r"Tree \d+ \(weight (\S+)\):", lines[at])
        at += 1
        if m:
            trees.append((float(m[1]), node()))
    return trees


def by_hand(url, trees, suffix_rates):
    x, total = url_features(url, suffix_rates), 0.0
    for weight, node in trees:
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        total += weight * node
    return total > 0


def brute_components(texts, width, least, of):
    """{id: (set size, component)} by comparing every two documents that share a shingle."""
    import re
    from collections import defaultdict

    sets, at, parent = {}, defaultdict(list), {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        parent[i] = i
        for s in sets[i]:
            at[s].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in sets.items():
        common = defaultdict(int)
        for s in own:
            for j in at[s]:
                common[j] += j < i
        for j, k in common.items():
            if k and of * k >= least * (len(own) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_op4(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(q.op4_ngram_join(spark, SF))}
    assert got == brute_components({k: r["text"] for k, r in documents.items()}, 4, 85, 100)


def test_op7(spark):
    import html as h
    import re

    pages = {r["page_id"]: r for r in rows(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))}
    got = {r["page_id"]: r for r in rows(q.op7_html_extraction(spark, "/root/testdata/sf0.01"))}
    assert got.keys() == pages.keys()
    for k, page in pages.items():
        body = re.search(r"<article>(.*?)(</article>|\Z)", page["html"], re.S)[1]
        body = re.sub(r"<[^<>]*\Z", "", body)
        blocks = (" ".join(h.unescape(re.sub("</?b>|<br>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body))
        assert got[k]["text"] == "\n".join(b for b in blocks if b) and got[k]["n_chars"] == len(got[k]["text"])
        assert got[k]["url"] == page["url"]
