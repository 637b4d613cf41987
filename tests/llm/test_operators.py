"""Operators of the corpus subpackage against plain versions, on small tables with every odd case."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, hyperminhash, licenses, packing, quality, secrets, topk, urls, winnow, wrappers
from spanloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, cid string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"src{k % 3}" if k % 4 else None, 0, "x", "y") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


ODD = [None, "", " ", "\n\t ", "one", "A b C d", "word " * 3000, "é" * 5000, "x  y\u00a0 z ", "<|endoftext|> a<|endoftext|>", "same text of six words here", "same text of six words here"]


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def reference_ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


# 1 -------------------------------------------------------------------------------------------------


def plain_topk(rows, k=10, every=100):
    out = {}
    sound = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, w in sound:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in sound if i != q and len(v) == len(w))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


@pytest.mark.parametrize("block_rows", [7, 64, 1 << 14])
def test_topk(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(0, 400, 2)]
    rows += [(1, rows[0][1]), (3, rows[0][1]), (5, None), (7, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9, [float("nan")] * 6), (11, [float("inf")] * 6), (None, [1.0] * 6), (500, []), (13, []), (600, [0.0] * 6), (700, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in topk.exact_topk(df, block_rows=block_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: v for q, v in plain_topk(rows).items() if v}


@pytest.mark.parametrize("block_rows", [5, 1 << 14])
def test_topk_of_large_components(spark, block_rows):
    rng = np.random.default_rng(4)
    rows = [(0, [100000.0, 1.0]), (1, [70000.0, 1.0]), (2, [90000.0, 1.0])]
    rows += [(100 * i + 3, [float(x) for x in rng.normal(0, 10.0 ** (i % 7), 2)]) for i in range(1, 60)] + [(100 * i, [float(x) for x in rng.normal(0, 10.0 ** (i % 7), 2)]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.exact_topk(df, block_rows=block_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == plain_topk(rows)
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.exact_topk(huge).orderBy("rank").collect()] == [(1, topk.WIDEST), (3, 5 << 20), (2, -topk.WIDEST)]


def test_topk_empty(spark):
    assert topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# 2 -------------------------------------------------------------------------------------------------


def test_winnow_guarantee_and_ties(spark):
    passage = " ".join(f"p{i}" for i in range(winnow.MATCH_WORDS))
    rows = docs(spark, [f"a b c {passage} d e f", f"q {passage} r s t u v", "z " * 40])
    got = {r.doc_id: r for r in winnow.fingerprints(rows).collect()}
    shared = set(got[0].hashes) & set(got[1].hashes)
    assert shared
    at = {h: p for h, p in zip(got[0].hashes, got[0].positions)}
    assert all(3 <= at[h] <= 3 + winnow.MATCH_WORDS - winnow.GRAM for h in shared)
    # All k-grams are equal: the rightmost of every window is chosen.
    assert got[2].positions == list(range(winnow.WINDOW - 1, 40 - winnow.GRAM + 1))


def test_winnow_edited(spark):
    texts = [*ODD, *(" ".join(f"w{i * j % 97}" for i in range(60)) for j in range(1, 9))]
    ids = [*range(5), None, *range(6, len(texts))]
    ids[11] = ids[10]
    got = winnow.compare_edited(docs(spark, texts, ids)).collect()
    assert len(got) == len(texts)
    prints = {}
    for r in got:
        prints.setdefault(r.fingerprint, []).append(r)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    order = sorted(range(len(texts)), key=lambda k: (-1 if ids[k] is None else ids[k]), reverse=True)
    want = set()
    for n, k in enumerate(order):
        own, after = texts[k] or "", texts[order[(n + 1) % len(order)]] or ""
        m = len(own) // 3
        want.add((ids[k], len(own), hashlib.sha256((own[: len(own) - m] + after[:m]).encode()).hexdigest()))
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got} == want
    assert winnow.compare_edited(docs(spark, texts, ids).limit(0)).collect() == []


# 3 -------------------------------------------------------------------------------------------------


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and low[b] < low[a]:
                    low[a], changed = low[b], True
    return {(i, len(sets[i]), low[i], low[i] == i) for i in sets}


@pytest.mark.parametrize("block", [4, 1024])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(hyperminhash, "BLOCK_DOCUMENTS", block)
    monkeypatch.setattr(hyperminhash, "BLOCK_SHINGLES", block * 1024)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    texts = list(ODD)
    for k in range(30):
        own = list(base)
        for at in rng.integers(0, 300, k % 7 + 1):
            own[at] = f"edit{k}"
        texts.append(" ".join(own))
    texts += [" ".join(f"u{x}" for x in rng.integers(0, 9000, 40)) for _ in range(20)] + ["ONE", "one"]
    got = hyperminhash.near_duplicates(docs(spark, texts))
    assert {tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()} == plain_components(list(enumerate(texts)))


def test_near_duplicates_odd_ids(spark):
    same = "a text that is long enough to hold some shingles of five words"
    got = hyperminhash.near_duplicates(docs(spark, [same, same, same, None], [4, 4, None, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("4", "4", True)] * 2 + [("None", "None", True)] * 2
    assert hyperminhash.near_duplicates(docs(spark, ["a"]).limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (60, 50), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 60: 50, 100: 50}


# 4, 10 ---------------------------------------------------------------------------------------------


def test_bpe(spark, vocabulary):
    texts = [*ODD, "It's  2024's\r\n\r\nend \x1c!\u2003x", "naïve\u0000null 漢字 \U0001f600", " lead", "trail ", "a\n b"]
    ids = [*range(len(texts) - 2), None, None]
    want = sorted((str(i), reference_ids(vocabulary, t), t or "") for i, t in zip(ids, texts))
    rows = docs(spark, texts, ids)
    rows.write.mode("overwrite").parquet(path := str(spark.sparkContext.getCheckpointDir() or "/tmp/spanloom-test") + "/bpe")
    rows = spark.read.parquet(path)
    for block_chars in (10, 1 << 20):
        coded = bpe.decode(bpe.encode(rows, vocabulary, block_chars=block_chars), vocabulary).collect()
        assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in coded) == want
    assert bpe.round_trip(rows.limit(0), vocabulary).collect() == []


def test_bpe_of_equal_blocks(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    two = docs(spark, ["one and two", "three"]).coalesce(1)
    two.write.mode("overwrite").parquet(path := str(spark.sparkContext.getCheckpointDir() or "/tmp/spanloom-test") + "/bpe-equal")
    two = spark.read.parquet(path)
    want = {(i, tuple(reference_ids(vocabulary, t)), t) for i, t in enumerate(["one and two", "three"])}
    for rows in (two.union(two), two.union(two).coalesce(1), two.union(two).union(two)):
        for block_chars in (1, 12, 1 << 20):
            coded = bpe.decode(bpe.encode(rows, vocabulary, block_chars=block_chars), vocabulary).collect()
            assert {(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in coded} == want
            assert len(coded) == rows.count()


@pytest.mark.parametrize("targets", [None, {"src1": 1, "src2": 3}])
def test_packing(spark, vocabulary, targets):
    texts = [*ODD, *(f"document {i} " * (i % 40) for i in range(60))]
    got = packing.pack(docs(spark, texts), vocabulary, length=64, targets=targets, with_ids=True).collect()
    whole = {i: [*reference_ids(vocabulary, t), 0] for i, t in enumerate(texts)}
    for i, ids in whole.items():
        parts = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in parts for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert [r.start for r in parts] == list(np.cumsum([0] + [r.length for r in parts])[:-1])
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids) for r in parts)
    places = sorted((r.sequence_id * 64 + r.offset, r.length) for r in got)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    assert all(r.offset + r.length <= 64 for r in got)
    assert packing.pack(docs(spark, texts).limit(0), vocabulary).collect() == []


def test_rounds_keep_proportions():
    rounds = packing.Rounds([1000, 3001, 77], [1000, 3001, 77], 100)
    seen = np.zeros(4078, int)
    for s, n in enumerate(rounds.totals):
        for at, size, place in rounds.pieces(s, 0, n):
            assert not seen[place : place + size].any()
            seen[place : place + size] = s + 1
    for w in range(40):
        shares = np.bincount(seen[100 * w : 100 * w + 100], minlength=4)[1:]
        assert abs(shares - np.array([24.5, 73.6, 1.9])).max() < 2.5


def path_of(totals, s):
    """Forks above leaf s: tokens below, tokens on the left side, whether s lies on the right."""
    height, out = max(len(totals) - 1, 0).bit_length(), []
    for k in range(height):
        up = s >> (k + 1)
        below = totals[up << (k + 1) : (up + 1) << (k + 1)]
        out.append((sum(below), sum(below[: 1 << k]), bool(s >> k & 1)))
    return out


@pytest.mark.parametrize("totals", [[5], [1000, 3001, 77], [int(x) for x in np.random.default_rng(7).integers(1, 400, 77)], [1] * 130 + [5000]], ids=["one", "three", "many", "tiny"])
def test_forks_place_every_token_once(totals):
    n, left, right = (np.array([[f[i] for f in path_of(totals, s)] for s in range(len(totals))]).reshape(len(totals), -1) for i in range(3))
    forks, everything = packing.Forks(n, left, right), sum(totals)
    leaf = np.arange(len(totals))
    row, at, size, place = packing.window_pieces(forks, everything, 100, leaf, np.zeros(len(totals), np.int64), np.array(totals))
    owner = np.full(everything, -1)
    for r, a, k, p in zip(row, at, size, place):
        assert (owner[p : p + k] == -1).all() and p // 100 == (p + k - 1) // 100
        owner[p : p + k] = r
    assert (owner >= 0).all() and sum(size) == everything
    # At the end of every window each queue is within a token a fork of its share.
    for w in range(1, everything // 100):
        owed = np.array(totals) * (100 * w / everything)
        assert (abs(np.bincount(owner[: 100 * w], minlength=len(totals)) - owed) < max(n.shape[1], 1)).all()
    # A document cut out of a queue finds the same places.
    half = np.array(totals) // 2
    whole = {(r, a + i): p + i for r, a, k, p in zip(row, at, size, place) for i in range(k)}
    for r, a, k, p in zip(*packing.window_pieces(forks, everything, 100, leaf, half, np.array(totals))):
        assert all(whole[r, a + i] == p + i for i in range(k))


def test_floor_of_large_products():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 45, 5000), rng.integers(1, 1 << 45, 5000)
    c = np.maximum(b - rng.integers(0, 5, 5000) * rng.integers(0, 1 << 30, 5000), 1 << 44)
    for plus in (0, -1):
        a = np.maximum(a, 1)
        assert packing._floor(a, b, c, plus).tolist() == [(x * y + plus) // z for x, y, z in zip(a.tolist(), b.tolist(), c.tolist())]


def test_two_hundred_sources_keep_their_proportions(spark, vocabulary):
    rows = [(i, f"w{i} " * (20 + i % 60), f"s{i % 200}") for i in range(2000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), vocabulary, length=512).collect()
    tokens, window = {}, {}
    for r in got:
        tokens[r.queue] = tokens.get(r.queue, 0) + r.length
        window[r.sequence_id, r.queue] = window.get((r.sequence_id, r.queue), 0) + r.length
    everything, last = sum(tokens.values()), max(r.sequence_id for r in got)
    assert len(tokens) == 200 and last > 20
    # Eight forks owe a source less than a token each at both ends of a window.
    for w in range(last):
        for source, n in tokens.items():
            assert abs(window.get((w, source), 0) - 512 * n / everything) < 16


# 5 -------------------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [f"http://h{i}.example.{t}/{p}/{i}?a={i}" for i in range(40) for t, p in (("com", "fr"), ("com", "de"), ("org", "es"), ("org", "en"), ("net", "en"))]
    odd = [None, "", "no scheme", "http://", "HTTP://A.ORG/x#y", "x://org", "x://org/", "x://notorg/", "https://EXAMPLE.org/en/1?q=/z", "x://a.example.org/en/2"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*rows, *odd])], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, u in enumerate([*rows, *odd]):
        rest = (u or "").partition("://")[2]
        host = re.split("[/?#]", rest)[0].lower() if "://" in (u or "") else ""
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [(len(r), r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule, verdict = (max(fits)[1:]) if fits else (None, got[i].verdict)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
        assert verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).collect() == []


def test_urls_learn(spark):
    labelled = spark.createDataFrame([(f"http://{'win' if i % 2 else 'www'}-{i % 7}.example.net/a/{i}", i % 2) for i in range(200)], "url string, label int")
    pages = spark.createDataFrame([(1, "http://win-3.example.net/a/999"), (2, "http://www-2.example.net/a/999")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, rules=[], labelled=labelled).collect()} == {1: "block", 2: "allow"}


# 6 -------------------------------------------------------------------------------------------------


def test_licenses(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License.\nmore"), ("a/x.c", "code"), ("a/b/y.c", None), ("a/b/COPYING", "text\nThis work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/z.c", ""), ("q/r.c", "code"), (None, "code"), ("a/own.c", "// Licensed under the Apache License, Version 2.0."), ("a/x.c", "code"), ("LICENSEE/x", "a licence"),
    ]
    df = spark.createDataFrame([(p, t, "clash") for p, t in files], "path string, text string, licence string")
    got = {(r.path, r.licence, r.origin, r.from_folder) for r in licenses.scan(df, "path").collect()}
    assert got == {
        ("a/LICENSE", "MIT", "own", None), ("a/x.c", "MIT", "inherited", "a"), ("a/b/y.c", "GPL-3.0", "inherited", "a/b"), ("a/b/COPYING", "GPL-3.0", "own", None),
        ("a/b/c/z.c", "GPL-3.0", "inherited", "a/b"), ("q/r.c", None, "none", None), (None, None, "none", None), ("a/own.c", "Apache-2.0", "own", None), ("LICENSEE/x", None, "none", None),
    }
    assert licenses.scan(df, "path").count() == len(files)
    assert licenses.scan(df.limit(0), "path").collect() == []


def test_license_cosine(spark):
    text = "released under the mit license, see the license"
    vectors, idf, unknown = licenses.weights(licenses.TEMPLATES)
    own = licenses.terms(text)
    norm = sum((k * idf.get(t, unknown)) ** 2 for t, k in own.items()) ** 0.5
    want = {n: sum(k * idf[t] * v[t] for t, k in own.items() if t in v) / norm for n, v in vectors.items() if set(own) & set(v)}
    df = spark.createDataFrame([("f", text)], "_file string, text string")
    got = {r.licence: r.cosine for r in licenses.line_scores(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


# 7 -------------------------------------------------------------------------------------------------


def test_secrets(spark):
    rng = np.random.default_rng(2)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(60)]
    texts = [f'some words token = "{h}" and more' if i % 2 else f"card {'4' + h[:4] + '12345678901234567'} or commit of 2024 {h[:3]} here" for i, h in enumerate(hexes)]
    rows = docs(spark, [*texts, *ODD])
    got = secrets.scan(rows).collect()
    assert {r.token for r in got if r.is_secret} == {h for i, h in enumerate(hexes) if i % 2}
    assert all(r.position == 4 for r in got if r.is_secret)
    clean = {r.doc_id: r for r in secrets.redact(rows).collect()}
    assert len(clean) == len(texts) + len(ODD) and secrets.redact(rows).columns == rows.columns
    for i, t in enumerate([*texts, *ODD]):
        want = t.replace(hexes[i], secrets.MASK) if i < 60 and i % 2 else t
        assert clean[i].text == want
        assert clean[i].n_chars == (len(want) if i < 60 and i % 2 else 0)
    assert secrets.scan(rows.limit(0)).collect() == [] and secrets.redact(rows.limit(0)).collect() == []
    # Without ids, and with one id for all, each text loses its own secrets only and no row is lost or doubled.
    want = sorted(c.text or "" for c in clean.values())
    for shared in (None, 7):
        same = rows.withColumn("doc_id", F.lit(shared).cast("long"))
        assert sorted(r.text or "" for r in secrets.redact(same).collect()) == want


def test_secrets_of_long_words(spark):
    rng = np.random.default_rng(3)
    word = lambda k: "".join(rng.choice(list("0123456789abcdefXYZ_/"), k))
    texts = [";".join(word(k) for k in rng.integers(10, 24, 300)) + "!" for _ in range(4)]
    texts += ['{"text":"' + "abcdefghijklmnop" * 3 + '","token":"' + word(40) + '"}', "no_digit_in_this_long_run", "a" * 15 + "1", "b" * 15 + ",1"]
    want = sorted((i, t) for i, text in enumerate(texts) for t in re.findall(r"[A-Za-z0-9_+/=.~-]{16,}", text) if re.search("[0-9]", t))
    found = secrets.candidates(docs(spark, texts)).collect()
    assert sorted((r.doc_id, r.token) for r in found) == want
    assert len({(r.doc_id, r.position) for r in found}) == len(want)
    last = next(r for r in found if r.doc_id == 4)
    assert (last.keyword, last.assigned) == (1.0, 1.0)


# 8 -------------------------------------------------------------------------------------------------


def page(i, body, extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        f"<!-- c --><div class=\"ad big\">Buy</div><article><h1>Head &amp; {i}</h1>{body}{extra}</article><footer>&copy; x</footer></body></html>"
    )


def test_main_text(spark):
    rows = [
        (1, "http://a.b/1", page(1, "<p>One <b>bold</b>\n text<br>next<p>Two &lt;3")), (2, "http://a.b/2", page(2, "<p>Other</p>", "<section class='comments'><p>me too</p></section>")),
        (3, "http://a.b/3", page(3, "<p>Third</p><form><input>x</form><script>var t='</p>';</script>")), (4, None, None), (5, "http://c.d", ""), (6, "http://c.d", "plain < text & more"),
        (7, "http://e.f", "<div id=sidebar>no</div><main><p>yes</p></main>"), (8, "http://g.h", "<p>" * 3000 + "deep"), (9, "http://g.h", "<div>" * 3000 + "deep"), (None, "http://a.b/1", page(9, "<p>same</p>")),
    ]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        1: "Head & 1 One bold text next Two <3", 2: "Head & 2 Other", 3: "Head & 3 Third", 4: "", 5: "", 6: "plain < text & more", 7: "yes", 8: "deep", 9: "deep", None: "Head & 9 same",
    }
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_wrapper_is_inferred():
    made = wrappers.infer([page(1, "<p>a</p><p>b</p>"), page(2, "<p>c</p>", "<table></table>")])
    article = json.dumps(next(x for x in next(y for y in made[3] if y[0] == "body")[3] if x[0] == "article"))
    assert article == json.dumps(["article", False, False, [["h1", False, False, [["#", False, False, None]]], ["p", False, True, [["#", False, False, None]]], ["table", True, False, []]]])


# 9 -------------------------------------------------------------------------------------------------


def test_quality(spark):
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in range(3000)]
    good = lambda: ". ".join(" ".join(rng.choice(words, 9)).capitalize() for _ in range(8)) + "."
    junk = lambda: " ".join(x for x in rng.choice(words, 5) for _ in range(14))
    texts = [good() if i % 4 else junk() for i in range(600)]
    rows = docs(spark, [*texts, *ODD])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 600, 2)] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(rows, labels).collect()}
    assert len(got) == len(texts) + len(ODD)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    right = [got[i].predicted == int(i % 4 > 0) for i in range(600)]
    assert np.mean(right) > 0.97
    assert quality.classify(rows.limit(0), labels).collect() == []
    assert {r.predicted for r in quality.classify(rows, labels.limit(0)).collect()} == {1}
