import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.llm.ann import search
from lociq.llm.decontaminate import contamination, drop_contaminated, matched, proximity_matches
from lociq.llm.sharding import cut_shards, permutation, shuffle_records
from lociq.llm.urls import judge_urls

from .conftest import sentence

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
URLS = [
    "http://a.net/x", "http://NET/", "http://net", "https://www.example.net/en/1?q=1", "http://example.net/fr", "http://example.com/de/9", "http://m.example.com/de", "http://x.org/fr/a#b", "http://x.org/en/a",
    "http://notnet/x", "http://example.com/en/77?page=2&ref=x", None, "", "no scheme", "://", "a://b://c/d", "http://É.NET/p", "http://a.net/x\nq/ü?z", "http://x.example.com:80/de/", "http://" + "a" * 5000 + ".com/1",
]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_url_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("features", F.lit(1))
    got = judge_urls(pages).collect()
    assert len(got) == len(rows)
    rules = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
    for r in got:
        url = URLS[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = lower(re.split("[/?#]", rest, maxsplit=1)[0])
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        fits = [h + p for (h, p) in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == rules[next(k for k in rules if k[0] + k[1] == rule)] if rule else r.verdict in ("allow", "block")
    assert judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules=()).collect()} == {"allow"}


def test_url_features(spark):
    """Features of a URL alone by a computation of their own; suffix statistics leave out the row's own label."""
    from collections import Counter

    from lociq.llm.urls import FEATURES, lexical, parts

    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    assert len(FEATURES) == 16
    for r in lexical(parts(pages)).collect():
        url, host, path = URLS[r.page_id] or "", r.host, r.path
        share = lambda t: sum(c in "0123456789" for c in t) / len(t) if t else 0.0
        query = url.split("?", 1)[1].split("#", 1)[0] if "?" in url else ""
        counts = [c / len(url) for c in Counter(url).values()]
        assert r.entropy == pytest.approx(-sum(p * math.log2(p) for p in counts), abs=1e-9)
        assert (r.digit_share, r.host_digit_share) == (pytest.approx(share(url)), pytest.approx(share(host)))
        assert r.url_length == pytest.approx(math.log1p(len(url))) and (r.host_length, r.path_length, r.query_length) == (len(host), len(path), len(query))
        assert r.depth == len(re.findall("/[^/]", path)) and r.parameters == (query.count("&") + 1 if query else 0) and r.hyphens == host.count("-")
        assert r.suffix == host.split(".")[-1] and r.longest_label == max(map(len, host.split("."))) and r.secure == url.startswith("https") and r.fragment == ("#" in url)


def test_trees_learn_from_ruled_urls(spark):
    rng = random.Random(1)
    rows = [(i, f"http://{'spam-' * (i % 2) * 3}{rng.randint(0, 10**9 if i % 2 else 9)}.{('net', 'org', 'com')[i % 3]}/fr/{i}") for i in range(300)]
    rows = [(i, u) for i, u in rows if not (".net" in u and "spam" not in u) and not (".org" in u and "spam" in u)]
    got = [r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect() if r.rule is None]
    right = sum((r.verdict == "block") == ("spam" in r.host) for r in got)
    assert right >= 0.9 * len(got)


@pytest.mark.parametrize(("shards", "buckets"), [(16, 10_000), (3, 2)])
def test_sharding(frame, odd_rows, monkeypatch, shards, buckets):
    """Also with two scatters, where there are more buckets than one takes."""
    import lociq.llm.sharding as module

    monkeypatch.setattr(module, "MAX_BUCKETS", buckets)
    rng = random.Random(4)
    rows = [*odd_rows, *((100 + i, sentence(rng, rng.randint(0, 30))) for i in range(200)), *[(7, "hot")] * 100]

    def cut():
        shuffled = shuffle_records(frame(rows), bucket_bytes=4000)
        df = cut_shards(shuffled, shards)
        *given, bucket, place, shard, slot = df.columns
        assert given == frame(rows).columns and (bucket, place, shard, slot) == ("_bucket_", "_place_", "_shard_", "_slot_")
        return sorted(df.collect(), key=lambda r: (r[shard], r[slot]))

    out = cut()
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == sorted((str(i), str(t)) for i, t in rows)
    assert all(r[c] == "clash" for r in out for c in ("_bucket", "_place", "_shard", "_slot", "_n", "_input", "_tie", "_end", "_at", "a.b"))
    sizes = [sum(r._shard_ == s for r in out) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert [r._slot_ for r in out if r._shard_ == s] == list(range(sizes[s]))
    assert sorted(map(str, cut())) == sorted(map(str, out))
    assert len({r._bucket_ for r in out}) > 3 and [r.doc_id for r in out] != [i for i, _ in rows]
    assert cut_shards(shuffle_records(frame([])), shards).count() == 0


def test_shard_digest(spark, frame, odd_rows, tmp_path):
    """op4's own columns: size and checksum of each text, null as empty."""
    from lociq.llm.queries import op4_shards

    frame(odd_rows).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = op4_shards(spark, str(tmp_path)).collect()
    raw = lambda t: (t or "").encode()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t in odd_rows)
    assert all(r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 16 for r in got)


def test_permutation_is_uniform():
    seen = {tuple(permutation(3, s, 0)) for s in range(100)}
    assert len(seen) == 6 and len(permutation(0, 1, 1)) == 0


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    x[:500] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (9005, [1.0]), (9006, [float("inf")] * 16), (9007, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)).withColumn("v", F.lit(2))
    got = search(df, df.where("vec_id % 50 = 0")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    by, hits = {}, 0
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1500, 50))
    for q, found in by.items():
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        hits += len({r.vec_id for r in found} & set(best.tolist()))
        assert [r.rank for r in sorted(found, key=lambda r: r.rank)] == [1, 2, 3, 4, 5]
        assert all(r.score == pytest.approx(s[r.vec_id], abs=1e-12) for r in found)
    assert hits >= 0.9 * 5 * len(by)
    assert search(df.limit(0), df).count() == 0 and search(df, df.limit(0)).count() == 0
    few = df.where("vec_id in (600, 700)")
    assert sorted((r.query_id, r.vec_id) for r in search(few, few).collect()) == [(600, 700), (700, 600)]


def brute_contamination(docs, items, n=10):
    found = lambda t: WORD.findall(lower(t))
    windows = {}
    for i, t in items:
        w = found(t)
        for s in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, named = found(t), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if (k := tuple(w[s : s + size])) in windows:
                    hit.update(range(s, s + size))
                    named |= windows[k]
        out.append((str(i), len(w), len(hit), ",".join(sorted(named))))
    return sorted(out)


@pytest.mark.parametrize("blocks", [512, 2])
def test_contamination_as_brute_force(spark, frame, odd_rows, monkeypatch, blocks):
    """Also with a filter so small that most words pass it."""
    import hashlib

    import lociq.llm.decontaminate as module

    monkeypatch.setattr(module, "BLOCKS", blocks)
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.randint(0, 30))) for i in range(20)] + [(30, None), (31, "one two"), (32, "!!"), (10, "one two"), (33, "Aa bb CC dd ee ff gg hh ii jj kk")]
    docs = [*odd_rows, (50, "x aa BB cc, dd-ee ff gg hh ii jj kk aa bb y"), (50, "x aa BB cc, dd-ee ff gg hh ii jj kk aa bb y")]
    docs += [(100 + i, f"{sentence(rng, rng.randint(0, 20))} {rng.choice(items)[1] if i % 2 else ''} {sentence(rng, 5)}") for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit("clash"))
    got = contamination(frame(docs), bench).collect()
    want = brute_contamination(docs, items)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.items_sha256) for r in got) == sorted((i, n, h, digest(x)) for i, n, h, x in want)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    kept = drop_contaminated(frame(docs), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(i for i, _, h, _ in want if not h)
    assert contamination(frame([]), bench).count() == 0
    assert not any(r.contaminated for r in contamination(frame(docs), bench.limit(0)).collect())


def test_shifted_lists(spark, frame):
    """Terms that stand twice in a window, at the very start and end, of windows of one, two and more terms, and copies of a row."""
    texts = ["aa aa aa aa", "x aa bb aa", "aa bb aa bb aa", "aa", "bb aa", "AA-bb-AA", "", None, "aa bb", "É aa é", "aa " * 25]
    docs = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])] * 3
    items = [(1, "aa bb aa"), (2, "aa aa"), (3, "bb"), (4, "É aa"), (5, "é aa"), (6, "aa " * 12), (7, "cc aa")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(frame(docs), bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in got) == sorted((i, n, h) for i, n, h, _ in brute_contamination(docs, items))
    want = {0: 1, 2: 2, 4: 1, 9: 1, 10: 2}
    assert {r.doc_id: r.n_items for r in got if r.doc_id in want} == want


def test_proximity(spark, frame):
    docs = frame([(1, "aa bb cc dd"), (2, "dd x cc y bb aa"), (3, "aa bb cc")])
    bench = spark.createDataFrame([(1, "aa bb cc dd")], "item_id long, text string")
    _, index, looked_up, pairs = matched(docs, bench, 10)
    near = proximity_matches(index, pairs, looked_up).join(index, ["node", "one"]).select("doc").distinct()
    assert sorted(r.doc for r in near.collect()) == [1, 2]
    assert {r.doc_id: (r.n_near, r.n_hit) for r in contamination(docs, bench).collect()} == {1: (1, 4), 2: (1, 0), 3: (0, 0)}


def test_crc_matches_python(spark):
    got = spark.range(50).select("id", F.crc32(F.col("id").cast("string").cast("binary")).alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in got) and math.isfinite(got[0].c)


def test_near_copies_of_one_code(spark):
    """A group of close vectors, far more than are ranked by code first: the nearest are found whatever their ids."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(10_000, 16))
    x[9_000:] = x[0] + rng.normal(0, 1e-4, (1_000, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4).cache()
    asked = list(range(9_000, 10_000, 25))
    got = {}
    for r in search(vectors, vectors.where("vec_id >= 9000 and vec_id % 25 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = ((u[asked][:, None, :] - u[None, 8_999:]) ** 2).sum(2)
    near[np.arange(len(asked)), np.array(asked) - 8_999] = np.inf
    want = {q: set((np.argsort(d)[:5] + 8_999).tolist()) for q, d in zip(asked, near, strict=True)}
    assert sum(len(got[q] & want[q]) for q in asked) >= 0.95 * 5 * len(asked)
