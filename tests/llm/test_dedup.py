import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lociq.llm.components import components
from lociq.llm.jaccard import keep_one_of_each, similar_components
from lociq.llm.suffixes import dedup_passages, passages, selected, stretches

from .conftest import sentence


def brute_components(rows, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y, key=lambda z: rows[z][0])] = min(x, y, key=lambda z: rows[z][0])
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def planted(seed):
    """Unrelated texts, exact and near copies of several kinds, shared passages, tiny texts."""
    rng = random.Random(seed)
    shared = sentence(rng, 60)
    rows = [sentence(rng, rng.randint(1, 120)) for _ in range(40)]
    for base in [sentence(rng, n) for n in (4, 12, 19, 25, 60, 150)]:
        for _ in range(12):
            w = base.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
            rows.append(" ".join(w) if rng.random() < 0.9 else base.upper())
    rows += [f"{sentence(rng, 20)} {shared} {sentence(rng, 20)}" for _ in range(10)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_components_as_brute_force(frame, k, percent):
    rows = planted(k)
    got = similar_components(frame(rows), k, percent).select("node.doc", "n", "component.doc").collect()
    assert sorted(map(tuple, got)) == brute_components(rows, k, percent)


@pytest.mark.parametrize("light", [0, 10_000])
def test_heavy_or_light_sets_alone(frame, monkeypatch, light):
    """All sets by their lists, and all by subsets; filters so small that everything passes; lists cut into heads one by one."""
    import lociq.llm.jaccard as module
    from lociq.llm import storage

    monkeypatch.setattr(module, "boundary", lambda *_: light)
    monkeypatch.setattr(storage, "FILTER_WORDS", 2)
    monkeypatch.setattr(module, "ALL_HEADS", 1)
    rows = planted(3)
    got = similar_components(frame(rows), 3, 90).select("node.doc", "n", "component.doc").collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 3, 90)


def test_texts_of_equal_hash_without_ids(frame):
    texts = ["alpha beta gamma delta 186041 epsilon 1473258679 zeta eta theta 5767276", "alpha beta gamma delta 239968 epsilon 1900306592 zeta eta theta 7439013"]
    kept = keep_one_of_each(frame([(None, t) for t in texts])).collect()
    assert sorted(r.text for r in kept) == sorted(texts) and all(r["_doc"] == r["_tie"] == "clash" for r in kept)


def test_components_of_odd_rows(frame, odd_rows):
    got = {(r[0], r[1], r[2]) for r in similar_components(frame(odd_rows)).select("node.doc", "n", "component.doc").collect()}
    assert {(1, 1, 1), (6, 1, 1), (2, 0, 2), (3, 0, 3), (5, 0, 5)} <= got
    assert similar_components(frame(odd_rows)).count() == len(odd_rows)
    kept = sorted(r.doc_id for r in keep_one_of_each(frame(odd_rows)).collect() if r.doc_id is not None)
    assert kept == [1, 2, 3, 4, 5, 7, 8, 9]
    assert keep_one_of_each(frame(odd_rows)).columns == frame(odd_rows).columns
    assert similar_components(frame([])).count() == 0 and keep_one_of_each(frame([])).count() == 0


def test_long_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "u long, v long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000}


def test_links_that_lie_together_need_no_round(spark, monkeypatch):
    """Lists whose links are read by one task are stars at once, and that nothing is left to do is told without another round."""
    import lociq.llm.components as module

    settle, written = module.settle, []
    monkeypatch.setattr(module, "settle", lambda df, label: written.append(label) or settle(df, label))
    links = [(7, i) for i in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(9, 9), (7, 3), (3, 7)]
    df = spark.createDataFrame(links, "u long, v long").coalesce(1)
    want = {**dict.fromkeys(range(40), 0), **dict.fromkeys(range(100, 141), 100)}
    assert {r.node: r.component for r in components(df).collect()} == want and written == ["links"]


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_components_of_links_in_chunks(spark, monkeypatch, chunk):
    import lociq.llm.components as module

    monkeypatch.setattr(module, "CHUNK", chunk)
    rng = random.Random(chunk)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    root = {x: x for link in links for x in link}
    for _ in root:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    got = components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()
    alone = {u for u, v in links if u == v} - {x for u, v in links if u != v for x in (u, v)}
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == {x: r for x, r in root.items() if x not in alone}


def brute_passages(rows, size):
    runs, words, whole = defaultdict(list), {}, {}
    for i, t in sorted((i, t) for i, t in rows if t):
        w = words[i] = t.split()
        whole.setdefault(t, i)
        for s in range(len(w) - size + 1):
            runs[tuple(w[s : s + size])].append((i, s))
    repeated, later, first = defaultdict(set), defaultdict(set), {}
    for places in runs.values():
        if len(set(places)) > 1:
            for i, s in places:
                repeated[i].update(range(s, s + size))
                if (i, s) != min(places):
                    later[i].update(range(s, s + size))
                    first[i] = min(first.get(i, i), min(places)[0])
    first |= {i: whole[t] for i, t in rows if t and whole[t] < i}
    spans = {i: [(a, b) for a, b in stretches(np.isin(np.arange(len(words[i])), list(x)))] for i, x in repeated.items()}
    return {i: (len(words[i]), len(repeated[i]), len(later[i]), first.get(i), spans[i]) for i in repeated}, {i: [w for k, w in enumerate(words[i]) if k not in later[i]] for i in words}


def repeated_texts(seed):
    rng = random.Random(seed)
    pool = [sentence(rng, rng.randint(40, 90)) for _ in range(6)]
    rows = [" ".join(x for _ in range(rng.randint(1, 3)) for x in (sentence(rng, rng.randint(0, 30)), rng.choice(pool))) for _ in range(40)]
    rows += [sentence(rng, 200) for _ in range(5)] + ["same " * 120, "same " * 70, sentence(rng, 49)]
    rows += [rows[0], rows[1], rows[1]]
    return list(enumerate(rows))


@pytest.mark.parametrize("hot", [4096, 5, 2])
def test_passages_as_brute_force(frame, monkeypatch, hot):
    import lociq.llm.suffixes as module

    monkeypatch.setattr(module, "HOT", hot)
    rows = repeated_texts(3)
    want, kept = brute_passages(rows, 50)
    got = passages(frame(rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_repeated, r.n_later, r.first_doc_id, [(s.begin, s.end) for s in r.spans]) for r in got} == want
    texts = {r.doc_id: r for r in dedup_passages(frame(rows)).collect()}
    assert {i: r.text.split() for i, r in texts.items()} == kept
    assert all(r.n_chars == len(r.text) for r in texts.values())


def test_passages_of_odd_rows(frame, odd_rows):
    assert passages(frame(odd_rows)).count() == 0 and passages(frame([])).count() == 0
    out = dedup_passages(frame(odd_rows))
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, (t for _, t in odd_rows)))
    assert out.columns == frame(odd_rows).columns


def test_every_window_holds_a_minimiser():
    h = np.random.default_rng(0).integers(0, 2**63, 400).astype(np.uint64)
    for row in (h, np.repeat(h[:4], 100)):
        places = selected(row, 50, 8, 15)
        assert all(((places >= s) & (places <= s + 35)).any() for s in range(len(row) - 49))


def test_classes_meet_components_once(spark, frame, monkeypatch):
    """Near copies share many lists; a join with components has a row for each class, not for each of its places in a list."""
    import lociq.llm.jaccard as module

    rng, made = random.Random(5), []
    base = sentence(rng, 80).split()
    rows = list(enumerate(" ".join([*base[:i], f"edit{i}", *base[i + 1 :]]) for i in range(40)))
    settle = module.settle

    def seen(df, label):
        if label == "members":
            plan = df._jdf.queryExecution().optimizedPlan()
            made.extend(re.findall(r"Join LeftOuter.*\n(?:.*Filter.*\n)?.*?(Aggregate|Project|Join|Relation)", plan.toString()))
        return settle(df, label)

    monkeypatch.setattr(module, "settle", seen)
    got = similar_components(frame(rows), 3, 90).select("node.doc", "n", "component.doc").collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 3, 90)
    assert made and set(made) == {"Aggregate"}


def test_members_are_dealt_anew_after_new_links_alone(frame, monkeypatch):
    """Long lists of texts that aren't alike take several rounds; one that finds no link leaves members in their components."""
    import lociq.llm.jaccard as module

    rng = random.Random(8)
    rows = list(enumerate(f"{sentence(rng, 3)} rare words here {sentence(rng, 9)}" for _ in range(60))) + [(100 + i, t) for i, t in planted(3)]
    settle, linking, dealt = module.settle, [], []

    def seen(df, label):
        if label == "members":
            dealt.append("Generate inline" in df._jdf.queryExecution().optimizedPlan().toString())
        out = settle(df, label)
        if label == "links-found":
            linking.append(not out.isEmpty())
        return out

    monkeypatch.setattr(module, "settle", seen)
    monkeypatch.setattr(module, "ALL_HEADS", 1)
    monkeypatch.setattr(module, "boundary", lambda *_: 0)
    got = similar_components(frame(rows), 3, 90).select("node.doc", "n", "component.doc").collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 3, 90)
    assert sum(dealt) == sum(linking) < len(dealt)


def test_parities_tell_apart_before_whole_sets_move(spark):
    """Sets that share their first shingles and little else aren't compared whole; no pair at the threshold is ruled out."""
    import lociq.llm.jaccard as module

    rng = np.random.default_rng(5)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    sets, links = [], set()
    for n in (1, 9, 40, 300, 5000):
        one = draw(n)
        close = np.unique(np.concatenate([one[: n - n // 25], draw(n // 25)]))
        far = np.unique(np.concatenate([one[: n // 2], draw(n - n // 2)]))
        for a, b in ((one, close), (one, far), (one, one[: n - n // 12]), (one, one)):
            assert module.least_apart(module.parities(a), module.parities(b)) <= len(np.setxor1d(a, b))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                links.add((len(sets), len(sets) + 1))
            sets += [a, b]
    rows = [(i, len(s), module.parities(s)) for i, s in enumerate(sets)]
    first = spark.createDataFrame(rows, "node long, n int, parity binary").withColumn("node", module.F.shiftleft("node", 40))
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, len(sets), 2)], "u long, v long")
    pairs = pairs.select(*(module.F.shiftleft(c, 40).alias(c) for c in ("u", "v")))
    got = {(r.u >> 40, r.v >> 40) for r in module.within_bounds(pairs, first, 90).collect()}
    assert got >= links and len(got) <= len(links) + 2 < len(sets) // 2
