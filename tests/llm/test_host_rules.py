import random
import re

import pytest

from lociq.llm.host_rules import LEAST, host_of, host_rates, judge_by_host, prior

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    at: dict[tuple, list[int]] = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + o for places in at.values() if len(places) > 1 for i in places for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), base


@pytest.fixture(scope="module")
def rows(odd_rows):
    rng = random.Random(5)
    out = list(odd_rows)
    for i in range(150):
        n = rng.choice((3, 30, 60, 200))
        words = [rng.choice("abcde") * rng.randint(1, 2) + rng.choice(("", "é", "日", "#", "|", "")) for _ in range(n)]
        out.append((100 + i, "".join(w + rng.choice((" ", " ", " ", "\n", "\t ", "\n \n")) for w in words)))
    same = "one two three four five six seven eight nine ten\n" * 9
    return [*out, (300, same), (301, same), (302, "a b c a b c"), (303, "a b c d a b c"), (304, "x x x x"), (305, "\x0bx\x0c\n\ny\r\nx\r"), (306, "   \n" * 2000 + "end"), (307, "\u00a0 \u2003a")]


def test_measures_by_hand(spark, frame, rows):
    got = judge_by_host(frame(rows)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    told = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key)
    assert told == sorted(((i, *measures(t)) for i, t in rows), key=key)
    assert all(r.kept == (not r.base_failed and not r.host_rejected) for r in got)


def hosts(spark):
    rng = random.Random(3)
    good = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(10, 9999)}" for _ in range(80))
    rows = [(i, good(), "https://Good.example/a?b") for i in range(120)]
    rows += [(200 + i, good() if i % 10 == 0 else "too short", "bad.example") for i in range(60)]
    rows += [(300, "too short", "one.example"), (301, good(), "two.example"), (302, good(), None), (303, good(), None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_verdicts_of_hosts(spark, monkeypatch):
    rows, df = hosts(spark)
    for share in (1000, 2):  # all hosts hot, the large one alone
        monkeypatch.setattr("lociq.llm.host_rules.HOT_SHARE", share)
        got = {r.doc_id: r for r in judge_by_host(df).collect()}
        assert len(got) == len(rows)
        assert {r.host for r in got.values() if r.host_rejected} <= {"bad.example", "one.example"}
        assert not any(got[i].kept for i in range(200, 260)) and not got[200].base_failed
        assert all(got[i].kept for i in (*range(120), 301, 302, 303)) and got[302].host == "" and got[0].host == "good.example"


def test_rates_by_hand(spark):
    _, df = hosts(spark)
    rows = judge_by_host(df)
    rates = {r.host: r for r in host_rates(rows).collect()}
    told = {}
    for r in rows.collect():
        n, f = told.get(r.host, (0, 0))
        told[r.host] = n + 1, f + r.fail_short
    n, f = (sum(x) for x in zip(*told.values()))
    mean, strength = prior(len(told), n, sum(a * a for a, _ in told.values()), f, sum(b * b / a for a, b in told.values()))
    assert mean == f / n and 0 < strength < 1 / LEAST
    for host, (a, b) in told.items():
        assert rates[host].rate_short == pytest.approx((b + mean * strength) / (a + strength)) and min(b / a, mean) - 1e-12 <= rates[host].rate_short <= max(b / a, mean) + 1e-12
    assert prior(0, None, None, None, None) == (0.0, 1.0)
    assert prior(10, 1000, 10 * 100.0**2, 500, 10 * 50.0**2 / 100)[1] == pytest.approx(1 / LEAST - 1)  # equal rates: all strength


def test_hosts_and_empty_table(spark, frame):
    texts = [("https://A.b:8/c",), ("x://",), (None,), ("Plain",), ("s://u?v://w",)]
    df = spark.createDataFrame(texts, "s string")
    assert [r[0] for r in df.select(host_of(df.s)).collect()] == ["a.b:8", "", "", "plain", "u"]
    assert judge_by_host(frame([])).count() == 0
