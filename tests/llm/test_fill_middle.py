import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociq.llm.fill_middle import NOTHING, SEEN, START, begins, fill_in_middle, restored, step_of

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.text(st.sampled_from("ab <PSM>\n\té日 "), max_size=40)


def by_hand(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(t) for t in (tokens[:x], tokens[x:y], tokens[y:]))
    spm = h[3] % 100 < 80
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(text=TEXTS, cuts=st.lists(st.integers(0, 60), max_size=5))
def test_steps_compose(text, cuts):
    raw = np.frombuffer(text.encode(), np.uint8)
    at = sorted({min(c, len(raw)) for c in (0, *cuts, len(raw))})
    whole, tokens = NOTHING, []
    for a, b in zip(at, at[1:]):
        if b > a:
            tokens += (begins(raw[a:b], whole.ends[START]) + a).tolist()
        whole = whole.then(step_of(raw[a:b]))
    assert whole == NOTHING.then(step_of(raw))
    assert whole.counts[START] == len(tokens) == len(TOKEN.findall(text)) and whole.chars == len(text)
    assert (whole.marks[0] == SEEN) == any(m in text for m in ("<P>", "<S>", "<M>"))
    assert np.cumsum([0, *(len(t.encode()) for t in TOKEN.findall(text))])[:-1].tolist() == tokens


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 15])
def test_by_hand(spark, frame, odd_rows, chunk):
    odd = ["a <P> b " * 9, "<", "x<P", "< P > <S " * 3, "\n \n", " lead", "trail  ", "日本 語é 😀 " * 40, "<<S", ">a <b >c <"]
    rows = [*odd_rows, *((100 + i, t) for i, t in enumerate(odd * 3)), *((200 + i, f"w{i} " * (i % 50)) for i in range(120))]
    got = fill_in_middle(frame(rows), chunk=chunk).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[-1])
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, *by_hand(i, t)) for i, t in rows), key=key)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_empty_table(frame):
    assert fill_in_middle(frame([])).count() == 0
