import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lociq.llm.alignment import Aligner, align_corpus, head_bound

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.text(st.sampled_from("abcXYZ .,'!|<>s/éÉß \n\t ́\x1c\x00日▁😀0129"), max_size=50)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), Aligner(A, B)


def by_hand(a, b, aligner, text):
    """(A ids, B ids, groups, links) of a text by whole encodings and spans of bytes; all empty where bytes differ."""
    if not text:
        return [], [], [], []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    sides = [[table[i] for i in ids] for ids, table in ((x, aligner.a_bytes), (y, aligner.b_bytes))]
    if any(b"".join(s) != (" " + text).encode() for s in sides):
        return [], [], [], []
    spans = []
    for s in sides:
        at, out = 0, []
        for t in s:
            out.append((at, at + len(t)))
            at += len(t)
        spans.append(out)
    links = [(x[i], y[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if max(s, u) < min(e, v)]
    ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, last = [], 0
    for end in ends:
        groups.append(tuple(tuple(i for i, (s, e) in zip(ids, sp) if last < e <= end) for ids, sp in ((x, spans[0]), (y, spans[1]))))
        last = end
    return x, y, groups, links


def told(groups):
    return ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(TEXTS, max_size=4))
def test_segments_as_whole_texts(libraries, texts):
    a, b, aligner = libraries
    for text, got in zip(texts, aligner(texts), strict=True):
        x, y, groups, links = by_hand(a, b, aligner, text)
        got = [] if None in got else got
        assert (sum(g[0] for g in got), sum(g[1] for g in got), sum(g[2] for g in got)) == (len(x), len(y), len(groups))
        assert ";".join(g[4] for g in got) == told(groups)
        assert b"".join(g[3] for g in got) == b"".join((p * aligner.width + q).to_bytes(8, "little") for p, q in links)


@pytest.mark.parametrize("head", [1 << 20, 40, 0])
def test_counts_by_hand(spark, frame, odd_rows, libraries, head):
    a, b, aligner = libraries
    rows = [*odd_rows, (20, "<|endoftext|> <s> </s> plain <unk>"), (21, "\x00"), (22, "a" * 3000 + "é" * 500), (23, "  two  blanks \n\n and \n line"), (24, "日本語のテキスト one two three"), (24, "x")]
    hand = [(i, by_hand(a, b, aligner, t)) for i, t in rows]
    held = Counter(p for _, (*_, links) in hand for p in set(links))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    want = sorted(
        (i or -1, len(x), len(y), len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), told(g)) for i, (x, y, g, links) in hand
    )
    got = align_corpus(frame(rows), A, B, head=head).collect()
    assert sorted((r.doc_id or -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got) == want
    short = align_corpus(frame(rows), A, B, head=head, texts=False).collect()
    assert sorted(r.groups for r in short) == sorted(hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for w in want)


def test_head_and_empty_table(spark, frame):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1, 1, 2, 3, 4, 9])], "pair long, n long")
    assert [head_bound(counts, k) for k in (6, 5, 4, 3, 2, 1, 0)] == [1, 2, 2, 4, 4, 8, 16]
    assert align_corpus(frame([]), A, B).count() == 0
    assert align_corpus(frame([(1, None), (2, "")]), A, B).select("n_a", "groups").distinct().collect() == [(0, "")]
