import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lociq.llm.pieces import CharMap, Normalizer, PieceCodec, encode_pieces
from lociq.llm.token_files import TokenFile, WordEncoder, read_token_files, write_token_files

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.text(st.sampled_from("abcXYZ .,'!|<>éÉßǅ \n\t\u00a0\u0301\x1c日▁😀0129"), max_size=60)


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(WORDS), WordEncoder(WORDS, "<u2"), PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXTS, max_size=4))
def test_words_as_whole_texts(whole, texts):
    library, ours, *_ = whole
    assert [np.frombuffer(x, "<u2").tolist() for x in ours(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXTS, max_size=4))
def test_pieces_as_library(whole, texts):
    _, _, codec, library = whole
    got = codec.encode(texts)
    assert [ids.tolist() for ids, _, _ in got] == [library.encode(t) for t in texts]
    assert codec.decode([ids.tolist() for ids, _, _ in got]) == [library.decode(library.encode(t)) for t in texts]
    for t, (ids, begins, ends) in zip(texts, got, strict=True):
        raw = t.encode()
        assert b"".join(raw[b:e] for b, e in zip(begins, ends, strict=True)) == raw
        assert len(ids) == len(begins) == len(ends) and (begins <= ends).all()


def test_special_token_in_other_case(whole):
    library, ours, *_ = whole
    for t in ("A <|EndOfText|> b", "<|endoftext|>x", "x<|startoftext|>"):
        assert np.frombuffer(ours([t])[0], "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def test_charmap_longest_prefix():
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(normalizer.serialized_model_proto())
    ours = Normalizer(model.normalizer_spec)
    assert ours.map.units and CharMap(b"").longest(b"abc", 0) is None
    for t in ("ﬁne ①②", "Ａｂｃ　ｘ", "é e\u0301", "plain", "", "㍿x", "  two  blanks "):
        text, places = ours(t)
        assert text == normalizer.Normalize(t)
        assert len(places) == len(text.encode()) + 1 and (np.diff(places) >= 0).all() and places[-1] <= len(t.encode())


def test_files_round_trip(spark, frame, odd_rows, tmp_path):
    library = Tokenizer.from_file(WORDS)
    manifest = write_token_files(frame(odd_rows), WORDS, seq_len=16, path=str(tmp_path / "t"))
    got = read_token_files(manifest).orderBy("start").collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in odd_rows]
    want = sorted((-1 if i is None else i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(odd_rows, ids, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert [r.doc_id is not None for r in got] == [False] + [True] * (len(got) - 1) and [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
    for m in manifest.collect():
        f = TokenFile(m.file)
        real = 0
        for k in range(f.reader.num_record_batches):
            for row in range(f.batch(k).num_rows):
                sequence, mask = f.sequence(k * 64 + row)
                assert len(sequence) == len(mask) == 16 and (sequence[~mask] == 0).all()
                real += mask.sum()
        assert real == m.n_tokens
        assert isinstance(f.reader.schema.field("ids").type, pa.FixedSizeListType)


def test_pieces_frame(spark, frame, odd_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = encode_pieces(frame(odd_rows), PIECES).collect()
    want = sorted((str(i), library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in odd_rows)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == want


def test_empty(spark, frame):
    assert read_token_files(write_token_files(frame([]), WORDS)).count() == 0
    assert encode_pieces(frame([]), PIECES).count() == 0


def test_tokenizer_that_keeps_blanks(frame):
    """A tokenizer whose pieces hold blanks gets whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from lociq.llm.token_files import word_encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello World. it's  two", "", None, "a\n\nb ÉÉ"]
    library = Tokenizer.from_file(path)
    got = [list(__import__("numpy").frombuffer(x, "<u4")) for x in word_encoder(path, "<u4")(texts)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
