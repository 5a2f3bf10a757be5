"""SentencePiece encoding with byte spans of the original text, and decoding.

The model's compiled character map (a double array of rules behind a table of replacements) is applied
by longest prefix; every normalised byte keeps the place in the original text that it came from, so each
piece projects to a span of original bytes. Merging itself is the library's, word by word: no piece holds
a word mark after another character, hence no merge crosses the start of a word.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CACHED_SEGMENTS = 500_000
SHORT_SEGMENT = 10
SLICE = 128

SPANS = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


class CharMap:
    """Longest-prefix replacement by a compiled character map; an empty map replaces nothing."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest rule that fits at a place."""
        units = self.units
        if not units:
            return None
        jump = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, best = jump(units[0]), None
        for n in range(at, len(raw)):
            node ^= raw[n]
            if node >= len(units) or (unit := units[node]) & 0x800000FF != raw[n]:
                break
            node ^= jump(unit)
            if unit & 0x100:
                best = n + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])]


class Normalizer:
    """Normalised text and, for each of its bytes and its end, the original byte it comes from."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        if self.map.units or self.squeeze or not self.escape:
            return self._by_rule(text)
        raw = np.frombuffer(text.encode(), np.uint8)
        if not len(raw):
            return "", np.zeros(1, np.int64)
        start = np.zeros(3 if self.prefix else 0, np.int64)
        places = np.repeat(np.arange(len(raw)), 1 + 2 * (raw == 32))
        return MARK * self.prefix + text.replace(" ", MARK), np.concatenate([start, places, [len(raw)]])

    def _by_rule(self, text: str) -> tuple[str, np.ndarray]:
        raw, at, parts = text.encode(), 0, []
        while at < len(raw):
            found = self.map.longest(raw, at)
            if found is None:
                lead = raw[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = n, raw[at : at + n]
            parts.append((at, found[1]))
            at += found[0]
        end = at
        if self.squeeze:
            while parts and not parts[0][1].strip(b" "):
                parts.pop(0)
        space = MARK.encode() if self.escape else b" "
        out, places = bytearray(), []
        if self.prefix and parts:
            out += space
            places += [parts[0][0]] * len(space)
        blank = self.squeeze
        for at, got in parts:
            got = got.lstrip(b" ") if blank else got
            if got:
                new = got.replace(b" ", space)
                out += new
                places += [at] * len(new)
                blank = self.squeeze and got.endswith(b" ")
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = places[-1]
                del places[-len(space) :]
        return out.decode(), np.array([*places, end], np.int64)


class PieceCodec:
    """encode(text) gives ids and spans of original bytes; decode(ids) is the library's."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.normalize = Normalizer(model.normalizer_spec)
        spec = model.normalizer_spec
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        kinds = proto.ModelProto.SentencePiece
        texts = [p.piece for p in model.pieces]
        self.sizes = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = model.trainer_spec.unk_id
        inner = any(MARK in t.lstrip(MARK) for t in texts)
        own = any(p.type == kinds.USER_DEFINED for p in model.pieces)
        self.split = not inner and not own and spec.escape_whitespaces and model.trainer_spec.byte_fallback
        self.cache: dict[str, bytes] = {}

    def _ids(self, normal: list[str]) -> list[np.ndarray]:
        """Ids of each normalised text; short segments, which recur, stay cached."""
        split = [SEGMENT.findall(t) if self.split else [t] * bool(t) for t in normal]
        if len(self.cache) > CACHED_SEGMENTS:
            self.cache = {}
        known = self.cache
        new = list({s for segments in split for s in segments}.difference(known))
        known.update((s, array("i", x).tobytes()) for s, x in zip(new, self.plain.encode(new, num_threads=1), strict=True))
        out = [np.frombuffer(b"".join(map(known.__getitem__, segments)), np.int32) for segments in split]
        for s in new:
            if len(s) > SHORT_SEGMENT:
                del known[s]
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: ids, and where each begins and ends among the text's bytes. A piece that stands
        for part of a character spans from that part on; one without original bytes spans none."""
        normal = [self.normalize(t) for t in texts]
        out = []
        for (text, places), ids in zip(normal, self._ids([t for t, _ in normal]), strict=True):
            sizes = self.sizes[ids]
            if (ids == self.unknown).any():
                spans = [(p.begin, p.end) for p in self.plain.encode(text, out_type="immutable_proto").pieces]
                chars = np.cumsum([0, *(len(c.encode()) for c in text)])
                begins, ends = (places[chars[[s[k] for s in spans]]] for k in (0, 1))
            else:
                marks = np.concatenate([[0], np.cumsum(sizes)])
                begins, ends = places[marks[:-1]], places[marks[1:]]
            out.append((ids, begins.astype(np.int32), ends.astype(np.int32)))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode(ids, num_threads=1) if ids else []


@lru_cache(maxsize=1)
def piece_codec(path: str) -> PieceCodec:
    """One for each Python worker, which serves many tasks."""
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, begins, ends (byte spans in the original text) and decoded, for every row.

    A null or empty text has no ids and decodes to the empty text. Rows are handled one by one in small
    slices, so repeated rows, ties, null ids and long texts change nothing; other columns are ignored
    whatever their names; an empty table gives no rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model_path)
        ints = lambda arrays: pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)], dtype=np.int32), np.concatenate(arrays))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                got = codec.encode([t or "" for t in piece.column(1).to_pylist()])
                ids, begins, ends = (list(x) for x in zip(*got, strict=True))
                decoded = codec.decode([x.tolist() for x in ids])
                yield pa.RecordBatch.from_arrays([piece.column(0), ints(ids), ints(begins), ints(ends), pa.array(decoded, pa.string())], names=["doc_id", "ids", "begins", "ends", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, SPANS)
