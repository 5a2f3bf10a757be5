"""Token-ID output: Arrow files of equal-length sequences with masks, and their reader.

A data set is a folder of pairs of files. ``<name>.arrow`` is an Arrow IPC file whose record batches
hold ``ids`` (fixed-size lists of unsigned ids, 16 bits wide where the vocabulary allows) and ``mask``
(fixed-size lists of booleans, false on padding). All batches but the last have ``ROWS`` sequences, so
the place of a token follows from arithmetic and a memory map serves it without a copy.
``<name>.index.arrow`` holds ``doc_id, offset, n_tokens`` for each document, in file order.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm.storage import new_path, open_store, settle

ROWS = 64
CACHED_WORDS = 900_000
SHORT_WORD = 11
STOP = re.compile(r"(?<=[a-z])([.,])(?= |\n|$)")
SLICE = 512

MANIFEST = "part int, file string, n_docs long, n_tokens long"


def apart(tokenizer: dict) -> bool:
    """Whether a tokenizer lower-cases, parts words at blanks and before a stop that ends them, and marks the ends of words, so that
    the ids of a text are those of its words in a row."""
    steps = (tokenizer["normalizer"] or {}).get("normalizers", [])
    split = (tokenizer["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    words_only = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and "[^\\s\\p{L}\\p{N}]+" in split["pattern"].get("Regex", "")
    return [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and bool(words_only) and tokenizer["model"].get("end_of_word_suffix") == "</w>"


class WordEncoder:
    """Ids of whole texts as little-endian bytes, by way of a bounded cache of words.

    Where blanks, tabs and line ends always separate pre-tokens and are dropped (see apart), the ids of a text are
    those of its words in a row; short words, which recur, stay cached. With any other tokenizer the library gets whole texts.
    Either way every text is encoded whole.
    """

    def __init__(self, path: str, width: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = width
        self.cache: dict[str, bytes] = {"": b""}
        self.by_words = apart(json.loads(self.tokenizer.to_str()))
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words of letters alone go in one text and come apart behind the tokens that end a
        word; a count that differs (letters that change into others) sends them in one by one."""
        plain = list(map(str.isalpha, words))
        letters = list(compress(words, plain))
        rest = [w for w, p in zip(words, plain, strict=True) if not p]
        together = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, self.width)
        cuts = np.flatnonzero(self.ends[together]) + 1
        if len(cuts) != len(letters):
            letters, rest, cuts = [], words, cuts[:0]
        raw, at = together.tobytes(), (cuts * together.itemsize).tolist()
        found = {w: raw[a:b] for w, a, b in zip(letters, [0, *at], at)}
        one_by_one = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        found.update((w, np.array(x.ids, self.width).tobytes()) for w, x in zip(rest, one_by_one, strict=True))
        return [found[w] for w in words]

    @staticmethod
    def plain(text: str) -> str:
        """A text of the same ids with fewer different words: in lower case, if it is ASCII and holds nothing
        like a special token, and with a stop or comma that ends a word set apart."""
        return STOP.sub(r" \1", text.lower() if text.isascii() and "<|" not in text else text)

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        if not self.by_words:
            given = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(x.ids, self.width).tobytes() for x in given]
        split = [self.plain(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.cache) > CACHED_WORDS:
            self.cache = {"": b""}
        known = self.cache
        found = [list(map(known.get, words)) for words in split]
        gaps = [[i for i, x in enumerate(ids) if x is None] for ids in found]
        new = list({words[i] for words, places in zip(split, gaps, strict=True) for i in places})
        own = dict(zip(new, self.ids(new), strict=True))
        for words, ids, places in zip(split, found, gaps, strict=True):
            for i in places:
                ids[i] = own[words[i]]
        known.update((w, x) for w, x in own.items() if len(w) <= SHORT_WORD)
        return list(map(b"".join, found))


@lru_cache(maxsize=1)
def word_encoder(path: str, width: str) -> WordEncoder:
    """One for each Python worker, which serves many tasks."""
    return WordEncoder(path, width)


class TokenWriter:
    """Writes one pair of files, a document at a time."""

    def __init__(self, fs: pafs.FileSystem, stem: str, seq_len: int, width: str):
        self.fs, self.stem, self.seq_len, self.width = fs, stem, seq_len, np.dtype(width)
        kind = pa.from_numpy_dtype(self.width)
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.sink = fs.open_output_stream(f"{stem}.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.step = ROWS * seq_len * self.width.itemsize
        self.buffer = bytearray()
        self.docs: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.buffer += ids
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // self.width.itemsize)
        while len(self.buffer) >= self.step:
            self._batch(bytes(self.buffer[: self.step]), ROWS * self.seq_len)
            del self.buffer[: self.step]

    def _batch(self, raw: bytes, used: int) -> None:
        ids, mask = pa.array(np.frombuffer(raw, self.width)), pa.array(np.arange(len(raw) // self.width.itemsize) < used)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.seq_len) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> tuple[int, int]:
        if self.buffer:
            used = len(self.buffer) // self.width.itemsize
            self._batch(bytes(self.buffer) + bytes(-used % self.seq_len * self.width.itemsize), used)
        self.out.close()
        self.sink.close()
        ends = np.cumsum([0, *self.sizes], dtype=np.int64)
        index = pa.table({"doc_id": pa.array(self.docs, pa.int64()), "offset": ends[:-1], "n_tokens": np.diff(ends)})
        with self.fs.open_output_stream(f"{self.stem}.index.arrow") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index)
        return len(self.docs), int(ends[-1])


class TokenFile:
    """Random access to one file: sequences and masks by number, ids by offset."""

    def __init__(self, uri: str):
        fs, path = open_store(uri)
        mapped = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if mapped else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.seq_len = self.reader.schema.field("ids").type.list_size
        self.held: tuple[int, pa.RecordBatch] | None = None
        with fs.open_input_file(path.removesuffix(".arrow") + ".index.arrow") as f:
            self.index = pa.ipc.open_file(f).read_all()

    def batch(self, k: int) -> pa.RecordBatch:
        if self.held is None or self.held[0] != k:
            self.held = k, self.reader.get_batch(k)
        return self.held[1]

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        batch, at = self.batch(row // ROWS), row % ROWS
        ids, mask = (batch.column(c)[at].values for c in ("ids", "mask"))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def tokens(self, offset: int, n: int) -> np.ndarray:
        step, found = ROWS * self.seq_len, []
        while n > 0:
            k, at = divmod(offset, step)
            found.append(self.batch(k).column("ids").values.slice(at, min(n, step - at)).to_numpy())
            offset, n = offset + len(found[-1]), n - len(found[-1])
        return found[0] if len(found) == 1 else np.concatenate(found or [np.zeros(0, np.uint16)])


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, seq_len: int = 2048, path: str | None = None) -> DataFrame:
    """Encode ``text`` of every row and write the files in ascending ``doc_id`` order (null first, equal
    ids ordered by a hash of the text). Returns the manifest: one row for each pair of files.

    Rows are dealt by range of (doc_id, text hash), so no id gathers in one task. A null or empty text
    gives the end id alone; a very long one is encoded whole in one task and runs over as many sequences as it fills. An empty table gives no files. Other columns are ignored, whatever their
    names. A task writes under a new name each time it runs, and only what its surviving attempt
    returned is in the manifest (itself a committed Parquet table), so a lost executor leaves stray
    files at most.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    size = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    width = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = word_encoder(tokenizer_path, width), None
        end = np.array([end_id], width).tobytes()
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        fs, folder = open_store(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    writer = TokenWriter(fs, f"{folder}/{name}", seq_len, width)
                for doc_id, ids in zip(piece.column(0).to_pylist(), encode(piece.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            n_docs, n_tokens = writer.close()
            row = {"part": [TaskContext.get().partitionId()], "file": [f"{path}/{name}.arrow"], "n_docs": [n_docs], "n_tokens": [n_tokens]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    dealt = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return settle(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """From the files of a manifest, for each document: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers), file, offset in it.
    A manifest without rows gives none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = TokenFile(file)
                offsets, sizes = (tokens.index.column(c).to_numpy() for c in ("offset", "n_tokens"))
                crc = [zlib.crc32(tokens.tokens(o, n).astype("<u4").tobytes()) for o, n in zip(offsets.tolist(), sizes.tolist(), strict=True)]
                table = tokens.index.select(["doc_id"]).append_column("start", pa.array(offsets + base)).append_column("n_tokens", pa.array(sizes))
                table = table.append_column("ids_crc32", pa.array(crc, pa.int64())).append_column("file", pa.array([file] * len(crc), pa.string())).append_column("offset", pa.array(offsets))
                yield from table.to_batches(max_chunksize=10_000)

    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file, not for each document
    based = manifest.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("base"), F.col("part"))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that few small rows still become many tasks
    return based.repartition(tasks, "part").select("file", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, offset long")
