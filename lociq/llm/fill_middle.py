"""Fill-in-the-middle transformation of texts, cut between tokens that a finite automaton finds.

Two automata read the bytes of a text: one begins a token at each blank behind a word (and at the start of the text), one looks for the
markers. A chunk tells, for each state in which it may be entered, the state in which it is left and how many tokens begin in it. Such
functions compose associatively, so the chunks of a giant text are scanned side by side in any task; their composition gives each chunk
its entry state and the tokens before it, which selects the chunks that hold a cut; only these are looked at again, where the text is put
together. Shorter texts are a chunk each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.storage import node_of, settle

#: Bytes of a chunk; longer texts are spread.
CHUNK = 32_768
SLICE = 256

#: States of the token automaton: nothing read yet, in the blanks that begin a token, in its word.
START, BLANK, WORD = 0, 1, 2
#: Marks in the order of the output's prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: States of the marker automaton: each beginning of a marker that may be read, and having seen one whole.
BEGUN = ("", "<", "<P", "<S", "<M")
SEEN = len(BEGUN)

IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def after(state: int, raw: bytes) -> int:
    """The state of the marker automaton behind some bytes."""
    for byte in raw:
        if state == SEEN:
            break
        read = BEGUN[state] + chr(byte)
        state = SEEN if read in MARKS else next(i for i in (BEGUN.index(x) if x in BEGUN else -1 for x in (read, chr(byte), "")) if i >= 0)
    return state


@dataclass(frozen=True)
class Step:
    """What a run of bytes does: ends[s] is the state of the token automaton behind it, counts[s] the tokens that begin in it, marks[s] the
    state of the marker automaton, each when entered in state s; chars are its code points."""

    ends: tuple[int, ...]
    counts: tuple[int, ...]
    marks: tuple[int, ...]
    chars: int

    def then(self, later: Step) -> Step:
        counts = tuple(n + later.counts[e] for n, e in zip(self.counts, self.ends, strict=True))
        return Step(tuple(later.ends[e] for e in self.ends), counts, tuple(later.marks[m] for m in self.marks), self.chars + later.chars)


NOTHING = Step((START, BLANK, WORD), (0, 0, 0), tuple(range(SEEN + 1)), 0)


def begins(raw: np.ndarray, entry: int) -> np.ndarray:
    """Where tokens begin in some bytes that are entered in a state: each blank behind a word, and whatever the text begins with."""
    blank = IS_BLANK[raw]
    before = np.concatenate([[entry != WORD], blank[:-1]])
    at = blank & ~before
    at[0] |= entry == START
    return np.flatnonzero(at)


def step_of(raw: np.ndarray) -> Step:
    """The function of a chunk. Behind its first byte no state depends on the entry any more, nor does the marker automaton's behind the
    second, so one look at all bytes and a few steps at both ends tell the whole function."""
    if not len(raw):
        return NOTHING
    blank = bool(IS_BLANK[raw[0]])
    inner = len(begins(raw, BLANK))
    counts = (inner + 1, inner, inner + blank)
    text = raw.tobytes()
    inside = any(m.encode() in text for m in MARKS)
    last = after(0, text[-2:])
    marks = [SEEN if inside or after(s, text[:2]) == SEEN else after(s, text) if len(text) < 2 else last for s in range(SEEN)]
    return Step((BLANK if IS_BLANK[raw[-1]] else WORD,) * 3, counts, (*marks, SEEN), code_points(raw))


def code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def cuts_of(n: int, draws: Sequence[int]) -> tuple[int, int]:
    """How many tokens stand before the middle and before the suffix."""
    x, y = draws[0] % (n + 1), draws[1] % (n + 1)
    return min(x, y), max(x, y)


def form_of(marked: bool, empty: bool, draws: Sequence[int], rate: int, spm_rate: int) -> str:
    if empty or marked or draws[2] % 100 >= rate:
        return "plain"
    return "spm" if draws[3] % 100 < spm_rate else "psm"


def drawn(seed: int) -> Column:
    """Four numbers for each document: the first groups of eight digits of the sha256 of ``seed:doc_id``."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output for every row of docs.

    A token is a run of blanks with the word behind it, or the blanks at the end. Of each 100 documents about ``rate`` are rearranged, of these
    ``spm_rate`` in the order suffix, prefix, middle. A null text counts as empty; empty texts and those that hold a marker stay plain. What
    is drawn depends on the id alone (a null id has draws of its own), so repeated rows and ties get equal outputs. Texts of more than ``chunk``
    bytes are scanned in chunks of that size, spread over all tasks; cuts and outputs are the same for any size. An empty table gives no
    rows. Other columns are ignored whatever their names."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    giant = F.octet_length("text") > chunk
    few = rows.where(~giant).select("doc_id", "text", drawn(seed).alias("draws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                texts, draws = piece.column(1).cast(pa.binary()).to_pylist(), piece.column(2).to_pylist()
                out = [short_text(np.frombuffer(t, np.uint8), d, rate, spm_rate) for t, d in zip(texts, draws, strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(x, kind) for x, kind in zip(zip(*out), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), *columns[:-1], columns[-1].cast(pa.string())], names=names_of(RESULT))

    return few.mapInArrow(run, RESULT).unionByName(giant_texts(rows.where(giant), seed, rate, spm_rate, chunk))


def short_text(raw: np.ndarray, draws: Sequence[int], rate: int, spm_rate: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output as bytes) of a text that is one chunk."""
    step = step_of(raw)
    n = step.counts[START]
    form = form_of(step.marks[0] == SEEN, not len(raw), draws, rate, spm_rate)
    if form == "plain":
        return n, form, None, None, raw.tobytes()
    places = np.append(begins(raw, START), len(raw))
    x, y = (int(places[k]) for k in cuts_of(n, draws))
    return n, form, *rearranged(raw, x, y, form)


def rearranged(raw: np.ndarray, x: int, y: int, form: str) -> tuple[int, int, bytes]:
    """(code points of the prefix, of the middle, output) of a text whose middle are the bytes from x to y."""
    (p, s, m), text = (k.encode() for k in MARKS), raw.tobytes()
    parts = (p, text[:x], s, text[y:], m, text[x:y]) if form == "psm" else (s, text[y:], p, text[:x], m, text[x:y])
    return code_points(raw[:x]), code_points(raw[x:y]), b"".join(parts)


KEY = "node long, other long"
STEP = f"{KEY}, part int, ends array<int>, counts array<long>, marks array<int>, chars long, draws array<long>"
PLAN = f"{KEY}, n long, form string, part array<int>, entry array<int>, skip array<long>"


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def giant_texts(rows: DataFrame, seed: int, rate: int, spm_rate: int, chunk: int) -> DataFrame:
    """The same for texts of any length, told by 128 bits of id and text. Their chunks are dealt out, each gives its Step, and the steps
    of a text are composed (one in ``chunk`` bytes). Cuts are then a chunk, its entry state and a number of tokens in it."""
    rows = rows.select(node_of(0).alias("node"), node_of(-1).alias("other"), "doc_id", "text", drawn(seed).alias("draws"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                raw = row.column("text")[0].as_buffer()
                for at in range(0, raw.size, chunk):
                    piece = pa.array([raw.slice(at, min(chunk, raw.size - at)).to_pybytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([row.column("node"), row.column("other"), pa.array([at // chunk], pa.int32()), piece, row.column("draws")], names=["node", "other", "part", "piece", "draws"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = [step_of(np.frombuffer(t, np.uint8)) for t in batch.column("piece").to_pylist()]
            lists = [pa.array([list(getattr(s, f)) for s in steps], pa.list_(kind)) for f, kind in (("ends", pa.int32()), ("counts", pa.int64()), ("marks", pa.int32()))]
            columns = [batch.column("node"), batch.column("other"), batch.column("part"), *lists, pa.array([s.chars for s in steps], pa.int64()), batch.column("draws")]
            yield pa.RecordBatch.from_arrays(columns, names=names_of(STEP))

    def compose(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("part")
        draws = table.column("draws")[0].as_py()
        whole, before = NOTHING, []
        for ends, counts, marks, chars in zip(*(table.column(c).to_pylist() for c in ("ends", "counts", "marks", "chars")), strict=True):
            before.append((whole.counts[START], whole.ends[START]))
            whole = whole.then(Step(tuple(ends), tuple(counts), tuple(marks), chars))
        n = whole.counts[START]
        form = form_of(whole.marks[0] == SEEN, False, draws, rate, spm_rate)
        before.append((n, START))  # the end of the text, where no chunk begins
        cuts = () if form == "plain" else cuts_of(n, draws)
        at = [int(np.searchsorted([b[0] for b in before], k, "right")) - 1 for k in cuts]  # the chunk in which a token begins
        told = [at, [before[i][1] for i in at], [k - before[i][0] for i, k in zip(at, cuts, strict=True)]]
        kinds = (pa.int32(), pa.int32(), pa.int64())
        lists = [pa.array([x], pa.list_(kind)) for x, kind in zip(told, kinds, strict=True)]
        ids = [pa.array([k.as_py()], pa.int64()) for k in key]
        yield pa.RecordBatch.from_arrays([*ids, pa.array([n], pa.int64()), pa.array([form]), *lists], names=names_of(PLAN))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n, form, parts, entries, skips = (row.column(c)[0].as_py() for c in ("n", "form", "part", "entry", "skip"))
                raw = np.frombuffer(row.column("text")[0].as_buffer(), np.uint8)
                places = []
                for at, entry, skip in zip(parts, entries, skips, strict=True):
                    piece = raw[at * chunk : (at + 1) * chunk]
                    places.append(at * chunk + int(begins(piece, entry)[skip]) if len(piece) else len(raw))
                prefix, middle, output = (None, None, raw.tobytes()) if form == "plain" else rearranged(raw, *places, form)
                numbers = [pa.array([x], pa.int64()) for x in (prefix, middle)]
                yield pa.RecordBatch.from_arrays([row.column("doc_id"), row.column("n"), row.column("form"), *numbers, pa.array([output], pa.binary()).cast(pa.string())], names=names_of(RESULT))

    pieces = rows.mapInArrow(part, f"{KEY}, part int, piece binary, draws array<long>").repartition("node", "other", "part")
    steps = pieces.mapInArrow(scan, STEP).dropDuplicates(["node", "other", "part"])  # repeated rows give equal steps
    plan = settle(steps.groupBy("node", "other").applyInArrow(compose, PLAN), "fim-cuts")
    return rows.select("node", "other", "doc_id", "text").join(plan, ["node", "other"]).mapInArrow(assemble, RESULT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No part holds a marker, so the markers of the output are those put in."""
    parts = F.split(output, "<[PSM]>")
    prefix, middle, suffix = F.when(form == "psm", F.get(parts, 1)).otherwise(F.get(parts, 2)), F.get(parts, 3), F.when(form == "psm", F.get(parts, 2)).otherwise(F.get(parts, 1))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))
