"""Where the operators put what they write: a folder that every executor and the driver see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
FILTER_WORDS = 1 << 18
SPARSE = 256
FAN_IN = 256


_own: dict[str, str] = {}
_swept: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a new temporary folder takes its place for as long
    as the process lives; on a cluster, whose executors don't see such a folder, that is an error."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="lociq-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        found = _own[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call gets. It belongs to the application: when the driver's
    Python ends in the ordinary way, all of them are removed."""
    app = f"{shared_folder(spark)}/lociq/{spark.sparkContext.applicationId}"
    if app not in _swept:
        _swept.add(app)
        atexit.register(_remove, app)
    return f"{app}/{label}-{uuid.uuid4().hex}"


def _remove(folder: str) -> None:
    fs, path = open_store(folder)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or an absolute local path, and the path in it."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once as Parquet in the shared folder and go on from the files: the lineage ends
    there, a lost executor costs no recomputation, and two readers don't compute it twice."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, column: str, label: str) -> DataFrame:
    """As settle(), in as many buckets of a column as shuffles have partitions: joins on it move the other side alone."""
    spark = df.sparkSession
    path, n = new_path(spark, label), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"lociq_{uuid.uuid4().hex}"
    df.repartition(n, column).write.format("parquet").bucketBy(n, column).option("path", path).saveAsTable(table)
    return spark.table(table)


def discard(*written: DataFrame) -> None:
    """Remove the files of written tables that nothing will read any more."""
    for folder in {f.rsplit("/", 1)[0] for df in written for f in df.inputFiles()}:
        fs, path = open_store(folder)
        fs.delete_dir(path)


def filter_bits(keys: DataFrame, column: str = "node", sparse: int | None = SPARSE) -> np.ndarray:
    """A Bloom filter of FILTER_WORDS * 64 bits at most, whatever the table, with one bit for each key of a column of 64-bit hashes: it is
    halved as long as ``sparse`` bits for each that is set are left, not at all if that is None."""
    word, bit = _place(F.col(column), FILTER_WORDS)
    marks = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # FILTER_WORDS rows at most
    bits = np.zeros(FILTER_WORDS, "<i8")
    bits[marks.column("word").to_numpy()] = marks.column("bits").to_numpy()
    places = np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    words = FILTER_WORDS
    while sparse and words > 2 and words * 32 >= sparse * len(places):
        words //= 2
    if words < FILTER_WORDS:
        small = np.zeros(words * 64, np.uint8)
        small[places // (FILTER_WORDS // words)] = 1
        bits = np.packbits(small, bitorder="little").view("<i8")
    return bits


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of some unsigned hashes may be among the keys of a filter."""
    shift = np.uint64(65 - len(bits).bit_length())
    return (bits.view(np.uint64)[keys >> shift] >> ((keys >> (shift - np.uint64(6))) & np.uint64(63))) & np.uint64(1) == 1


def may_hold(keys: DataFrame, column: str = "node") -> Callable[[Column], Column]:
    """Whether a value may be among the 64-bit hashes in a column of a written table, as a condition, by a filter of bounded size. It says
    yes of every key, and of some others, the more the fuller the filter is: what follows must rule these out."""
    bits = filter_bits(keys, column)
    table = pa.table({"bits": pa.array([bits], pa.list_(pa.int64()))})
    held = keys.sparkSession.createDataFrame(table).scalar()

    def condition(key: Column) -> Column:
        word, bit = _place(key, len(bits))
        return F.get(held, word).bitwiseAND(bit) != 0

    return condition


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """Word and bit of a hash in a filter of so many words: its highest bits tell the word, the next six the bit."""
    shift = 65 - words.bit_length()
    at = F.shiftrightunsigned(key, shift - 6).bitwiseAND(63).cast("int")
    return F.shiftrightunsigned(key, shift).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), at)


def matching(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a scan joined to the written rows of ``keys``, the first of whose columns is a 64-bit hash. All that can't match are
    left where they lie; the others go through the same shuffle whatever their number."""
    return rows.where(may_hold(keys, on[0])(F.col(on[0]))).join(keys, on)


def without(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Rows of a scan whose node isn't ``out`` in the written table told (node, out), which has every node of them. Rows that the filter
    of the nodes that are out takes for one of these, wrongly, are found in told, so that only they and the few that a filter of
    theirs lets pass besides are shuffled."""
    out = told.where("out").select("node")
    may = may_hold(out)(F.col("node"))
    spared = settle(told.where(~F.col("out") & may).select("node"), "spared")
    unsure = rows.where(may & may_hold(spared)(F.col("node"))).join(out, "node", "left_anti")
    return rows.where(~may).unionByName(unsure)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(columns: list[str]) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def numbered(docs: DataFrame, seed: int = 0) -> DataFrame:
    """node, one, two, doc, text of every row: a 64-bit hash of (id, text) that stands for the row, 128 more bits of these to tell
    whether two rows got one node (see repeated_nodes), the id, the text (null as empty). Rows with equal ids and texts are one document; a
    null id is an id of its own."""
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(node_of(seed).alias("node"), node_of(-1).alias("one"), node_of(-2).alias("two"), doc.alias("doc"), text.alias("text"))


def node_of(seed: int) -> Column:
    """The node of numbered() as an expression over columns doc_id and text."""
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(F.lit(seed), doc.isNull(), F.coalesce(doc, F.lit(0)), text)


def repeated_nodes(told: DataFrame) -> DataFrame | None:
    """node of several rows of a written (node, one, two); None if two different rows share a node: then another seed must number them."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("one", "two") for f in (F.min, F.max)]
    several = settle(told.groupBy("node").agg(F.count("*").alias("rows"), *ends).where("rows > 1"), "repeated-rows")
    return several.select("node") if several.where("min_one != max_one or min_two != max_two").isEmpty() else None


def once(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row of each of the written nodes that several have, and all others. Only those that may be repeated are shuffled."""
    if repeated.isEmpty():
        return rows
    may = may_hold(repeated)(F.col("node"))
    return rows.where(~may).unionByName(rows.where(may).dropDuplicates(["node"]))


def summed(parts: DataFrame, key: str, value: str, kind: str) -> DataFrame:
    """The sums, by key, of arrays of equal length that a column holds as bytes of a numpy type: ``parts`` has one row for
    each partition and key. Parts meet in groups of about FAN_IN first, then these sums, so that no group grows with
    the number of partitions."""

    def add(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = None, None
        for batch in batches:
            for part in batch.column(value):
                x = np.frombuffer(part.as_py(), kind)
                total = x.astype(x.dtype) if total is None else total + x
            last = batch
        if last is not None:
            yield pa.RecordBatch.from_arrays([last.column(key).slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=[key, value])

    schema = f"{key} {dict(parts.dtypes)[key]}, {value} binary"
    spread = parts.select(key, value, (F.spark_partition_id() / FAN_IN).cast("int").alias("fan"))
    some = spread.groupBy(key, "fan").applyInArrow(add, schema)
    return some.groupBy(key).applyInArrow(add, schema)
