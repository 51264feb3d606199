"""Shared helpers: tables in the shared folder, and vectorised work on the bytes of Arrow text columns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: 0x09-0x0D and 0x20.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- tables in the shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset a local session, whose executor is
    the driver, gets a temporary one; a cluster is refused, as its executors would write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Rows of a narrow table that a file at least holds, where their number is known.
FILE_ROWS = 100_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read the table back: lineage is cut, executors may go.

    rows: about how many there are at most, if that is known: small tables are then written in few files, by few tasks that each
    read several partitions; of large ones every partition stays a file."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if rows is not None and (files := max(1, -(-rows // FILE_ROWS))) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(files)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by stored() that nothing reads any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        p = jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):  # a left-over folder does no harm
            p.getFileSystem(conf).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it has fewer partitions than these, as a table in one small file has; else as it is: inputs
    that fill the cluster aren't shuffled. Only where rows are worked on depends on it, never what comes out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---------------------------------------------------------------- bytes of text
def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    h = h ^ (h >> np.uint64(30))
    h = h * MIX_A
    h ^= h >> np.uint64(27)
    h *= MIX_B
    h ^= h >> np.uint64(31)
    return h


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column end to end (a null is empty), and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of bytes that are not `outside` (a flag for each byte value; ASCII white space
    where not given), and for each row the index of its first word (n + 1 numbers). A run never crosses rows."""
    inside = ~outside[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    starts = inside & ~before[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    starts[edges] = inside[edges]
    after = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = inside[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        after[last] = False
    ends = inside & ~after
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, outside: np.ndarray = SPACE) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over the byte's place in the word, then mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    step = 1 << 18  # words at a time: bounded memory
    base = np.uint64((0x9E3779B97F4A7C15 + 2 * 0xD1342543DE82EF95 * (seed + 1)) & (2**64 - 1) | 1)
    for a in range(0, len(starts), step):
        s, e = starts[a : a + step], ends[a : a + step]
        lo, hi = int(s[0]), int(e[-1])
        n = e - s
        longest = int(n.max())
        powers = np.cumprod(np.full(longest + 1, base, np.uint64), dtype=np.uint64)
        part = data[lo:hi]
        # the place of each byte in its word; bytes between words get weight 0 through a clipped index
        place = np.arange(hi - lo, dtype=np.int64) - np.repeat(s - lo, np.diff(np.append(s, hi)))
        weight = np.where(outside[part], np.uint64(0), powers[np.minimum(place, longest)])
        summed = np.add.reduceat((part.astype(np.uint64) + np.uint64(1)) * weight, s - lo)
        out[a : a + step] = mix(summed ^ (n.astype(np.uint64) * GOLDEN))
    return out


def window_hashes(h: np.ndarray, size: int, multiplier: int) -> np.ndarray:
    """The hash of h[i : i + size] for each i, by prefix sums of h[j] * m**j modulo 2**64 (m is odd, so it has an inverse)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = multiplier | 1
    inverse = pow(m, -1, 2**64)
    powers = np.ones(len(h), np.uint64)
    powers[1:] = np.cumprod(np.full(len(h) - 1, m, np.uint64), dtype=np.uint64)
    back = np.ones(n, np.uint64)
    back[1:] = np.cumprod(np.full(n - 1, inverse, np.uint64), dtype=np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers, out=total[1:])
    return mix((total[size:] - total[:-size]) * back)


def segments(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of text; one row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df hasn't, without regard to case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found without regard to what else df carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
