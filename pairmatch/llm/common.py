"""Shared helpers of the training-data operators: tables in the shared scratch folder, row ids
and blocks of documents."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, scratch_table

# The white space every operator splits words on: space and \x09-\x0D, nothing wider.
WORD = r"[^\x20\x09-\x0D]+"

BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

# Bounds of one block of documents: what a Python task holds at a time.
BLOCK_ROWS = 500
BLOCK_BYTES = 3 << 19


def trim():
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(task):
    """``task`` (a function of a partition's batches) that gives freed memory back when it ends:
    Spark keeps its Python workers, and what they hold would add up over the steps of a job."""
    def run(batches):
        yield from task(batches)
        trim()
    return run


def lean_group(task):
    """The same for a function of one group."""
    def run(group):
        out = task(group)
        trim()
        return out
    return run


def refuse_clash(carry: Iterable[str], results: Iterable[str]) -> None:
    """Raise if a carried column is named like a result column."""
    clash = sorted(set(carry) & set(results))
    if clash:
        raise ValueError(f"carried columns named like result columns: {clash}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names (shared by the cluster)."""
    return scratch_path(spark, name)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """While a table is written: Arrow batches of a few MB between Spark and its Python workers, so
    that rows with long texts take little memory on both sides."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, branches that
    reuse it do not recompute it, and a lost executor only re-reads files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, cols: list[str], name: str) -> DataFrame:
    """``cols`` of ``docs`` plus ``uid``, a number of the row that stays the same for every later
    reader (ids in the data may be null or repeated, so they cannot name a row)."""
    return stored(docs.select(F.monotonically_increasing_id().alias("uid"), *cols), name)


def slices(batch: pa.RecordBatch, text: int, rows: int = BLOCK_ROWS,
           size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of at most ``rows`` rows and about ``size`` bytes of the
    text column; one row larger than that is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def blocks(docs: DataFrame, carry: list[str], name: str, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES,
           bucketed: bool = False) -> DataFrame:
    """``docs`` as a stored table of blocks: ``block`` (its number), ``d`` (the ``carry`` columns of
    its rows), ``body`` (their texts one after another, compressed), ``lens`` (their lengths in
    bytes, 64-bit) and ``size`` (of all texts). Later steps read a block as one row, so a row of the
    input is named by its block and its place there. A null text counts as empty. A ``bucketed``
    table is dealt out by block number once, so that joins on it move the other side only; it is
    registered in the session's catalog under a name of its own, its files are in the shared
    folder."""
    fields = docs.select(F.struct(*carry).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, 1, rows, size):
                texts = [t or b"" for t in part.column(1).to_pylist()]
                lens = np.array([len(t) for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), part.column(0)),
                    pa.array([pack(b"".join(texts))], pa.binary()), pa.array([lens.tobytes()], pa.binary()),
                    pa.array([int(lens.sum())], pa.int64())], names=["d", "body", "lens", "size"])

    kind = fields.schema["d"].dataType.simpleString()
    raw = docs.select(F.struct(*carry).alias("d"), F.col("text").cast("string").cast("binary").alias("text"))
    out = raw.mapInArrow(lean(run), f"d array<{kind}>, body binary, lens binary, size long")
    out = out.select(F.monotonically_increasing_id().alias("block"), "*")
    if not bucketed:
        return stored(out, name)
    spark, path = docs.sparkSession, scratch(docs.sparkSession, name)
    own = scratch_table(path)
    with small_batches(spark):
        (out.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
         .option("path", path).saveAsTable(own))
    return spark.table(own)


def total_size(blocks_: DataFrame) -> int:
    return blocks_.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def open_block(body: bytes, lens: bytes) -> pa.Array:
    """The texts of a block as an Arrow string array."""
    raw = zstandard.ZstdDecompressor().decompress(body)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lens, dtype=np.int64))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw))


def block_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word's distinct word, the distinct words, words of each text)."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)       # leading and trailing space leave empty runs
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
    real = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.diff(real[bounds])


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word: sums of a scrambled number per byte and place."""
    raw = words.cast(pa.large_binary())
    _, at, data = raw.buffers()
    at = np.frombuffer(at, dtype=np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if len(raw) else np.empty(0, dtype=np.uint8)
    at = at - at[0]
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    cell = (place.astype(np.uint64) << np.uint64(8)) | data
    out = []
    for seed in (0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(cell + np.uint64(seed)), dtype=np.uint64)])
        out.append(mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def gram_hash(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hashes of every ``n`` consecutive values (the last n - 1 places are left out)."""
    done, width, out, powers = 0, 1, None, h
    while True:                                  # binary expansion of n, widest part last
        if n & width:
            part = powers[done:]
            factor = np.uint64(pow(base, width, 1 << 64))
            out = part if out is None else out[:len(part)] * factor + part[:len(out)]
            done += width
        width *= 2
        if width > n:
            return out[:max(0, len(h) - n + 1)]
        half = width // 2
        if len(powers) <= half:
            return h[:0]
        powers = powers[:-half] * np.uint64(pow(base, half, 1 << 64)) + powers[half:]
