"""Exact deduplication as a stateful stream (operator 4).

Documents arrive as a file stream. Each row is reduced to the SHA-256 digest of its normalised text
(white space deleted), its code points, its id and its content locator (file and row). A streaming
aggregation keyed by the digest keeps, in the disk-backed RocksDB state store and without expiry,
how many rows carried the digest and the identifier and locator of the one that stays: the row with
the most code points, then the smallest doc_id (null last), then the smallest locator. A later run
on the same checkpoint continues from that state, so a new file is compared with all that came
before. Hits are checked on full bytes: every row whose digest came more than once is compared with
the normalised text found at the locator; should two texts share a digest, the rows of that digest
are grouped anew by the texts themselves.

Plan: the digest aggregation combines map-side, so a text copied into a third of all rows reaches
the state as one row per task; only digests and numbers are shuffled. Rows meet their group in an
equi-join on the digest that AQE splits when one digest is hot. Texts are moved only for digests
that came more than once.

A null text counts as empty; empty texts are equal to each other. Repeated rows (same id and text)
are told apart by their locators: one stays. A null doc_id is an id like any other, ordered last.
Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

SPACE = r"[\x20\x09-\x0D]+"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # RocksDB would set aside some 4 MB of disk for every state partition, however little it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _rows(docs: DataFrame, digest: Callable[[Column], Column], text: bool = False, sha: bool = False) -> DataFrame:
    """One row per document: its order among equal texts, its locator and its digest; as wanted,
    the normalised text and its SHA-256."""
    norm = normalised(F.col("text"))
    place = docs.metadataColumn("_metadata")             # not a column of the table that has this name
    return docs.select(
        "doc_id", (-F.char_length(F.coalesce("text", F.lit("")))).cast("long").alias("order"),
        place["file_path"].alias("file"), place["row_index"].alias("row"),
        digest(norm).alias("digest"), *([norm.alias("norm")] if text else []), *([sha256(norm).alias("sha")] if sha else []))


def _best() -> list[Column]:
    """The aggregates that the state keeps."""
    return [F.count(F.lit(1)).alias("size"),
            F.min(F.struct("order", F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("keep")]


def run_stream(spark: SparkSession, path: str, schema, checkpoint: str, out: str,
               digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> None:
    """Feed every file of ``path`` that ``checkpoint`` has not seen yet through the state. Each
    micro-batch writes the digests it changed under its own epoch, so a replay overwrites itself."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        state = _rows(reader.parquet(path), digest).groupBy("digest").agg(*_best())
        query = (state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                 .foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dedup_stream(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256,
                 files_per_batch: int | None = None) -> DataFrame:
    """Deduplicate the parquet files of ``path`` (a folder or a file): ``doc_id``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256`` and the locator ``file``, ``row`` of every row."""
    docs = spark.read.parquet(path)
    out = scratch(spark, "exact-state")
    sink = "digest string, size long, keep struct<order: long, no_id: boolean, doc_id: {}, file: string, row: long>".format(
        docs.schema["doc_id"].dataType.simpleString())
    spark.createDataFrame([], sink).write.parquet(f"{out}/epoch=-1")   # a table without files runs no batch
    run_stream(spark, path[:-1] + f"[{path[-1]}]", docs.schema, scratch(spark, "exact-checkpoint"), out, digest, files_per_batch)
    groups = (spark.read.schema(f"{sink}, epoch int").parquet(out)
              .groupBy("digest").agg(F.max_by(F.struct("size", "keep"), "epoch").alias("g"))
              .select("digest", F.col("g.size").alias("size"), F.col("g.keep").alias("keep")))
    groups = stored(groups, "exact-groups")

    # full bytes of every row whose digest came more than once
    again = stored(_rows(docs, digest, text=True).join(groups.filter(F.col("size") > 1), "digest"), "exact-hits")
    here = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    keeper = again.filter(here).select("digest", F.col("norm").alias("kept_norm"))
    clash = stored(again.filter(~here).join(keeper, "digest").filter(F.col("norm") != F.col("kept_norm"))
                   .select("digest").distinct(), "exact-clashes")
    rows = _rows(docs, digest, sha=True)
    result = rows.join(groups, "digest")
    if not clash.isEmpty():
        apart = again.drop("size", "keep").join(clash, "digest")
        exact = apart.groupBy("digest", "norm").agg(*_best())
        own = apart.join(exact, ["digest", "norm"]).select("digest", "file", "row", "size", "keep")
        lone = rows.join(clash, "digest").join(own, ["digest", "file", "row"])
        result = result.join(clash, "digest", "left_anti").unionByName(lone)
    return result.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
                         here.alias("kept"), F.col("sha").alias("text_sha256"), "file", "row")
