"""A corpus kept up to date from a folder that advisories arrive in.

Batch n of a stream is at folder/n. Every so many batches that is the whole corpus; batches between are
only what arrived, and are put over the whole one where the corpus is read. So a batch costs what it
brings, and reading joins with at most that many small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from advisium.operators.corpus import Corpus
from advisium.sources import csaf


def parse(batch: DataFrame) -> Corpus:
    """The corpus of a batch of (source_path, value) rows."""
    docs = batch.select("source_path", F.try_parse_json("value").alias("doc")).where("schema_of_variant(doc) like 'OBJECT%'")
    return csaf.corpus(batch.sparkSession, docs)


def last(spark: SparkSession, folder: str) -> int | None:
    """The number of the last batch that is whole on file; None before the first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = [int(x.removesuffix(".done")) for x in found if x.endswith(".done")]
    return max(done, default=None)


def load(spark: SparkSession, folder: str, n: int | None = None, every: int = 1) -> Corpus:
    """The corpus after batch n, the last one if none is named."""
    n = last(spark, folder) if n is None else n
    if n is None:
        raise ValueError(f"no batch at {folder}")
    whole = n - n % every
    out = Corpus.load(spark, f"{folder}/{whole}")
    for k in range(whole + 1, n + 1):
        out = out.upsert(Corpus.load(spark, f"{folder}/{k}"))
    return out


def start(spark: SparkSession, incoming: str, folder: str, checkpoint: str, every: int = 1) -> StreamingQuery:
    """Merges files that arrive into the corpus at folder, and writes it whole every so many batches.

    A batch that runs again writes the same folder again, so each file counts once. Deletes nothing.
    """
    stream = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(incoming)
    stream = stream.select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("source_path"), "value")

    def merge(batch: DataFrame, n: int) -> None:
        new = parse(batch.persist())
        try:
            old = load(spark, folder, n - 1, every) if n else None
            top = old.advisories.agg(F.coalesce(F.max("adv_ord"), F.lit(0))).first()[0] if old else 0
            new = Corpus(new.advisories.withColumn("adv_ord", F.col("adv_ord") + top), new.leaves, new.vulns)
            (old.upsert(new) if old and n % every == 0 else new).save(f"{folder}/{n}", "overwrite")
            spark.range(0).write.mode("overwrite").parquet(f"{folder}/{n}.done")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
