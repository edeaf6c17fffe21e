"""Validation of documents as they arrive in a folder, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bomstrata.operators import profiles
from bomstrata.operators.engine import findings, verdicts
from bomstrata.sources.documents import read


def validate_stream(spark: SparkSession, source: str, sink: str, names: list[str], checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Append the verdicts of new files below ``source`` to the parquet table ``sink``, then stop.

    Each micro-batch is an ordinary corpus; the checkpoint keeps which files are done, so a restarted run goes on
    where the last one ended. Profiles are read once, before the stream starts.
    """
    chosen = [profiles.load(n) for n in names]
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).load(source).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def batch(df: DataFrame, number: int) -> None:
        named = df.withColumn("doc_id", F.xxhash64("path"))
        result = verdicts(findings(read(named, "doc_id", "text"), chosen, passing=False)).withColumn("batch", F.lit(number))
        result.join(named.select("doc_id", "path"), "doc_id").write.mode("append").parquet(sink)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
