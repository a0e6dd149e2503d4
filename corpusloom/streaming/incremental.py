"""Documents as they arrive: new and changed ones alone are extracted, restatements come once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import manifest


def changed_documents(docs: DataFrame, store: str, process: Callable[[DataFrame], DataFrame], out: str, key: str = "doc_id"):
    """A writer that, per micro-batch, processes the documents whose (key, content hash) the store does
    not hold, appends the results to out and then the hashes to the store. Batch folders are named
    by epoch and overwritten, so that a replayed batch leaves no second copy."""

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        now = df.withColumn("content_hash", F.sha2("text", 256)).dropDuplicates([key, "content_hash"])
        try:
            seen = spark.read.option("basePath", store).parquet(store).where(F.col("epoch") < epoch)
            now = manifest.to_process(now, seen.select(key, "content_hash").distinct(), key, "content_hash")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        process(now).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        now.select(key, "content_hash").write.mode("overwrite").parquet(f"{store}/epoch={epoch}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store}-checkpoint")


def first_restatements(units: DataFrame, arrived: str, lateness: str = "1 day") -> DataFrame:
    """Units of a stream, the first of each (category, normalised text) within the watermark."""
    keyed = units.withColumn("norm", T.claim_key(F.col("text")))
    return keyed.withWatermark(arrived, lateness).dropDuplicatesWithinWatermark(["category", "norm"]).drop("norm")


def windowed_units(units: DataFrame, arrived: str, size: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Units per category and window of arrival."""
    return units.withWatermark(arrived, lateness).groupBy(F.window(arrived, size), "category").agg(F.count("*").alias("n"))
