"""Incremental ingest of a growing folder of files, and of a stream of extraction results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.functions import paths
from paperloom.operators import corpus, extraction

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """A stream of the supported files of a folder, each once."""
    r = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", str(recursive).lower())
    return r.load(folder).where(paths.is_supported(F.col("path")))


def ingest(spark: SparkSession, folder: str, store: str, state: str, ocr: extraction.OcrBackend | None = None) -> StreamingQuery:
    """Extracts what is new in a folder into Parquet tables documents and elements under `store`, then stops.

    Each batch is a partition, which a batch that runs again after a failure replaces, so no row is there twice. A file that
    changed is read again in a later batch; readers keep the latest batch of each id.
    """

    def write(batch: DataFrame, n: int) -> None:
        docs = extraction.documents(batch, ocr).persist()
        try:
            extraction.results(docs).drop("elements").write.mode("overwrite").parquet(f"{store}/documents/batch={n}")
            extraction.elements(docs).write.mode("overwrite").parquet(f"{store}/elements/batch={n}")
        finally:
            docs.unpersist()

    return new_files(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def save_facts(facts: DataFrame, store: str) -> None:
    """The merged facts and their canonical items under `store`: Parquet tables facts and spec_items, and the facts as JSON lines in facts_json.

    Each is written whole by the executors and replaces what was there.
    """
    merged = corpus.merge_facts(facts)
    merged.write.mode("overwrite").parquet(f"{store}/facts")
    merged.write.mode("overwrite").json(f"{store}/facts_json")
    corpus.canonical_items(facts).write.mode("overwrite").parquet(f"{store}/spec_items")


def first_of_content(stream: DataFrame, time: str, late: str = "7 days") -> DataFrame:
    """The first delivery of each content_hash in a stream, with a watermark that bounds the state; later than `late` counts anew."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["content_hash"])


def loads_by_window(stream: DataFrame, time: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, file_type, n: deliveries by tumbling window, late ones within `late` counted where they belong."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, size), F.lower("file_type").alias("file_type")).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), "file_type", "n")
