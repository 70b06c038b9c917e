"""Incremental load: CSV files dropped into a folder -> the load table, exactly once.

The batch load job reads one file; in production the same orders often
arrive as a stream of files.  This is that job on Structured Streaming: a
file source whose all-text schema has the names of the first file's header, the same coercion and quarantine
split (``load_job.staged``), and each micro-batch appended to the load table's
files partitioned by ``Status``.  The checkpoint (in the shared folder) records
which files were taken, so a restarted or re-run query never loads a file
twice; ``trigger(availableNow=True)`` processes what is there and stops.
No state is kept between batches — every row is handled on its own.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from bazaar.plans.load_job import staged
from bazaar.schema import MALFORMED
from bazaar.session import shared_path
from bazaar.sources.csv import header_of, read_options, text_schema


def start(spark: SparkSession, source_dir: str, table_dir: str, checkpoint: str | None = None,
          available_now: bool = True, max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Start the incremental load from ``source_dir`` into Parquet at ``table_dir``."""
    checkpoint = checkpoint or shared_path(spark, "streaming", "ingest-checkpoint")
    raw = (spark.readStream.schema(text_schema(header_of(spark, source_dir))).options(**read_options())
           .option("enforceSchema", False).option("columnNameOfCorruptRecord", MALFORMED)
           .option("maxFilesPerTrigger", max_files_per_trigger)
           .csv(source_dir))
    writer = (staged(raw, places=False).writeStream.format("parquet")
              .option("path", table_dir).option("checkpointLocation", checkpoint)
              .partitionBy("Status").outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
