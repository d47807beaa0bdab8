"""New session files as a stream: each micro-batch is parsed and appended once. An extension; exports are finished files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import parse_filename, parse_folder
from ..sources import raw

_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Parsed blocks of files as they arrive under root, with their names' columns."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(root)
    blocks = files.select("path", "content").mapInPandas(raw._parse, raw.BLOCKS)
    folder, name = F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1)
    return blocks.withColumn("f", parse_folder(folder)).withColumn("p", parse_filename(name)).select("*", "f.*", "p.*").drop("f", "p")


def append_blocks(spark: SparkSession, root: str, out: str, checkpoint: str):
    """Write what has arrived and stop; files already written are not read again."""
    query = stream_blocks(spark, root).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()
