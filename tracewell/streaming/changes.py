"""Extension: lineage kept up to date from a stream of model versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.operators.assembly import parse_models


def latest(versions: DataFrame) -> DataFrame:
    """Of each node in a batch the version with the highest ord."""
    return versions.withColumn("n", F.row_number().over(Window.partitionBy("unique_id").orderBy(F.desc("ord")))).where("n = 1").drop("n")


def start(spark: SparkSession, path: str, out: str, checkpoint: str, once: bool = True):
    """Read node versions (JSON lines in NODES' shape) as they arrive and write their lineage, by batch, under ``out``.

    Each micro-batch parses only the nodes in it; a batch that is run again after a failure overwrites its own folder.
    """
    stream = spark.readStream.schema(schemas.NODES).json(path)

    def parse(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        found = parse_models(s, latest(batch), s.createDataFrame([], schemas.COLUMNS))
        found.lineage.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(parse).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
