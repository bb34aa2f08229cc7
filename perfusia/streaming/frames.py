"""Chunks of a simulation as a stream: each tick takes the state one chunk on and writes its frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from perfusia.operators.iterate import run_steps
from perfusia.operators.stencil import StepParams
from perfusia.plans.simulate import Frame


def stream_frames(spark: SparkSession, ticks: DataFrame, first: DataFrame, params: StepParams, steps_per_chunk: int, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """ticks: a stream whose micro-batches are chunks. State n is written from state n - 1, so a batch that is run again writes the same, and a
    stream that goes on from its checkpoint leaves frames alone that are done. available_now: it ends with the ticks that are there."""
    first.write.mode("ignore").parquet(f"{folder}/state/-1")

    def advance(batch: DataFrame, batch_id: int) -> None:
        state = spark.read.parquet(f"{folder}/state/{batch_id - 1}")
        run_steps(state, params, steps_per_chunk).write.mode("overwrite").parquet(f"{folder}/state/{batch_id}")
        after = spark.read.parquet(f"{folder}/state/{batch_id}")
        Frame(batch_id, (batch_id + 1) * steps_per_chunk * params.dt, after).overlay().drop("frame_id").write.mode("overwrite").parquet(f"{folder}/frames/frame_id={batch_id}")

    stream = ticks.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def ticks_from(spark: SparkSession, folder: str) -> DataFrame:
    """A file source of ticks, (chunk): each file is a micro-batch."""
    return spark.readStream.schema("chunk long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
