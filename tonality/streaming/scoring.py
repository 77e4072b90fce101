"""Incremental scoring of utterance files as they arrive (Structured Streaming).

New episode files in a folder are picked up by a file stream; every
micro-batch is a static DataFrame and runs the same batch plan (prepare ->
score -> label).  Each batch writes its scored rows and its rejects to folders
of its own number, which a replay overwrites.  Scoring is per sentence, so a
micro-batch needs no state from earlier batches; the checkpoint location makes
the stream restartable after failures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tonality.operators.prepare import prepare_utterances
from tonality.operators.model import model_rejects
from tonality.plans.pipeline import SCORED, Scoring, with_scores
from tonality.schema import UTTERANCE
from tonality.session import materialize
from tonality.sources.utterances import CSV_READ_OPTIONS, episode_from_path


def start_scoring_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                         characters: DataFrame, stopwords, sc: Scoring,
                         max_files_per_trigger: int = 100, trigger_once: bool = False) -> StreamingQuery:
    stream = (spark.readStream.schema(UTTERANCE).options(**CSV_READ_OPTIONS, enforceSchema="false")
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .csv(source_dir)
              .withColumn("Episode", episode_from_path()))

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        scores = materialize(with_scores(prepare_utterances(batch, characters, stopwords), sc))
        ok, rejects = model_rejects(scores)
        for name, rows in (("scored", ok.select(*SCORED)), ("rejects", rejects)):
            rows.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger_once else writer
    return writer.start()
