"""The recogniser hook: user code over speech intervals, with failures kept to their recording."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.operators.transcripts import fold_text
from voxtide.sources.ranges import Decoder, Opener, read_range

# recognise(model, pcm bytes of one interval) -> the emissions in order
Recognise = Callable[[Any, bytes], list[str]]


def recognize(audio: DataFrame, load_model: Callable[[], Any], recognise: Recognise, decoder: Decoder | None = None) -> DataFrame:
    """Text of every interval: ``file_id, idx, start_sample, end_sample, text, error``.

    ``audio`` has the intervals with their samples' place, ``path, at, length`` (``sources.wave.interval_ranges``),
    which are read right before they are recognised, or the samples themselves in ``pcm``. The model is loaded once per
    task and not at all for a task without rows. An interval whose samples cannot be read, or whose recognition
    fails, carries the error; a model that does not load fails the job.
    """
    kind = audio.schema["file_id"].dataType.simpleString()
    given = ["pcm"] if "pcm" in audio.columns else ["path", "at", "length"]
    bounds = ["file_id", "idx", "start_sample", "end_sample"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, opener = None, Opener(decoder)

        def samples(row: tuple) -> bytes:
            if len(row) == 1:
                return row[0]
            path, at, length = row
            return b"".join(piece for _, piece in read_range(opener(path), int(at), int(length)))

        for batch in batches:
            if model is None and len(batch):
                model = load_model()
            texts, errors = [], []
            for row in zip(*(batch[c] for c in given)):
                try:
                    text = ""
                    for emission in recognise(model, samples(row)):
                        if emission.strip():
                            text = fold_text(text, emission)
                    texts.append(text)
                    errors.append(None)
                except Exception as problem:
                    texts.append(None)
                    errors.append(str(problem))
            yield batch[bounds].assign(text=texts, error=errors)
        opener.close()

    return audio.select(*bounds, *given).mapInPandas(
        run, f"file_id {kind}, idx bigint, start_sample bigint, end_sample bigint, text string, error string"
    )


def isolate_failures(files: DataFrame, recognised: DataFrame) -> DataFrame:
    """Per recording ``Failed`` with its first error, or ``Complete``; one recording never affects another."""
    bad = recognised.groupBy("file_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("idx"))).alias("error"))
    rows = files.select("file_id").join(bad, "file_id", "left")
    return rows.select("file_id", F.when(F.col("error").isNull(), "Complete").otherwise("Failed").alias("state"), "error")
