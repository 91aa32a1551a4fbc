"""Provider slots: outside models and converters called in batches from tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docsluice.operators.corpus import embed_batches, hashing_embedder
from docsluice.operators.extraction import extract_texts

__all__ = ["complete", "echo", "embed_batches", "extract_texts", "hashing_embedder"]


def echo(prompts: list[str]) -> list[str]:
    """Completion for tests: the prompt itself."""
    return prompts


def complete(rows: DataFrame, fn: Callable[[list[str]], list[str]] = echo, prompt: str = "prompt", out: str = "reply", batch: int = 16) -> DataFrame:
    """Add the completion of a prompt column, at most ``batch`` prompts per call."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies: list[str] = []
            for at in range(0, len(frame), batch):
                asked = frame[prompt].iloc[at : at + batch].tolist()
                got = fn(asked)
                if len(got) != len(asked):
                    raise ValueError(f"completion provider returned {len(got)} replies for {len(asked)} prompts")
                replies.extend(got)
            yield frame.assign(**{out: replies})

    return rows.mapInPandas(run, schema)
