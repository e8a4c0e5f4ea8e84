"""Pluggable inference with a prediction table as its cache."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def worklist(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that have no prediction yet."""
    return rows.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def infer(rows: DataFrame, prompt: Column, key: str, call: Callable[[str], str], partitions: int | None = None) -> DataFrame:
    """(key, answer): the model's answer to each prompt, one batch of a partition at a time."""
    asked = rows.select(F.col(key).cast("string").alias("key"), prompt.alias("prompt"))
    if partitions:
        asked = asked.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "answer": [call(p) if isinstance(p, str) else None for p in batch["prompt"]]})

    return asked.mapInPandas(run, "key string, answer string")


def parse_answer(answer: Column, schema: str, field: str) -> Column:
    """The first flat JSON object with the field in an answer, as a struct; null where there is none."""
    return F.from_json(F.regexp_extract(answer, r'\{[^{}]*"' + field + r'"[^{}]*\}', 0), schema)


def keyword_stub(prompt: str) -> str:
    """A stand-in for a model in tests: a verdict from one word."""
    hit = "panic" in prompt.lower() or "overflow" in prompt.lower()
    return "note\n" + json.dumps({"is_security_fix": hit, "confidence": 0.8 if hit else 0.6})
