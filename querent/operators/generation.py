"""The place where a text generator is plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Generator = Callable[[DataFrame], DataFrame]


def generate(prompts: DataFrame, generator: Generator, keys: Sequence[str] = ("query_id",)):
    """Prompts with a ``response`` column; NULL where the generator gave none.

    The generator maps ``(keys, prompt)`` to ``(keys, response)``; a key it gives
    twice is an error. Counting by key deals the rows as the join needs them.
    """
    given = generator(prompts.select(*keys, "prompt")).select(*keys, "response")
    named = F.concat_ws("/", *[F.col(key).cast("string") for key in keys])
    error = F.raise_error(F.concat(F.lit("more than one response for "), named)).cast("string")
    counted = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("response").alias("r"))
    responses = counted.select(*keys, F.when(F.col("n") == 1, F.col("r")).otherwise(error).alias("response"))
    return prompts.join(responses, list(keys), "left")


def from_stored(responses: DataFrame, keys: Sequence[str] = ("query_id",)) -> Generator:
    """A generator that looks up responses made earlier."""
    return lambda prompts: prompts.select(*keys).join(responses, list(keys))


def from_function(
    factory: Callable[[], Callable[[list[str]], list[str | None]]],
    keys: Sequence[str] = ("query_id",),
    batch_size: int = 32,
    failures: tuple[type[Exception], ...] = (OSError,),
) -> Generator:
    """A generator that calls a user function on batches of prompts in the tasks.

    The factory runs once per task. A call that raises one of ``failures``, such
    as a request error, leaves its batch NULL.
    """

    def generator(prompts: DataFrame) -> DataFrame:
        fields = [prompts.schema[key] for key in keys]
        out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = factory()
            for frame in frames:
                texts, responses = frame["prompt"].tolist(), []
                for start in range(0, len(texts), batch_size):
                    batch = texts[start : start + batch_size]
                    try:
                        responses.extend(call(batch))
                    except failures:
                        responses.extend([None] * len(batch))
                yield frame[list(keys)].assign(response=responses)

        return prompts.mapInPandas(run, f"{out}, response string")

    return generator
