"""Results of a client, kept row by row: a restart asks only for what is missing."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Rows asked for in one job, whose results are committed together.
ROUND_ROWS = 50_000


class Transient(Exception):
    """A failure that another try may mend."""


def with_retries(call: Callable[[list], list], asked: list, tries: int, wait: float, seed: object = None) -> tuple[list | None, str | None]:
    """(results, None), or (None, reason) after ``tries`` tries. Only Transient failures are tried again, after waits that
    double, each shortened by a random part so that tasks do not ask in step."""
    rng = random.Random(seed)
    for i in range(tries):
        try:
            got = call(asked)
            return (got, None) if len(got) == len(asked) else (None, f"{len(got)} results for {len(asked)} items")
        except Transient as e:
            reason = f"transient: {e}"
            if i + 1 < tries:
                time.sleep(wait * 2**i * (0.5 + rng.random() / 2))
        except Exception as e:  # noqa: BLE001 - the reason is a row of the result
            return None, f"{type(e).__name__}: {e}"
    return None, reason


def complete(
    items: DataFrame, path: str, call: Callable[[list], list], schema: str, batch: int = 16, tries: int = 3, wait: float = 0.5,
) -> DataFrame:
    """(key, result) for every row of ``items(key, value)``, from the table at ``path`` and from ``call`` for what it lacks.

    Missing keys are asked for in rounds of ROUND_ROWS, in batches within a task; a round's results are appended as they are,
    those of batches that failed being left out, and a failed round raises after its commit. So a client that fails half way
    costs its own batches only, and a restart asks for nothing that was answered; a lost executor repeats the tasks of a round.
    Keys must not be null or repeated. Results of type ``schema``.
    """
    from quern.operators.ingest import require

    spark = items.sparkSession
    kind = dict(items.dtypes)["key"]
    rows = f"key {kind}, result {schema}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    known = lambda: spark.read.schema(rows).parquet(f"{path}/round=*") if fs.exists(jpath) else spark.createDataFrame([], rows)
    once = items.groupBy("key").agg(F.count("*").alias("n"))
    require(once, F.col("key").isNotNull() & (F.col("n") == 1), "keys must be given and different").write.format("noop").mode("overwrite").save()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for at in range(0, len(f), batch):
                some = f.iloc[at : at + batch]
                got, reason = with_retries(call, some["value"].tolist(), tries, wait, str(some["key"].iloc[0]))
                results = got if reason is None else [None] * len(some)
                out += [(k, r, reason) for k, r in zip(some["key"], results)]
            yield pd.DataFrame(out, columns=["key", "result", "reason"])

    number = 0
    while True:
        missing = items.join(known().select("key"), "key", "left_anti").limit(ROUND_ROWS)
        while fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tried={number}")):
            number += 1
        tried = f"{path}/tried={number}"
        parts = max(1, spark.sparkContext.defaultParallelism)
        missing.repartition(parts, "key").mapInPandas(ask, f"{rows}, reason string").write.parquet(tried)  # asked once, read twice
        answers = spark.read.schema(f"{rows}, reason string").parquet(tried)
        answers.where("reason is null").select("key", "result").write.parquet(f"{path}/round={number}")
        count = answers.agg(F.count("*").alias("n"), F.count("reason").alias("bad"), F.min("reason").alias("why")).first()
        if count["bad"]:
            raise RuntimeError(f"{count['bad']} of {count['n']} items have no result: {count['why']}")
        if count["n"] < ROUND_ROWS:
            return known().join(items.select("key"), "key", "left_semi")
