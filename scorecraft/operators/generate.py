"""The generator hook (U1): record a user callable's answers for the rows of runs.

``generate`` calls ``generator(model, prompt)`` inside tasks, over Arrow batches,
and writes a table of recorded outputs, the one that ``scoring.evaluate`` reads.
Calls are dear and need not be repeatable, so they are made once a row and their
answers are a written table: nothing downstream calls again.

A row's failure is that row's: its error is recorded and the run goes on. A rate
limit is tried again up to ``max_retries`` times after ``retry_delay_seconds``. A
refused credential ends the run: rows of a run reach a task in row order, and the
task calls for none after the refused one. Tasks that hold other parts of the run
find out by a call of their own; what they record after the first refused row is
dropped by ``evaluate``, which cuts every run there.

Scale: rows are dealt by range of (run, row_index) over ``concurrency`` tasks, so
one large run is spread, and that is the number of calls open at once. A task
that is lost calls again for its rows (at least once); the table shows the
attempt that ended. ``recorded`` (a table of an earlier call) spares its rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.operators.layout import written
from scorecraft.operators.scoring import AUTH, RUN_KEYS, runs_of_cases

ERROR, RATE_LIMIT = "error", "rate_limit"
MAX_RETRIES = 1
RETRY_DELAY_SECONDS = 3.0
ANSWER = "output string, error_kind string, error_message string, attempts int"


class AuthFailure(Exception):
    """Credentials are refused: the run ends."""


class RateLimited(Exception):
    """Too many calls: the row may be tried again."""


def error_names(kinds: Sequence[type[BaseException]]) -> frozenset[str]:
    """Exception classes by name: a task may hold another copy of the class."""
    return frozenset(f"{k.__module__}.{k.__qualname__}" for k in kinds)


def is_a(error: BaseException, names: frozenset[str]) -> bool:
    return any(f"{k.__module__}.{k.__qualname__}" in names for k in type(error).__mro__)


def answer(
    generator: Callable[[str, str], object],
    model: str,
    prompt: str,
    auth: frozenset[str],
    limits: frozenset[str],
    max_retries: int,
    delay: float,
) -> tuple[str | None, str | None, str | None, int]:
    """``output, error_kind, error_message, attempts`` of one row."""
    attempts = 0
    while True:
        attempts += 1
        try:
            return str(generator(model, prompt)), None, None, attempts
        except Exception as error:  # noqa: BLE001 - a row's failure is recorded, not raised
            message = str(error) or type(error).__name__
            if is_a(error, auth):
                return None, AUTH, message, attempts
            if not is_a(error, limits):
                return None, ERROR, message, attempts
            if attempts > max_retries:
                return None, RATE_LIMIT, message, attempts
        time.sleep(delay)


def generate(
    dataset: DataFrame,
    runs: DataFrame,
    generator: Callable[[str, str], object],
    path: str | None = None,
    run_keys: Sequence[str] = RUN_KEYS,
    prompt: str = "prompt",
    max_retries: int = MAX_RETRIES,
    retry_delay_seconds: float = RETRY_DELAY_SECONDS,
    concurrency: int | None = None,
    auth_errors: Sequence[type[BaseException]] = (AuthFailure,),
    rate_limit_errors: Sequence[type[BaseException]] = (RateLimited,),
    recorded: DataFrame | None = None,
) -> DataFrame:
    """Recorded outputs ``run_keys, row_index, output, error_kind,
    error_message, attempts`` of every run over its case's rows, read back from
    ``path`` (else a folder of the shared checkpoint dir).

    ``dataset``: ``case_id, row_index, <prompt>``; ``runs``: ``model, case_id``.
    A null prompt is an empty one. Rows that ``recorded`` has an answer for are
    taken from it; those it holds as refused are called for again.
    """
    if max_retries < 0:
        raise ValueError(f"max_retries must not be negative: {max_retries}")
    keys = list(run_keys)
    rows = runs_of_cases(dataset, runs.select(*keys).distinct(), keys).select(
        *keys, "row_index", F.coalesce(F.col(prompt).cast("string"), F.lit("")).alias("_prompt")
    )
    order = [*keys, "row_index"]
    if recorded is not None:
        recorded = recorded.filter(~F.col("error_kind").eqNullSafe(AUTH))
        rows = rows.join(recorded.select(*order), order, "left_anti")
    tasks = concurrency or dataset.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    auth, limits = error_names(auth_errors), error_names(rate_limit_errors)
    model_key = keys.index("model")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ended: set[tuple] = set()
        for batch in batches:
            kept, answers = [], []
            for place, row in enumerate(batch.itertuples(index=False, name=None)):
                run = row[: len(keys)]
                if run in ended:
                    continue
                got = answer(generator, row[model_key], row[-1], auth, limits, max_retries, retry_delay_seconds)
                if got[1] == AUTH:
                    ended.add(run)
                kept.append(place)
                answers.append(got)
            if not kept:  # a batch after its run's end; Arrow takes no untyped empty column
                continue
            out = batch.iloc[kept].drop(columns="_prompt").reset_index(drop=True)
            for k, field in enumerate(ANSWER.split(", ")):
                out[field.split()[0]] = [a[k] for a in answers]
            yield out.astype({"attempts": "int32"})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_prompt")
    fresh = rows.mapInPandas(call, f"{fields}, {ANSWER}")
    if recorded is not None:
        fresh = fresh.unionByName(recorded.select(*fresh.columns))
    return written(fresh, "recorded-outputs", path)
