"""Edges: models and media tools are plugged in as functions and run in the tasks; none is shipped."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_model(rows: DataFrame, load: Callable[[], object], apply: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What a model makes of whole batches of rows, plus an ``error`` column; the model is loaded once a task.

    ``apply`` gets a batch and returns rows with ``clip`` and the columns of
    ``schema``. If a batch fails, its rows go one by one; one that fails then
    gives one row with its clip and the error, and the others go on.
    """
    full = T.StructType.fromDDL(f"clip string, error string, {schema}")
    names = full.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            try:
                yield apply(model, batch).assign(error=None).reindex(columns=names)
                continue
            except Exception:  # noqa: BLE001 - found again below, row by row
                pass
            for at in range(len(batch)):
                row = batch.iloc[at : at + 1]
                try:
                    out = apply(model, row).assign(error=None)
                except Exception as error:  # noqa: BLE001 - kept with the row, not swallowed
                    out = pd.DataFrame({"clip": row["clip"].to_list(), "error": [f"{type(error).__name__}: {error}"]})
                yield out.reindex(columns=names)

    return rows.mapInPandas(run, full)


def probed_duration(answer: Column) -> Column:
    """A media tool's answer as seconds, 0 where it gave none or no number."""
    return F.coalesce(F.trim(answer).try_cast("double"), F.lit(0.0))


def execute(plan: DataFrame, act: Callable[[dict], None], done: DataFrame | None = None, key: str = "file") -> DataFrame:
    """The rows of a plan with ``outcome`` (done, skipped, error) and ``error``, after an action ran for each, in the tasks.

    An action that raises gives an error row, and the others go on. Keep the
    result and hand it in as ``done`` to take up where a run ended: rows whose
    key it has as done or skipped are skipped. A lost task runs its actions
    again, so they should write with ``aside``.
    """
    names = [*plan.columns, "outcome", "error"]
    if done is not None:
        kept = done.filter("outcome <> 'error'").select(F.col(key).alias("key_")).distinct()
        rows = plan.join(kept, F.col(key) == F.col("key_"), "left").withColumn("open_", F.col("key_").isNull()).select(*plan.columns, "open_")
    else:
        rows = plan.withColumn("open_", F.lit(True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outcomes, errors = [], []
            for row in batch.to_dict("records"):
                outcome, error = "skipped", None
                if row.pop("open_"):
                    try:
                        act(row)
                        outcome = "done"
                    except Exception as e:  # noqa: BLE001 - kept with the row, not swallowed
                        outcome, error = "error", f"{type(e).__name__}: {e}"
                outcomes.append(outcome)
                errors.append(error)
            yield batch.assign(outcome=outcomes, error=errors).reindex(columns=names)

    return rows.mapInPandas(run, T.StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema) + ", outcome string, error string"))


def aside(path: str, write: Callable[[str], None]) -> None:
    """Lets ``write`` make a file beside ``path`` and moves it there in one step; a failed write leaves nothing."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    name = f"{path}.{uuid.uuid4().hex}"
    try:
        write(name)
        os.replace(name, path)
    finally:
        if os.path.exists(name):
            os.remove(name)
