"""Interfaces to what lies outside the engine: generation, compilation and test runs.

An outside step is a function over Arrow batches of pandas frames. The engine gives it rows
and takes rows; processes and networks stay behind it. A step that raises marks its rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from lodestone.session import stored


def with_step(df: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str, attempts: int = 1, wait: float = 1.0) -> DataFrame:
    """``df`` with the columns of ``schema`` that ``step`` makes of each batch, and ``step_error``.

    A failing batch is tried again, waiting twice as long each time; then its rows carry the error."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            made, error = pd.DataFrame({n: [None] * len(batch) for n in names}), None
            for attempt in range(attempts):
                try:
                    made, error = step(batch)[names].reset_index(drop=True), None
                    break
                except Exception as e:  # noqa: BLE001  whatever an outside step raises becomes data
                    error = f"{type(e).__name__}: {e}"
                    if attempt + 1 < attempts:
                        time.sleep(wait * 2**attempt)
            yield pd.concat([batch.reset_index(drop=True), made, pd.DataFrame({"step_error": [error] * len(batch)})], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, {schema}, step_error string")


class ContextExceeded(Exception):
    """Raised by a generator whose model has too little room: tokens of the prompt, and of the whole context."""

    def __init__(self, prompt_tokens: int, context: int):
        super().__init__(f"prompt of {prompt_tokens} tokens in a context of {context}")
        self.prompt_tokens, self.context = prompt_tokens, context


def ask_again(ask: Callable[[str, int, float], dict], prompt: str, max_tokens: int, timeout: float, attempts: int = 3, wait: float = 1.0) -> dict:
    """What ``ask(prompt, max_tokens, timeout)`` gives, after up to ``attempts`` tries.

    Where the context is too small, the answer's room shrinks to what the prompt leaves, at once; a prompt that leaves none fails.
    After a TimeoutError the time grows by half; after other errors the wait doubles. The last error is raised."""
    for attempt in range(attempts):
        try:
            return ask(prompt, max_tokens, timeout)
        except ContextExceeded as e:
            if e.context <= e.prompt_tokens or attempt + 1 == attempts:
                raise
            max_tokens = e.context - e.prompt_tokens
        except TimeoutError:
            if attempt + 1 == attempts:
                raise
            timeout = int(timeout * 1.5)
            time.sleep(2 * wait)
        except Exception:
            if attempt + 1 == attempts:
                raise
            time.sleep(wait * 2**attempt)
    raise ValueError("at least one attempt")


def generated(df: DataFrame, ask: Callable[[str, int, float], dict], prompt: str, schema: str, max_tokens: int, timeout: float = 120.0, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """``df`` with the fields of ``schema`` that ``ask`` answers to each prompt, and ``error``: a prompt that fails leaves the others alone.

    A null prompt is not asked and has the error ``no prompt``."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            rows = []
            for p in batch[prompt]:
                if not isinstance(p, str):
                    rows.append(dict.fromkeys(names) | {"error": "no prompt"})
                    continue
                try:
                    answer = ask_again(ask, p, max_tokens, timeout, attempts, wait)
                    rows.append({n: answer.get(n) for n in names} | {"error": None})
                except Exception as e:  # noqa: BLE001  whatever an outside generator raises becomes data
                    rows.append(dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"})
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=[*names, "error"])], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, {schema}, error string")


def rerun(samples: DataFrame, broken: DataFrame, keys: list[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str, attempts: int = 1, wait: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Samples whose keys are in ``broken``, with the columns of ``schema`` made anew, and those that failed again, with ``step_error``.

    Only the broken rows go through the step, once: they are stored. The first table is meant for ``sinks.replace_rows`` over the
    samples; keys that no sample has are passed over."""
    columns = samples.columns
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    chosen = samples.join(broken.select(*keys).distinct(), keys, "left_semi").drop(*(n for n in names if n not in keys))
    made = stored(with_step(chosen, step, schema, attempts, wait))
    return made.filter("step_error is null").select(*columns, *(n for n in names if n not in columns)), made.filter("step_error is not null")


def resume(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are not done yet."""
    return df.join(done.select(*keys), keys, "left_anti")
