"""Mapping tasks through a remote model, with bounded concurrency, retries and no task lost.

Each partition runs its own event loop; at most ``concurrency`` calls are open in it, so partitions times concurrency
bounds all calls. A task that fails comes back marked, never as an error. Calls have side effects and cost: results are
written by task id, and a task that has one isn't sent again when a job is repeated.
"""

from __future__ import annotations

import asyncio
import json
import os
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.replies import FAILED

CONCURRENCY, ATTEMPTS, BACKOFF, TIMEOUT = 10, 5, 2.0, 300.0


class Transient(Exception):
    """A failure after which a call is worth repeating."""


class Provider(Protocol):
    """A model: made once for each partition, then called."""

    async def complete(self, prompt: str, task_id: str) -> tuple[str | None, str | None]:
        """The reply and a log entry (JSON), either of which may be missing."""
        ...


_PAYLOAD = re.compile(r"INPUT:\n(.*)\Z", re.DOTALL)


def payload_of(prompt: str) -> str:
    m = _PAYLOAD.search(prompt)
    return m[1] if m else prompt


class Identity:
    """Returns the payload (offline)."""

    async def complete(self, prompt: str, task_id: str) -> tuple[str | None, str | None]:
        return payload_of(prompt), json.dumps({"task_id": task_id, "chars": len(prompt)})


class Substituting:
    """Returns the payload with the terms of a glossary replaced (offline)."""

    def __init__(self, glossary: dict[str, str]) -> None:
        self.glossary = glossary

    async def complete(self, prompt: str, task_id: str) -> tuple[str | None, str | None]:
        text = payload_of(prompt)
        for a, b in self.glossary.items():
            text = text.replace(a, b)
        return text, json.dumps({"task_id": task_id})


class Faulty:
    """Returns what models return on bad days, by the digits of the task id (offline, the same each time)."""

    KINDS = ("good", "empty", "cut", "repeated", "doubled_key", "failing")

    async def complete(self, prompt: str, task_id: str) -> tuple[str | None, str | None]:
        kind = self.KINDS[sum(map(ord, task_id)) % len(self.KINDS)]
        text = payload_of(prompt)
        if kind == "failing":
            raise Transient(task_id)
        if kind == "empty":
            text = ""
        elif kind == "cut":
            text = text[: len(text) * 2 // 3]
        elif kind == "repeated":
            text = re.sub(r'"text": "[^"]*"', '"text": "aaaaaaaaaaaa"', text)
        elif kind == "doubled_key":
            text = text.replace('"id": ', '"id": "id": ', 1)
        return text, json.dumps({"task_id": task_id, "kind": kind})


class Http:
    """A model behind an HTTP endpoint that takes and gives JSON.

    ``body`` is the request, in which the string ``{prompt}`` stands for the prompt; ``answer`` are the steps to the text in the
    reply, as in ``choices/0/message/content``. The key is read from the environment variable ``key_variable`` of the executor and
    sent as a bearer token. A busy or broken server, and no connection, are worth repeating; other errors aren't.
    """

    def __init__(self, url: str, body: dict[str, object], answer: str, key_variable: str | None = None, timeout: float = TIMEOUT) -> None:
        self.url, self.body, self.answer, self.timeout = url, body, answer.split("/"), timeout
        self.key = os.environ.get(key_variable, "") if key_variable else ""
        if key_variable and not self.key:
            raise ValueError(f"the environment variable {key_variable} holds no key")

    def _filled(self, value: object, prompt: str) -> object:
        if isinstance(value, dict):
            return {k: self._filled(v, prompt) for k, v in value.items()}
        if isinstance(value, list):
            return [self._filled(v, prompt) for v in value]
        return prompt if value == "{prompt}" else value

    def _send(self, prompt: str) -> str:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, json.dumps(self._filled(self.body, prompt)).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:  # noqa: S310
                return reply.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise Transient(f"status {e.code}") from e
            raise
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise Transient(repr(e)) from e

    async def complete(self, prompt: str, task_id: str) -> tuple[str | None, str | None]:
        text = await asyncio.to_thread(self._send, prompt)
        at: object = json.loads(text)
        for step in self.answer:
            at = at[int(step)] if isinstance(at, list) else at.get(step) if isinstance(at, dict) else None
            if at is None:
                break
        return (at if isinstance(at, str) else None), json.dumps({"task_id": task_id, "reply": text})


PROVIDERS: dict[str, Callable[..., Provider]] = {"identity": Identity, "substituting": Substituting, "faulty": Faulty, "http": Http}


def register_provider(name: str, make: Callable[..., Provider]) -> None:
    PROVIDERS[name] = make


def provider(name: str, **options: object) -> Callable[[], Provider]:
    """How to make a provider on an executor; an unknown name is an error."""
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name!r}; there are {sorted(PROVIDERS)}")
    make = PROVIDERS[name]
    return lambda: make(**options)


async def _call(model: Provider, gate: asyncio.Semaphore, prompt: str | None, task_id: str, attempts: int, backoff: float, timeout: float) -> tuple[str, str | None]:
    if prompt is None:
        return f"{FAILED} no prompt for task {task_id}", None
    async with gate:
        for n in range(attempts):
            try:
                text, log = await asyncio.wait_for(model.complete(prompt, task_id), timeout)
                return (text, log) if text is not None else (f"{FAILED} no answer for task {task_id}", log)
            except (Transient, TimeoutError) as e:
                why = repr(e)
                if n + 1 < attempts:
                    await asyncio.sleep(backoff * 2**n)
            except Exception as e:  # noqa: BLE001
                why = repr(e)
                break
    return f"{FAILED} task {task_id}", json.dumps({"task_id": task_id, "error": why})


_SCHEMA = "task_id string, translated_text string, log string"


def map_remote(tasks: DataFrame, make: Callable[[], Provider], task_id: str = "task_id", prompt: str = "prompt", concurrency: int = CONCURRENCY, attempts: int = ATTEMPTS, backoff: float = BACKOFF, timeout: float = TIMEOUT, partitions: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``task_id, translated_text, log`` for each task, in :data:`_SCHEMA`; a failed one's text begins with the mark.

    The columns ``keep`` of a task come along with its result. ``partitions`` bounds how many loops run at once, and with ``concurrency`` how many calls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Provider | None = None
        for b in batches:
            model = model or make()

            async def all_of(ids: list[str], prompts: list[str | None]) -> list[tuple[str, str | None]]:
                gate = asyncio.Semaphore(concurrency)
                return await asyncio.gather(*[_call(model, gate, p, i, attempts, backoff, timeout) for i, p in zip(ids, prompts, strict=True)])

            done = asyncio.run(all_of(list(b["i"]), list(b["p"])))
            yield pd.DataFrame({"task_id": b["i"], "translated_text": [t for t, _ in done], "log": [x for _, x in done], **{k: b[k] for k in keep}})

    own = tasks.where(F.col(task_id).isNotNull()).select(F.col(task_id).alias("i"), F.col(prompt).alias("p"), *keep)
    schema = ", ".join([_SCHEMA, *[f"`{k}` {tasks.schema[k].dataType.simpleString()}" for k in keep]])
    return (own.repartition(partitions) if partitions else own).mapInPandas(run, schema)


def map_once(tasks: DataFrame, make: Callable[[], Provider], results_path: str, task_id: str = "task_id", **options: object) -> DataFrame:
    """Results of all ``tasks``: those already at ``results_path``, and the others, which are sent and appended there.

    Failed tasks are kept too; leave them out of the table to send them again.
    """
    spark = tasks.sparkSession
    try:
        there = spark.read.parquet(results_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # results may be there but not readable; sending all again would pay for them twice
        missing = tasks
    else:
        missing = tasks.join(there.select(F.col("task_id").alias(task_id)).distinct(), task_id, "left_anti")
    map_remote(missing, make, task_id=task_id, **options).write.mode("append").parquet(results_path)
    done = spark.read.parquet(results_path)
    return done.join(tasks.select(F.col(task_id).alias("task_id")), "task_id", "left_semi")
