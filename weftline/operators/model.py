"""Lineage by a model: prompts go to a backend that runs once a partition, answers are parsed by expressions.

A backend is a function that makes a client in the worker: make() -> (prompt -> answer). Its concurrency is the
number of partitions. Without one the offline stub answers by patterns, so that programs run anywhere.
"""

from __future__ import annotations

import json
import queue
import re
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.responses import build_messages, parse_response
from weftline.functions.sqltext import PLAIN, QUOTED

Client = Callable[[str], str]
Backend = Callable[[], Client]

SYSTEM = "You read SQL and name the table it writes and the tables it reads."
PROMPT = 'Answer with JSON alone: {"sources": ["schema.table"], "target": "schema.table"}.'


def stub_backend(prefix: str = "") -> Backend:
    """A client that needs no network: it answers with the tables that patterns find in the prompt's SQL."""

    def make() -> Client:
        name = re.compile(rf"\b({re.escape(prefix)}\w*[.](?:{QUOTED}|{PLAIN}))", re.I)

        def answer(prompt: str) -> str:
            sql = prompt.rpartition("```sql")[2]
            found = list(dict.fromkeys(m.replace('"', "").lower() for m in name.findall(sql)))
            if not found:
                raise ValueError("no table in the prompt")
            return json.dumps({"target": found[0], "sources": sorted(found[1:])})

        return answer

    return make


def http_backend(url: str, model: str, token: str | None = None, max_new_tokens: int = 2048, do_sample: bool = False, temperature: float = 0.1, timeout: float = 120.0) -> Backend:
    """A client of a chat-completion service over HTTP, the common JSON form: messages in, choices out.

    token goes into the Authorization header (see sources.files.access_token). timeout bounds each wait for the
    service. Without do_sample the answer is the likeliest one: temperature 0.
    """

    def make() -> Client:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})

        def answer(prompt: str) -> str:
            asked = {"model": model, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_new_tokens, "temperature": temperature if do_sample else 0.0}
            request = urllib.request.Request(url, json.dumps(asked).encode(), headers)
            with urllib.request.urlopen(request, timeout=timeout) as said:
                return json.load(said)["choices"][0]["message"]["content"]

        return answer

    return make


def bounded(client: Client, seconds: float | None) -> Client:
    """The client, given up after so many seconds a call: a call that hangs is left to a thread that ends with the worker."""
    if seconds is None:
        return client

    def answer(prompt: str) -> str:
        out: queue.Queue = queue.Queue(1)

        def call() -> None:
            try:
                out.put((client(prompt), None))
            except Exception as e:  # handed on to the caller
                out.put((None, e))

        threading.Thread(target=call, daemon=True).start()
        try:
            said, why = out.get(timeout=seconds)
        except queue.Empty:
            raise TimeoutError(f"no answer within {seconds:g} s") from None
        if why is not None:
            raise why
        return said

    return answer


def respond(
    prompts: DataFrame, backend: Backend, max_retries: int = 5, wait: Callable[[int], float] = lambda k: min(30, 2**k), last_wait: bool = True, good: Callable[[str], bool] | None = None,
    sleep: Callable[[float], None] = time.sleep, timeout: float | None = None, delay: float = 0.0,
) -> DataFrame:
    """prompts (with a column prompt) with response, error and processing_time.

    One client a partition. A call that raises, takes longer than timeout seconds, or whose answer isn't good, is
    tried again after wait(tries before). delay: seconds between the prompts of a partition, so that the rate is at
    most partitions / delay. A null prompt is not sent; its error says so.
    """
    names = prompts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", response string, error string, processing_time double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, sent = bounded(backend(), timeout), 0
        for batch in batches:
            out: list[tuple[str | None, str | None, float]] = []
            for prompt in batch["prompt"]:
                if delay and sent and isinstance(prompt, str):
                    sleep(delay)
                sent += isinstance(prompt, str)
                began, said, why = time.time(), None, "no prompt"
                for k in range(max_retries if isinstance(prompt, str) else 0):
                    try:
                        said = client(prompt)
                        if good is None or good(said):
                            why = None
                            break
                        why = "Max retries exceeded"
                    except Exception as e:  # the backend's failures are results
                        why = f"Max retries exceeded: {e}"
                    if k < max_retries - 1 or last_wait:
                        sleep(wait(k))
                out.append((said if why is None else None, why, time.time() - began))
            batch["response"], batch["error"], batch["processing_time"] = zip(*out) if out else ([], [], [])
            yield batch[[*names, "response", "error", "processing_time"]]

    return prompts.mapInPandas(run, schema)


_NAMED = re.compile(r"""target["']?\s*:\s*["']?[^"',\s}\]]""", re.I)


def _has_target(answer: str) -> bool:
    return bool(_NAMED.search(answer))


@dataclass
class LineageExtractor:
    """Configuration of extraction by a model."""

    backend: Backend
    model: str = "stub"
    provider: str = "offline"
    max_retries: int = 5
    prompt: str = PROMPT
    system: str = SYSTEM
    wait: Callable[[int], float] = lambda k: min(30, 2**k)
    last_wait: bool = True
    timeout: float | None = None
    delay: float = 0.0

    def extract(self, df: DataFrame, sql: str = "sql") -> DataFrame:
        """df with target, sources, error and query (the first 100 characters, where it failed).

        Asked once: the answers are written before they are parsed. A failed statement has an empty target and no sources.
        """
        from weftline.sources.shared import stored

        human = build_messages(F.col(sql), self.system, self.prompt)
        prompts = df.withColumn("prompt", F.array_join(F.transform(human, lambda m: m["content"]), "\n\n"))
        answers = stored(respond(prompts, self.backend, self.max_retries, self.wait, self.last_wait, _has_target, timeout=self.timeout, delay=self.delay), "answers")
        parsed = answers.withColumn("_l", parse_response(F.col("response")))
        none = F.array().cast("array<string>")
        return parsed.select(
            *(f"`{c}`" for c in df.columns), F.coalesce("_l.target", F.lit("")).alias("target"), F.coalesce("_l.sources", none).alias("sources"), "error",
            F.when(F.col("error").isNotNull(), F.substring(sql, 1, 100)).alias("query"),
        )

    def config(self) -> dict:
        return {k: getattr(self, k) for k in ("model", "provider", "prompt", "system", "max_retries")}

    def works(self, spark, sql: str = "INSERT INTO a.b SELECT 1 FROM c.d") -> bool:
        """Whether one statement comes back without an error."""
        row = self.extract(spark.createDataFrame([(sql,)], "sql string")).first()
        return row["error"] is None


def create_extractor(model: str = "stub", provider: str = "offline", backend: Backend | None = None, **options) -> LineageExtractor:
    return LineageExtractor(backend or stub_backend(), model, provider, **options)
