"""Answers of a language model as a table: the Python data source ``model_calls``, one row for each batch of a kind.

The planner tiles each kind's total into batches, leaves out those that are done, and deals the rest out to partitions. A task makes its
client once, asks it for each of its batches, tries again on an error, and gives a null answer when the tries are used up, so that one bad
batch does not fail the others. A lost task asks again with the same request keys.

Options: ``totals`` (JSON, kind to number of samples), ``size`` of a batch, ``done`` (JSON, kind to list of [first, last] batches), ``prompts``
(``module:function`` of a kind and a number), ``client`` (``module:factory``; the factory gives a function of a prompt and a request key),
``tries``, ``first_try`` (the number of tries of earlier runs), ``partitions`` at most.
"""

from __future__ import annotations

import hashlib
import importlib
import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

SCHEMA = "kind string, batch long, n int, tries int, raw string"
SIZE, TRIES, PARTITIONS = 30, 3, 64

_clients: dict[str, Callable[[str, str], str]] = {}


def named(path: str):
    """What ``module:name`` stands for."""
    module, name = path.split(":")
    return getattr(importlib.import_module(module), name)


def client_of(path: str) -> Callable[[str, str], str]:
    """The client of a factory, made once in a worker."""
    if path not in _clients:
        _clients[path] = named(path)()
    return _clients[path]


def tiles(totals: dict[str, int], size: int, done: dict[str, list[list[int]]]) -> Iterator[tuple[str, int, int]]:
    """(kind, batch, n) of the batches to ask for: those of a kind add up to its total, the last may be short, and done ranges are left out."""
    for kind, total in totals.items():
        batch, end = 0, -(-total // size)
        for first, last in [*sorted(done.get(kind, [])), [end, end]]:
            for k in range(batch, min(first, end)):
                yield kind, k, min(size, total - k * size)
            batch = max(batch, last + 1)


class Share(InputPartition):
    """The batches of one task."""

    def __init__(self, batches: list[tuple[str, int, int]]):
        self.batches = batches


class _Settings(NamedTuple):
    totals: dict
    size: int
    done: dict
    prompts: str
    client: str
    tries: int
    first_try: int
    partitions: int


class ModelCallsReader(DataSourceReader):
    def __init__(self, settings: _Settings):
        self.settings = settings

    def partitions(self) -> list[Share]:
        s = self.settings
        left = list(tiles(s.totals, s.size, s.done))
        share = max(1, -(-len(left) // s.partitions))
        return [Share(left[k : k + share]) for k in range(0, len(left), share)] or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        s = self.settings
        prompt, ask = named(s.prompts), client_of(s.client)
        for kind, batch, n in partition.batches:
            raw, text = None, prompt(kind, n)
            for k in range(s.first_try, s.first_try + s.tries):
                try:
                    raw = ask(text, f"{kind}:{batch}:{k}")
                    break
                except Exception:  # noqa: BLE001, S112  what a client raises is its own; the batch stays unanswered
                    continue
            yield kind, batch, n, k + 1, raw


class ModelCalls(DataSource):
    @classmethod
    def name(cls) -> str:
        return "model_calls"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ModelCallsReader:
        o = self.options
        number = lambda name, other: int(o.get(name, other))
        return ModelCallsReader(_Settings(json.loads(o["totals"]), number("size", SIZE), json.loads(o.get("done", "{}")), o["prompts"], o["client"], number("tries", TRIES), number("first_try", 0), number("partitions", PARTITIONS)))


def read_answers(spark: SparkSession, totals: dict[str, int], prompts: str, client: str, done: dict[str, list[list[int]]] | None = None, **options: int) -> DataFrame:
    """(kind, batch, n, tries, raw) for each batch that is not done."""
    spark.dataSource.register(ModelCalls)
    reader = spark.read.format("model_calls").option("totals", json.dumps(totals)).option("done", json.dumps(done or {})).option("prompts", prompts).option("client", client)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()


def done_ranges(done: DataFrame) -> dict[str, list[list[int]]]:
    """Runs of the batches of each kind (kind, batch), repeated ones counted once: as many rows as there are gaps come to the driver."""
    numbered = done.select("kind", "batch").distinct().withColumn("run", F.col("batch") - F.row_number().over(Window.partitionBy("kind", F.floor(F.col("batch") / 1_000_000)).orderBy("batch")))
    runs = numbered.groupBy("kind", "run", F.floor(F.col("batch") / 1_000_000)).agg(F.min("batch").alias("first"), F.max("batch").alias("last"))
    out: dict[str, list[list[int]]] = {}
    for r in runs.orderBy("kind", "first").collect():
        out.setdefault(r.kind, []).append([r.first, r.last])
    return out


# an offline model, so that all of this runs without a network


def draw(key: str, slot: str) -> int:
    """The draw of functions.rng.u32 outside Spark."""
    return int(hashlib.md5(f"{key}:{slot}:42".encode()).hexdigest()[:8], 16)  # noqa: S324


#: What the offline model may say, by kind; without the placeholder a sentence is no use.
SENTENCES = {
    "IN_AADHAAR": ["My aadhaar is {{AADHAAR}}, please link it", "UID {{AADHAAR}} de diya hai", "They typed {{AADHAAR}} at the counter", "आधार {{AADHAAR}} है", "I forgot my number"],
    "IN_PAN": ["PAN {{PAN}} for the return", "Income tax wants {{PAN}}", "Send {{PAN}} to the bank", "The form was empty"],
    "EMAIL_ADDRESS": ["Mail me at {{EMAIL}}", "Reach {{EMAIL}} for details", "{{EMAIL}} or again {{EMAIL}}", "No address was given"],
    "PHONE_NUMBER": ["Call {{PHONE}} after six", "My whatsapp is {{PHONE}}", "Try {{PHONE}}", "The line was dead"],
    "US_SSN": ["SSN {{SSN}} is on the W-2", "Social security {{SSN}}", "It says {{SSN}} here", "The field was blank"],
    "CREDIT_CARD": ["Card {{CARD}} was charged", "Pay with {{CARD}}", "visa {{CARD}} expires soon", "Cash only today"],
    "PERSON": ["Mr {{NAME}} is on leave", "Ask {{NAME}} about it", "The customer {{NAME}} called", "Nobody answered"],
    "NEGATIVE": ["The meeting is at noon", "Order #9876 has shipped", "Part X-200 is back in stock", "Version two is ready"],
}


class OfflineModel:
    """Answers from the request key alone: of ten tries one fails; an answer is a JSON array by itself, fenced, within prose, or cut off."""

    def __call__(self, prompt: str, key: str) -> str:
        if draw(key, "fails") % 10 == 0:
            raise TimeoutError(key)
        kind, batch, _ = key.split(":")
        n = int(prompt.split()[1])
        said = [SENTENCES[kind][draw(f"{kind}:{batch}:{k}", "says") % len(SENTENCES[kind])] for k in range(n)]
        text = json.dumps(said, ensure_ascii=False)
        return (text, f"```json\n{text}\n```", f"Here they are:\n{text}\nDone.", text[:-1])[draw(f"{kind}:{batch}", "shape") % 4]
