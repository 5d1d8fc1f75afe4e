"""Relations out of documents by a model: prompts, backends, and one client per partition."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr


class Backend(Protocol):
    """A model that answers a prompt with text."""

    name: str

    def complete(self, system: str, user: str) -> str: ...


class Canned:
    """A backend that needs no model: the answer of the first key that the prompt holds, else no relation."""

    name = "canned"

    def __init__(self, answers: dict[str, object]) -> None:
        self.answers = answers

    def complete(self, system: str, user: str) -> str:
        found = next((a for key, a in self.answers.items() if key in user), [])
        return found if isinstance(found, str) else json.dumps({"relations": found}, ensure_ascii=False)


class Repairing:
    """A backend that asks again, at most ``rounds`` times, where an answer is no JSON."""

    def __init__(self, inner: Backend, rounds: int = 2) -> None:
        self.inner, self.rounds, self.name = inner, rounds, inner.name

    def complete(self, system: str, user: str) -> str:
        answer = self.inner.complete(system, user)
        for _ in range(self.rounds):
            if is_json(answer):
                break
            answer = self.inner.complete(system, f"{user}\n\n{answer}\n\nThis is no valid JSON. Answer with the JSON alone.")
        return answer


def is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def prompt(label: Column, text: Column, known: Column) -> Column:
    """What a model is asked about one chunk; ``known``: names that it should reuse."""
    return F.concat_ws("\n\n", F.concat(F.lit("# "), label), F.concat(F.lit("Known names: "), known), text)


def known_names(gazetteer: DataFrame) -> DataFrame:
    """One row (known): the labels of a gazetteer (type, rank, label) by type and rank. A gazetteer has some hundred rows."""
    rows = F.array_sort(F.collect_list(F.struct("type", "rank", "label")))
    return gazetteer.agg(F.array_join(F.transform(rows, lambda r: F.concat(r["label"], F.lit(" ("), r["type"], F.lit(")"))), ", ").alias("known"))


def extract(chunks: DataFrame, gazetteer: DataFrame, system: str, make: Callable[[], Backend], partitions: int | None = None) -> DataFrame:
    """``node_id, chunk, text`` and the fields of the relations that the model finds in chunks (node_id, label, chunk, text).

    ``make`` builds a client, once in every partition. A chunk whose call raises RuntimeError, or whose answer holds no relation, gives
    no row. ``partitions`` sets how many clients work side by side.
    """
    asked = chunks.join(F.broadcast(known_names(gazetteer)), how="cross").select("node_id", "chunk", "text", prompt(F.col("label"), F.col("text"), F.col("known")).alias("prompt"))
    if partitions:
        asked = asked.repartition(partitions, "node_id", "chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for b in batches:
            answers = []
            for user in b["prompt"]:
                client = client or make()
                try:
                    answers.append(client.complete(system, user))
                except RuntimeError:
                    answers.append(None)
            yield b[["node_id", "chunk", "text"]].assign(answer=answers)

    answered = asked.mapInPandas(run, "node_id string, chunk int, text string, answer string")
    return answered.withColumn("r", F.explode(expr.relations_json(F.col("answer")))).select("node_id", "chunk", "text", "r.*")
