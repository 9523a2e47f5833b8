"""The answers of a review model in a durable store: asked chunk by chunk, each chunk committed before the next."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.functions.storage import Folder, Scratch

#: Prompts of a chunk; a lost run loses the chunk it was asking.
CHUNK = 500
_ANSWERS = "key string, answer string"


def prompt_key(prompt: str = "prompt") -> Column:
    """A prompt's name in the store: its SHA-256."""
    return F.sha2(F.col(prompt), 256)


class SettingsError(ValueError):
    """The store holds answers that were made with other settings."""


class AnswerStore:
    """Answers to prompts in one folder, made by one model with one set of settings.

    ``settings`` (a dictionary, or text) is written when the store is made; opening it with others is refused, as its
    answers would be mixed. Answers lie in ``chunk=<name>`` as Parquet. A chunk counts once ``_manifest/<name>.json``
    exists, which is written after its data; what a lost run left without an entry is not read, and ``sweep`` removes
    it. A store can be filled by several runs, one after another or at once; where two of them answered one prompt,
    the answer of the chunk whose name sorts first counts, for all readers alike.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict | str = "") -> None:
        self.spark, self.folder = spark, Folder(spark, path)
        self.settings = settings if isinstance(settings, str) else json.dumps(settings, sort_keys=True)
        if not self.folder.exists("_settings.json"):
            self.folder.write("_settings.json", json.dumps({"settings": self.settings}))
        found = json.loads(self.folder.text("_settings.json"))["settings"]
        if found != self.settings:
            raise SettingsError(f"{path} holds answers of other settings: {found}, not {self.settings}")

    def _path(self, name: str) -> str:
        return f"{self.folder.path}/chunk={name}"

    def chunks(self) -> list[str]:
        """Names of the committed chunks."""
        return [x.removesuffix(".json") for x in self.folder.names("_manifest") if x.endswith(".json")]

    def manifest(self) -> DataFrame:
        """(name, run, chunk, n_answers) of the committed chunks."""
        entries = [json.loads(self.folder.text(f"_manifest/{x}.json")) for x in self.chunks()]
        return self.spark.createDataFrame([(e["name"], e["run"], e["chunk"], e["n_answers"]) for e in entries], "name string, run string, chunk long, n_answers long")

    def answers(self) -> DataFrame:
        """(key, answer), one row a prompt."""
        names = self.chunks()
        if not names:
            return self.spark.createDataFrame([], _ANSWERS)
        rows = self.spark.read.schema(_ANSWERS).parquet(*map(self._path, names))
        return rows.groupBy("key").agg(F.min_by("answer", F.struct(F.col("_metadata.file_path"), "answer")).alias("answer"))

    def missing(self, prompts: DataFrame) -> DataFrame:
        """(key, prompt): the distinct prompts without an answer here. Null prompts aren't asked."""
        todo = prompts.filter("prompt IS NOT NULL").groupBy(prompt_key().alias("key")).agg(F.first("prompt").alias("prompt"))
        return todo.join(self.answers().select("key"), "key", "left_anti") if self.chunks() else todo

    def fill(self, prompts: DataFrame, model: Callable[[list[str]], list[str]], chunk: int = CHUNK, tasks: int = 1) -> int:
        """Ask what is missing, about ``chunk`` prompts after another, and return how many were asked.

        ``prompts`` needs a column ``prompt``. The missing ones are dealt once into folders by the hash of their keys,
        so each chunk's job reads its own rows; ``tasks`` tasks ask a chunk, it is written as a whole, then the
        manifest names it. Only chunk numbers pass through the driver. If a task fails for good the error is raised,
        and a later call asks what isn't committed.
        """
        run = uuid.uuid4().hex
        scratch = Scratch(self.spark, "prompts")
        try:
            todo = scratch.keep(self.missing(prompts), "missing")
            n = todo.count()
            if not n:
                return 0
            dealt = Folder(self.spark, f"{scratch.folder.path}/dealt")
            number = F.pmod(F.xxhash64("key"), F.lit(-(-n // chunk)))
            todo.withColumn("chunk", number).repartition("chunk").write.partitionBy("chunk").parquet(dealt.path)
            for k in sorted(int(x[6:]) for x in dealt.names() if x.startswith("chunk=")):
                self._ask(self.spark.read.schema("key string, prompt string").parquet(f"{dealt.path}/chunk={k}"), model, run, k, tasks)
            return n
        finally:
            scratch.folder.delete()

    def _ask(self, rows: DataFrame, model: Callable[[list[str]], list[str]], run: str, number: int, tasks: int) -> None:
        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = model(b["prompt"].tolist())
                if len(found) != len(b):
                    raise ValueError(f"{len(b)} prompts got {len(found)} answers")
                yield pd.DataFrame({"key": b["key"], "answer": found})

        name = f"{run}-{number:09d}"
        rows.repartition(tasks, "key").mapInPandas(ask, _ANSWERS).write.parquet(self._path(name))
        self._commit(name, run, number)

    def _commit(self, name: str, run: str, number: int) -> None:
        count = self.spark.read.schema(_ANSWERS).parquet(self._path(name)).count()
        self.folder.write(f"_manifest/{name}.json", json.dumps({"name": name, "run": run, "chunk": number, "n_answers": count}))

    def sweep(self) -> list[str]:
        """Remove what lost runs wrote without committing; not while another run fills the store."""
        left = sorted({x.removeprefix("chunk=") for x in self.folder.names() if x.startswith("chunk=")} - {*self.chunks()})
        for name in left:
            self.folder.delete(f"chunk={name}")
        return left

    def compact(self) -> None:
        """One chunk in place of all; a reader sees the old ones, both or the new one, with the same answers. Not while another run fills the store."""
        old = self.chunks()
        if len(old) < 2:
            return
        name = f"0-{uuid.uuid4().hex}"
        self.answers().write.parquet(self._path(name))
        self._commit(name, "compact", 0)
        for x in old:
            self.folder.delete(f"_manifest/{x}.json")
        for x in old:
            self.folder.delete(f"chunk={x}")

    def attach(self, asked: DataFrame) -> DataFrame:
        """``asked`` with ``answer``; null where the store has none."""
        return asked.withColumn("_key", prompt_key()).join(self.answers().withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
