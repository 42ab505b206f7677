"""Model calls over DataFrames: clients are plain objects that go to the workers; answers are kept before they are read."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
import warnings
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields, is_dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import scratch
from ..sources.snapshots import Snapshots

#: Defaults: fixed values.
SYSTEM, TEMPERATURE, MOST_TOKENS, TIMEOUT = "You are a helpful assistant.", 0.7, -1, 2000


@dataclass(repr=False)
class Generator:
    """A model behind a function from prompt to answer."""

    system: str = SYSTEM
    temperature: float = TEMPERATURE
    max_tokens: int = MOST_TOKENS
    model: str = "local-model"

    def generate(self, prompt: str) -> str:
        raise NotImplementedError

    def __call__(self, prompt: str) -> str:
        return self.generate(prompt)

    @classmethod
    def label(cls) -> str:
        """The name that the generator is registered under."""
        return next((name for name, kind in GENERATORS.items() if kind is cls), cls.__name__)

    def __repr__(self) -> str:
        return f"<Generator:{self.label()}>"


@dataclass(repr=False)
class Stub(Generator):
    """Answers by a function, for tests and dry runs."""

    answer: Callable[[str], str] = lambda prompt: prompt

    def generate(self, prompt: str) -> str:
        return self.answer(prompt)


def _post(url: str, payload: dict, headers: dict[str, str]) -> str:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as reply:
            if reply.status != 200:
                raise ValueError(f"the model server answered {reply.status}")
            body = json.loads(reply.read())
    except urllib.error.URLError as failed:
        raise ConnectionError(f"the model server can't be reached: {failed}") from failed
    if not body.get("choices"):
        raise ValueError("the answer holds no choices")
    return body["choices"][0]["message"]["content"]


@dataclass(repr=False)
class LocalServer(Generator):
    """Chat completions of a server that speaks the common protocol; max_tokens is always sent."""

    base_url: str = "http://localhost:1234/v1"

    def generate(self, prompt: str) -> str:
        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
        payload = {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens, "stream": False}
        return _post(self.base_url.rstrip("/") + "/chat/completions", payload, {})


@dataclass(repr=False)
class HostedServer(Generator):
    """A hosted endpoint with a bearer token, taken from the environment unless given; max_tokens is sent if positive.

    Without a model of its own it asks for ``default_model``; without a token it warns, as calls may fail.
    """

    model: str = ""
    base_url: str = ""
    token: str | None = None
    token_variable: str = "MODEL_TOKEN"
    default_model: str = "default"

    def __post_init__(self) -> None:
        if not (self.token or os.environ.get(self.token_variable)):
            warnings.warn(f"no token is given and {self.token_variable} is not set; calls may fail", stacklevel=2)

    def generate(self, prompt: str) -> str:
        token = self.token or os.environ.get(self.token_variable, "")
        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": [{"type": "text", "text": prompt}]}]
        payload = {"model": self.model or self.default_model, "messages": messages, "temperature": self.temperature} | ({"max_tokens": self.max_tokens} if self.max_tokens > 0 else {})
        return _post(self.base_url.rstrip("/") + "/chat/completions", payload, {"Authorization": f"Bearer {token}"})


GENERATORS: dict[str, type[Generator]] = {"stub": Stub, "local": LocalServer, "hosted": HostedServer}


def get_generator(label: str, **how) -> Generator:
    if label not in GENERATORS:
        raise ValueError(f"no generator {label!r}; there are {sorted(GENERATORS)}")
    return GENERATORS[label](**how)


def ask(prompts: DataFrame, generator: Callable[[str], str], prompt: str = "prompt", *keys: str) -> DataFrame:
    """(keys, raw, error) for every prompt. A call that fails gives its message and drops no other row."""
    schema = ", ".join([*(f"`{k}` {prompts.schema[k].dataType.simpleString()}" for k in keys), "raw string", "error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw, error = [], []
            for p in batch[prompt]:
                try:
                    raw.append(generator(p))
                    error.append(None)
                except Exception as failed:
                    raw.append(None)
                    error.append(f"{type(failed).__name__}: {failed}")
            yield batch[list(keys)].assign(raw=raw, error=error)

    return prompts.select(*keys, prompt).mapInPandas(run, schema)


#: Calls at a time in a task, tries of a call, seconds before the second; each later one waits twice as long.
AT_ONCE, TRIES, PAUSE = 8, 3, 1.0


def settings(generator: Callable[[str], str]) -> str:
    """What answers depend on but for the prompt: the kind of generator and its fields, but no token. Plain functions go by name."""
    if not is_dataclass(generator):
        return f"{getattr(generator, '__module__', '')}.{getattr(generator, '__qualname__', type(generator).__qualname__)}"
    own = {f.name: getattr(generator, f.name) for f in fields(generator) if f.name != "token"}
    return json.dumps([type(generator).__qualname__, {k: settings(v) if callable(v) else v for k, v in own.items()}], sort_keys=True, default=str)


class Answers:
    """Answers that are kept in a folder by prompt, model and settings, so that nothing is asked twice.

    Only what is not known is asked, each prompt once however many rows have it, several at a time within a task; a call
    that fails is tried again after a pause that doubles. Calls that fail to the end are not kept: a later run asks again.
    """

    def __init__(self, spark: SparkSession, path: str, at_once: int = AT_ONCE, tries: int = TRIES, pause: float = PAUSE):
        self.store = Snapshots(spark, path, "answer_key string, raw string", "answer_key")
        self.at_once, self.tries, self.pause = at_once, tries, pause

    def ask(self, prompts: DataFrame, generator: Callable[[str], str], prompt: str = "prompt", *keys: str) -> DataFrame:
        """(keys, raw, error) for every prompt, as ``ask`` gives them; a null prompt is asked like any other."""
        with_ = F.lit(settings(generator))
        key = F.sha2(F.concat_ws("\x00", with_, F.col(prompt).isNull().cast("string"), F.col(prompt)), 256).alias("answer_key")
        rows = scratch.written(prompts.select(*keys, prompt, key), "answer-rows")
        known = self.store.read(buckets=self.store._touched(rows)).join(rows.select("answer_key").distinct(), "answer_key", "left_semi")
        unknown = rows.groupBy("answer_key").agg(F.first(prompt).alias("prompt")).join(known, "answer_key", "left_anti")
        got = scratch.written(unknown.mapInPandas(self._caller(generator), "answer_key string, raw string, error string"), "answers")
        fresh = got.where("raw IS NOT NULL").select("answer_key", "raw")
        known = scratch.written(known, "answers-known")
        if not fresh.isEmpty():
            self.store.append(fresh)
        every = known.withColumn("error", F.lit(None).cast("string")).unionByName(got)
        return rows.join(every, "answer_key").select(*keys, "raw", "error")

    def _caller(self, generator: Callable[[str], str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        at_once, tries, pause = self.at_once, self.tries, self.pause

        def call(prompt: str) -> tuple[str | None, str | None]:
            for turn in range(tries):
                try:
                    return generator(prompt), None
                except Exception as failed:
                    error = f"{type(failed).__name__}: {failed}"
                    if turn + 1 < tries:
                        time.sleep(pause * 2**turn)
            return None, error

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(at_once) as pool:
                for batch in batches:
                    said = list(pool.map(call, batch["prompt"]))
                    yield pd.DataFrame({"answer_key": batch["answer_key"], "raw": [r for r, _ in said], "error": [e for _, e in said]})

        return run


def extract(documents: DataFrame, generator: Callable[[str], str], template: str, *keys: str, answers: Answers | None = None) -> DataFrame:
    """(keys, raw, error, extraction): ask for each document's content and parse the answer; no JSON gives null.

    With ``answers`` what was asked before is taken from there.
    """
    prompts = documents.where(F.length(text.strip(F.col("content"))) > 0).withColumn("prompt", text.render(F.lit(template), {"document": F.col("content")}))
    asked = answers.ask(prompts, generator, "prompt", *keys) if answers else ask(prompts, generator, "prompt", *keys)
    return asked.withColumn("extraction", text.parse_json(F.col("raw")))


def succeeded(extractions: DataFrame, claim: str = "claim_id", order: str = "doc_idx") -> DataFrame:
    """Parsed extractions, renumbered from 0 within their claim."""
    from pyspark.sql import Window

    w = Window.partitionBy(claim).orderBy(order)
    kept = extractions.where(F.col("extraction").isNotNull())
    return kept.withColumn("_n", F.row_number().over(w) - 1).drop(order).withColumnRenamed("_n", order)


#: Shapes of answers that prompts ask for, as flags: fixed values.
MONEY_SHAPE, DATE_SHAPE, UNQUOTED = r"^[A-Z]{3} [0-9]+$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"""^[^"'].*[^"']$|^$"""


def quality_flags(rows: DataFrame, kind: str, value: str, reason: str, page: str) -> DataFrame:
    """Boolean columns: whether a value has the shape that its kind asks for, and whether absence is consistent."""
    v = F.col(value)
    flags = {
        "money_ok": (F.col(kind) != "currency") | v.isNull() | v.rlike(MONEY_SHAPE),
        "date_ok": (F.col(kind) != "date") | v.isNull() | v.rlike(DATE_SHAPE),
        "page_ok": F.col(page).isNull() | F.col(page).cast("string").rlike("^[0-9]+$"),
        "absence_ok": v.isNotNull() | F.col(reason).isNull(),
        "cell_ok": v.isNull() | ~v.contains("|"),
        "quotes_ok": v.isNull() | v.rlike(UNQUOTED),
    }
    return rows.withColumns(flags)
