"""Model calls as pluggable providers.

A provider is a function from a list of prompts to a list of outputs, created once per Python worker; the engine hands it
Arrow batches. ``Stub`` answers deterministically, so pipelines run and are tested without a model.
"""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str | None]]


class Stub:
    """Deterministic outputs: a template filled with the prompt, its digest and its length."""

    def __init__(self, template: str = "<answer>{digest}</answer><reason>{length}</reason>"):
        self.template = template

    def __call__(self, prompts: list[str]) -> list[str | None]:
        return [self.template.format(prompt=p, digest=hashlib.md5(p.encode()).hexdigest(), length=len(p)) for p in prompts]


class Retrying:
    """Calls again what failed, came back null or isn't ``valid`` (prompt, output), up to ``attempts`` times; what still fails
    is null. An error whose text matches ``skip`` (a refused content, a prompt too long) is not tried again."""

    def __init__(self, provider: Provider, attempts: int = 2, valid: Callable[[str, str], bool] | None = None, skip: str | None = None):
        self.provider, self.attempts, self.valid, self.skip = provider, attempts, valid, skip

    def __call__(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(prompts)
        todo = list(range(len(prompts)))
        for _ in range(self.attempts):
            if not todo:
                break
            left = []
            try:
                got = self._ask([prompts[i] for i in todo])
            except Exception as e:  # a passing failure: all are asked again; one that would last, of some prompt: each alone
                lasting = self.skip and re.search(self.skip, str(e))
                got = [self._alone(prompts[i]) for i in todo] if lasting else [None] * len(todo)
            for i, g in zip(todo, got):
                if g is _SKIP:
                    continue
                out[i] = g if g is not None and (self.valid is None or self.valid(prompts[i], g)) else None
                if out[i] is None:
                    left.append(i)
            todo = left
        return out

    def _ask(self, prompts: list[str]) -> list[str | None]:
        return list(self.provider(prompts))

    def _alone(self, prompt: str):
        try:
            return self._ask([prompt])[0]
        except Exception as e:
            return _SKIP if self.skip and re.search(self.skip, str(e)) else None


_SKIP = object()


class Http:
    """A chat endpoint that takes {model, messages} and answers {choices: [{message: {content}}]}; ``threads`` calls at a time."""

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 600, threads: int = 8, **settings):
        self.url, self.model, self.key, self.timeout, self.threads, self.settings = url, model, key, timeout, threads, settings

    def _one(self, prompt: str) -> str | None:
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], **self.settings}).encode()
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=self.timeout) as r:
            return json.load(r)["choices"][0]["message"]["content"]

    def __call__(self, prompts: list[str]) -> list[str | None]:
        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(self._one, prompts))


def embed_stub(dim: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """Unit vectors from a digest of the text."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [b - 127.5 for b in hashlib.shake_128(t.encode()).digest(dim)]
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v])
        return out

    return run


def token_probabilities_stub(prompts: list[str], answers: list[str]) -> list[list[float]]:
    """A probability per blank-separated token of each answer, from digests."""
    return [[(hashlib.md5(f"{p}|{w}".encode()).digest()[0] + 1) / 257 for w in a.split()] for p, a in zip(prompts, answers)]


def complete(df: DataFrame, prompt: str, to: str, make: Callable[[], Provider] = Stub, batch: int = 64) -> DataFrame:
    """df with the provider's output. Each distinct prompt is asked once and joined back by its digest: prompts that a hot
    row group repeats cost one call."""
    d = df.withColumn("_digest", F.md5(F.col(prompt)))
    asked = d.where(F.col(prompt).isNotNull()).groupBy("_digest").agg(F.first(prompt).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(provider(part.column(1).to_pylist()), pa.string())], names=["_digest", to])

    return d.join(asked.mapInArrow(run, f"_digest string, `{to}` string"), "_digest", "left").drop("_digest")


def embed(df: DataFrame, text: str, to: str, make: Callable[[], Callable[[list[str]], list[list[float]]]] = embed_stub) -> DataFrame:
    """df with a vector per text, null for null."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            got = iter(provider([t for t in texts if t is not None]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else next(got) for t in texts], pa.list_(pa.float32()))], names=[*b.schema.names, to])

    return df.mapInArrow(run, f"{fields}, `{to}` array<float>")
