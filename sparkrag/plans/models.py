"""Embedders and language-model drivers as protocols, with deterministic ones that need no files; registries; rate limits."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmbeddingError, GenerationError
from ..operators import context
from ..registry import Registry


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@dataclass
class HashingEmbedder:
    """Signed counts of hashed words, scaled to unit length: equal texts, equal vectors, on any machine."""

    dim: int = 384

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for word in re.findall(r"\S+", text.lower()):
                h = crc32(word.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


@dataclass
class SentenceTransformerEmbedder:
    """A sentence-transformers model, loaded once a worker, where that package is installed."""

    model_name: str
    dim: int
    device: str = "cpu"
    batch_size: int = 32
    _model: object = field(default=None, repr=False)

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._model is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise EmbeddingError("this embedder needs the sentence-transformers package") from e
            self._model = SentenceTransformer(self.model_name, device=self.device)
        return self._model.encode(texts, batch_size=self.batch_size)


class RateLimiter:
    """Token bucket that starts full and allows debt: a request reserves its tokens, then waits for what is missing."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0:
            raise ValueError("rate must be positive")
        self.rate, self.tokens, self.clock, self.sleep = rate, rate, clock, sleep
        self.at = clock()

    def acquire(self, n: float = 1.0) -> float:
        now = self.clock()
        self.tokens = min(self.rate, self.tokens + (now - self.at) * self.rate) - n
        self.at = now
        wait = max(0.0, -self.tokens / self.rate)
        if wait:
            self.sleep(wait)
        return wait


def embed_column(df: DataFrame, embedder: Embedder, text: str = "content", out: str = "vector", batch_size: int = 32, rate_limit: float | None = None) -> DataFrame:
    """``df`` with vectors of a text column. A rate limit is for the whole job: each task takes its share."""
    share = rate_limit / max(1, df.sparkSession.sparkContext.defaultParallelism) if rate_limit else None
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out), f"`{out}` array<float>"])
    names = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limiter = RateLimiter(share) if share else None
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            parts = []
            for i in range(0, len(texts), batch_size):
                if limiter:
                    limiter.acquire()
                parts.append(np.asarray(embedder.embed(texts[i : i + batch_size]), np.float32))
            v = np.concatenate(parts) if parts else np.zeros((0, embedder.dim), np.float32)
            if v.shape[1] != embedder.dim:
                raise EmbeddingError(f"expected {embedder.dim} dimensions, got {v.shape[1]}")
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, embedder.dim), pa.int32()), pa.array(v.ravel()))
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in names), flat], names=[*names, out])

    return df.mapInArrow(run, schema)


class LLMDriver(Protocol):
    """What generation needs: ``generate`` gives text, prompt tokens, completion tokens and the reason it ended.

    Drivers can also have ``stream`` (pieces of text), ``count_tokens`` (a list of texts to a list of numbers), ``json_mode``
    (``generate`` then takes ``response_format``) and ``close``; drivers are context managers that load once and release.
    """

    context_window: int

    def generate(self, prompt: str, max_tokens: int, temperature: float) -> tuple[str, int, int, str]: ...


class Lifecycle:
    """A driver that loads at its first use, or on entering, and is released on leaving; entering again loads it anew."""

    def load(self) -> None:
        pass

    def close(self) -> None:
        pass

    def __enter__(self):
        self.load()
        return self

    def __exit__(self, *why) -> None:
        self.close()


@dataclass
class EchoDriver(Lifecycle):
    """Answers with the start of the prompt's first numbered chunk, or of the prompt: deterministic, for tests and dry runs."""

    context_window: int = 4096

    def generate(self, prompt: str, max_tokens: int = 512, temperature: float = 0.0) -> tuple[str, int, int, str]:
        m = re.search(r"\[1\] ([^\n]*)", prompt)
        words = (m[1] if m else prompt).split()
        text = " ".join(words[:max_tokens])
        return text, max(1, len(prompt) // 5), max(1, len(text) // 5), "length" if len(words) > max_tokens else "stop"

    def stream(self, prompt: str, max_tokens: int = 512, temperature: float = 0.0) -> Iterator[str]:
        for i, word in enumerate(self.generate(prompt, max_tokens)[0].split()):
            yield (" " if i else "") + word

    def count_tokens(self, texts: list[str]) -> list[int]:
        return [max(1, len(x) // 5) for x in texts]


@dataclass
class LlamaDriver(Lifecycle):
    """A GGUF model by llama-cpp, where that package is installed; one model a worker."""

    model_path: str
    context_window: int = 4096
    n_gpu_layers: int = 0
    json_mode: bool = False
    _model: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}  # each worker loads its own

    def load(self):
        if self._model is None:
            try:
                from llama_cpp import Llama
            except ImportError as e:
                raise GenerationError("this driver needs the llama-cpp-python package") from e
            self._model = Llama(self.model_path, n_ctx=self.context_window, n_gpu_layers=self.n_gpu_layers, verbose=False)
        return self._model

    def close(self) -> None:
        if self._model is not None and hasattr(self._model, "close"):
            self._model.close()
        self._model = None

    def _ask(self, prompt: str, max_tokens: int, temperature: float, stream: bool):
        more = {"response_format": {"type": "json_object"}} if self.json_mode else {}
        return self.load().create_chat_completion([{"role": "user", "content": prompt}], max_tokens=max_tokens, temperature=temperature, stream=stream, **more)

    def generate(self, prompt: str, max_tokens: int = 512, temperature: float = 0.7) -> tuple[str, int, int, str]:
        got = self._ask(prompt, max_tokens, temperature, False)
        use, choice = got["usage"], got["choices"][0]
        return choice["message"]["content"], use["prompt_tokens"], use["completion_tokens"], choice["finish_reason"]

    def stream(self, prompt: str, max_tokens: int = 512, temperature: float = 0.7) -> Iterator[str]:
        for part in self._ask(prompt, max_tokens, temperature, True):
            if text := part["choices"][0].get("delta", {}).get("content"):
                yield text

    def count_tokens(self, texts: list[str]) -> list[int]:
        model = self.load()
        return [len(model.tokenize(x.encode(), add_bos=False)) for x in texts]


def token_counter(driver: LLMDriver) -> Callable[[Column], Column]:
    """A function of a text column for ``context.fit_context(count=...)``: the driver's own token counts.

    The echoing driver's rule is an expression; others are asked in Arrow batches.
    """
    if isinstance(driver, EchoDriver):
        return context.count_tokens

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(driver.count_tokens([x or "" for x in texts.to_pylist()]), pa.int32())

    return F.arrow_udf(count, "int")


def stream_column(df: DataFrame, driver: LLMDriver, prompt: str = "prompt", max_tokens: int = 512, temperature: float = 0.7) -> DataFrame:
    """``df`` with a row for each piece that the driver streams: columns ``piece_no`` (from 0) and ``piece``."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "piece_no int, piece string"])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, pieces = [], [], []
            for i, text in enumerate(batch.column(batch.schema.get_field_index(prompt)).to_pylist()):
                for j, piece in enumerate(driver.stream(text or "", max_tokens, temperature)):
                    at.append(i)
                    no.append(j)
                    pieces.append(piece)
            own = [c.take(pa.array(at, pa.int64())) for c in batch.columns]
            yield pa.record_batch([*own, pa.array(no, pa.int32()), pa.array(pieces, pa.string())], names=[*names, "piece_no", "piece"])

    return df.mapInArrow(run, schema)


def generate_column(df: DataFrame, driver: LLMDriver, prompt: str = "prompt", out: str = "generation_result", max_tokens: int = 512, temperature: float = 0.7) -> DataFrame:
    """``df`` with a struct text, usage, finish_reason; a failing call gives finish_reason "error" and its message."""
    usage = pa.struct([("prompt_tokens", pa.int32()), ("completion_tokens", pa.int32()), ("total_tokens", pa.int32())])
    kind = pa.struct([("text", pa.string()), ("usage", usage), ("finish_reason", pa.string())])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` struct<text:string,usage:struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>,finish_reason:string>"])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(batch.schema.get_field_index(prompt)).to_pylist():
                try:
                    answer, a, b, why = driver.generate(text or "", max_tokens, temperature)
                except GenerationError as e:
                    answer, a, b, why = str(e), 0, 0, "error"
                rows.append({"text": answer, "usage": {"prompt_tokens": a, "completion_tokens": b, "total_tokens": a + b}, "finish_reason": why})
            yield pa.record_batch([*batch.columns, pa.array(rows, kind)], names=[*names, out])

    return df.mapInArrow(run, schema)


EMBEDDERS = Registry("embedder", hashing=lambda dim=384, **_: HashingEmbedder(dim), sentence_transformer=SentenceTransformerEmbedder)
DRIVERS = Registry("driver", echo=EchoDriver, llama=LlamaDriver)


def sparse_embed(df: DataFrame, text: str = "content", out: str = "sparse_vector") -> DataFrame:
    """Term frequencies as a map from a word's 63-bit hash to its count, within the row: hashes are sorted, and each run of
    equal ones is an entry. (Of 31 bits, two words of one long text share a hash now and then, and would be one entry.)"""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0))
    ids = F.array_sort(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << 63) - 1))))
    # generators make each step once a row, where nested expressions would be copied into the loops
    rows = df.select("*", F.explode(F.array(F.coalesce(ids, F.array().cast("array<bigint>")))).alias("_ids"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_ids")), lambda i: (i == 0) | (i == F.size("_ids")) | (F.get(F.col("_ids"), i) != F.get(F.col("_ids"), i - 1)))
    rows = rows.select("*", F.explode(F.array(starts)).alias("_at"))
    runs = F.transform(F.slice("_at", 1, F.size("_at") - 1), lambda a, k: F.struct(F.get(F.col("_ids"), a).alias("k"), (F.get(F.col("_at"), k + 1) - a).cast("double").alias("v")))
    return rows.withColumn(out, F.map_from_entries(F.when(F.size("_ids") > 0, runs).otherwise(F.array().cast("array<struct<k:bigint,v:double>>")))).drop("_ids", "_at")
