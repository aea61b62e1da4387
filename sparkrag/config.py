"""Experiment profiles: what a run is made of, checked on construction, on the driver."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import typing
from dataclasses import dataclass, field
from pathlib import Path

from .errors import ConfigError, ConfigOverrideError


def _between(name: str, value: float | None, low: float, high: float | None = None) -> None:
    if value is not None and (value < low or high is not None and value > high):
        raise ConfigError(f"{name} is {value}; allowed: {low} to {high if high is not None else 'any'}")


def _one_of(name: str, value: str, known: tuple[str, ...]) -> None:
    if value not in known:
        raise ConfigError(f"{name} is {value!r}; allowed: {', '.join(known)}")


@dataclass(frozen=True)
class IngestorConfig:
    backend: str = "text"
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class FragmenterConfig:
    strategy: str = "token"
    chunk_size: int = 256
    overlap: int = 64
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        _between("chunk_size", self.chunk_size, 50, 8192)
        _between("overlap", self.overlap, 0)
        if self.overlap >= self.chunk_size:
            raise ConfigError("overlap must be less than chunk_size")


@dataclass(frozen=True)
class EmbedderConfig:
    model_name: str = "hashing"
    device: str = "cpu"
    batch_size: int = 32
    rate_limit: float | None = None

    def __post_init__(self):
        _between("batch_size", self.batch_size, 1)
        _between("rate_limit", self.rate_limit, 0.1)


@dataclass(frozen=True)
class IndexConfig:
    backend: str = "memory"
    collection_name: str = "default"
    embedding_dim: int = 384
    connection: dict | None = None

    def __post_init__(self):
        _between("embedding_dim", self.embedding_dim, 64, 4096)
        if self.backend in ("qdrant", "milvus", "lancedb") and not self.connection:
            raise ConfigError(f"backend {self.backend} needs a connection")


@dataclass(frozen=True)
class RerankerConfig:
    model_name: str = "overlap"
    device: str = "cpu"
    top_k: int = 10

    def __post_init__(self):
        _between("top_k", self.top_k, 1)


@dataclass(frozen=True)
class RetrievalConfig:
    mode: str = "dense"
    top_k: int = 10
    alpha: float | None = None
    reranker: RerankerConfig | None = None

    def __post_init__(self):
        _one_of("mode", self.mode, ("dense", "sparse", "hybrid"))
        _between("top_k", self.top_k, 1, 100)
        _between("alpha", self.alpha, 0, 1)
        if self.mode == "hybrid" and self.alpha is None:
            raise ConfigError("hybrid retrieval needs alpha")


@dataclass(frozen=True)
class GeneratorConfig:
    model_path: str = ""
    context_window: int = 4096
    max_new_tokens: int = 512
    temperature: float = 0.7

    def __post_init__(self):
        _between("context_window", self.context_window, 512, 128_000)
        _between("max_new_tokens", self.max_new_tokens, 1, 4096)
        _between("temperature", self.temperature, 0, 2)


@dataclass(frozen=True)
class QuestionGeneratorConfig:
    enabled: bool = False
    backend: str = "llm"
    model_path: str = ""
    num_questions: int = 3
    batch_size: int = 4
    temperature: float = 0.7
    max_tokens: int = 512
    context_window: int = 4096
    n_gpu_layers: int = 0
    validation: bool = True

    def __post_init__(self):
        _one_of("backend", self.backend, ("llm",))
        _between("num_questions", self.num_questions, 1, 10)
        _between("batch_size", self.batch_size, 1, 16)
        _between("temperature", self.temperature, 0, 2)
        _between("max_tokens", self.max_tokens, 128, 2048)
        _between("context_window", self.context_window, 512, 32_768)
        _between("n_gpu_layers", self.n_gpu_layers, 0)


@dataclass(frozen=True)
class EvaluationConfig:
    metrics: list = field(default_factory=lambda: ["recall", "precision", "mrr", "ndcg", "map"])
    metric_parameters: dict = field(default_factory=dict)
    trial_cases_path: str = ""
    judge_model_path: str | None = None


@dataclass(frozen=True)
class StreamingMetricsConfig:
    enabled: bool = True
    interval: float = 1.0
    max_samples: int = 10_000
    backpressure_threshold: float = 0.8

    def __post_init__(self):
        _between("interval", self.interval, 0.1, 60)
        _between("max_samples", self.max_samples, 10, 100_000)
        _between("backpressure_threshold", self.backpressure_threshold, 0.5, 1)


@dataclass(frozen=True)
class MonitoringConfig:
    enabled: bool = False


@dataclass(frozen=True)
class MetricsConfig:
    monitoring: MonitoringConfig | None = field(default_factory=MonitoringConfig)
    streaming: StreamingMetricsConfig | None = field(default_factory=StreamingMetricsConfig)


@dataclass(frozen=True)
class ExperimentProfile:
    ingestor: IngestorConfig = field(default_factory=IngestorConfig)
    fragmenter: FragmenterConfig = field(default_factory=FragmenterConfig)
    fail_fast: bool = True
    embedder: EmbedderConfig = field(default_factory=EmbedderConfig)
    index: IndexConfig = field(default_factory=IndexConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    generator: GeneratorConfig | None = None
    question_generator: QuestionGeneratorConfig | None = None
    evaluation: EvaluationConfig | None = None
    metrics: MetricsConfig | None = field(default_factory=MetricsConfig)

    @classmethod
    def from_dict(cls, data: dict) -> ExperimentProfile:
        return _build(cls, data or {}, "")

    @classmethod
    def from_yaml(cls, path: str | Path) -> ExperimentProfile:
        """Read a profile; relative paths in it are taken from its own folder."""
        yaml = _yaml()
        try:
            data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        except (OSError, yaml.YAMLError) as e:
            raise ConfigError(f"cannot read profile {path}: {e}") from e
        return cls.from_dict(resolve_paths(data or {}, Path(path).resolve().parent))

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    def to_yaml(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(_yaml().safe_dump(self.to_dict(), sort_keys=False, allow_unicode=True), encoding="utf-8")

    def with_overrides(self, overrides: dict[str, object]) -> ExperimentProfile:
        """A copy with dotted keys replaced, such as ``{"retrieval.top_k": 5}``."""
        data = self.to_dict()
        for key, value in overrides.items():
            at = data
            *parents, last = key.split(".")
            for name in parents:
                if not isinstance(at, dict) or not isinstance(at.get(name), dict):
                    raise ConfigOverrideError(f"no section {name!r} for override {key}", key)
                at = at[name]
            if not isinstance(at, dict) or last not in at:
                raise ConfigOverrideError(f"no such setting: {key}", key)
            at[last] = value
        try:
            return type(self).from_dict(data)
        except ConfigError as e:
            raise ConfigOverrideError(str(e), next(iter(overrides), "")) from e

    def diff(self, other: ExperimentProfile) -> dict[str, tuple[object, object]]:
        a, b = _flat(self.to_dict()), _flat(other.to_dict())
        return {k: (a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)}

    def compute_hash(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True, default=str).encode()).hexdigest()


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("profiles in YAML need the PyYAML package") from e
    return yaml


def _build(cls: type, data: dict, at: str):
    if not isinstance(data, dict):
        raise ConfigError(f"section {at or 'profile'} must be a mapping")
    hints = typing.get_type_hints(cls)
    if extra := set(data) - set(hints):
        raise ConfigError(f"unknown settings in {at or 'profile'}: {', '.join(sorted(extra))}")
    values = {}
    for name, value in data.items():
        kinds = [k for k in (typing.get_args(hints[name]) or (hints[name],)) if k is not type(None)]
        section = next((k for k in kinds if dataclasses.is_dataclass(k)), None)
        if value is not None and section:
            value = _build(section, value, f"{at}.{name}".strip("."))
        elif value is not None and not _fits(value, kinds):
            raise ConfigError(f"{at}.{name} has the wrong type: {value!r}".lstrip("."))
        elif value is None and type(None) not in typing.get_args(hints[name]):
            raise ConfigError(f"{at}.{name} must not be null".lstrip("."))
        values[name] = value
    return cls(**values)


def _fits(value: object, kinds: list[type]) -> bool:
    if isinstance(value, bool):
        return bool in kinds
    return isinstance(value, tuple(kinds)) or isinstance(value, int) and float in kinds


def _flat(data: dict, prefix: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in data.items():
        out |= _flat(v, f"{prefix}{k}.") if isinstance(v, dict) and v else {f"{prefix}{k}": v}
    return out


# How a string is told to be a path.
PATH_STARTS = ("./", "../", "/", "~", "\\")
PATH_ENDS = (".json", ".jsonl", ".yaml", ".yml", ".gguf", ".bin", ".txt")


def resolve_paths(data: object, base: Path) -> object:
    if isinstance(data, dict):
        return {k: resolve_paths(v, base) for k, v in data.items()}
    if isinstance(data, list):
        return [resolve_paths(v, base) for v in data]
    if isinstance(data, str) and (data.startswith(PATH_STARTS) or data.endswith(PATH_ENDS)):
        path = Path(os.path.expanduser(data))
        return str(path if path.is_absolute() else (base / path).resolve())
    return data
