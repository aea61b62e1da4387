"""Errors of the library, one kind for each concern."""

from __future__ import annotations


class SparkRagError(Exception):
    """Base of all errors that the library raises on purpose."""


class ConfigError(SparkRagError):
    pass


class ConfigOverrideError(ConfigError):
    def __init__(self, message: str, field_path: str = ""):
        super().__init__(message)
        self.field_path = field_path


class UnsupportedBackendError(ConfigError):
    def __init__(self, backend: str, known: list[str]):
        super().__init__(f"unsupported backend {backend!r}; known: {', '.join(known) or 'none'}")
        self.backend, self.known = backend, known


class IngestionError(SparkRagError):
    pass


class FragmentationError(SparkRagError):
    pass


class VectorIndexError(SparkRagError):
    pass


class RetrievalError(SparkRagError):
    pass


class EmbeddingError(SparkRagError):
    pass


class GenerationError(SparkRagError):
    pass


class EvaluationError(SparkRagError):
    pass


class MetricValidationError(EvaluationError):
    pass


class QuestionGenerationError(SparkRagError):
    pass
