"""Logging on the driver: JSON lines, levels by name or environment, masked secrets."""

from __future__ import annotations

import json
import logging
import os
import sys
from datetime import UTC, datetime


def mask(secret: str, prefix: int = 4, suffix: int = 4) -> str:
    return "***" if len(secret) <= prefix + suffix else f"{secret[:prefix]}***{secret[len(secret) - suffix :]}"


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        row = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            row["error"] = self.formatException(record.exc_info)
        return json.dumps(row, ensure_ascii=False)


def level_of(name: str | None = None, variable: str = "SPARKRAG_LOG_LEVEL") -> int:
    """A level by name, else by the environment; unknown names count as INFO."""
    found = logging.getLevelNamesMapping().get((name or os.environ.get(variable, "INFO")).upper())
    return logging.INFO if found is None else found


def setup(level: str | None = None, as_json: bool = False, stream=sys.stderr) -> logging.Logger:
    logger = logging.getLogger("sparkrag")
    handler = logging.StreamHandler(stream)
    handler.setFormatter(JsonLines() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    logger.handlers[:] = [handler]
    logger.setLevel(level_of(level))
    logger.propagate = False
    return logger
