"""Log lines of the engine, for people or for machines."""

from __future__ import annotations

import json
import logging
import sys
from typing import TextIO

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")


class JsonLines(logging.Formatter):
    """One JSON object for each line."""

    def format(self, record: logging.LogRecord) -> str:
        told = {"time": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            told["error"] = self.formatException(record.exc_info)
        return json.dumps(told)


def configure(level: str = "INFO", form: str = "console", to: TextIO | None = None) -> logging.Logger:
    """Send the engine's log to a stream (by default standard error), as text or as JSON; called again, it replaces what it set before."""
    if level not in LEVELS or form not in ("console", "json"):
        raise ValueError(f"level is one of {LEVELS}, form is console or json")
    logger = logging.getLogger("chronofold")
    handler = logging.StreamHandler(to or sys.stderr)
    handler.setFormatter(JsonLines() if form == "json" else logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    logger.handlers, logger.propagate = [handler], False
    logger.setLevel(level)
    return logger
