"""Logging: to stderr, to a file that is appended to, to a file per day; levels can be changed while running, by name."""

from __future__ import annotations

import logging
import logging.handlers
import os
import sys
import tempfile

from pyspark.sql import SparkSession

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"
_HANDLERS: dict[str, logging.Handler] = {}


def log_folder() -> str:
    """TMPDIR of this process; logs are the driver's own."""
    return tempfile.gettempdir()


def add_handler(name: str, handler: logging.Handler, level: int | str = "INFO") -> logging.Handler:
    """Register a handler under a name and attach it to the library's logger."""
    handler.setFormatter(logging.Formatter(FORMAT))
    handler.setLevel(level)
    logger = logging.getLogger("locusframe")
    if name in _HANDLERS:
        logger.removeHandler(_HANDLERS[name])
    _HANDLERS[name] = handler
    logger.addHandler(handler)
    logger.setLevel(min(h.level for h in _HANDLERS.values()))
    return handler


def modify_handler(name: str, level: int | str) -> None:
    """Change the level of a registered handler; KeyError for a name that isn't registered."""
    _HANDLERS[name].setLevel(level)
    logging.getLogger("locusframe").setLevel(min(h.level for h in _HANDLERS.values()))


def to_stderr(level: int | str = "INFO") -> None:
    add_handler("stderr", logging.StreamHandler(sys.stderr), level)


def to_stderr_and_file(path: str, level: int | str = "INFO") -> None:
    """The file is made if it isn't there, and appended to if it is."""
    to_stderr(level)
    add_handler("file", logging.FileHandler(path, mode="a"), level)


def to_stderr_and_daily_file(folder: str, name: str, level: int | str = "INFO") -> None:
    to_stderr(level)
    add_handler("daily", logging.handlers.TimedRotatingFileHandler(os.path.join(folder, name), when="midnight", utc=True), level)


def spark_level(spark: SparkSession, level: str) -> None:
    spark.sparkContext.setLogLevel(level)


def lines(items) -> str:
    """One item per line, for log messages."""
    return "\n".join(map(repr, items))
