"""Loggers of a run: a file with everything, a console with what matters."""

from __future__ import annotations

import logging
import os

_FORM = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def task_logger(name: str, path: str | None = None, level: int = logging.DEBUG, console_level: int = logging.INFO) -> logging.Logger:
    """The logger ``name``; asking again replaces its handlers, so no line is written twice."""
    logger = logging.getLogger(name)
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    logger.setLevel(min(level, console_level))
    logger.propagate = False
    handlers: list[tuple[logging.Handler, int]] = [(logging.StreamHandler(), console_level)]
    if path:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        handlers.append((logging.FileHandler(path, encoding="utf-8"), level))
    for handler, own in handlers:
        handler.setLevel(own)
        handler.setFormatter(logging.Formatter(_FORM))
        logger.addHandler(handler)
    return logger
