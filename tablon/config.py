"""Settings from the environment, and the log of a process."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from datetime import datetime
from typing import TypeVar

Number = TypeVar("Number", int, float)


def env_number(name: str, default: Number, kind: Callable[[str], Number] | None = None) -> Number:
    """The number in variable ``name``; ``default`` where it is unset, blank or no number of the default's type."""
    try:
        return (kind or type(default))(os.environ.get(name, "").strip())
    except ValueError:
        return default


def log_to_folder(folder: str, level: int = logging.INFO, name: str = "tablon") -> str:
    """Sends the records of logger ``name`` to the console and to a new file in ``folder``, and gives the file's path.
    Called again, it replaces the handlers of before."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}_{datetime.now():%Y%m%d_%H%M%S_%f}.log")
    logger = logging.getLogger(name)
    logger.setLevel(level)
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    for handler in (logging.FileHandler(path, encoding="utf-8"), logging.StreamHandler()):
        handler.setFormatter(form)
        logger.addHandler(handler)
    return path
