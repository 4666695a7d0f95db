"""Identifiers: columns by any name, and names of tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTES = "`'\""


def bare(name: str) -> str:
    """The name without one pair of quotes around it."""
    name = name.strip()
    return name[1:-1] if len(name) >= 2 and name[0] == name[-1] and name[0] in QUOTES else name


def quoted(name: str) -> str:
    return "`" + bare(name).replace("`", "``") + "`"


def col(name: str, side: str | None = None) -> Column:
    """The column of exactly that name, whatever characters are in it; side: the alias of the frame it belongs to."""
    return F.col(f"{side}.{quoted(name)}" if side else quoted(name))


def safe_suffix(text: str) -> str:
    """text with everything but letters, digits and underscores replaced, for use in a table's name."""
    return re.sub(r"\W", "_", text, flags=re.ASCII).strip("_") or "run"


def table_name(database: str, prefix: str, name: str) -> str:
    return ".".join(quoted(part) for part in (*bare(database).split("."), f"{prefix}_{name}"))


def chunks(items: list, size: int) -> list[list]:
    if size <= 0:
        raise ValueError("size must be positive")
    return [items[i : i + size] for i in range(0, len(items), size)]
