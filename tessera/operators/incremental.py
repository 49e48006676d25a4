"""The ledger of what has been read, by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER_SCHEMA = "source string, sha256 string"


def changed(sources: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of ``sources`` (source, sha256, ...) that are new or not as the ledger, a row per source, knows them."""
    return sources.join(ledger.select("source", "sha256"), ["source", "sha256"], "left_anti")


def without_subagents(sources: DataFrame, column: str = "source") -> DataFrame:
    return sources.filter(~F.col(column).contains("/subagents/"))


def translate_path(path, container: str, marker: str = "/projects/"):
    """What follows the first ``marker`` in ``path``, below ``container``; paths without it stay."""
    at = F.instr(path, marker)
    return F.when(at > 0, F.concat(F.lit(container), F.substring(path, at + F.lit(len(marker) - 1), F.char_length(path)))).otherwise(path)


def replace_sessions(old: DataFrame, new: DataFrame, key: str = "session") -> DataFrame:
    """``old`` without the sessions that ``new`` brings, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
