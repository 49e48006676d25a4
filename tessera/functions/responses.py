"""Reading facts out of model responses: strict JSON first, then what can be saved."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .entities import is_valid_entity, normalize_entity, normalize_predicate

FACT = T.StructType([T.StructField(n, T.StringType()) for n in ("subject", "predicate", "object")])
FACTS = T.ArrayType(FACT)
#: Facts kept of one response, in the order given.
MAX_FACTS = 10
#: A whole fact in a broken list. The pattern, and the order in which readings are tried, are fixed values.
COMPLETE_OBJECT = r'\{[^{}]*"subject"\s*:\s*"[^"]*"\s*,\s*"predicate"\s*:\s*"[^"]*"\s*,\s*"object"\s*:\s*"[^"]*"[^{}]*\}'


def _count(text: Column, char: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(char), F.lit("")))


def is_truncated(raw: Column) -> Column:
    """An opened list never closed, brackets or braces left open, or an end that asks for more."""
    text = F.regexp_replace(raw, r"(?U)\s+$", "")
    opened = F.ltrim(text).startswith("[") & ~F.endswith(text, F.lit("]"))
    unbalanced = (_count(text, "[") > _count(text, "]")) | (_count(text, "{") > _count(text, "}"))
    return F.coalesce((F.char_length(text) > 0) & (opened | unbalanced | F.right(text, F.lit(1)).isin(",", ":", '"', "{")), F.lit(False))


def truncated(raw: str) -> bool:
    """``is_truncated`` of one response."""
    text = raw.rstrip()
    if not text:
        return False
    opened = text.lstrip(" ").startswith("[") and not text.endswith("]")
    return opened or text.count("[") > text.count("]") or text.count("{") > text.count("}") or text[-1] in ',:"{'


def salvage(raw: Column) -> Column:
    """The complete objects of a truncated response."""
    return F.transform(F.regexp_extract_all(raw, F.lit(COMPLETE_OBJECT), F.lit(0)), lambda x: F.from_json(x, FACT))


def _strict(text: str):
    """(parsed, ok) under strict JSON."""
    try:
        return json.loads(text), True
    except (ValueError, RecursionError):
        return None, False


def candidate_facts(raw: str | None, truncated: bool) -> list[dict] | None:
    """String-valued facts of a response before validation; None if nothing can be read."""
    if raw is None:
        return None
    parsed, ok = _strict(raw)
    if not ok:
        listed = re.search(r"\[.*\]", raw, re.DOTALL)
        if listed:
            parsed, ok = _strict(listed[0])
        if (not ok or parsed is None) and truncated:
            parsed = [json.loads(x) for x in re.findall(COMPLETE_OBJECT, raw) if _strict(x)[1]] or None
            ok = parsed is not None
        if not ok or parsed is None:
            return None
    if isinstance(parsed, dict):
        parsed = next((v for v in parsed.values() if isinstance(v, list)), None)
    if not isinstance(parsed, list):
        return None
    fields = ("subject", "predicate", "object")
    return [{k: x[k] for k in fields} for x in parsed if isinstance(x, dict) and all(isinstance(x.get(k), str) for k in fields)]


@F.pandas_udf(FACTS)
def _candidates(raw: pd.Series, truncated: pd.Series) -> pd.Series:
    return pd.Series([candidate_facts(r, bool(t)) for r, t in zip(raw, truncated, strict=True)], dtype=object)


def parse_response(raw: Column) -> Column:
    """Validated facts of a response (null: unreadable), at most ``MAX_FACTS``.

    Only the strict JSON reading runs in Python, in Arrow batches; normalising,
    validating and the cap are column expressions.
    """
    normal = F.transform(
        _candidates(raw, is_truncated(raw)),
        lambda f: F.struct(normalize_entity(f["subject"]).alias("subject"), F.when(f["predicate"] != "", normalize_predicate(f["predicate"])).alias("predicate"), normalize_entity(f["object"]).alias("object")),
    )
    valid = F.filter(normal, lambda f: f["predicate"].isNotNull() & is_valid_entity(f["subject"]) & is_valid_entity(f["object"]))
    return F.slice(valid, 1, MAX_FACTS)


def parsed(answers: DataFrame, *keys: str, raw: str = "raw") -> DataFrame:
    """``keys`` and the validated facts of every answer (null: unreadable), as ``parse_response`` gives them.

    For whole tables: facts are rows while they are judged, so that the filters are
    plain columns of generated code. ``keys`` tell the answers apart.
    """
    read = answers.select(*keys, _candidates(F.col(raw), is_truncated(F.col(raw))).alias("found"))
    rows = read.select(*keys, F.col("found").isNotNull().alias("readable"), F.posexplode_outer("found").alias("at", "f"))
    plain = rows.select(
        *keys, "readable", "at",
        normalize_entity(F.col("f.subject")).alias("subject"),
        F.when(F.col("f.predicate") != "", normalize_predicate(F.col("f.predicate"))).alias("predicate"),
        normalize_entity(F.col("f.object")).alias("object"),
    )
    good = F.col("predicate").isNotNull() & is_valid_entity(F.col("subject")) & is_valid_entity(F.col("object"))
    judged = plain.select(*keys, "readable", F.when(good, F.struct("at", F.struct("subject", "predicate", "object").alias("fact"))).alias("kept"))
    listed = judged.groupBy(*keys).agg(F.max("readable").alias("readable"), F.sort_array(F.collect_list("kept")).alias("facts"))
    return listed.select(*keys, F.when(F.col("readable"), F.slice(F.transform("facts", lambda x: x["fact"]), 1, MAX_FACTS)).alias("facts"))
