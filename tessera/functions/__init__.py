"""Scalar functions, and their registration for SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import entities

SQL_FUNCTIONS = {
    "kg_slug": "(name STRING) RETURNS STRING RETURN btrim(regexp_replace(lower(name), '[^a-z0-9]+', '-'), '-')",
    "kg_normalize_entity": r"(name STRING) RETURNS STRING RETURN rtrim('.,;:', regexp_replace(lower(regexp_replace(name, r'(?U)^\s+|\s+$', '')), r'(?U)\s+', ' '))",
    "kg_triple_id": "(s STRING, p STRING, o STRING, message_id STRING) RETURNS STRING RETURN substring(md5(concat_ws('|', s, p, o, concat('http://tessera.local/data/message/', message_id))), 1, 12)",
}
#: Functions too long to write twice: their SQL is that of the column expression.
EXPRESSIONS = {
    "kg_normalize_label": ("STRING", entities.normalize_label),
    "kg_is_valid_entity": ("BOOLEAN", entities.is_valid_entity),
    "kg_is_linkable_entity": ("BOOLEAN", entities.is_linkable_entity),
    "kg_has_tech_keyword": ("BOOLEAN", entities.has_tech_keyword),
}
_LITERAL_OR_OPERATOR = re.compile(r"'(?:[^'\\]|\\.)*'|(?P<operator><=>|<=|>=|!=|=|<|>|\bin)(?=\()")


def _sql(column: Column) -> str:
    """The SQL of an expression; operators written as functions are quoted, as the parser wants them."""
    text = column._jc.node().sql()
    return _LITERAL_OR_OPERATOR.sub(lambda m: f"`{m['operator']}`" if m["operator"] else m[0], text)


def register(spark: SparkSession) -> None:
    """Make the functions known to this session's SQL."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    for name, (kind, expression) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(name STRING) RETURNS {kind} RETURN ({_sql(expression(F.col('name')))})")
