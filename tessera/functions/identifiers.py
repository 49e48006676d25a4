"""Deterministic identifiers of the graph model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespaces of data and of terms; all identifiers below are built on them.
DATA = "http://tessera.local/data/"
TERM = "http://tessera.local/terms#"
CATALOGUE = "http://www.wikidata.org/entity/"
TRIPLE_ID_LENGTH = 12


def slug(text: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 become one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def iri(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{DATA}{kind}/"), name)


def message_iri(message_id: Column) -> Column:
    """Message ids enter their IRI as they are."""
    return iri("message", message_id)


def triple_id(subject: Column, predicate: Column, object_: Column, message_id: Column) -> Column:
    """Of a fact in a message: the same fact twice in one message is one."""
    key = F.concat_ws("|", subject, predicate, object_, message_iri(message_id))
    return F.substring(F.md5(key), 1, TRIPLE_ID_LENGTH)


def content_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def cut(text: Column, length: int) -> Column:
    """At most ``length`` code points, with dots where something was left out."""
    return F.when(F.char_length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)
