"""Graphs stored as N-Triples or Turtle, read back as long rows (s, p, o, o_kind, o_datatype, o_lang).

N-Triples are read line by line in SQL functions. Turtle needs its file's prefixes, so a
file is read by one task: the subset that graph libraries write, which is prefixes and
bases, ``;`` and ``,`` lists, ``a``, quoted texts of one or several lines with language
or type, numbers and truth values. Lines and files that cannot be read are set aside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

LONG = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
_IRI = r"(?:<([^<>\"{}|^`\\\x00-\x20]*)>|(_:\S+))"
_LINE = rf'^\s*{_IRI}\s+<([^<>"\s]*)>\s+(?:{_IRI}|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^<>\s]*)>)?)\s*\.\s*(?:#.*)?$'
#: Escapes of texts, the backslash's own last.
_ESCAPES = (("t", "\t"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("f", "\f"), ('"', '"'), ("'", "'"))


def unescaped(text: Column) -> Column:
    """The text that escapes of N-Triples stand for; of numbered ones the common four-digit form."""
    parts = F.split(text, r"\\\\", -1)  # between escaped backslashes a backslash opens another escape

    def one(part: Column) -> Column:
        for letter, char in _ESCAPES:
            part = F.replace(part, F.lit("\\" + letter), F.lit(char))
        pieces = F.split(part, r"\\u")
        code = lambda x: F.concat(F.decode(F.unhex(F.substring(x, 1, 4)), "UTF-16BE"), F.substring(x, 5, 1 << 30))
        return F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), code), ""))

    return F.array_join(F.transform(parts, one), "\\")


def read_n_triples(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, lines that cannot be read) of N-Triples files; blank lines and comments are neither."""
    lines = spark.read.text(path).filter(r"NOT value RLIKE '^\\s*(#.*)?$'")
    part = lambda n: F.regexp_extract("value", _LINE, n)
    good = F.col("value").rlike(_LINE)
    either = lambda a, b: F.when(part(b) != "", part(b)).otherwise(part(a))
    is_iri = F.regexp_extract("value", rf"^\s*{_IRI}\s+<[^<>\"\s]*>\s+(.)", 3) != '"'
    rows = lines.filter(good).select(
        either(1, 2).alias("s"), part(3).alias("p"), F.when(is_iri, either(4, 5)).otherwise(unescaped(part(6))).alias("o"), F.when(is_iri, "iri").otherwise("literal").alias("o_kind"),
        F.when(part(8) != "", part(8)).alias("o_datatype"), F.when(part(7) != "", part(7)).alias("o_lang"),
    )
    return rows, lines.filter(~good)


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"\s]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3})|(?P<text>"(?:[^"\\\n]|\\.)*")|(?P<lang>@(?!prefix|base)[A-Za-z][A-Za-z0-9-]*)
    |(?P<num>[+-]?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<blank>_:[\w.-]*\w)|(?P<name>[A-Za-z][\w.-]*\w:|[A-Za-z]?:)(?P<local>(?:[\w%-]|\.(?=[\w%-])|\\.)*)|(?P<word>@?[A-Za-z]+)|(?P<op>\^\^|[.;,])""",
    re.X,
)
_CODES = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)


class Unreadable(ValueError):
    pass


def turtle(text: str) -> Iterator[tuple]:
    """The statements of a Turtle text, in order."""
    prefixes, at, base = {}, 0, ""
    tokens = []
    while at < len(text):
        found = _TOKEN.match(text, at)
        if found is None or found.end() == at:
            raise Unreadable(f"at {at}: {text[at : at + 20]!r}")
        if found.lastgroup:
            tokens.append(("name", (found["name"][:-1], found["local"])) if found["name"] is not None else (found.lastgroup, found[found.lastgroup]))
        at = found.end()
    tokens.reverse()
    plain = dict(_ESCAPES) | {"\\": "\\"}
    code = lambda m: plain.get(m[1]) or chr(int(m[1][1:], 16)) if m[1][0] in "uU" or m[1] in plain else m[1]

    def take(*kinds: str) -> tuple[str, object]:
        if not tokens or (kinds and tokens[-1][0] not in kinds):
            raise Unreadable(f"{tokens[-1][1] if tokens else 'the end'!r} was not expected")
        return tokens.pop()

    def resource(token: tuple) -> str:
        kind, value = token
        if kind == "name":
            if value[0] not in prefixes:
                raise Unreadable(f"unknown prefix {value[0]!r}")
            return prefixes[value[0]] + re.sub(r"\\(.)", r"\1", value[1])
        if kind == "iri":
            return value[1:-1] if ":" in value else base + value[1:-1]
        return value

    def object_() -> tuple:
        kind, value = take("iri", "name", "blank", "text", "long", "num", "word")
        if kind in ("iri", "name", "blank"):
            return resource((kind, value)), "iri", None, None
        if kind == "num":
            return value, "literal", XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None
        if kind == "word":
            if value not in ("true", "false"):
                raise Unreadable(f"{value!r} was not expected")
            return value, "literal", f"{XSD}boolean", None
        said = _CODES.sub(code, value[3:-3] if kind == "long" else value[1:-1])
        if tokens and tokens[-1][0] == "lang":
            return said, "literal", None, take()[1][1:]
        if tokens and tokens[-1] == ("op", "^^"):
            take()
            return said, "literal", resource(take("iri", "name")), None
        return said, "literal", None, None

    while tokens:
        kind, value = take("iri", "name", "blank", "word")
        if kind == "word":
            if value.lower().strip("@") == "prefix":
                name = take("name")[1][0]
                prefixes[name] = take("iri")[1][1:-1]
            elif value.lower().strip("@") == "base":
                base = take("iri")[1][1:-1]
            else:
                raise Unreadable(f"{value!r} was not expected")
            if value.startswith("@"):
                take("op")
            continue
        subject, end = resource((kind, value)), ";"
        while end == ";":
            while tokens and tokens[-1] == ("op", ";"):
                take()
            if tokens and tokens[-1] == ("op", "."):
                take()
                break
            kind, value = take("iri", "name", "word")
            if kind == "word" and value != "a":
                raise Unreadable(f"{value!r} was not expected")
            predicate, end = RDF_TYPE if kind == "word" else resource((kind, value)), ","
            while end == ",":
                yield (subject, predicate, *object_())
                end = take("op")[1]


def read_turtle(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their ``source``, (source, reason) of files that cannot be read) of Turtle files."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("text"))
    names = [x.split()[0] for x in LONG.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, text in zip(batch["source"], batch["text"], strict=True):
                try:
                    rows, reason = list(turtle(text)), None
                except Unreadable as error:
                    rows, reason = [(None,) * 6], str(error)
                yield pd.DataFrame(rows, columns=names, dtype=object).assign(source=source, reason=reason)

    read = files.mapInPandas(run, f"{LONG}, source string, reason string")
    return read.filter("reason IS NULL").drop("reason"), read.filter("reason IS NOT NULL").select("source", "reason")
