"""A subset of SPARQL 1.1 SELECT, compiled to DataFrames over the long view.

Supported: PREFIX, SELECT [DISTINCT], basic graph patterns with ``;`` ``,`` and ``a``,
FILTER, OPTIONAL, UNION, BIND, SERVICE (on a table given for its name), GROUP BY,
HAVING, aggregates, ORDER BY, LIMIT, OFFSET.

A term is one string, as in N-Triples: ``<iri>``, ``"text"``, ``"text"@lang`` or
``"text"^^<type>``; so joins compare whole terms, and a language tag tells literals
apart. Solutions are bags over the set of triples. Results hold lexical values.
A variable that OPTIONAL or UNION leaves unbound is compatible with any value, as the
standard has it: solutions join by the variables that are bound. But solutions that share
no bound variable are not multiplied: under OPTIONAL they stay as they are, elsewhere
they are left out.

``stored`` writes the view once, a folder per predicate, with the number of triples of
each, dealt by subject into buckets: a pattern with a predicate then reads that folder
alone, patterns of one subject are joined where they lie, and those that are small by
their number are broadcast. Subjects are joined from the smallest on.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(
    r"""\s*(?:\#[^\n]*\n\s*)*(?:(?P<iri><[^<>\s]*>)|(?P<var>[?$]\w+)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)
    |(?P<num>\d+(?:\.\d+)?)|(?P<prefixed>(?:[A-Za-z_][\w-]*)?:[\w-]*)|(?P<word>[A-Za-z_]\w*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}().;,=<>!+*/-]))""",
    re.X,
)
#: Triples of a stored pattern up to which it is sent to every executor.
BROADCAST_ROWS = 200_000
_AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "GROUP_CONCAT", "SAMPLE"}


class SparqlError(ValueError):
    pass


@dataclass
class Group:
    patterns: list[tuple] = field(default_factory=list)
    filters: list = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)
    unions: list[list[Group]] = field(default_factory=list)
    binds: list[tuple] = field(default_factory=list)
    services: list[tuple[str, Group]] = field(default_factory=list)


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip() + "\n"
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if m is None or m.end() == at:
            raise SparqlError(f"cannot read {text[at : at + 20]!r}")
        at = m.end()
        out.append((m.lastgroup, m[m.lastgroup]))
    return out


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.prefixes = tokenize(text), 0, {}

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def is_word(self, *words: str) -> bool:
        kind, value = self.peek()
        return kind == "word" and value.upper() in words

    def take(self, *values: str) -> str:
        kind, value = self.peek()
        if values and not (value in values or kind == "word" and value.upper() in values):
            raise SparqlError(f"{value!r} where one of {values} was expected")
        self.at += 1
        return value

    def accept(self, *values: str) -> bool:
        kind, value = self.peek()
        if value in values or kind == "word" and value.upper() in values:
            self.at += 1
            return True
        return False

    # terms
    def iri(self) -> str:
        kind, value = self.peek()
        self.at += 1
        if kind == "iri":
            return value[1:-1]
        if kind == "prefixed":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + local
        raise SparqlError(f"{value!r} is no IRI")

    def literal(self) -> str:
        raw = self.take()[1:-1]
        value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), raw)
        if self.peek()[0] == "lang":
            return f'"{value}"{self.take()}'
        if self.accept("^^"):
            return f'"{value}"^^<{self.iri()}>'
        return f'"{value}"'

    def term(self) -> tuple[str, str]:
        kind, value = self.peek()
        if kind == "var":
            self.at += 1
            return "var", value[1:]
        if kind == "text":
            return "term", self.literal()
        if kind == "word" and value == "a":
            self.at += 1
            return "term", f"<{RDF_TYPE}>"
        return "term", f"<{self.iri()}>"

    # groups
    def group(self) -> Group:
        out = Group()
        self.take("{")
        while not self.accept("}"):
            if self.accept("."):
                continue
            if self.accept("FILTER"):
                out.filters.append(self.primary())
            elif self.accept("OPTIONAL"):
                out.optionals.append(self.group())
            elif self.accept("SERVICE"):
                name = self.iri()
                out.services.append((name, self.group()))
            elif self.accept("BIND"):
                self.take("(")
                value = self.expression()
                self.take("AS")
                out.binds.append((self.take()[1:], value))
                self.take(")")
            elif self.peek()[1] == "{":
                parts = [self.group()]
                while self.accept("UNION"):
                    parts.append(self.group())
                out.unions.append(parts)
            else:
                self.same_subject(out)
        return out

    def same_subject(self, out: Group) -> None:
        subject = self.term()
        while True:
            predicate = self.term()
            while True:
                out.patterns.append((subject, predicate, self.term()))
                if not self.accept(","):
                    break
            if not self.accept(";"):
                break
            if self.peek()[1] in (".", "}"):
                break

    # expressions, loosest first
    def expression(self):
        left = self.conjunction()
        while self.accept("||"):
            left = ("||", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.comparison()
        while self.accept("&&"):
            left = ("&&", left, self.comparison())
        return left

    def comparison(self):
        left = self.sum()
        if self.peek()[1] in ("=", "!=", "<", ">", "<=", ">="):
            return (self.take(), left, self.sum())
        negated = self.is_word("NOT") and self.peek(1)[1].upper() == "IN"
        if negated:
            self.take()
        if self.accept("IN"):
            self.take("(")
            items = [self.expression()]
            while self.accept(","):
                items.append(self.expression())
            self.take(")")
            return ("!", ("in", left, items)) if negated else ("in", left, items)
        return left

    def sum(self):
        left = self.product()
        while self.peek()[1] in ("+", "-"):
            left = (self.take(), left, self.product())
        return left

    def product(self):
        left = self.primary()
        while self.peek()[1] in ("*", "/"):
            left = (self.take(), left, self.primary())
        return left

    def primary(self):
        kind, value = self.peek()
        if self.accept("!"):
            return ("!", self.primary())
        if self.accept("("):
            inner = self.expression()
            self.take(")")
            return inner
        if kind == "num":
            self.at += 1
            return ("num", float(value) if "." in value else int(value))
        if kind == "word" and value.upper() in ("TRUE", "FALSE"):
            self.at += 1
            return ("bool", value.upper() == "TRUE")
        if kind == "word" and self.peek(1)[1] == "(":
            return self.call(self.take().upper())
        return self.term()

    def call(self, name: str):
        self.take("(")
        distinct = self.accept("DISTINCT")
        args, separator = [], " "
        if self.accept("*"):
            args.append(("star",))
        while not self.accept(")"):
            if self.accept(";"):
                self.take("SEPARATOR")
                self.take("=")
                separator = self.literal()[1:-1]
            elif not self.accept(","):
                args.append(self.expression())
        return ("aggregate", name, args, distinct, separator) if name in _AGGREGATES else ("call", name, args)

    def select(self) -> dict:
        while self.accept("PREFIX"):
            prefix = self.take()
            self.prefixes[prefix.rstrip(":")] = self.take()[1:-1]
        self.take("SELECT")
        query = {"distinct": self.accept("DISTINCT"), "items": [], "group": [], "having": None, "order": [], "limit": None, "offset": 0}
        while not self.is_word("WHERE") and self.peek()[1] != "{":
            if self.accept("*"):
                query["items"] = None
            elif self.accept("("):
                value = self.expression()
                self.take("AS")
                query["items"].append((self.take()[1:], value))
                self.take(")")
            else:
                name = self.take()[1:]
                query["items"].append((name, ("var", name)))
        self.accept("WHERE")
        query["where"] = self.group()
        while self.peek()[0] != "end":
            if self.accept("GROUP"):
                self.take("BY")
                while self.peek()[0] == "var":
                    query["group"].append(self.take()[1:])
            elif self.accept("HAVING"):
                query["having"] = self.primary()
            elif self.accept("ORDER"):
                self.take("BY")
                while self.peek()[0] == "var" or self.is_word("ASC", "DESC") or self.peek()[1] == "(":
                    down = self.is_word("DESC")
                    if self.is_word("ASC", "DESC"):
                        self.take()
                    query["order"].append((self.primary(), down))
            elif self.accept("LIMIT"):
                query["limit"] = int(self.take())
            elif self.accept("OFFSET"):
                query["offset"] = int(self.take())
            else:
                raise SparqlError(f"{self.peek()[1]!r} was not expected")
        return query


def resource(name: Column) -> Column:
    """The term of an IRI."""
    return F.concat(F.lit("<"), name, F.lit(">"))


def predicates(text: str) -> set[str] | None:
    """IRIs of the predicates that a SELECT's patterns name, services apart; None if one is a variable. The
    solutions depend on no other triples."""

    def patterns(group: Group) -> list[tuple]:
        inner = [*group.optionals, *(g for union in group.unions for g in union)]
        return [*group.patterns, *(p for g in inner for p in patterns(g))]

    named = [p for _, p, _ in patterns(Parser(text).select()["where"])]
    return {value[1:-1] for _, value in named} if all(kind == "term" for kind, _ in named) else None


def encoded(rows: DataFrame) -> DataFrame:
    """Long rows (s, p, o, o_kind, o_datatype [, o_lang]) as a set of terms (s, p, o)."""
    return spelt(rows).distinct()


def spelt(rows: DataFrame) -> DataFrame:
    """Long rows as terms, each row for itself: a set if no two rows say the same."""
    lang = F.concat(F.lit("@"), F.col("o_lang")) if "o_lang" in rows.columns else F.lit(None).cast("string")
    literal = F.concat(F.lit('"'), F.col("o"), F.lit('"'), F.coalesce(lang, F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">")), F.lit("")))
    iri = lambda c: resource(F.col(c))
    return rows.select(iri("s").alias("s"), iri("p").alias("p"), F.when(F.col("o_kind") == "iri", iri("o")).otherwise(literal).alias("o"))


def lexical(term: Column) -> Column:
    """STR: the IRI or the literal's text."""
    return F.when(term.startswith("<"), F.substring(term, F.lit(2), F.char_length(term) - 2)).otherwise(F.regexp_extract(term, r'(?s)^"(.*)"[^"]*$', 1))


def _language(term: Column) -> Column:
    return F.when(term.startswith('"'), F.regexp_extract(term, r'"@([A-Za-z0-9-]+)$', 1))


@dataclass
class Value:
    """A column of terms ("term"), of texts ("text"), numbers ("num") or truth values ("bool")."""

    kind: str
    column: Column

    def text(self) -> Column:
        return lexical(self.column) if self.kind == "term" else self.column.cast("string")

    def number(self) -> Column:
        return self.column if self.kind == "num" else self.text().try_cast("double")


@dataclass
class Stored:
    """Triples by predicate, and how many of each."""

    triples: DataFrame
    sizes: dict[str, int]


def stored(triples: DataFrame, folder: str, buckets: int | None = None) -> Stored:
    """Terms (s, p, o), a set, written to ``folder`` by predicate, each in ``buckets`` by subject. There are
    as many sizes as predicates, a vocabulary's."""
    buckets = buckets or triples.sparkSession.sparkContext.defaultParallelism
    return _kept(triples.repartition(buckets, "s"), folder, buckets)


def stored_parts(parts: list[tuple[DataFrame, Column, Callable[[DataFrame], DataFrame]]], folder: str, buckets: int) -> Stored:
    """``stored`` of parts (compact rows, the subject's term, what makes terms of the rows): the compact
    rows are dealt by subject and spelt out where they are written, so that no term is shuffled. All terms
    of a row have its subject, and no two rows say the same."""
    dealt = [spell(rows.repartition(buckets, subject)) for rows, subject, spell in parts]
    return _kept(reduce(lambda a, b: a.unionByName(b), dealt), folder, buckets)


def _kept(dealt: DataFrame, folder: str, buckets: int) -> Stored:
    """A task has one bucket's rows, so a bucket is one file for each predicate and part."""
    spark, name = dealt.sparkSession, f"terms_{uuid.uuid4().hex}"
    dealt.select("s", "o", "p").write.partitionBy("p").bucketBy(buckets, "s").option("path", folder).format("parquet").saveAsTable(name)
    read = spark.table(name).select("s", "p", "o")
    return Stored(read, {r["p"]: r["n"] for r in read.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()})


class Compiler:
    def __init__(self, triples: DataFrame, services: dict[str, DataFrame] | None = None, sizes: dict[str, int] | None = None):
        self.triples, self.services, self.sizes = triples, services or {}, sizes
        self.maybe: set[str] = set()  # variables that some solution may leave unbound

    def size(self, pattern: tuple) -> float:
        """How many triples a pattern matches at most; a given subject or object counts as a hundredth."""
        if self.sizes is None:
            return 0.0
        (s, _), (p, name), (o, _) = pattern
        n = self.sizes.get(name, 0) if p == "term" else sum(self.sizes.values())
        return n * 0.01 ** ((s == "term") + (o == "term"))

    def joined(self, rows: DataFrame, other: DataFrame, how: str = "inner", conditions: Callable[[], list[Column]] = list) -> DataFrame:
        """Join of compatible solutions: equal where both are bound."""
        common = [c for c in other.columns if c in rows.columns]
        sure = [c for c in common if c not in self.maybe]
        if not sure and len(common) == 1:
            sure = common
        elif not sure:
            raise SparqlError(f"solutions that share only variables which may be unbound: {', '.join(common)}")
        if sure == common and how == "inner":
            return rows.join(other, common)
        renamed = other.select(*[F.col(c).alias(f"_{c}") if c in common else F.col(c) for c in other.columns])
        on = [F.col(c) == F.col(f"_{c}") if c in sure else (F.col(c) == F.col(f"_{c}")) | F.col(c).isNull() | F.col(f"_{c}").isNull() for c in common] + conditions()
        both = rows.join(renamed, reduce(lambda a, b: a & b, on), how)
        merged = [F.coalesce(c, f"_{c}").alias(c) if c in common and c not in sure else F.col(c) for c in rows.columns]
        return both.select(*merged, *[c for c in renamed.columns if c not in {f"_{x}" for x in common}])

    def pattern(self, triples: DataFrame, pattern: tuple) -> DataFrame:
        rows, names = triples, {}
        for column, (kind, value) in zip("spo", pattern, strict=True):
            if kind == "term":
                rows = rows.filter(F.col(column) == value)
            elif value in names:
                rows = rows.filter(F.col(column) == F.col(names[value]))
            else:
                names[value] = column
        if not names:
            raise SparqlError("a pattern without a variable")
        return rows.select(*[F.col(c).alias(n) for n, c in names.items()])

    def by_subject(self, patterns: list[tuple], triples: DataFrame) -> list[DataFrame]:
        """Solutions of patterns; those of one subject are joined, since stored triples lie by subject."""
        if self.sizes is None or triples is not self.triples:
            return [self.pattern(triples, p) for p in patterns]
        stars: dict[tuple, list[tuple]] = {}
        for p in patterns:
            stars.setdefault(p[0] if p[0][0] == "var" else p, []).append(p)
        alone = lambda p: F.broadcast(self.pattern(triples, p)) if self.size(p) <= BROADCAST_ROWS else self.pattern(triples, p)
        return [alone(star[0]) if len(star) == 1 else reduce(self.joined, [self.pattern(triples, p) for p in star]) for star in stars.values()]

    def group(self, group: Group, triples: DataFrame, filtered: bool = True) -> tuple[DataFrame, dict[str, str]]:
        """(solutions, kind of each variable). Patterns of one subject are joined first, then those that share variables."""
        parts = self.by_subject(sorted(group.patterns, key=self.size), triples)
        kinds: dict[str, str] = {c: "term" for p in parts for c in p.columns}
        for union in group.unions:
            sides = [self.group(g, triples) for g in union]
            self.maybe |= {c for s, _ in sides for c in s.columns if any(c not in x.columns for x, _ in sides)}
            parts.append(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s for s, _ in sides]))
            for _, k in sides:
                kinds |= k
        for name, inner in group.services:
            if name not in self.services:
                raise SparqlError(f"no table is given for service {name}")
            rows, k = self.group(inner, self.services[name])
            parts.append(rows)
            kinds |= k
        if not parts:
            raise SparqlError("a group without a pattern")
        rows = parts.pop(0)
        while parts:
            i = next((i for i, p in enumerate(parts) if set(p.columns) & set(rows.columns)), None)
            if i is None:
                raise SparqlError("patterns that share no variable")
            rows = self.joined(rows, parts.pop(i))
        for optional in group.optionals:
            rows = self.optional(rows, kinds, optional, triples)
        for name, value in group.binds:
            v = self.value(value, kinds)
            rows, kinds[name] = rows.withColumn(name, v.column), v.kind
        if filtered:
            for condition in group.filters:
                rows = rows.filter(self.value(condition, kinds).column)
        return rows, kinds

    def optional(self, rows: DataFrame, kinds: dict[str, str], inner: Group, triples: DataFrame) -> DataFrame:
        """Left join; the group's filters are part of the join's condition."""
        before = set(rows.columns)
        other, k = self.group(inner, triples, filtered=False)
        kinds |= k
        out = self.joined(rows, other, "left", lambda: [self.value(f, kinds).column for f in inner.filters])
        self.maybe |= set(other.columns) - before
        return out

    def value(self, e: tuple, kinds: dict[str, str]) -> Value:
        kind = e[0]
        if kind == "var":
            if e[1] not in kinds:
                return Value("term", F.lit(None).cast("string"))
            return Value(kinds[e[1]], F.col(e[1]))
        if kind == "term":
            return Value("term", F.lit(e[1]))
        if kind in ("num", "bool"):
            return Value(kind, F.lit(e[1]))
        if kind == "!":
            return Value("bool", ~self.value(e[1], kinds).column)
        if kind in ("&&", "||"):
            a, b = (self.value(x, kinds).column for x in e[1:])
            return Value("bool", a & b if kind == "&&" else a | b)
        if kind == "in":
            return Value("bool", reduce(lambda a, b: a | b, [self.value(("=", e[1], x), kinds).column for x in e[2]]))
        if kind in ("=", "!=", "<", ">", "<=", ">="):
            return Value("bool", self.compare(kind, *(self.value(x, kinds) for x in e[1:])))
        if kind in ("+", "-", "*", "/"):
            a, b = (self.value(x, kinds).number() for x in e[1:])
            return Value("num", {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[kind])
        if kind == "aggregate":
            return self.aggregate(e, kinds)
        return self.call(e[1], [self.value(x, kinds) for x in e[2]])

    def compare(self, op: str, a: Value, b: Value) -> Column:
        if "num" in (a.kind, b.kind):
            x, y = a.number(), b.number()
        elif a.kind == b.kind == "bool" or (op in ("=", "!=") and a.kind == b.kind == "term"):
            x, y = a.column, b.column
        else:
            x, y = a.text(), b.text()
        return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    def call(self, name: str, args: list[Value]) -> Value:
        text = [a.text() for a in args]
        if name == "SUBSTR":
            length = args[2].column if len(args) > 2 else F.char_length(text[0])
            return Value("text", F.substring(text[0], args[1].column, length))
        if name == "IF":
            same = args[1].kind == args[2].kind
            return Value(args[1].kind if same else "text", F.when(args[0].column, args[1].column if same else text[1]).otherwise(args[2].column if same else text[2]))
        if name == "COALESCE":
            return Value("text", F.coalesce(*text))
        if name == "REGEX":
            pattern = F.concat(F.lit("(?i)"), text[1]) if len(args) > 2 else text[1]
            return Value("bool", F.regexp(text[0], pattern))
        known = {
            "STR": ("text", lambda: text[0]), "LCASE": ("text", lambda: F.lower(text[0])), "UCASE": ("text", lambda: F.upper(text[0])), "CONCAT": ("text", lambda: F.concat(*text)),
            "LANG": ("text", lambda: _language(args[0].column)), "STRLEN": ("num", lambda: F.char_length(text[0])), "BOUND": ("bool", lambda: args[0].column.isNotNull()),
            "CONTAINS": ("bool", lambda: F.contains(text[0], text[1])), "STRSTARTS": ("bool", lambda: F.startswith(text[0], text[1])), "STRENDS": ("bool", lambda: F.endswith(text[0], text[1])),
            "ISIRI": ("bool", lambda: args[0].column.startswith("<")), "ISURI": ("bool", lambda: args[0].column.startswith("<")), "ISLITERAL": ("bool", lambda: args[0].column.startswith('"')),
        }
        if name not in known:
            raise SparqlError(f"unknown function {name}")
        kind, make = known[name]
        return Value(kind, make())

    def aggregate(self, e: tuple, kinds: dict[str, str]) -> Value:
        _, name, args, distinct, separator = e
        if args == [("star",)]:
            return Value("num", F.count(F.lit(1)))
        v = self.value(args[0], kinds)
        if name == "COUNT":
            return Value("num", F.countDistinct(v.column) if distinct else F.count(v.column))
        if name == "GROUP_CONCAT":
            gathered = F.collect_set(v.text()) if distinct else F.collect_list(v.text())
            return Value("text", F.array_join(F.sort_array(gathered), separator))
        if name in ("MIN", "MAX", "SAMPLE"):
            return Value(v.kind, F.max(v.column) if name == "MAX" else F.min(v.column))
        number = v.number()
        return Value("num", {"SUM": F.sum_distinct if distinct else F.sum, "AVG": F.avg}[name](number))

    def select(self, query: dict) -> DataFrame:
        rows, kinds = self.group(query["where"], self.triples)
        items = query["items"] if query["items"] is not None else [(c, ("var", c)) for c in rows.columns]
        grouped = query["group"] or any(_has_aggregate(v) for _, v in items)
        if grouped:
            extra = [(f"_order{i}", v) for i, (v, _) in enumerate(query["order"]) if _has_aggregate(v)]
            values = {n: self.value(v, kinds) for n, v in [*items, *extra] if v != ("var", n) or n not in query["group"]}
            aggs = [v.column.alias(n) for n, v in values.items()]
            if query["having"] is not None:
                aggs.append(self.value(query["having"], kinds).column.alias("_having"))
            rows = rows.groupBy(*query["group"]).agg(*aggs)
            if query["having"] is not None:
                rows = rows.filter("_having")
            kinds = {n: kinds[n] for n in query["group"]} | {n: v.kind for n, v in values.items()}
            orders = [(("var", f"_order{i}") if _has_aggregate(v) else v, d) for i, (v, d) in enumerate(query["order"])]
        else:
            for name, value in items:
                v = self.value(value, kinds)
                rows, kinds[name] = rows.withColumn(name, v.column), v.kind
            orders = query["order"]
        names = [n for n, _ in items]
        # lexical values: what a result set shows
        shown = {n: Value(kinds[n], F.col(n)) for n in names if n in rows.columns}
        plain = [(v.text() if v.kind == "term" else v.column).alias(n) for n, v in shown.items()] + [F.lit(None).cast("string").alias(n) for n in names if n not in shown]
        keys = []
        for value, down in orders:
            v = self.value(value, kinds)
            keys.append((v.text() if v.kind == "term" else v.column, down))
        rows = rows.select(*plain, *[k.alias(f"_key{i}") for i, (k, _) in enumerate(keys)])
        if query["distinct"]:
            rows = rows.distinct()
        if keys:
            rows = rows.orderBy(*[F.col(f"_key{i}").desc_nulls_last() if d else F.col(f"_key{i}").asc_nulls_first() for i, (_, d) in enumerate(keys)], *names)
        if query["offset"]:
            rows = rows.offset(query["offset"])
        if query["limit"] is not None:
            rows = rows.limit(query["limit"])
        return rows.select(*names)


def _has_aggregate(e) -> bool:
    return isinstance(e, tuple) and (e[:1] == ("aggregate",) or any(_has_aggregate(x) for x in e[1:])) or isinstance(e, list) and any(map(_has_aggregate, e))


def sparql(triples: DataFrame | Stored, text: str, services: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a SELECT over terms (s, p, o), as ``encoded`` gives them, or ``stored`` ones."""
    rows, sizes = (triples.triples, triples.sizes) if isinstance(triples, Stored) else (triples, None)
    return Compiler(rows, services, sizes).select(Parser(text).select())
