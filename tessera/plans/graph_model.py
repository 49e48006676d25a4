"""From facts to the graph: reified rows, the long view, edges and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import TERM, iri, message_iri, slug

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
CREATED = "http://purl.org/dc/terms/created"
MODIFIED = "http://purl.org/dc/terms/modified"
TITLE = "http://purl.org/dc/terms/title"
DESCRIPTION = "http://purl.org/dc/terms/description"
CONTENT = "http://rdfs.org/sioc/ns#content"
CREATOR = "http://rdfs.org/sioc/ns#has_creator"
CONTAINER = "http://rdfs.org/sioc/ns#has_container"
ASSOCIATED = "http://www.w3.org/ns/prov#wasAssociatedWith"
DATE_TIME = "http://www.w3.org/2001/XMLSchema#dateTime"


def _rows(df: DataFrame, subject, triples: list[tuple], also: tuple[str, ...] = ()) -> DataFrame:
    """Long rows (s, p, o, o_kind, o_datatype) of several statements about each row, in one scan.

    A statement with a null object is left out.
    """
    parts = [
        F.struct(subject.alias("s"), F.lit(p).alias("p") if isinstance(p, str) else p.alias("p"), o.cast("string").alias("o"), F.lit("iri" if kind == "iri" else "literal").alias("o_kind"), F.lit(DATE_TIME if kind == "time" else None).cast("string").alias("o_datatype"))
        for p, o, kind in triples
    ]
    kept = [c for c in also if c in df.columns]
    return df.select(*kept, F.explode(F.array(*parts)).alias("t")).select(*kept, "t.*").filter("s is not null and o is not null")


def _fact_parts(facts: DataFrame) -> list[tuple]:
    """(rows, subject, statements, whether each row has a subject of its own) of each kind of statement;
    no two of them, or of their rows, say the same.

    ``facts`` are distinct by triple id. An entity's label is its least name (several
    names may have one slug).
    """
    term = lambda name: f"{TERM}{name}"
    subject, object_ = iri("entity", F.col("subj")), iri("entity", F.col("obj"))
    kinds = lambda name: F.lit(term(name))
    both = lambda *columns: F.explode(F.array(*[F.struct(*[F.col(c).alias(c.replace("subj", "entity").replace("obj", "entity")) for c in (r, *(f"{r}{x}" for x in columns))]) for r in ("subj", "obj")])).alias("e")
    reified = [
        (RDF_TYPE, kinds("KnowledgeTriple"), "iri"), (term("tripleSubject"), subject, "iri"), (term("tripleObject"), object_, "iri"),
        (term("triplePredicateLabel"), F.col("predicate"), "text"), (term("extractedFrom"), message_iri(F.col("message_id").cast("string")), "iri"),
        (term("extractedInSession"), iri("session", slug(F.col("session").cast("string"))), "iri"),
    ]
    mentions = facts.select("message_id", both()).select("message_id", "e.entity").distinct()
    entities = facts.select(both("_name")).groupBy("e.entity").agg(F.min("e.entity_name").alias("name"))
    entity = iri("entity", F.col("entity"))
    return [
        (facts, iri("triple", F.col("triple_id")), reified, True),
        (facts.select("subj", "predicate", "obj").distinct(), subject, [(F.concat(F.lit(TERM), F.col("predicate")), object_, "iri")], False),
        (mentions, message_iri(F.col("message_id").cast("string")), [(term("mentionsTopic"), entity, "iri")], False),
        (entities, entity, [(RDF_TYPE, kinds("Entity"), "iri"), (LABEL, F.col("name"), "text")], True),
    ]


def fact_rows(facts: DataFrame) -> DataFrame:
    """The statements of facts: entities and labels, direct edges, reified facts, mentions. A set."""
    out, *more = (_rows(*part[:3]) for part in _fact_parts(facts))
    for rows in more:
        out = out.unionByName(rows)
    return out


def fact_row_parts(facts: DataFrame, predicates: set[str] | None = None) -> list[tuple]:
    """``fact_rows`` not yet spelt out: (compact rows, their subject, what makes long rows of them) of each
    kind of statement; only those with one of ``predicates``, if given."""
    parts = []
    for rows, subject, statements, _ in _fact_parts(facts):
        if predicates is not None:
            for p, _, _ in statements:
                rows = rows if isinstance(p, str) else rows.filter(p.isin(*predicates))
            statements = [x for x in statements if not isinstance(x[0], str) or x[0] in predicates]
        if statements:
            parts.append((rows, subject, lambda dealt, subject=subject, statements=statements: _rows(dealt, subject, statements)))
    return parts


def fact_row_count(facts: DataFrame) -> DataFrame:
    """How many rows ``fact_rows`` has (triples), counted before they are spelt out."""
    counted = [
        rows.agg(sum((F.count(F.when(subject.isNotNull() & o.isNotNull(), 1)) for _, o, _ in statements), F.lit(0)).alias("n"))
        for rows, subject, statements, _ in _fact_parts(facts)
    ]
    out, *more = counted
    for rows in more:
        out = out.unionByName(rows)
    return out.agg(F.sum("n").alias("triples"))


def fact_row_summary(facts: DataFrame) -> DataFrame:
    """Per predicate and kind of object of ``fact_rows``: rows (n), subjects, and the least object.

    Each kind of statement is summed up where its facts are, without spelling out the rows:
    first by subject, so that subjects are counted and not told apart again.
    """
    sums = []
    for rows, subject, statements, own in _fact_parts(facts):
        for p, o, kind in statements if not own else []:
            (of,) = {"message_id", "subj"} & set(rows.columns)
            key = [c for c in (of, "predicate") if c in rows.columns]
            value = F.when(subject.isNotNull(), o.cast("string"))
            said = rows.groupBy(*key).agg(F.count(value).alias("n"), F.min(value).alias("least_object")).filter("n > 0")
            named = said.select((F.lit(p) if isinstance(p, str) else p).alias("p"), F.lit("iri" if kind == "iri" else "literal").alias("o_kind"), "n", "least_object")
            sums.append(named.groupBy("p", "o_kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("subjects"), F.min("least_object").alias("least_object")))
        if own:
            each = []
            for i, (p, o, kind) in enumerate(statements):
                o = F.when(subject.isNotNull(), o.cast("string"))
                each += [F.count(o).alias(f"n{i}"), F.min(o).alias(f"least{i}")]
            summed = rows.agg(*each)
            kinds = [F.struct(F.lit(p).alias("p"), F.lit("iri" if kind == "iri" else "literal").alias("o_kind"), F.col(f"n{i}").alias("n"), F.col(f"n{i}").alias("subjects"), F.col(f"least{i}").alias("least_object")) for i, (p, _, kind) in enumerate(statements)]
            sums.append(summed.select(F.explode(F.array(*kinds)).alias("k")).select("k.*").filter("n > 0"))
    out, *more = sums
    for part in more:
        out = out.unionByName(part)
    # subjects of different kinds of statement are different resources
    return out.groupBy("p", "o_kind").agg(F.sum("n").alias("n"), F.sum("subjects").alias("subjects"), F.min("least_object").alias("least_object"))


def slug_collisions(facts: DataFrame) -> DataFrame:
    """Entities whose slug stands for several names."""
    named = facts.select(F.explode(F.array(F.struct(F.col("subj").alias("entity"), F.col("subj_name").alias("name")), F.struct(F.col("obj").alias("entity"), F.col("obj_name").alias("name")))).alias("e")).select("e.*")
    return named.distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("names"), F.min("name").alias("label")).filter("names > 1")


def n_triples(rows: DataFrame, *also: str) -> DataFrame:
    """One N-Triples line per long row, beside the columns ``also``."""
    escaped = F.col("o")
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(char), F.lit(code))
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">")), F.lit("")))
    resource = F.concat(F.lit("<"), F.col("o"), F.lit(">"))
    return rows.select(*also, F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), F.when(F.col("o_kind") == "iri", resource).otherwise(literal), F.lit(" .")).alias("value"))


def paths(edges: DataFrame, start: str, hops: int = 3) -> DataFrame:
    """Extension: simple paths of up to ``hops`` edges from an entity (by name)."""
    step = edges.select(F.col("subj_name").alias("from_name"), F.col("predicate").alias("by"), F.col("obj_name").alias("to_name")).distinct()
    front = step.filter(F.col("from_name") == start).select(F.lit(1).alias("hops"), F.concat_ws(" ", "from_name", "by", "to_name").alias("path"), F.array("from_name", "to_name").alias("seen"), F.col("to_name").alias("end"))
    found = front
    for n in range(2, hops + 1):
        front = (
            front.join(step, F.col("end") == F.col("from_name")).filter(~F.array_contains("seen", F.col("to_name")))
            .select(F.lit(n).alias("hops"), F.concat_ws(" ", "path", "by", "to_name").alias("path"), F.array_append("seen", F.col("to_name")).alias("seen"), F.col("to_name").alias("end"))
        )
        found = found.unionByName(front)
    return found.select("hops", "path", F.col("end").alias("end_name"))
