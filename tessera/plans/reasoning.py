"""What the vocabulary entails: super-properties, inverses, symmetry, and transitive closure.

Closure is semi-naive: each round joins only the pairs that the round before found with
all pairs found so far, so that lengths double and a chain of n edges takes about log n
rounds; pairs known already are left out. Every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import SUPER_PROPERTIES
from ..session import written

#: Of the public vocabularies that the super-properties are from.
INVERSES = {"dcterms:isPartOf": "dcterms:hasPart", "skos:broader": "skos:narrower"}
SYMMETRIC = ("skos:related",)
#: A transitive property above others.
TRANSITIVE = {"skos:broader": "skos:broaderTransitive", "dcterms:isPartOf": "dcterms:isPartOf"}


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (from_name, to_name) joined by one edge or more, cycles included."""
    known = written(edges.select("from_name", "to_name").filter("from_name IS NOT NULL AND to_name IS NOT NULL").distinct(), "closure")
    delta = known
    while True:
        left = delta.select("from_name", F.col("to_name").alias("mid")).join(known.select(F.col("from_name").alias("mid"), "to_name"), "mid")
        right = known.select("from_name", F.col("to_name").alias("mid")).join(delta.select(F.col("from_name").alias("mid"), "to_name"), "mid")
        found = left.unionByName(right).select("from_name", "to_name").distinct()
        delta = written(found.join(known, ["from_name", "to_name"], "left_anti"), "closure-new")
        if not delta.limit(1).count():
            return known
        known = written(known.unionByName(delta), "closure")


def entailed(edges: DataFrame) -> DataFrame:
    """Edges (subj_name, predicate, obj_name) and all that the vocabulary says of them, each once.

    A predicate with a super-property also says that; an inverse or symmetric property is
    also said the other way round, and transitive ones are closed.
    """
    supers = F.create_map(*[F.lit(x) for pair in SUPER_PROPERTIES.items() for x in pair])
    inverses = F.create_map(*[F.lit(x) for a, b in INVERSES.items() for x in (a, b, b, a)])
    own = edges.select("subj_name", "predicate", "obj_name").distinct()
    raised = own.select("subj_name", F.coalesce(supers[F.col("predicate")]).alias("predicate"), "obj_name").filter("predicate IS NOT NULL")
    turned = raised.withColumn("other", F.when(F.col("predicate").isin(*SYMMETRIC), F.col("predicate")).otherwise(inverses[F.col("predicate")])).filter("other IS NOT NULL")
    said = written(raised.unionByName(turned.select(F.col("obj_name").alias("subj_name"), F.col("other").alias("predicate"), F.col("subj_name").alias("obj_name"))).distinct(), "entailed")
    out = own.unionByName(said)
    for below, above in TRANSITIVE.items():
        pairs = closure(said.filter(F.col("predicate") == below).select(F.col("subj_name").alias("from_name"), F.col("obj_name").alias("to_name")))
        out = out.unionByName(pairs.select(F.col("from_name").alias("subj_name"), F.lit(above).alias("predicate"), F.col("to_name").alias("obj_name")))
        if above in INVERSES:
            out = out.unionByName(pairs.select(F.col("to_name").alias("subj_name"), F.lit(INVERSES[above]).alias("predicate"), F.col("from_name").alias("obj_name")))
    return out.distinct()
