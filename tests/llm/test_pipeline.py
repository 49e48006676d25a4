import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, surrogates

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage on all that the one before kept; plain versions of the middle stages agree."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], FOLDER)
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert len(corpus_pipeline.STAGES) == 5
    assert all(k.columns == docs.columns for k in kept[:-1])
    counts = [k.count() for k in kept]
    assert counts[0] >= counts[1] >= 0.97 * counts[0] and counts[1] > counts[2]
    # near duplicates: one of each class, found by brute force
    sets = {}
    for r in kept[1].collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    ids, parent = sorted(sets), {}
    for b in ids:
        parent[b] = b
        for a in ids:
            if a >= b:
                break
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = a, b
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in kept[2].collect()) == [i for i in ids if parent[i] == i]
    # personal data: the text of each row is what the plain function makes of it
    s = surrogates.Surrogates()
    before = {r.doc_id: r.text for r in kept[2].collect()}
    assert all(r.text == surrogates.replace(before[r.doc_id], s)[0] for r in kept[3].collect())
    words = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words(kept[4]) == pytest.approx(1.5 * words(kept[3]), rel=0.02)
    assert kept[5].agg(F.sum("length")).first()[0] > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).select("sequence_id").distinct().count() > 10


def odd_rows(spark, empty=False):
    """Real documents with null and blank texts, null ids and sources, repeated rows, and columns of working names."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0 if empty else 120)
    nulls = docs.filter("doc_id % 7 = 0").withColumn("text", F.lit(None).cast("string"))
    blanks = docs.filter("doc_id % 7 = 1").withColumn("text", F.lit(" \n"))
    loose = docs.filter("doc_id % 7 = 2").withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)).withColumn("source", F.lit(None).cast("string"))
    out = docs.unionByName(nulls).unionByName(blanks).unionByName(loose).unionByName(docs.filter("doc_id % 7 = 3"))
    for name in ("row", "doc", "whole", "cuts", "use", "node", "_node", "_keeps", "lang_pred", "score", "same", "copy", "skey"):
        out = out.withColumn(name, F.lit("clash"))
    return out


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_through_all_stages(spark, tmp_path, empty):
    kept = [odd_rows(spark, empty)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], FOLDER).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert all(k.columns == kept[0].columns for k in kept[:-1])
    if empty:
        assert all(k.count() == 0 for k in kept)
        return
    assert kept[1].filter("text is null or trim(text) = ''").count() == 0
    assert kept[2].filter("doc_id is null").count() == kept[1].filter("doc_id is null").count() > 0
    assert kept[2].filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").count() == 0
    assert kept[4].filter("row != 'clash'").count() == 0 < kept[4].count()
    assert kept[5].agg(F.sum("length")).first()[0] > 0


def test_copies_are_dropped(documents):
    assert jaccard_join.one_of_each(documents).count() < documents.count()
