import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "été", "straße", "naïve", "plate", "of", "the", "and", "river", "stone", "cloud", "日本", "done."]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(40)) if r.random() < 0.5 else "") for _ in range(n))


def corpus():
    """Short documents with copies, near copies, shared passages, nulls, blanks and one long text."""
    passage = prose("passage", 60)
    texts = [prose(i, 30 + 7 * i) for i in range(25)]
    texts += [texts[20], texts[20], texts[21].replace("river", "brook", 1), texts[22] + " tail", passage + "\n" + prose("p1", 40), prose("p2", 40) + "\n" + passage]
    texts += [None, "", "  \n\t ", "one", "one", "a b c", prose("long", 4000), "x" * 700, "ab" * 300]
    langs, sources = ["en", "fr", None], ["src0", "src0", "src1", None, "Src2"]
    return [(i, t, langs[i % 3], sources[i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows_of():
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, rows_of):
    return spark.createDataFrame(rows_of, SCHEMA)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same rows with columns named like working columns of the operators."""
    from pyspark.sql import functions as F

    out = documents
    for name in ("key", "size", "score", "block", "taken", "node", "path", "length", "copies", "group", "rank", "bucket", "shard", "anchor", "spans", "n", "m"):
        out = out.withColumn(name, F.lit("clash"))
    return out


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lookalikes(n):
    """Two strings of n letters that differ everywhere, yet whose polynomial hashes modulo 2**64 are equal for any odd base from 1,024 on."""
    one = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.fixture(params=[1024, 4096])
def lookalike(request):
    return lookalikes(request.param)
