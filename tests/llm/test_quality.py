import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_classifier, quality_rules


def brute(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


ODD = ["a b c d e f g h\n" * 5, "x\n\nx\n \n \nx", "###", "\n", "é|è " * 30, "w1 w2 w3 w4 w5 w6 w7 w8 " * 3 + " ".join(f"u{i}" for i in range(90))]


def test_counts_equal_brute_force(spark, documents, rows_of):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    texts = {i: t for i, t, *_ in rows_of} | {1000 + i: t for i, t in enumerate(ODD)}
    got = quality_rules.judge(documents.select("doc_id", "text").unionByName(extra)).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == {i: brute(t) for i, t in texts.items()}


GOOD = "The river ran past the old stone mill and on to the sea.\nNobody had seen it so high in thirty years, they said."
LINES = [
    ("Home | News | Sport | Contact | About", True), ("Skip to content", True), ("Released under the MIT License.", True), ("WIN!! NOW!! FREE!!", True), ("wo$$$ rd%%% an###", True),
    ("a short tail", True), ("A short sentence.", False), ("a longer line of nine words without any mark", False), ("He said “stop!”", False), ("価格は安い。", False), ("cats | dogs", True),
    ("the licence says it is licensed under the terms that were agreed on by all of the parties in the month of June.", False),
]


@pytest.mark.parametrize(("line", "fails"), LINES)
def test_line_rules(line, fails):
    counts, spans = quality_rules.measure([f"{GOOD}\n{line}\n{GOOD}".encode()])
    assert counts["n_lines_removed"][0] == int(fails)
    if fails:
        a, b = spans[0][0]
        assert f"{GOOD}\n{line}\n{GOOD}".encode()[a:b].decode() == line


def test_clean_removes_lines_and_rejects_documents(spark):
    good = " ".join(f"Sentence number {i} speaks of other things." for i in range(9))
    more = " ".join(f"Another line {i * 7} is about that and this." for i in range(9))
    rows = [(1, f"{good}\nHome | News | Sport\n{more}", "k"), (2, "\n".join(f"Item{i} | Item | Item" for i in range(40)), "k"), (3, None, "k"), (4, good, None)]
    got = {r.doc_id: (r.text, r.kept) for r in quality_rules.clean(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()}
    assert got == {1: (f"{good}\n{more}", "k"), 4: (good, None)}


def test_rules_edge_cases(clashing, nothing):
    assert quality_rules.judge(clashing.unionByName(clashing)).count() == 2 * clashing.count()
    assert quality_rules.judge(nothing).count() == 0 and quality_rules.clean(nothing).count() == 0


def junk(i):
    return " ".join(f"WORD{(i * k) % 9}!!" for k in range(40))


def clean_text(i):
    return " ".join(f"calm water flows by house {i % 7} and {k}." for k in range(8))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, (junk if i % 3 == 0 else clean_text)(i)) for i in range(300)] + [(900, None), (901, ""), (902, "x" * 300_000)]
    labels = [(i, int(i % 3 != 0)) for i in range(300)] + [(5, 1), (901, None), (None, 1), (7, 9)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_classifier_on_held_out_rows(labelled):
    documents, labels = labelled
    got = {r.doc_id: r for r in quality_classifier.classify(documents.withColumn("score", F.lit("clash")), labels).collect()}
    assert len(got) == 303
    held = [r for i, r in got.items() if r.held_out and i < 300]
    assert len(held) > 30 and all(r.predicted == int(r.doc_id % 3 != 0) for r in held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[900].score == got[901].score


def test_classifier_without_labels(labelled, nothing):
    documents, labels = labelled
    none = quality_classifier.classify(documents.limit(5), labels.filter("quality > 5"))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality_classifier.classify(nothing, labels).count() == 0


def test_scores_are_exact_cosine_votes():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 103, 80, dtype=np.uint8)) for _ in range(60)]
    labels = np.arange(60) % 2
    model = quality_classifier.LatentVoter.fit(quality_classifier.trigram_counts(texts), labels)
    z = model.weigh(quality_classifier.trigram_counts(texts[:5]), model.idf) @ model.basis
    cosine = (z / np.linalg.norm(z, axis=1, keepdims=True)) @ model.vectors.T
    for row, got in zip(cosine, model.score(texts[:5]), strict=True):
        near = np.argsort(-row)[: quality_classifier.NEIGHBOURS]
        weight = np.maximum(row[near], 0) ** quality_classifier.SHARPNESS
        assert abs((weight * labels[near]).sum() / weight.sum() - got) < 1e-5


def test_the_model_does_not_depend_on_the_order_of_repeated_ids(spark):
    """Rows that share an id: the least text is learnt from, whatever comes first; the sample holds one row an id."""
    from tessera.llm import quality_classifier

    texts = ["good prose about rivers and stones " * 3, "buy now!!! cheap $$$ " * 5]
    rows = [(i, texts[i % 2]) for i in range(40)] + [(i, f"other text {i} " * 4) for i in range(0, 40, 3)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    one, two = (spark.createDataFrame(x, "doc_id long, text string").coalesce(1) for x in (rows, rows[::-1]))
    scores = [{(r.doc_id, round(r.score, 9)) for r in quality_classifier.classify(df, labels).collect()} for df in (one, two)]
    assert scores[0] == scores[1]


def test_lines_that_polynomials_confuse(spark, lookalike):
    """Lines and words that differ everywhere are not taken for equal."""
    one, other = lookalike
    rows = [(0, f"{one}\n{other}"), (1, " ".join([*[one, "x"] * 4, *[other, "x"] * 4])), (2, f"{one}\n{one}")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_dup_lines for i in range(3)] == [0, 0, 1]
    assert got[1].n_repeat_words == 0
