"""Residue in texts made here: copies in other lines, repeated text, and texts at the edge of the pre-tests."""

from weirflow.llm import residue
from weirflow.llm.residue_rules import has_slot


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")
    return sorted(tuple(r) for r in residue.residue(df).collect())


def test_p9_copies_of_labelled_texts_in_other_lines(spark):
    """A document without a label of its own has that of a text of the same words."""
    notice = "Please enable JavaScript to view the app that shows how settlement batches move between regional ledgers"
    slot = "Hello [insert name here], your report\nfor the templates is attached to this message."
    wrapped, flat = notice.replace("the app that", "the app\nthat"), slot.replace("\n", " ")
    assert has_slot(slot) and not has_slot(flat)
    assert found(spark, [wrapped]) == []
    assert found(spark, [notice, wrapped, slot, flat, "The run of the night ended without a fault."]) == [(1, "seed"), (2, "near"), (3, "slot"), (4, "slot")]


def test_p9_size_counts_distinct_shingles(spark):
    """A text that repeats itself and its shorter form: likeness 1."""
    short = "one two three four five " * 3
    df = spark.createDataFrame([(1, short), (2, short * 5)], "doc_id bigint, text string")
    nodes = residue.signed(df).withColumnRenamed("doc_id", "rep")
    pairs = residue.near_pairs(nodes.where("rep = 1"), nodes.where("rep = 2"))
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 0)]
    assert [tuple(r) for r in residue.alike(pairs, df).collect()] == [(1, 2)]


def test_p9_pre_tests_refuse_nothing_the_rules_find(spark):
    assert has_slot("(YOUR NAME HERE)") and has_slot("signed (your name here)")
    bodies = ["Pipelines | Alerts | Billing | Team\n\n404 Not Found", "Please enable JavaScript to see how settlement batches move between regional ledgers after midnight"]
    assert found(spark, bodies + ["Pipelines | Alerts | Billing | Team", "The run of the night ended without a fault."]) == [(1, "seed"), (2, "seed")]
