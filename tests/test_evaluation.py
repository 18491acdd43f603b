"""The gate over classes by hand."""

import pytest

from factloom.operators import evaluation


@pytest.mark.parametrize("examples, classes, support, threshold, status, problems", [
    (20, 2, 1, 0.5, "pass", []), (20, 2, 1, 0.9, "fail", []), (5, 2, 1, 0.5, "insufficient_data", []), (20, 3, 1, 0.5, "insufficient_data", ["too_few_classes:family", "too_few_classes:type"]),
    (20, 2, 2, 0.5, "insufficient_data", ["low_class_support:type"]),
])
def test_classification_gate(spark, examples, classes, support, threshold, status, problems):
    rows = [("family", "a", "a"), ("family", "a", "a"), ("family", "b", "b"), ("family", "b", "a"), ("type", "x", "x"), ("type", "x", None), ("type", "y", "y")]
    made = evaluation.classification_gate(spark.createDataFrame(rows, "pointer string, gold string, predicted string"), examples, 10, classes, support, threshold).first()
    # family: a 0.8, b 2/3; type: x 2/3, y 1.
    assert (made.status, made.problems) == (status, problems)
    assert made.macro_f1 == pytest.approx(((0.8 + 2 / 3) / 2 + (2 / 3 + 1) / 2) / 2)


def test_no_pairs(spark):
    made = evaluation.classification_gate(spark.createDataFrame([], "pointer string, gold string, predicted string"), 0, 10, 2, 1, 0.5)
    assert tuple(made.first()) == ("insufficient_data", 0.0, [])
