"""What objects tell, on small groups whose scores can be worked out by hand."""

from __future__ import annotations

import pytest

from tessera.operators.fields import information


def test_information_of_small_groups(spark):
    rows = [("a", 1, '{"x":"1"}'), ("a", 2, '{"x":"1"}'), ("a", 3, '{"y":"22"}'), ("a", 4, "{}"), ("a", 5, None), (None, 1, '{"x":null}'), ("b", 1, "[1]")]
    got = {(r["g"], r["k"]): r["score"] for r in information(spark.createDataFrame(rows, "g string, k int, item string"), "g", "k", "item").collect()}
    # four objects in group a, of 2 to 10 characters: x is in two of them, y in one, so neither is common or rare
    assert got[("a", 1)] == got[("a", 2)] == pytest.approx(0.4 * 0.5 + 0.3 * 7 / 8)
    assert got[("a", 3)] == pytest.approx(0.4 * 0.75 + 0.3)
    assert (got[("a", 4)], got[("a", 5)], got[(None, 1)], got[("b", 1)]) == (0.0, 0.0, 0.5, 0.0)
    assert len(got) == len(rows)


def test_information_of_nothing(spark):
    assert information(spark.createDataFrame([], "g string, k int, item string"), "g", "k", "item").collect() == []
