"""Benchmark items too short for a spaced seed."""

import pytest

from logarc.llm.decontaminate import contaminated_pairs, seeds_for

from .fixtures import doc, frame, words


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 12])
def test_any_one_word_may_be_replaced(spark, n):
    item = words(800 + n, n)
    rows = [doc(0, " ".join(["lead", *item, "tail"]))]
    for k in range(n):
        changed = [*item[:k], "changedword", *item[k + 1 :]]
        rows.append(doc(1 + k, " ".join(["some", "words", *changed, "more"])))
    two = [*item]
    two[0] = two[-1] = "changedword"
    rows.append(doc(100, " ".join(two)))
    rows.append(doc(101, " ".join(item[:-1])))
    benchmark = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: (r.n_equal, r.n_overlap) for r in contaminated_pairs(frame(spark, rows), benchmark).collect()}
    assert found[0] == (n, n)
    assert {d for d in found if d <= n} == set(range(n + 1))
    assert all(found[d] == (n - 1, n) for d in range(1, n + 1))
    assert (100 in found) == ((n - 2) / n >= 0.8) and 101 not in found


def test_seeds_are_only_as_many_as_the_items_need():
    assert len(seeds_for([20, 9])) == 4
    assert len(seeds_for([5])) == 4 + 1 + 5 and len(seeds_for([3, 8])) == 4 + 1
