import random

import pytest

from apexframe.contracts import DataValidationError
from apexframe.sources.seals import changed_items, root_of, seal_tree, tree_depth

ITEMS = "name string, digest string"


@pytest.mark.parametrize("depth", [0, 2])
def test_changes_are_named(spark, depth):
    rng = random.Random(1)
    before = {f"part-{i}": str(rng.random()) for i in range(300)}
    after = dict(before)
    del after["part-7"], after["part-70"]
    after |= {"part-9": "other", "new": "x"}
    a, b = (spark.createDataFrame(list(d.items()), ITEMS) for d in (before, after))
    trees = [seal_tree(x, depth) for x in (a, b)]
    assert {r.name: r.state for r in changed_items(a, b, *trees, depth).collect()} == {"part-7": "removed", "part-70": "removed", "part-9": "changed", "new": "added"}
    assert root_of(trees[0]) != root_of(trees[1]) and root_of(seal_tree(a.orderBy("digest"), depth)) == root_of(trees[0])
    assert changed_items(a, a, trees[0], trees[0], depth).count() == 0
    assert trees[0].where("level = 0").first()["items"] == 300


def test_edges(spark):
    none = spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([("a", "1")], ITEMS)
    assert root_of(seal_tree(none, 1)) == "" and [tuple(r) for r in changed_items(none, one, seal_tree(none, 1), seal_tree(one, 1), 1).collect()] == [("a", "added")]
    for bad in ([("a", "1"), ("a", "2")], [(None, "1")], [("a", None)]):
        with pytest.raises(DataValidationError):
            seal_tree(spark.createDataFrame(bad, ITEMS), 1)
    assert [tree_depth(n) for n in (0, 64, 65, 1024, 1025)] == [0, 0, 1, 1, 2]
