import random

import pytest

from corpusmill.operators import compile as tree

SCHEMA = "node_id string, parent_id string, ord int"


def plain(nodes):
    kids = {}
    for node, parent, ord_ in nodes:
        kids.setdefault(parent, []).append((ord_, node))
    out = {}
    for _, root in sorted(kids.get(None, [])):
        stack, order = [(root, 0)], []
        while stack:
            node, depth = stack.pop()
            order.append(node)
            out[node] = (root, depth, len(order))
            stack += [(n, depth + 1) for _, n in sorted(kids.get(node, []), reverse=True)]
    return out


def places(spark, nodes, parts=3):
    found = tree.number_parts(tree.places(spark.createDataFrame(nodes, SCHEMA).repartition(parts)).select("node_id", "root", "depth", "key"), "root", "key")
    return {r.node_id: (r.root, r.depth, r.part) for r in found.collect()}


def test_random_forests(spark):
    rng = random.Random(8)
    nodes = [(f"n{i}", None if i < 3 else f"n{rng.randrange(max(0, i - 40), i)}", rng.randrange(4)) for i in range(300)]
    nodes += [("alone", None, 0), ("hot", None, 0), *((f"h{i}", "hot", i % 5) for i in range(400))]
    assert places(spark, nodes) == plain(nodes)


def test_a_chain_takes_the_logarithm_of_its_length(spark, monkeypatch):
    chain = [(f"n{i:05d}", f"n{i - 1:05d}" if i else None, 0) for i in range(10_000)]
    rounds, write = [], tree.materialize
    monkeypatch.setattr(tree, "materialize", lambda df, label: (rounds.append(label), write(df, label))[1])
    assert places(spark, chain) == {n: ("n00000", i, i + 1) for i, (n, *_) in enumerate(chain)}
    assert len([r for r in rounds if r.startswith("tour-") and r[5:].isdigit()]) < 20


@pytest.mark.parametrize("bad,lost", [([("a", "b", 0), ("b", "a", 0), ("c", None, 0)], 2), ([("a", "gone", 0), ("b", "a", 0), ("r", None, 0)], 2)])
def test_nodes_that_no_root_reaches(spark, bad, lost):
    with pytest.raises(ValueError, match=f"{lost} nodes hang in a cycle"):
        tree.places(spark.createDataFrame(bad, SCHEMA))


def test_no_nodes(spark):
    assert tree.places(spark.createDataFrame([], SCHEMA)).collect() == []
