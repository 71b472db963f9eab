import random

import pytest

from corpusmill.operators import fingerprint, merkle

SCHEMA = "path string, mtime long, size long"


def listing(spark, rows, parts=3):
    return spark.createDataFrame([(p, m, s) for p, (m, s) in rows.items()], SCHEMA).repartition(parts)


def changes(df):
    return sorted(map(tuple, df.select("path", "change").collect()))


@pytest.mark.parametrize("seed", range(3))
def test_changes_equal_those_of_whole_listings(spark, seed):
    rng = random.Random(seed)
    name = lambda: "/".join(["", *(rng.choice("abc") for _ in range(rng.randint(0, 4))), f"f{rng.randrange(40)}.md"])[rng.randint(0, 1) :]
    before = {name(): (rng.randrange(3), rng.randrange(3)) for _ in range(150)}
    now = dict(before)
    for p in rng.sample(sorted(now), 12):
        if rng.random() < 0.5:
            del now[p]
        else:
            now[p] = (7, 7)
    now |= {f"new/deep/er/than/all/{i}": (1, 1) for i in range(3)} | {"top.md": (1, 1)}
    a, b = listing(spark, now), listing(spark, before, 5)
    x, y = merkle.MerkleTree.build(a), merkle.MerkleTree.build(b)
    assert x.root != y.root and changes(merkle.changed_files(x, y)) == changes(fingerprint.changed_files(a, b))
    assert changes(merkle.changed_files(y, x)) == changes(fingerprint.changed_files(b, a))
    assert merkle.MerkleTree.build(listing(spark, before, 1)).root == y.root and changes(merkle.changed_files(y, y)) == []


def test_only_folders_that_differ_are_opened(spark, monkeypatch):
    before = {f"d{i}/e{j}/f{k}": (1, 1) for i in range(6) for j in range(6) for k in range(6)}
    now = before | {"d2/e3/f1": (2, 1)}
    x, y = (merkle.MerkleTree.build(listing(spark, r)) for r in (now, before))
    seen, write = {}, merkle.materialize
    monkeypatch.setattr(merkle, "materialize", lambda df, label: (out := write(df, label), seen.__setitem__(label, out.count()))[0])
    assert changes(merkle.changed_files(x, y)) == [("d2/e3/f1", "modified")]
    assert seen == {"merkle-differ-0": 1, "merkle-differ-1": 1, "merkle-differ-2": 1}


def test_one_kind_of_value_and_a_tree_on_disk(spark, tmp_path):
    rows = {f"p{i % 7}/{i}": (1, i) for i in range(6000)}
    few, many = (merkle.MerkleTree.build(listing(spark, r)) for r in (dict(list(rows.items())[:4000]), rows))
    assert len(few.root) == len(many.root) == 64 and few.root != many.root
    many.save(str(tmp_path / "tree"))
    again = merkle.MerkleTree.load(spark, str(tmp_path / "tree"))
    assert again.root == many.root and len(changes(merkle.changed_files(again, few))) == 2000


def test_empty_listings(spark):
    none, one = merkle.MerkleTree.build(listing(spark, {"a": (1, 1)}).limit(0)), merkle.MerkleTree.build(listing(spark, {"a": (1, 1)}))
    assert none.levels == [] and changes(merkle.changed_files(one, none)) == [("a", "new")]
    assert changes(merkle.changed_files(none, one)) == [("a", "gone")] and changes(merkle.changed_files(none, none)) == []
