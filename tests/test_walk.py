import os

import pytest
from pyspark.sql import functions as F

from corpusmill.settings import EXCLUDED_B, EXTENSIONS_B
from corpusmill.sources import files, walk


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    names = ["b.md", "a/x.txt", "a/b/c/d/deep.md", "a/b/.hid/_y.md", "venv/lib/z.md", "a/venv/q/w.md", "a/venv2/ok.md", "a/other.bin", "node_modules/m.md", "a/b/venv"]
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(n)
    os.symlink(root / "a", root / "link")
    os.symlink(root / "b.md", root / "copy.md")
    os.symlink(root / "nowhere", root / "broken.md")
    return root


def test_excluded_folders_are_never_opened(spark, tree, monkeypatch):
    met = walk.walk(spark, [str(tree)], EXCLUDED_B)
    paths = sorted(os.path.relpath(r.path, tree) for r in met.files.collect())
    assert paths == sorted(["b.md", "copy.md", "a/x.txt", "a/b/c/d/deep.md", "a/b/.hid/_y.md", "a/venv2/ok.md", "a/other.bin", "a/b/venv"])
    # the root, a, a/b, a/b/c, a/b/c/d, a/b/.hid, a/venv2; an unpruned walk opens venv, venv/lib, a/venv, a/venv/q and node_modules too
    assert met.opened == 7 and met.rounds == 5
    assert walk.walk(spark, [str(tree)]).opened == 12


def test_the_same_files_as_a_listing_that_is_filtered(spark, tree):
    listed = files.read_tree(spark, [str(tree)], content=False)
    rel = lambda df: df.selectExpr("*", f"substr(path, {len(str(tree)) + 2}) AS rel")
    want = {r.rel for r in rel(listed).filter(files.scan_filter(F.col("rel"), EXTENSIONS_B, EXCLUDED_B)).collect()}
    got = {r.rel for r in rel(walk.walk(spark, [str(tree)], EXCLUDED_B, EXTENSIONS_B).files).collect()}
    assert got == want and got
    order = files.scan(rel(walk.walk(spark, [str(tree)], EXCLUDED_B).files), EXTENSIONS_B, EXCLUDED_B, 3, "rel")
    assert [r.rel for r in order.orderBy("file_ord").collect()] == ["b.md", "copy.md", "a/x.txt"]


def test_several_roots_blocks_and_missing_ones(spark, tree, monkeypatch):
    monkeypatch.setattr(walk, "FOLDERS", 2)
    wide = tree / "wide"
    for i in range(30):
        (wide / f"d{i}").mkdir(parents=True)
        (wide / f"d{i}" / "f.txt").write_text("x" * i)
    met = walk.walk(spark, [str(wide) + "/", str(tree / "missing"), str(tree / "venv")], EXCLUDED_B)
    assert sorted((os.path.basename(r.root), r.size) for r in met.files.collect()) == sorted([("wide", i) for i in range(30)] + [("venv", len("venv/lib/z.md"))])
    assert walk.walk(spark, []).files.collect() == []


def test_content_and_written_trees(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "BYTES", 3)
    found = walk.with_content(walk.walk(spark, [str(tree)], EXCLUDED_B).files)
    assert {os.path.relpath(r.path, tree): r.content.decode() for r in found.collect()}["a/b/c/d/deep.md"] == "a/b/c/d/deep.md"
    docs = spark.createDataFrame([("x/y.md", "é"), ("z.md", None)], "path string, text string")
    assert walk.write_tree(docs, str(tmp_path / "out")) == 2
    assert (tmp_path / "out/x/y.md").read_text() == "é" and (tmp_path / "out/z.md").read_bytes() == b"" and sorted(os.listdir(tmp_path / "out/x")) == ["y.md"]
    os.remove(tree / "b.md")
    assert "b.md" not in {os.path.relpath(r.path, tree) for r in found.collect()}
