import pytest
from pyspark.sql import functions as F

from corpusmill.operators import embed
from corpusmill.sources.store import IndexStore

SETTINGS = {"size": 10}


class Corpus:
    """Files as a dictionary of path to (mtime, text); counts the files that are built."""

    def __init__(self, spark, files):
        self.spark, self.files, self.built = spark, dict(files), []

    def listing(self):
        return self.spark.createDataFrame([(p, m, len(t)) for p, (m, t) in self.files.items()], "path string, mtime long, size long")

    def build(self, changed):
        paths = [r.path for r in changed.collect()]
        self.built.append(sorted(paths))
        rows = [(p, i, w) for p in paths for i, w in enumerate(self.files[p][1].split())]
        return embed.hash_embed(self.spark.createDataFrame(rows, "doc_path string, chunk_id int, chunk_text string"), dim=4)

    def want(self):
        return sorted((p, i, w) for p, (_, t) in self.files.items() for i, w in enumerate(t.split()))


def rows(index):
    return sorted((r.doc_path, r.chunk_id, r.chunk_text) for r in index.load().collect())


@pytest.fixture
def corpus(spark):
    return Corpus(spark, {f"d/{i}.md": (1, f"words of {i}") for i in range(12)} | {"blank.md": (1, " ")})


@pytest.fixture
def index(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index"))


def test_only_changed_files_are_built(corpus, index):
    assert index.update(corpus.listing(), corpus.build, SETTINGS) == {"new": 13, "modified": 0, "gone": 0}
    assert rows(index) == corpus.want()
    assert index.update(corpus.listing(), corpus.build, SETTINGS) == {"new": 0, "modified": 0, "gone": 0} and len(corpus.built) == 1
    corpus.files["d/3.md"] = (2, "other words entirely")
    assert index.update(corpus.listing(), corpus.build, SETTINGS) == {"new": 0, "modified": 1, "gone": 0}
    assert corpus.built[-1] == ["d/3.md"] and rows(index) == corpus.want()
    del corpus.files["d/4.md"]
    corpus.files |= {"e.md": (5, "a new one"), "d/3.md": (3, "again")}
    assert index.update(corpus.listing(), corpus.build, SETTINGS) == {"new": 1, "modified": 1, "gone": 1}
    assert corpus.built[-1] == ["d/3.md", "e.md"] and rows(index) == corpus.want()
    del corpus.files["e.md"]
    corpus.files["d/4.md"] = (9, "back again")  # a path whose earlier chunks are dead
    index.update(corpus.listing(), corpus.build, SETTINGS)
    assert rows(index) == corpus.want() and len(corpus.built) == 4
    index.update(corpus.listing(), corpus.build, {"size": 11})  # other settings
    assert len(corpus.built[-1]) == len(corpus.files) and rows(index) == corpus.want()


def test_a_writer_that_dies_leaves_the_old_state(corpus, index, monkeypatch):
    index.update(corpus.listing(), corpus.build, SETTINGS)
    before = corpus.want()
    corpus.files["d/3.md"] = (2, "new words")

    def dies(*_, **__):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        index.update(corpus.listing(), dies, SETTINGS)
    with monkeypatch.context() as m:
        m.setattr(index, "_commit", dies)
        for step in (lambda: index.update(corpus.listing(), corpus.build, SETTINGS), lambda: index.save(index.load(), "f"), lambda: index.compact(0, 0)):
            with pytest.raises(RuntimeError):
                step() or dies()
            assert rows(index) == before
    assert index.vacuum() > 0 and rows(index) == before
    assert index.update(corpus.listing(), corpus.build, SETTINGS)["modified"] == 1 and rows(index) == corpus.want()


def test_of_two_writers_one_fails(corpus, index, spark):
    index.update(corpus.listing(), corpus.build, SETTINGS)
    other = IndexStore(spark, index.path)

    def slow(changed):
        made = corpus.build(changed)
        del other_corpus.files["d/1.md"]
        other.update(other_corpus.listing(), other_corpus.build, SETTINGS)
        return made

    other_corpus = Corpus(spark, corpus.files)
    corpus.files["d/3.md"] = (2, "new words")
    with pytest.raises(Exception, match="(?i)exist"):
        index.update(corpus.listing(), slow, SETTINGS)
    assert rows(index) == other_corpus.want()


def test_compaction_and_vacuum(corpus, index):
    index.update(corpus.listing(), corpus.build, SETTINGS)
    for n in range(3):
        corpus.files[f"d/{n}.md"] = (2, f"round {n}")
        index.update(corpus.listing(), corpus.build, SETTINGS)
    assert not index.compact(max_parts=10, max_dead=0.5) and len(index.manifest()["segments"]) == 4
    assert index.compact(max_parts=10, max_dead=0.1) and index.manifest()["tombstones"] == []
    assert len(index.manifest()["segments"]) == 1 and rows(index) == corpus.want()
    assert not index.compact(max_parts=1, max_dead=0)
    assert index.vacuum(keep=1) >= 9 and rows(index) == corpus.want()
    corpus.files["d/9.md"] = (7, "after all")
    assert index.update(corpus.listing(), corpus.build, SETTINGS)["modified"] == 1 and rows(index) == corpus.want()


def test_all_files_gone_and_none_at_first(corpus, index):
    empty = Corpus(corpus.spark, {"blank.md": (1, " ")})
    with pytest.raises(ValueError, match="No vectors"):
        index.update(empty.listing(), empty.build, SETTINGS)
    assert index.manifest() is None
    with pytest.raises(ValueError, match="no index"):
        index.load()
    index.update(corpus.listing(), corpus.build, SETTINGS)
    assert index.update(corpus.listing().filter("false"), corpus.build, SETTINGS)["gone"] == 13 and rows(index) == []


def test_vectors_of_another_length_are_refused(corpus, index):
    index.update(corpus.listing(), corpus.build, SETTINGS)
    before = rows(index)
    corpus.files["d/3.md"] = (2, "new words")
    with pytest.raises(ValueError, match="differ"):
        index.update(corpus.listing(), lambda c: corpus.build(c).withColumn("embedding", F.slice("embedding", 1, 3)), SETTINGS)
    assert rows(index) == before
