import json
import random

import pytest

from corpusmill.sources import onefile, store

SCHEMA = "doc_path string, chunk_id long, text string"
PARTS = ['"', "\\", "{", "}", "[", "]", ",", "\n", "a", "é", "🎉", "\\\"", "x" * 20, "\u2028"]


def odd_chunks(seed, n):
    rng = random.Random(seed)
    return [{"doc_path": f"d/{i}.md", "chunk_id": i, "text": "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))} for i in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("style", [{}, {"indent": 1}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_blocks_of_any_size_give_the_records(tmp_path, monkeypatch, block, style):
    monkeypatch.setattr(onefile, "MORE", 11)
    path, chunks = str(tmp_path / "m.json"), odd_chunks(block, 60)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"dim": 3, "note": "a [ \" {", "chunks": chunks, "end": [1, {"x": {}}][:1]}, f, **style)
    size, state, depth, got = len(open(path, "rb").read()), 0, 0, []
    for start in range(0, size, block):
        got += [json.loads(r) for r in onefile.records(path, start, block, state, depth)]
        state, opened = onefile.summary(onefile._read(path, start, block))[state]
        depth += opened
    assert got == chunks and (state, depth) == (0, 0)
    assert onefile.scalars(path) == {"dim": 3, "note": 'a [ " {'}


def test_several_tasks_read_and_write_one_file(spark, tmp_path):
    path, chunks = str(tmp_path / "out" / "meta.json"), odd_chunks(1, 300)
    df = spark.createDataFrame([(i, c["doc_path"], c["chunk_id"], c["text"]) for i, c in enumerate(chunks)], f"chunk_ord long, {SCHEMA}").repartition(5)
    assert onefile.write_object(df, path, dim=4) == len(open(path, "rb").read())
    assert json.load(open(path, encoding="utf-8")) == {"dim": 4, "chunks": chunks}
    found = onefile.read_object(spark, path, SCHEMA, block=2000)
    assert found.rdd.getNumPartitions() > 3 and rows(found) == rows(df.drop("chunk_ord"))
    assert [p for p in (tmp_path / "out").iterdir()] == [tmp_path / "out" / "meta.json"]
    assert rows(store.read_metadata(spark, path).drop("dim")) == rows(df.drop("chunk_ord")) and store.read_metadata(spark, path).first().dim == 4


def test_no_records_and_broken_files(spark, tmp_path):
    path = str(tmp_path / "meta.json")
    none = spark.createDataFrame([], f"chunk_ord long, {SCHEMA}")
    onefile.write_object(none, path, dim=4)
    assert json.load(open(path)) == {"dim": 4, "chunks": []} and rows(onefile.read_object(spark, path, SCHEMA)) == []
    (tmp_path / "bad.json").write_text('{"dim": 1, "chunks": [{"text": "a')
    with pytest.raises(ValueError, match="not one whole JSON object"):
        onefile.read_object(spark, str(tmp_path / "bad.json"), SCHEMA)
