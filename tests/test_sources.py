import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import embed, fingerprint
from corpusmill.plans import engines
from corpusmill.settings import EXCLUDED_B, EXTENSIONS_A, EXTENSIONS_B, IGNORED_A
from corpusmill.sources import files, store
from corpusmill.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    made = {"b.md": "# title\ntext of b", "a/_hidden.md": "hidden words", "a/.x/deep.txt": "deep", "a/n.schema.yaml": "k:\n  v: 1", "node_modules/skip.md": "skip", "a/bad.md": b"ok \xff\xfe end", "a/blank.md": " \n", "z.bin": "no"}
    for name, body in made.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return tmp_path / "root"


def test_every_file_is_listed(spark, folder):
    got = files.read_tree(spark, [str(folder), str(folder / "missing")])
    want = {str(Path(d) / n) for d, _, ns in os.walk(folder) for n in ns}
    assert {r.path for r in got.collect()} == want
    plain = {r.path for r in files.read_tree(spark, [str(folder)], hidden=False, content=False).collect()}
    assert plain < want and str(folder / "b.md") in plain
    assert files.read_tree(spark, [str(folder / "missing")], hidden=False).count() == 0


def test_crawl_and_decode(spark, folder):
    rows = files.read_tree(spark, [str(folder)]).filter(files.crawl_filter(F.col("path"), EXTENSIONS_A, IGNORED_A))
    text = {os.path.relpath(r.path, folder): (r.a, r.b) for r in rows.select("path", files.decode_a(F.col("content")).alias("a"), files.decode_b(F.col("content")).alias("b")).collect()}
    assert "node_modules/skip.md" not in text and "z.bin" not in text
    assert text["a/bad.md"][1] == "ok  end" and "\ufffd" in text["a/bad.md"][0]


def test_scan_walks_files_before_folders(spark, folder):
    root = str(folder) + "/"
    rows = files.read_tree(spark, [str(folder)], content=False).withColumn("rel", F.replace(F.col("path"), F.lit(root), F.lit("")))
    got = [r.rel for r in files.scan(rows, EXTENSIONS_B, EXCLUDED_B, 10, "rel").orderBy("file_ord").collect()]
    assert got == ["b.md", "a/_hidden.md", "a/bad.md", "a/blank.md", "a/n.schema.yaml", "a/.x/deep.txt"]
    assert files.scan(rows, EXTENSIONS_B, EXCLUDED_B, 2, "rel").count() == 2
    assert "a/n.schema.yaml" not in [r.rel for r in files.scan(rows, EXTENSIONS_B, EXCLUDED_B, 10, "rel", strict=True).collect()]


def test_index_store(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"d/{i}.md", f"words of document {i}") for i in range(5)], "file_ord long, source_path string, text string")
    index, built = store.IndexStore(spark, str(tmp_path / "index")), []

    def build():
        built.append(1)
        return embed.hash_embed(engines.ingest_b(docs))

    assert index.state() is None
    for fingerprint_, settings, mode, times in (("f", {"s": 1}, "auto", 1), ("f", {"s": 1}, "auto", 1), ("f", {"s": 2}, "auto", 2), ("g", {"s": 2}, "auto", 3), ("h", {"s": 2}, "reuse", 3), ("g", {"s": 2}, "rebuild", 4)):
        assert index.ensure(build, fingerprint_, settings, mode).count() == 5
        assert len(built) == times
    assert index.current("g", {"s": 2}) and index.state()[2] == 64
    with pytest.raises(ValueError, match="No vectors"):
        index.save(build().limit(0), "x")
    asked = spark.createDataFrame([(0, "words of document 3"), (1, "nothing like it at all"), (2, "")], "query_id long, question string")
    got = {r.query_id: r for r in engines.ask_b(index.load(), asked).collect()}
    assert got[0].route == "context" and "d/" in got[0].messages[1].content and got[2].route == "empty"
    assert store.metadata_json(index.load(), 64).count() == 5


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "é\nline"), ("b.md", '"quoted"')], "source_path string, chunk_text string")
    store.write_chunks_jsonl(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, store.read_chunks_jsonl(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, rows.collect()))
    store.write_source(rows.select(F.col("chunk_text").alias("source")).limit(1), str(tmp_path / "tex"))
    assert spark.read.text(str(tmp_path / "tex")).count() == 2


def test_listing_digest_ignores_order(spark):
    rows = spark.createDataFrame([(f"p{i}", i, i * 2) for i in range(50)], "path string, mtime long, size long")
    assert fingerprint.listing_digest(rows).collect() == fingerprint.listing_digest(rows.repartition(7)).collect()
    assert fingerprint.listing_digest(rows).collect() != fingerprint.listing_digest(rows.withColumn("mtime", F.col("mtime") + 1)).collect()


def test_stream_takes_each_file_once(spark, folder, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        ingest.append_chunks(ingest.stream_documents(spark, str(folder)), out, mark).awaitTermination()
    once = spark.read.parquet(out)
    assert once.groupBy("doc_path", "chunk_id").count().filter("count > 1").count() == 0
    before = once.count()
    (folder / "new.md").write_text("a new file")
    ingest.append_chunks(ingest.stream_documents(spark, str(folder)), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == before + 1


def test_streamed_questions_reach_subscribers(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "one.json").write_text('{"query_id": 1, "question": "x"}\n{"query_id": 2, "question": "y"}\n')
    questions = spark.readStream.schema("query_id long, question string").json(str(tmp_path / "q"))
    publisher, seen = ingest.Publisher(), []
    keep = lambda batch, number: seen.extend(r.query_id for r in batch.collect())
    publisher.attach(keep)
    publisher.attach(gone := lambda batch, number: seen.append("gone"))
    publisher.detach(gone)
    ingest.answer_stream(questions, lambda b: b, publisher.notify, str(tmp_path / "mark")).awaitTermination()
    assert sorted(seen) == [1, 2]


def test_engine_b_from_files(spark, folder):
    from corpusmill.settings import SettingsB

    rows = files.read_tree(spark, [str(folder)])
    index = engines.build_b(rows, str(folder), embed.HashEmbedder, SettingsB(include_roots=("a", str(folder)), max_files=4))
    assert [r[0] for r in index.select("doc_path").distinct().orderBy("doc_path").collect()] == ["_hidden.md", "bad.md", "blank.md", "n.schema.yaml"]
    assert engines.build_b(rows, str(folder), embed.HashEmbedder, SettingsB(max_chunks_total=2)).count() == 2
    with pytest.raises(ValueError, match="No chunks"):
        engines.build_b(rows, str(folder / "missing"), embed.HashEmbedder)


def test_engine_a_falls_back_to_words(spark):
    docs = spark.createDataFrame([(0, "a.md", "cats and dogs"), (1, "b.md", "birds")], "file_ord long, source_path string, text string")
    index = embed.hash_embed(engines.ingest_a(docs))
    asked = spark.createDataFrame([(0, "birds"), (1, "dogs"), (2, "nosuchword"), (3, " ")], "query_id long, question string")
    silent = lambda df, col: embed.hash_embed(df, col).filter(F.col(col) == "birds")
    got = {r.query_id: r.context for r in engines.ask_a(index, asked, silent).collect()}
    assert got[0][0] == "source_path: b.md\nsource_path: b.md\nbirds" and got[1] == ["source_path: a.md\nsource_path: a.md\ncats and dogs"]
    assert got[2] == got[3] == ["No relevant context found in indexed files."]


def test_tables_are_released(spark):
    from corpusmill import runtime

    table = runtime.materialize(spark.range(3), "t")
    path = table.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert table.count() == 3 and path in runtime.tables(spark)
    runtime.release(spark, [path])
    assert not os.path.exists(path) and path not in runtime.tables(spark)


def test_metadata_file(spark, tmp_path):
    (tmp_path / "meta.json").write_text('{"dim": 3,\n "chunks": [{"doc_path": "a", "chunk_id": 0, "text": "x\\ny"}]}')
    assert [tuple(r) for r in store.read_metadata(spark, str(tmp_path / "meta.json")).collect()] == [(3, "a", 0, "x\ny")]


def test_completion_plug(spark):
    prompts = spark.createDataFrame([(0, "a"), (1, None)], "i int, prompt string")
    assert {r.i: r.completion for r in engines.complete(prompts, lambda: str.upper).collect()} == {0: "A", 1: None}


def test_entry_works_without_the_training_data_package(tmp_path):
    """The entry imports, and has its other queries, when that package and the pipeline are gone."""
    repo = Path(__file__).resolve().parents[1]
    for name in ("corpusmill", "__spark_entry__.py"):
        os.symlink(repo / name, tmp_path / name)
    code = "import sys; sys.modules['corpusmill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'keyword_b' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_fingerprint_sees_every_file(spark):
    rows = spark.range(1, 12001).select(F.col("id").alias("file_ord"), F.col("id").cast("string").alias("path"), F.lit(1).alias("mtime"), F.lit(2).alias("size"))
    digest = lambda df: fingerprint.fingerprint(df).first()
    whole = digest(rows)
    assert whole.n_files == 12000 and digest(rows.repartition(5)) == whole
    for ord_ in (1, 5000, 5001, 12000):
        assert digest(rows.withColumn("mtime", F.when(F.col("file_ord") == ord_, 9).otherwise(1))).fingerprint != whole.fingerprint
    assert digest(rows.filter("file_ord < 12000")).fingerprint != whole.fingerprint
    assert digest(rows.filter("file_ord < 1")).n_files == 0
