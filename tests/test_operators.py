"""Golden rows, properties against plain restatements, and plans."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vectors as V
from corpusmill.operators import chunk, compile as tree, embed, expand, flatten, graph, pack, retrieve
from corpusmill.settings import GENERAL_PROMPT, NOT_FOUND, SYSTEM_PROMPT, Policy, SettingsB, instructions, read_instructions

ALPHABET = " \n\r\t:-ab.é🎉\xa0\x1c/_"


def strings(seed, n=150, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def column(spark, data, expr):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, t string")
    return [r.x for r in rows.withColumn("x", expr(F.col("t"))).orderBy("i").collect()]


def test_strip_and_newlines_equal_python(spark):
    data = strings(1)
    assert column(spark, data, T.strip) == [s.strip() for s in data]
    assert column(spark, data, T.normalize_newlines) == [s.replace("\r\n", "\n").replace("\r", "\n") for s in data]


def test_paths(spark):
    paths = ["a/b.tar.gz", "x/.git", "r/README", "u/n.schema.yaml", "d/My-Notes_v2.md"]
    assert column(spark, paths, T.stem) == ["b.tar", ".git", "README", "n.schema", "My-Notes_v2"]
    assert column(spark, paths, T.suffix) == [".gz", "", "", ".yaml", ".md"]
    assert column(spark, paths, T.path_tokens) == [["a", "b", "tar", "gz"], ["x", "git"], ["r", "readme"], ["u", "n", "schema", "yaml"], ["d", "my", "notes", "v2", "md"]]
    assert column(spark, ["/r/d/My-Notes_v2.md"], lambda c: T.header_b(T.relative(c, "/r"), F.lit("x"))) == ["__DOC_PATH__ d/My-Notes_v2.md\n__DOC_STEM__ My-Notes_v2\n__DOC_TOKENS__ d my notes v2 md\n\nx"]


def restated_windows(text, size, overlap):
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, start = [], 0
    while text.strip():
        part = text[start : start + size].strip()
        if part:
            out.append(part)
        if start + size >= len(text):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(10, 3), (7, 0), (5, 4)])
def test_chunks(spark, size, overlap):
    data = ["abcdefghijklmnopqrstuvwxyz", *strings(2, 120, 90), "x" * 10, "x" * 11]
    got = {}
    for r in chunk.chunk_a(spark.createDataFrame(list(enumerate(data)), "i int, text string"), size, overlap).collect():
        got.setdefault(r.i, []).append((r.win, r.chunk_text))
    assert [[c for _, c in sorted(got.get(i, []))] for i in range(len(data))] == [restated_windows(t, size, overlap) for t in data]


def test_chunk_edges(spark):
    rows = spark.createDataFrame([(1, " " * 1200 + "z"), (2, None), (3, "x" * 1800), (4, "x" * 1801)], "i int, text string")
    a = [(r.i, r.win) for r in chunk.chunk_a(rows).collect()]
    assert sorted(a) == [(1, 1), (3, 0), (3, 1), (4, 0), (4, 1), (4, 2)]
    assert [(r.i, r.chunk_id) for r in chunk.chunk_b(rows, 1000, 200).filter("i = 1").collect()] == [(1, 0)]
    for size, overlap in ((0, 0), (5, 5), (5, 6), (5, -1)):
        with pytest.raises(ValueError):
            chunk.chunk_a(rows, size, overlap)


GOLDEN_YAML = [
    ("a:\n  b: 1\n  c:\n    d: http://x\n      deep: 2\n- k: v\nnocolon\n: lone\n  |x: |\n    text\n", ["a.b = 1", "a.c.d = http://x", "a.c.d.deep = 2", "- k = v", " = lone", " = |"]),
    ("rag:\n  system_prompt: |\n    If x: y.\npolicy:\n  vector_min_score: 0.22", ["rag.system_prompt = |", "rag.system_prompt.If x = y.", "policy.vector_min_score = 0.22"]),
]


def restated_flatten(text):
    stack, out = [], []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if not line.strip() or ":" not in line:
            continue
        level = (len(line) - len(line.lstrip(" "))) // 2
        key, value = (x.strip() for x in line.strip().split(":", 1))
        del stack[level:]
        if key and len(stack) == level:
            stack.append(key)
        if value:
            out.append(".".join(stack) + " = " + value)
    return out


def test_flatten(spark):
    assert column(spark, [t for t, _ in GOLDEN_YAML], flatten.flatten_lines) == [w for _, w in GOLDEN_YAML]
    rng = random.Random(9)
    data = ["\n".join(" " * rng.randint(0, 7) + rng.choice(["a", "", "b c", "-"]) + rng.choice([":", ": ", "", ": v", ":x: y"]) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    assert column(spark, data, flatten.flatten_lines) == [restated_flatten(t) for t in data]


def test_pretty_yaml_touches_yml_only(spark):
    rows = [("a.yml", "b: 1\na: [x, y]"), ("b.yml", "a: [unclosed"), ("c.md", "a: [x]"), (None, "t")]
    got = {r.source_path: r.text for r in flatten.pretty_yaml(spark.createDataFrame(rows, "source_path string, text string")).collect()}
    assert got == {"a.yml": "b: 1\na:\n- x\n- y\n", "b.yml": "a: [unclosed", "c.md": "a: [x]", None: "t"}


def hits_of(spark, questions, chunks, search, **kw):
    c = spark.createDataFrame([(i, *r) for i, r in enumerate(chunks)], "chunk_ord long, doc_path string, chunk_text string").withColumn("chunk_id", F.lit(0))
    q = spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")
    return search(c, q, 8, "doc_path").collect()


def test_lexical_scores(spark):
    assert [r.score for r in hits_of(spark, ["Where, is  the cat?"], [("x/cat.md", "the cat sat")], retrieve.lexical_a)] == [0.5]
    golden = [("cat", "A cat. Cat!", "x/cat.md", 2.4), ("black cat", "the black cat black cat", "d/n.md", 2.2), ("black dog", "black cat", "d/n.md", 0.5), ("dog", "black cat", "d/n.md", None), ("a a zz", "a", "n.md", 2 / 3), ("aa", "aaaa", "n.md", 2.2), ("cat", "cat " * 30, "n.md", 3.0)]
    for question, text, path, score in golden:
        got = [r.score for r in hits_of(spark, [question], [(path, text)], retrieve.keyword_b)]
        assert got == ([] if score is None else [pytest.approx(score)]), question
    assert hits_of(spark, ["  ", ""], [("a", "b")], retrieve.keyword_b) == hits_of(spark, ["?"], [("a", "b")], retrieve.lexical_a) == []


def test_expansion(spark):
    q = [(0, "  Austrian embassy in vienna? "), (1, "Vienna consulate")]
    got = {}
    for r in expand.expand_questions(spark.createDataFrame(q, "query_id long, question string")).collect():
        got.setdefault(r.query_id, []).append((r.variant, r.question))
    assert [x for _, x in sorted(got[0])] == ["Austrian embassy in vienna?", "Austrian embassy in vienna? consulate", "Austrian embassy in wien?"]
    assert [x for _, x in sorted(got[1])] == ["Vienna consulate", "Vienna consulate embassy"]


def test_merges(spark):
    rows = [(0, 0, 1, 0.80, "f1", "X"), (0, 0, 2, 0.60, "f2", "Y"), (0, 1, 1, 0.95, "f1", "X"), (0, 1, 2, 0.70, "f3", "Z")]
    merged = retrieve.merge_variants(spark.createDataFrame(rows, "query_id long, variant int, rank int, score double, source_path string, chunk_text string"))
    assert [(r.source_path, r.score) for r in merged.orderBy("merged_rank").collect()] == [("f1", 0.80), ("f3", 0.70), ("f2", 0.60)]
    schema = "query_id long, rank int, score double, doc_path string, chunk_id int"
    vec = spark.createDataFrame([(0, 1, 0.9, "d1", 0), (0, 2, 0.5, "d1", 1), (0, 3, 0.3, "d2", 0)], schema)
    kw = spark.createDataFrame([(0, 1, 2.1, "d2", 0), (0, 2, 1.0, "d3", 0), (0, 3, 0.5, "d4", 0)], schema)
    got = retrieve.merge_hybrid(vec, kw, 10).orderBy("rank").collect()
    assert [(r.doc_path, r.chunk_id, round(r.score, 6)) for r in got] == [("d3", 0, 1.05), ("d1", 0, 0.9), ("d4", 0, 0.55), ("d1", 1, 0.5), ("d2", 0, 0.3)]


def test_policy_and_routes(spark):
    rows = [(None, None, False), (0.22, None, True), (0.21, 0.6, True), (0.21, 0.59, False)]
    df = spark.createDataFrame(rows, "v double, k double, want boolean")
    assert df.filter(pack.use_context(F.col("v"), F.col("k")) != F.col("want")).count() == 0
    data = [("", True), ("one", True), ("two words", True), ("two words", False), (None, True)]
    df = spark.createDataFrame(data, "q string, c boolean")
    assert [r[0] for r in df.select(pack.route(F.col("q"), F.col("c"))).collect()] == ["empty", "snippet", "context", "general", "empty"]
    none = df.select(pack.route(F.col("q"), F.col("c"), Policy(allow_general_fallback=False))).collect()
    assert none[3][0] == "not_found"


HITS = "array<struct<rank:int,score:double,doc_path:string,chunk_id:int,chunk_text:string>>"


def restated_fit(question, hits, s):
    limit, kept = 600, list(hits)
    while True:
        context = "\n\n".join(f"[source={h[2]} chunk={h[3]} score={h[1]:.4f}]\n{h[4][:limit]}" for h in kept[:6])
        tokens = len(f"SYSTEM:\n{s.system_prompt}\n\nUSER:\nCONTEXT:\n{context}\n\nQUESTION:\n{question}\n".split())
        if tokens + s.max_tokens <= s.n_ctx:
            return limit, len(kept), True
        if limit > 200:
            limit = max(200, int(limit * 0.8))
        elif len(kept) > 1:
            kept = kept[:-1]
        elif limit > 80:
            limit = max(80, int(limit * 0.7))
        else:
            return limit, len(kept), False


def test_fit_equals_the_loop(spark):
    rng, rows = random.Random(4), []
    for i in range(80):
        hits = [(r, rng.random(), f"d{r}", r, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(5, 200)))) for r in range(rng.randint(0, 12))]
        rows.append((i, "what is this", hits))
    for n_ctx in (40, 120, 300, 700):
        s = SettingsB(n_ctx=n_ctx, max_tokens=10)
        for r in pack.fit_context(spark.createDataFrame(rows, f"i int, question string, hits {HITS}"), s).collect():
            chars, n, fits = restated_fit(r.question, [tuple(h) for h in r.hits], s)
            assert (r.fit.chars, r.fit.n_hits, r.fit.fits) == (chars, n, fits), (r.i, n_ctx)


def test_answers(spark):
    hit = (1, 0.9, "d/a.md", 2, "some text " * 20)
    rows = [("", [hit], [], 0.9, None), ("two words", [hit], [], 0.9, None), ("word", [hit], [], 0.9, None), ("two words", [hit], [], 0.1, None)]
    df = spark.createDataFrame(rows, f"question string, hits {HITS}, kw_hits {HITS}, best_vector double, best_keyword double")
    a = pack.answer(df).collect()
    assert [r.route for r in a] == ["empty", "context", "snippet", "general"]
    assert a[0].reply == "" and a[2].reply.startswith("[source=d/a.md chunk=2 score=0.9000]\nsome text")
    assert a[1].messages[0].content == SYSTEM_PROMPT and "CONTEXT:\n[source=" in a[1].messages[1].content
    assert a[3].messages[0].content == GENERAL_PROMPT
    assert pack.answer(df, SettingsB(policy=Policy(allow_general_fallback=False))).collect()[3].reply == NOT_FOUND
    assert pack.answer(df, SettingsB(n_ctx=230)).collect()[1].route == "general"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(V.l2_normalize(F.col("v"))).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0]]


def test_topk_is_a_prefix_and_takes_ties_in_order(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "chunk_ord long, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0, 1.0]), (8, [0.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    for parts in (1, 5):
        long = retrieve.vector_topk(vectors.repartition(parts), queries, 30).collect()
        short = retrieve.vector_topk(vectors.repartition(parts), queries, 4).collect()
        assert {(r.query_id, r.rank, r.chunk_ord) for r in short} <= {(r.query_id, r.rank, r.chunk_ord) for r in long}
        assert [r.chunk_ord for r in sorted(long, key=lambda r: r.rank) if r.query_id == 8] == list(range(30))
    assert retrieve.vector_topk(vectors, queries.limit(0), 3).count() == 0
    assert retrieve.vector_topk(vectors.limit(2), queries, 5).count() == 4


def test_question_blocks_change_nothing(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"d{i}", f"word{i % 7} other") for i in range(40)], "chunk_ord long, doc_path string, chunk_text string")
    asked = spark.createDataFrame([(i, f"word{i % 7}") for i in range(30)], "query_id long, question string")
    want = sorted(map(tuple, retrieve.lexical_a(chunks, asked, 3, "doc_path").collect()))
    monkeypatch.setattr(retrieve, "BLOCK", 4)
    assert sorted(map(tuple, retrieve.lexical_a(chunks, asked, 3, "doc_path").collect())) == want


def test_embedders_agree_and_recover(spark):
    rows = spark.createDataFrame([(0, "a b a"), (1, ""), (2, None), (3, "Ü é")], "i int, chunk_text string")
    native = {r.i: r.embedding for r in embed.hash_embed(rows.filter("chunk_text IS NOT NULL")).collect()}

    class Flaky(embed.HashEmbedder):
        def embed(self, texts):
            if len(texts) > 1:
                raise RuntimeError("one at a time")
            return super().embed(texts)

    for r in embed.embed(rows, Flaky).collect():
        assert r.embedding == pytest.approx(native.get(r.i, [0.0] * 64), abs=1e-6)
    cut = embed.embed(rows, embed.HashEmbedder, max_tokens=1)
    assert cut.columns == ["i", "chunk_text", "embedding"] and sum(cut.filter("i = 0").first().embedding) == 1

    class Short(embed.HashEmbedder):
        def embed(self, texts):
            return super().embed(texts)[:-1]

    with pytest.raises(Exception, match="vectors for"):
        embed.embed(rows, Short).collect()


def test_compile(spark):
    rows = [("s", "b.md", "B"), ("s", "a/x.md", "X"), ("s", "a/c/y.md", "Y"), ("s", "z/q.md", "Q")]
    out = tree.joined(tree.compile_tree(spark.createDataFrame(rows, "project string, path string, text string"), "project"), "project").first()
    assert out.source == "\\chapter{b}\nB\n\\section{x}\nX\n\\subsection{y}\nY\n\\section{q}\nQ"
    nodes = spark.createDataFrame([("r", None, 0), ("b", "r", 1), ("a", "r", 0), ("c", "a", 0)], "node_id string, parent_id string, ord int")
    assert [r.node_id for r in tree.preorder(nodes).orderBy("key").collect()] == ["r", "a", "c", "b"]
    assert spark.range(1).select(tree.document(F.lit("x"), bibliography="refs")).first()[0] == "\\documentclass{article}\n\\begin{document}\nx\n\\bibliography{refs}\n\\end{document}\n"


def test_document_parts(spark):
    row = spark.range(1).select(tree.preamble(F.lit("T"), F.lit(None).cast("string"), F.lit("today")).alias("p"), tree.itemize(F.array(F.lit("a"), F.lit("b"))).alias("i")).first()
    assert row.p == "\\documentclass{article}\n\\title{T}\n\\date{today}"
    assert row.i == "\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}"
    nodes = spark.createDataFrame([("d", None, "document"), ("l", "d", "itemize"), ("x", "d", "figure"), ("y", "x", "figure")], "node_id string, parent_id string, kind string")
    assert [r.node_id for r in tree.misplaced(nodes).collect()] == ["x"]


def test_clusters(spark):
    points = [(f"p{i}", 10.0 * (i % 2) + i / 100, 50.0 * (i % 2), float(i)) for i in range(12)]
    lines = [(f"p{i}", f"p{i + 1}", 0.5, 10.0) for i in range(11)] + [("p0", "p2", 0.25, 1.0)]
    told = graph.geo_clusters(spark.createDataFrame(points, "id string, lat double, lon double, load double"))
    nodes, edges = graph.aggregate_clusters(told, spark.createDataFrame(lines, "src string, dst string, x double, p_max double"))
    assert {r.cluster: (r.load, r.members) for r in nodes.collect()} == {"p0": (30.0, 6), "p1": (36.0, 6)}
    assert {(r.a, r.b): (r.x, r.p_max, r.n) for r in edges.collect()} == {("p0", "p1"): (3.0, 60.0, 6), ("p1", "p0"): (2.5, 50.0, 5)}


def test_comment_nodes(spark):
    made = spark.range(1).select(T.comment_node("right", F.lit("n"), F.lit("c"), F.lit("t"), F.lit("2mm"))).first()[0]
    assert made == "\\node[gray, anchor=south west] (c) at ([xshift=2mm,yshift=6mm]n.north east) {\\shortstack{t}};\n\\draw[dashed, gray, <-] (c.south west) -| (n.east);"


def test_instructions():
    assert instructions(None) == instructions({"rag": {"system_prompt": "x"}}) == (SYSTEM_PROMPT, GENERAL_PROMPT)
    assert instructions({"rag": {"system_prompt": " x "}}, nested=True)[0] == "x"
    assert read_instructions("/no/such/file") == (SYSTEM_PROMPT, GENERAL_PROMPT)
    assert instructions({"system_prompt": "a", "general_system_prompt": " "}) == ("a", GENERAL_PROMPT)


def test_plans(spark):
    chunks = spark.createDataFrame([(0, "d", "t")], "chunk_ord long, doc_path string, chunk_text string")
    asked = spark.createDataFrame([(0, "t")], "query_id long, question string")
    plan = retrieve.lexical_a(chunks, asked, 3, "doc_path")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastNestedLoopJoin" in plan
    capped = chunk.cap_chunks(chunks, 5, ["chunk_ord"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in capped
    narrow = chunk.chunk_a(spark.createDataFrame([(0, "t")], "i int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in narrow and "Python" not in narrow


def test_whole_text_queries_find_what_stands_behind_the_prefix(spark, tmp_path):
    from corpusmill import queries as Q

    texts = ["x " * 300 + "the on", "the on " + "y " * 300, "nothing"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_path for r in Q.QUERIES["keyword_b"](spark, str(tmp_path)).filter("query_id = 0 AND score > 2").collect()}
    paths = {r.doc_id: r.path for r in Q.corpus(spark, str(tmp_path)).collect()}
    assert {i for i, p in paths.items() if p in got} == {i for i, t in enumerate(texts) if "the on" in t} == {0, 1}


def test_whole_text_queries_differ_where_texts_differ_late(spark, tmp_path):
    from corpusmill import queries as Q

    texts = ["the " * 200 + "on", "the " * 200 + "was end"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: Q.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.bare for r in run("strip_text")} == dict(enumerate(texts))
    assert {r.doc_id: r.tokens_b for r in run("query_tokens")} == {i: "|".join([*t.split()[:-1], t.split()[-1] + "?"]) for i, t in enumerate(texts)}
    assert [r.source.split("\n", 1)[1] for r in sorted(run("compile_tree"), key=lambda r: r.part)] == texts[1:] + texts[:1]
    assert sorted(r.doc_id for r in run("hash_embed") if r.x == 1) == [] and {r.doc_id for r in run("hash_embed")} == {0, 1}
    # one source, equal first letters: both documents stay
    assert len({r.source_path for r in run("search_many_merge")}) == 2


def test_vector_topk_asks_every_id_divisible_by_50(spark, tmp_path):
    from corpusmill import queries as Q

    spark.range(120).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.query_id for r in Q.QUERIES["vector_topk"](spark, str(tmp_path)).collect()} == {0, 50, 100}


def test_long_texts_take_linear_time(spark):
    import time

    began = time.perf_counter()
    rows = spark.createDataFrame([(1, "abc dé\n" * 700_000)], "i int, text string")
    made = chunk.chunk_b(rows).agg(F.count("*"), F.max("chunk_id")).first()
    assert made[0] == made[1] + 1 == len(restated_windows("abc dé\n" * 700_000, 1500, 150))
    blank = spark.createDataFrame([("x" + " " * 1_000_000 + "x\u3000\x1c",)], "t string")
    assert blank.select(F.length(T.strip(F.col("t"))), T.is_blank(F.col("t"))).first() == (1_000_002, False)
    lines = "\n".join("  " * (i % 4) + f"k{i}: v{i}" for i in range(100_000))
    out = spark.createDataFrame([(lines,)], "t string").select(flatten.flatten_lines(F.col("t"))).first()[0]
    assert out == restated_flatten(lines)
    assert time.perf_counter() - began < 60


def test_vectors_with_nulls_and_many_queries(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(300)] + [(900, None), (901, [1.0, None, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "chunk_ord long, embedding array<float>")
    queries = vectors.filter("chunk_ord % 7 = 0 OR chunk_ord >= 900").withColumnRenamed("chunk_ord", "query_id")
    want = sorted(map(tuple, retrieve.vector_topk(vectors, queries, 5).collect()))
    assert {r[0] for r in want} == set(range(0, 300, 7)) and all(r[3] < 900 for r in want)

    def unit(v):
        n = sum(x * x for x in v) ** 0.5
        return [x / n if n else x for x in v]

    for q in (0, 7, 294):
        scores = sorted((-round(sum(a * b for a, b in zip(unit(rows[q][1]), unit(v))), 6), i) for i, v in rows[:300])[:5]
        assert [r[3] for r in want if r[0] == q] == [i for _, i in scores]
    monkeypatch.setattr(retrieve, "BLOCK", 4)
    monkeypatch.setattr(retrieve, "VECTOR_ROWS", 10)
    monkeypatch.setattr(retrieve, "QUERY_BYTES", 400)
    assert sorted(map(tuple, retrieve.vector_topk(vectors.repartition(5), queries, 5).collect())) == want
    with pytest.raises(ValueError, match="differ in length"):
        retrieve.vector_topk(vectors, spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "query_id long, embedding array<float>"), 3)


def test_trees_of_any_depth_and_cycles(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None, 0) for i in range(30)]
    nodes = spark.createDataFrame(chain, "node_id string, parent_id string, ord int")
    assert sorted(r.depth for r in tree.preorder(nodes).collect()) == list(range(30))
    for bad in ([("a", "b", 0), ("b", "a", 0), ("c", None, 0)], [("a", "gone", 0)]):
        with pytest.raises(ValueError, match="cycle"):
            tree.preorder(spark.createDataFrame(bad, "node_id string, parent_id string, ord int"))


def test_a_hot_source_is_numbered_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"s{i % 7}", rng.randrange(100_000)) for i in range(3000)]
    made = tree.number_parts(spark.createDataFrame(rows, "s string, k long"), "s", "k").collect()
    for s in {r.s for r in made}:
        mine = sorted([r for r in made if r.s == s], key=lambda r: r.part)
        assert [r.part for r in mine] == list(range(1, len(mine) + 1)) and [r.k for r in mine] == sorted(r.k for r in mine)


def test_builders_by_kind(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "kind string, t string")
    assert [r.source for r in tree.build(rows, {"a": F.col("t"), "b": F.upper("t")}).collect()] == ["x", "Y"]
    with pytest.raises(Exception, match="no builder"):
        tree.build(rows, {"a": F.col("t")}).collect()
