import json
import time

import pytest

from corpusmill.streaming import ingest, sessions


@pytest.fixture
def desk(spark, tmp_path):
    """A folder of typed lines, and what a stream over it has written."""

    class Desk:
        def put(self, name, *lines):
            (tmp_path / "in").mkdir(exist_ok=True)
            (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps({"session": s, "line_no": n, "line": t}) for s, n, t in lines))

        def stream(self, idle_ms=None):
            lines = spark.readStream.schema("session string, line_no long, line string").json(str(tmp_path / "in"))
            return sessions.question_stream(lines, idle_ms).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark"))

        def run(self):
            sessions.started(self.stream().trigger(availableNow=True), spark).awaitTermination()
            return self.rows()

        def rows(self):
            return sorted((r.session or "", r.query_id, r.question, r.reloads) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    return Desk()


FIRST = [("a", 1, " hi "), ("a", 2, ":reload"), ("b", 1, "x"), ("b", 2, ":exit\t"), ("b", 3, "no"), (None, 5, "nobody's"), ("c", None, "no number"), ("c", 1, None)]
THEN = [("a", 2, ":reload"), ("a", 3, "again"), ("b", 4, "still closed"), ("b", 5, ":reload"), ("a", 4, "  "), ("a", 5, ":reload"), ("a", 6, "last"), ("c", 2, "c")]


def test_state_outlives_a_restart(spark, desk):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    desk.put("1", *FIRST)
    assert desk.run() == [("", 5, "nobody's", 0), ("a", 1, "hi", 0), ("b", 1, "x", 0)]
    assert desk.run() == desk.rows()  # nothing new
    desk.put("2", *THEN)
    got = desk.run()
    assert got == [("", 5, "nobody's", 0), ("a", 1, "hi", 0), ("a", 3, "again", 1), ("a", 6, "last", 2), ("b", 1, "x", 0), ("c", 2, "c", 0)]
    lines = spark.createDataFrame([x for x in dict.fromkeys(FIRST + THEN) if x[1]], "session string, line_no long, line string")
    assert sorted((r.session or "", r.query_id, r.question, r.reloads) for r in ingest.question_lines(lines.na.fill("")).collect()) == got
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_an_idle_session_is_forgotten(spark, desk):
    desk.put("1", ("a", 1, ":reload"), ("a", 2, "one"), ("b", 1, ":exit"))
    query = sessions.started(desk.stream(idle_ms=1000).trigger(processingTime="100 milliseconds"), spark)
    try:
        until = time.time() + 60
        while time.time() < until and not query.exception():
            try:
                if ("a", 2, "one", 1) in desk.rows():
                    break
            except Exception:  # nothing is written yet
                pass
            time.sleep(0.5)
        time.sleep(5)  # both sessions go
        desk.put("2", ("a", 1, "fresh"), ("b", 1, "open"))
        while time.time() < until and len(desk.rows()) < 3 and not query.exception():
            time.sleep(0.5)
    finally:
        query.stop()
    assert desk.rows() == [("a", 1, "fresh", 0), ("a", 2, "one", 1), ("b", 1, "open", 0)]
