import pytest

from corpusmill.streaming.ledger import Ledger, LedgerPublisher


@pytest.fixture
def run(spark, tmp_path):
    """Runs a stream over a folder of numbers, a file a batch, to its end."""

    def go(publisher):
        numbers = spark.readStream.schema("n long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = numbers.writeStream.foreachBatch(publisher.notify).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination()

    (tmp_path / "in").mkdir()
    go.put = lambda n: (tmp_path / "in" / f"{n}.json").write_text(f'{{"n": {n}}}')
    go.publisher = lambda: LedgerPublisher(Ledger(spark, str(tmp_path / "mark" / "subscribers")))
    return go


def test_each_batch_once_although_one_fails(run):
    for n in range(3):
        run.put(n)
    seen, broken = {"good": [], "frail": []}, [True]

    def frail(batch, number):
        if number == 1 and broken:
            broken.pop()
            raise OSError("down")
        seen["frail"].append((number, batch.count()))

    def told():
        p = run.publisher()
        p.attach("frail", frail)
        p.attach("good", lambda batch, number: seen["good"].append((number, batch.count())))
        return p

    with pytest.raises(Exception, match="batch 1 failed for frail"):
        run(told())
    assert seen == {"good": [(0, 1), (1, 1)], "frail": [(0, 1)]}
    run(told())
    run(told())
    assert seen == {"good": [(0, 1), (1, 1), (2, 1)], "frail": [(0, 1), (1, 1), (2, 1)]}
    run.put(3)
    late = told()
    late.attach("late", lambda batch, number: seen.setdefault("late", []).append((number, batch.count())))
    late.detach("good")
    run(late)
    assert seen["late"] == [(3, 1)] and seen["frail"][-1] == (3, 1) and len(seen["good"]) == 3


def test_ledger_and_names(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    assert ledger.last("a") == -1
    for n in (0, 1, 1, 12):
        ledger.enter("a", n)
    assert ledger.last("a") == 12 and ledger.last("b") == -1 and sum(not p.name.startswith(".") for p in (tmp_path / "l" / "a").iterdir()) == 1
    p = LedgerPublisher(ledger)
    p.attach("a", print)
    for bad in ("a", "", "x/y", ".x"):
        with pytest.raises(ValueError):
            p.attach(bad, print)
