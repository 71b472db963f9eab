import random
import re
from collections import Counter

from corpusmill.llm import quality_rules as Q
from tests.llm.helpers import no_docs, odd_docs, odd_rows


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), lines


def test_measures_of_odd_and_random_texts():
    rng = random.Random(8)
    texts = [r[1] for r in odd_rows()]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["\n".join(rng.choice(["x", "", " ", "y z", "\t", "x "]) for _ in range(rng.randint(0, 20))) for _ in range(200)]
    for text in texts:
        assert Q.measure((text or "").encode()) == slow(text), text


def test_query(spark):
    got = Q.judge_documents(odd_docs(spark)).collect()
    want = Counter((r[0], r[3], *slow(r[1])) for r in odd_rows())
    assert Counter((r.doc_id, r.host, *(r[m] for m in Q.METRICS)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.host_ok)
    assert len({(r.host, r.host_ok) for r in got}) == len({r.host for r in got})


def test_hosts_are_shrunk(spark):
    good, bad = "these are " + " ".join(f"word{i}" for i in range(40)), "too short"
    rows = [(i, good, f"h{i % 30}") for i in range(3000)] + [(9000 + i, bad, "spam") for i in range(400)] + [(9900 + i, good, "spam") for i in range(40)]
    rows += [(9990, bad, "small"), (9991, good, "small")]
    got = {r.doc_id: r for r in Q.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[9900].kept and not got[9900].base_failed  # a clean document of a host that mostly fails
    assert got[9991].kept and got[0].kept  # one failure of two says little
    assert got[9991].host_rate < 0.5 < got[9900].host_rate


def test_a_very_long_text_and_a_hot_host(spark):
    long = " ".join(f"word{i % 50_000}" for i in range(600_000))
    rows = [(i, "a few words " * 10, "hot") for i in range(3000)] + [(9000, long, "hot"), (9001, None, None)]
    got = {r.doc_id: r for r in Q.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == len(rows) and got[9000].n_words == got[9000].n_repeat_words == 600_000 and got[9000].base_failed
    assert got[9001].base_failed and got[9001].n_words == 0


def test_empty_table(spark):
    assert Q.judge_documents(no_docs(spark)).count() == 0
