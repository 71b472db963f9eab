import hashlib
import random
import zlib

import pytest

from corpusmill.llm import periodic_runs as pr
from corpusmill.llm.registry import planted_period
from tests.llm.helpers import no_docs, odd_docs, odd_rows


def plain_runs(words):
    """Every period by itself: stretches of equal words q apart, the smallest period of a stretch."""
    best = {}
    for q in range(1, len(words) // 4 + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            a = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - (a - q) >= max(6, 4 * q):
                best.setdefault((a - q, i - a + q), q)
    return sorted(((a, n, q) for (a, n), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(a + q <= i < a + n for a, n, q in runs))


def odd_words(rng):
    """Random words, periodic stretches of any period and nested repeats."""
    out = []
    for _ in range(rng.randint(0, 6)):
        kind = rng.random()
        letters = [b"w%d" % i for i in range(rng.choice([1, 2, 3, 8]))]
        if kind < 0.3:
            out += [rng.choice(letters) for _ in range(rng.randint(0, 30))]
        else:
            root = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            if kind > 0.8:
                root = root * rng.randint(1, 5) + [rng.choice(letters)]
            out += (root * rng.randint(2, 8))[: rng.randint(1, 120)]
    return out


@pytest.mark.parametrize("block", [2048, 8])
def test_runs_of_odd_words(monkeypatch, block):
    monkeypatch.setattr(pr, "BLOCK", block)
    rng, met = random.Random(block), 0
    for _ in range(1500):
        words = odd_words(rng)
        runs = plain_runs(words)
        met += len(runs)
        assert pr.text_runs(list(words)) == runs, words
        codes = {}
        assert pr.segment_runs([codes.setdefault(w, len(codes)) for w in words]) == runs
        assert pr.collapse(words, runs) == plain_collapse(words, runs)
    assert met > 1000


def test_all_short_texts_of_two_words():
    for n in range(0, 13):
        for bits in range(1 << n):
            words = [b"ab"[bits >> i & 1 :][:1] for i in range(n)]
            assert pr.text_runs(words) == plain_runs(words)


def test_the_automaton_knows_every_end():
    rng = random.Random(9)
    for _ in range(200):
        codes = [rng.randint(0, 2) for _ in range(rng.randint(1, 25))]
        length, link, end = pr.suffix_automaton(codes)
        stretches = {tuple(codes[a:b]) for a in range(len(codes)) for b in range(a + 1, len(codes) + 1)}
        assert sum(length[s] - length[link[s]] for s in range(1, len(length))) == len(stretches)
        assert sorted(e for e in end if e >= 0) == list(range(len(codes)))


@pytest.mark.parametrize("words", [[b"a"] * 200_000, [b"a", b"b", b"c"] * 70_000, [b"%d" % i for i in range(20_000)] * 5, [b"a"] * 3 + [b"b"] * 199_000])
def test_long_texts(words):
    runs = pr.text_runs(words)
    n = len(words)
    if words[:4] == [b"a"] * 3 + [b"b"]:
        assert runs == [(3, n - 3, 1)]
    else:
        assert runs == [(0, n, next(q for q in (1, 3, 20_000) if words[q] == words[0]))]


def test_long_random_text_of_few_words():
    rng = random.Random(4)
    words = [rng.choice([b"a", b"b"]) for _ in range(30_000)]
    assert pr.text_runs(words) == sorted((r for r in plain_runs_upto(words, 60)), key=lambda r: (r[0], r[2]))


def plain_runs_upto(words, longest):
    best = {}
    for q in range(1, longest):
        at = None
        for i in range(q, len(words) + 1):
            same = i < len(words) and words[i] == words[i - q]
            if same and at is None:
                at = i - q
            if not same and at is not None:
                if i - at >= max(6, 4 * q):
                    best.setdefault((at, i - at), q)
                at = None
    return [(a, n, q) for (a, n), q in best.items()]


def test_documents_against_plain_version(spark):
    rng = random.Random(12)
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(1000 + i, " \n".join(map(bytes.decode, odd_words(rng)))) for i in range(80)], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for doc, text in rows:
        words = planted_period(doc, (text or "").encode().split())
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        want.append((doc, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(plain_collapse(words, runs)).hexdigest()))
    got = [tuple(r) for r in pr.run_digests(pr.find_runs(docs, rewrite=planted_period)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == len(odd_rows()) + 80 and sum(r[1] > 0 for r in got) > 40


def test_planted_period():
    for doc in range(300):
        words = [b"%d" % i for i in range(doc % 41)]
        h, n = zlib.crc32(str(doc).encode()), doc % 41
        g = h // 10
        want = list(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert planted_period(doc, words) == want
    assert planted_period(None, [b"a"]) == [b"a"]


def test_empty_table(spark):
    assert pr.run_digests(pr.find_runs(no_docs(spark), rewrite=planted_period)).collect() == []
