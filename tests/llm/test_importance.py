import math
import random
import struct
from collections import Counter

import numpy as np
import xxhash

from corpusmill.llm import importance as I
from tests.llm.helpers import DE, EN, no_docs, odd_docs, odd_rows, prose


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    keys = [int(x) for x in rng.integers(0, 1 << 62, 500)] + [5, 5, 5, 1 << 40, (1 << 40) + 1]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    order = sorted(keys, reverse=True)
    for k in (1, 2, 77, 500, 501, 503, 504, 505):
        assert I.kth_largest(df, k) == order[k - 1]
    assert I.kth_largest(df, 0) is None


def slow_buckets(text):
    """Buckets of words and neighbouring pairs, one by one, in plain integers."""
    words = [xxhash.xxh32_intdigest(w) for w in (text or "").encode().lower().split()]
    pairs = [((a * 2654435761) % 2**32 ^ (b + 0x9E3779B9) % 2**32) * 2654435761 % 2**32 for a, b in zip(words, words[1:])]
    return [(h ^ (h >> 15)) % I.BUCKETS for h in words + pairs]


def slow_noise(doc_id, seed):
    """Gumbel noise of an id: the session's 64-bit hash of id and seed, as an even number between 0 and 1."""
    h = 42
    if doc_id is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), h)
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), h)
    return -math.log(-math.log(((h >> 11) + 0.5) / 2**53))


def test_query_against_brute_force(spark):
    good = spark.createDataFrame([(i,) for i in range(0, 60)] + [(None,), (5,)], "doc_id long")
    got = I.resample(odd_docs(spark), good, share=0.5).collect()
    raw, target = [1] * I.BUCKETS, [1] * I.BUCKETS
    for r in odd_rows():
        for b in slow_buckets(r[1]):
            raw[b] += 1
            target[b] += r[0] is not None and r[0] < 60
    ratio = [math.log(t / sum(target)) - math.log(q / sum(raw)) for t, q in zip(target, raw)]
    want = Counter()
    for r in odd_rows():
        weight = sum(ratio[b] for b in slow_buckets(r[1]))
        want[r[0], round(weight, 5), round(weight + slow_noise(r[0], 11), 5)] += 1
    assert Counter((r.doc_id, round(r.log_weight, 5), round(r.gumbel_key, 5)) for r in got) == want
    keys = sorted((k for (_, _, k), n in want.items() for _ in range(n)), reverse=True)
    limit = keys[round(0.5 * len(keys)) - 1]
    assert Counter((r.doc_id, round(r.gumbel_key, 5)) for r in got if r.kept) == Counter({(i, k): n for (i, _, k), n in want.items() if k >= limit})
    again = I.resample(odd_docs(spark, 5), good, share=0.5).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got) == sorted((str(r.doc_id), r.kept) for r in again)


def test_good_texts_are_drawn_more_often(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, EN if i % 2 else DE, 30)) for i in range(400)]
    good = spark.createDataFrame([(i,) for i in range(1, 100, 2)], "doc_id long")
    kept = {r.doc_id for r in I.resample(spark.createDataFrame(rows, "doc_id long, text string"), good, share=0.5).collect() if r.kept}
    assert len(kept) == 200 and sum(i % 2 for i in kept) > 190


def test_a_very_long_text(spark):
    long = "some words of a text " * 250_000
    got = I.resample(spark.createDataFrame([(1, long), (2, "words of"), (3, None)], "doc_id long, text string"), spark.createDataFrame([(2,)], "doc_id long")).collect()
    assert {r.doc_id: r.log_weight == 0 for r in got} == {1: False, 2: False, 3: True}


def test_no_target_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert {r.log_weight for r in I.resample(odd_docs(spark), none).collect()} == {0.0}
    assert I.resample(no_docs(spark), none).count() == 0
