import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import complement_packing as cp
from corpusmill.llm.packing import assemble
from tests.llm.helpers import no_docs, odd_docs, odd_rows

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
ALPHABET = ["a", "b", "é", "ª", "²", "ÿ", " ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "中", "🎉", "1", "'s", "'ll", "!", ".", ",", "<|endoftext|>", "<|", "word", "The", "\x00", "̀", "ſ", "٣"]


@pytest.fixture(scope="module")
def encoder():
    return cp.ByteEncoder(PATH)


def test_ids_are_those_of_the_library(encoder):
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14)))
        assert list(array("I", encoder.encode(text.encode()))) == encoder.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_plain_character_beside_letters_and_spaces(encoder):
    for c in map(chr, range(256)):
        for text in (c, f"a{c}b", f" {c}", f"{c} x", f"a {c}a\n{c}\n\n{c} ", f"a{c}.", f"\n{c}{c} {c}"):
            assert list(array("I", encoder.encode(text.encode()))) == encoder.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_full_cache_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(cp, "CACHE_ENTRIES", 3)
    small = cp.ByteEncoder(PATH)
    text = "one two, three. four five\nsix seven one two eight."
    for _ in range(3):
        assert small.encode(text.encode()) == encoder.encode(text.encode())


@pytest.mark.parametrize("text", ["x" * 300_000, " " * 300_000, "ab " * 500_000, "\n" * 100_000 + "a"])
def test_long_texts(encoder, text):
    assert list(array("I", encoder.encode(text.encode()))) == encoder.library.encode(text, add_special_tokens=False).ids


def checked(plan, counts, room):
    used = Counter()
    for pattern, of in plan:
        assert of > 0 and 0 < sum(n * k for n, k in pattern.items()) <= room
        for n, k in pattern.items():
            used[n] += k * of
    assert +used == +Counter(counts)
    return sum(of for _, of in plan)


def plain_best_fit(counts, room):
    gaps = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((room if fit is None else fit) - n)
    return Counter(gaps)


def test_best_fit_on_counts_is_best_fit_one_by_one():
    rng = random.Random(1)
    for _ in range(300):
        room = rng.choice([10, 64, 100])
        counts = {rng.randint(1, room): rng.randint(1, 9) for _ in range(rng.randint(0, 12))}
        plan = cp.best_fit(counts, room)
        checked(plan, counts, room)
        gaps = Counter()
        for pattern, of in plan:
            gaps[room - sum(n * k for n, k in pattern.items())] += of
        assert gaps == plain_best_fit(counts, room)


def test_exact_patterns_fill_exactly_and_miss_no_combination_of_four():
    rng = random.Random(2)
    for _ in range(200):
        room = rng.choice([12, 40, 100])
        counts = {rng.randint(1, room): rng.randint(1, 6) for _ in range(rng.randint(0, 10))}
        plan, rest = cp.exact_patterns(counts, room)
        assert all(sum(n * k for n, k in p.items()) == room for p, _ in plan)
        checked(plan + cp.best_fit(rest, room), counts, room)
        index, none = cp.SumIndex(counts, room), Counter()
        for gap in range(1, room + 1):
            some = [n for n in counts if n <= gap]
            want = any(sum(c) == gap and all(counts[n] >= c.count(n) for n in c) for k in (1, 2, 3) for c in combos(some, k))
            found = index.fill(gap, none)
            assert (found is not None) == want
            assert not found or sum(found) == gap and all(counts[n] >= found.count(n) for n in found)


def combos(of, k):
    from itertools import combinations_with_replacement

    return combinations_with_replacement(of, k)


def test_few_sequences():
    rng = random.Random(6)
    counts = Counter(min(2047, int(rng.expovariate(1 / 700)) + 1) for _ in range(20_000))
    assert checked(cp.plan_sequences(counts, 2048), counts, 2048) <= -(-sum(n * k for n, k in counts.items()) // 2048) + 1
    assert checked(cp.plan_sequences({1500: 10**12, 548: 10**12 - 7, 3: 5}, 2048), {1500: 10**12, 548: 10**12 - 7, 3: 5}, 2048) == 10**12
    assert cp.plan_sequences({}, 2048) == [] and checked(cp.plan_sequences({1: 10**9}, 2048), {1: 10**9}, 2048) == -(-(10**9) // 2048)


def laid_out(pieces, room):
    """Offsets are gapless; the number of sequences."""
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(by)


def test_pieces_and_sequences(spark):
    library = tokenizers.Tokenizer.from_file(PATH)
    rows = cp.pack_documents(odd_docs(spark), PATH, room=64, with_ids=True, group_rows=20)
    pieces = rows.collect()
    want, got = Counter(), Counter()
    for r in odd_rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 64 or 64
        for piece, start in enumerate([0, *range(first, len(ids), 64)]):
            part = ids[start : start + (64 if piece else first)]
            want[r[0], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    for p in pieces:
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
        got[p.doc_id, p.piece, p.start, p.length, p.ids_crc32] += 1
    assert got == want
    sequences = laid_out(pieces, 64)
    rests = Counter(p.length for p in pieces if p.length < 64)
    assert sequences <= sum(plain_best_fit(rests, 64).values()) + sum(p.length == 64 for p in pieces)
    assert {s.sequence_id: (s.tokens, len(s.ids)) for s in assemble(rows).collect()} == {i: (n, 4 * n) for i, n in ((i, sum(p.length for p in pieces if p.sequence_id == i)) for i in {p.sequence_id for p in pieces})}


def test_one_length_over_many_groups(spark):
    docs = spark.createDataFrame([(1, "same words here")] * 1500 + [(None, None)] * 400 + [(i, "x " * (i % 50)) for i in range(2, 900)], "doc_id long, text string").repartition(7)
    pieces = cp.pack_documents(docs, PATH, room=64, group_rows=100).collect()
    assert len(pieces) >= 2798 and len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    assert laid_out(pieces, 64) == -(-sum(p.length for p in pieces) // 64)


def test_the_split_does_not_matter(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, "word " * rng.randint(0, 300)) for i in range(400)], "doc_id long, text string")

    def places(df):
        return sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32, p.sequence_id if p.length < 256 else -1, p.offset) for p in cp.pack_documents(df, PATH, room=256).collect())

    assert places(docs.repartition(2).sortWithinPartitions("doc_id")) == places(docs.repartition(5).sortWithinPartitions("doc_id"))


def test_multiples_of_the_room(spark):
    one = "word"
    ids = tokenizers.Tokenizer.from_file(PATH).encode(" ".join([one] * 127), add_special_tokens=False).ids
    assert len(ids) == 127
    docs = spark.createDataFrame([(1, " ".join([one] * 127)), (2, " ".join([one] * 128)), (3, "")], "doc_id long, text string")
    got = sorted((p.doc_id, p.piece, p.start, p.length) for p in cp.pack_documents(docs, PATH, room=64).collect())
    assert got == [(1, 0, 0, 64), (1, 1, 64, 64), (2, 0, 0, 1), (2, 1, 1, 64), (2, 2, 65, 64), (3, 0, 0, 1)]


def test_empty_table(spark):
    assert cp.pack_documents(no_docs(spark), PATH).count() == 0
