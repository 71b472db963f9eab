import random
import zlib

import numpy as np
import pytest

from corpusmill.llm import packing
from tests.llm.helpers import no_docs, odd_docs, odd_rows

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def slow_first_fit(sizes, room):
    bins = []
    for i, size in enumerate(sizes):
        for b in bins:
            if sum(sizes[k] for k in b) + size <= room:
                b.append(i)
                break
        else:
            bins.append([i])
    return bins


def test_tournament_tree_is_first_fit():
    rng = random.Random(4)
    for _ in range(60):
        room = rng.choice([8, 100, 2048])
        sizes = sorted((rng.randint(1, room) for _ in range(rng.randint(0, 200))), reverse=True)
        assert packing.first_fit_decreasing(sizes, room) == slow_first_fit(sizes, room)


def test_every_id_lies_in_one_piece(spark):
    library = tokenizers.Tokenizer.from_file(PATH)
    rows = packing.pack_documents(odd_docs(spark), PATH, room=64, group_rests=40, with_ids=True)
    pieces = rows.collect()
    want, got = {}, {}
    for r in odd_rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.setdefault(r[0], []).append(ids)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length <= 64 and zlib.crc32(p.ids) == p.ids_crc32
        assert any(len(d) == p.doc_tokens and d[p.start : p.start + p.length] == ids for d in want[p.doc_id])
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == {k: sum(map(len, v)) for k, v in want.items()}
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for s in packing.assemble(rows).collect():
        assert len(s.ids) == 4 * s.tokens == 4 * sum(n for _, n in by_sequence[s.sequence_id])


def test_little_padding():
    rng = random.Random(6)
    sizes = sorted((min(2047, int(rng.expovariate(1 / 700)) + 1) for _ in range(8192)), reverse=True)
    bins = packing.first_fit_decreasing(sizes, 2048)
    assert len(bins) * 2048 < 1.005 * sum(sizes) + 2048


def test_packing_does_not_depend_on_the_split(spark):
    rng = random.Random(7)
    rows = [(i, "word " * rng.randint(0, 300)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def sequences(df):
        by = {}
        for p in packing.pack_documents(df, PATH, room=256, group_rests=50).collect():
            by.setdefault(p.sequence_id, []).append((p.offset, p.doc_id, p.start, p.length))
        return sorted(sorted(parts) for parts in by.values())

    assert sequences(docs.repartition(2)) == sequences(docs.repartition(7))


def test_a_rest_that_repeats_fills_no_group(spark):
    docs = spark.createDataFrame([(1, "same words here")] * 1000 + [(i, f"other {i}") for i in range(2, 500)], "doc_id long, text string").repartition(5)
    pieces = packing.pack_documents(docs, PATH, room=64, group_rests=100).collect()
    groups = {}
    for p in pieces:
        groups[p.sequence_id >> 32] = groups.get(p.sequence_id >> 32, 0) + 1
    assert len(pieces) == 1498 and max(groups.values()) < 200
    assert len({(p.sequence_id, p.offset) for p in pieces}) == 1498


def test_full_sequences_and_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "ab " * 1_700_000), (2, "x"), (None, None)], "doc_id long, text string")
    pieces = packing.pack_documents(docs, PATH).collect()
    long = sorted((p.start, p.length, p.sequence_id) for p in pieces if p.doc_id == 1)
    assert [s for s, _, _ in long] == list(range(0, long[-1][0] + 1, 2048)) and all(n == 2048 and s < 0 for _, n, s in long[:-1])
    assert len({s for *_, s in long}) == len(long) and sum(n for _, n, _ in long) == next(p.doc_tokens for p in pieces if p.doc_id == 1)
    assert len({p.sequence_id for p in pieces if p.sequence_id >= 0}) <= 2


def test_empty_table(spark):
    assert packing.pack_documents(no_docs(spark), PATH).count() == 0
