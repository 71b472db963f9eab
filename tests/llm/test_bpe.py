import hashlib
import random

import numpy as np
import pytest

from corpusmill.llm import bpe
from tests.llm.helpers import no_docs, odd_docs, odd_rows

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    letters = "abcdefgh ijklmno pqrstuvwxyz'  \t\n\r\x0b\x0c\x1c\x85\xa0 　éÉßẞİΣσςÅ日本語한국각🎉👍🏽0123456789²½Ⅳǅﬁᾼͅ.,;!?<|>#$%'s't'RE'll∑क्षिا‍\x00\x7f"
    out = [r[1] or "" for r in odd_rows()]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    out += ["".join(rng.choice(["th", "in", "er", "an", "on", "re", "s", "e"]) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    return out + ["the" * 1000, "<|endoftext|>x<|startoftext|><|ENDOFTEXT|>", "word."]


def test_ids_and_text_equal_the_library(library):
    own, other = bpe.Encoder(bpe.Vocabulary(PATH)), bpe.Encoder(bpe.LibraryVocabulary(PATH))
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text.encode())
        assert np.frombuffer(got, "<u4").tolist() == ids, text
        assert other.encode(text.encode()) == got
        assert own.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_small_caches_give_the_same(monkeypatch):
    plain = bpe.Encoder(bpe.Vocabulary(PATH))
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(bpe, "PAIR_ENTRIES", 5)
    tight = bpe.Encoder(bpe.Vocabulary(PATH))
    for text in texts()[:300]:
        assert tight.encode(text.encode()) == plain.encode(text.encode())


def test_query(spark, library):
    got = {}
    for r in bpe.encode_digests(odd_docs(spark), PATH).collect():
        got.setdefault(r.doc_id, set()).add((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    want = {}
    for r in odd_rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        shown = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.setdefault(r[0], set()).add((len(ids), shown, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want


def test_round_trip_tables(spark, library):
    docs = odd_docs(spark).filter("doc_id < 20")
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()}
    for r in docs.collect():
        assert back[r.doc_id] == library.decode(library.encode(r.text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_empty_table(spark):
    assert bpe.encode_digests(no_docs(spark), PATH).count() == 0


def test_very_long_texts_and_words(spark, library):
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefgh,.'é") for _ in range(rng.randint(1, 9))) for _ in range(900_000))
    docs = spark.createDataFrame([(1, long), (2, "theinan" * 20_000)], "doc_id long, text string")
    assert len(long) > 5_000_000
    for r in bpe.encode_digests(docs, PATH).collect():
        ids = library.encode(long if r.doc_id == 1 else "theinan" * 20_000, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_other_files_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"added_tokens": [{**spec["added_tokens"][0], "content": "[X]"}]}, {"added_tokens": [{**spec["added_tokens"][0], "content": "<|a b|>"}]}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(path))
