"""What the finding of round 4 named: each test failed before, the one over single texts for nine of them."""

import duckdb
import pytest

from corpusmill.operators import embed
from tests.test_findings_r03 import _equal

ODD = [
    (0, ""), (1, " \n\t\f\r "), (2, None), (3, "\xa0"), (4, "\x0b"), (5, "plain words"), (5, "other plain rows"), (None, "no id"), (None, "nor id"), (6, ""), (6, "six"),
    (7, "a\xa0b c d\x85e\x1cf\u3000g"), (8, "a\x0bb c"), (9, "w\x0bx " * 100 + "last"), (10, " ".join(f"w{i}\xa0v{i}" for i in range(128)) + " past"),
    (11, "İSTANBUL iki"), (12, "ΑΣ ΣΑΣ Σ"), (13, "ẞ ß \x00 a\x00 🎉"), (14, " ".join(f"w{i}" for i in range(129))), (15, "w" * 5000 + " " * 5000), (16, "\nA a\n" * 200),
]


def _documents(folder, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?, 'en', 's')", [list(r) for r in rows])
    con.sql(f"COPY d TO '{folder}/documents.parquet' (FORMAT parquet)")


@pytest.mark.parametrize("i", [None, *range(len(ODD))])
def test_embed_model_is_its_sql_on_odd_texts(spark, tmp_path, i):
    _documents(tmp_path, ODD if i is None else [ODD[i]])
    _equal(spark, "embed_model", tmp_path)


def test_tokens_are_cut_as_in_sql(spark, tmp_path):
    _documents(tmp_path, [r for r in ODD if None not in r])
    _equal(spark, "count_truncate_format", tmp_path)


def test_a_word_has_the_white_space_and_lower_case_of_the_sql():
    assert list(embed.HashEmbedder().embed(["A\xa0B c\x0bd", " \f\r\n\t", "İ ΑΣ"]).sum(axis=1)) == [2, 0, 2]
    assert (embed.HashEmbedder().embed(["İ ΑΣ"]) == embed.HashEmbedder().embed(["i ασ"])).all()
