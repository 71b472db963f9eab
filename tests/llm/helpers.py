"""Small fixtures: odd rows that every operator has to take."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for their own columns
        T.StructField("kept", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("_row", T.StringType()),
        T.StructField("n", T.StringType()),
        T.StructField("rate", T.StringType()),
    ]
)

EN = "the of and to in a is that for it was on be with as by this they have from or one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
DE = "der die das und ist nicht ein eine zu mit für auf werden haben über können müssen durch gegen zwischen während würde schön größe straße mädchen freundlich sprechen wissen stadt welt haus immer schon noch mehr viel nach bei aus von sich auch als wie wenn aber oder doch weil".split()
FR = "le la les des une est dans pour que qui pas avec sur être avoir fait même aussi plus tout très où été après était leur deux français élève garçon hôtel mère père frère voix choix beaucoup toujours jamais rien chose homme femme enfant jour temps année vie monde pays ville".split()


def prose(rng, words, n):
    out, line = [], 0
    for _ in range(n):
        out.append(rng.choice(words) + rng.choice(["", "", "", "", ",", "."]))
        line += 1
    text = " ".join(out)
    return "\n".join(text[i : i + 90] for i in range(0, len(text), 90))


def odd_rows(seed=1):
    rng = random.Random(seed)
    rows = []

    def add(doc_id, text, lang="en", source="s0"):
        rows.append((doc_id, text, lang, source, None if text is None else len(text), "x", "y", "z", "w", "v"))

    for i in range(120):
        words, lang = ((EN, "en"), (DE, "de"), (FR, "fr"))[i % 3]
        add(i, prose(rng, words, rng.randint(1, 120)), lang, f"s{i % 5}" if i % 2 else "hot")
    shared = prose(random.Random(99), EN + FR + DE, 60)
    add(200, prose(rng, EN, 40) + " " + shared + " " + prose(rng, EN, 30))
    add(201, prose(rng, FR, 25) + " " + shared + " " + prose(rng, FR, 50), "fr")
    for i in (210, 211, 212):
        add(i, rows[3][1])
    add(213, rows[3][1].replace(" ", "  "))
    add(214, rows[3][1].replace("\n", " "))
    add(rows[7][0], *rows[7][1:4])  # a repeated row
    add(220, None)
    add(221, "", None)
    add(222, " \t\n\r\x0b\x0c ", None, None)
    add(223, "12345 67890 !!! ###")
    add(None, "a document without an id and with few words")
    add(None, None, None, None)
    add(224, "x" * 5000)
    add(225, "日本語のテキスト。" * 40, "ja", "s9")
    add(226, "Ünï Σίσυφος ǅ ﬁ İstanbul ÉCOLE é     \x1c end 🎉👍🏽")
    add(227, ("spam and eggs " * 300).strip())
    add(228, "same line here\n" * 30 + prose(rng, EN, 30))
    add(229, prose(rng, EN, 3000))
    add(230, "<|startoftext|> a <|endoftext|>b</s>[INST]")
    return rows


def odd_docs(spark, parts=3):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(parts)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
