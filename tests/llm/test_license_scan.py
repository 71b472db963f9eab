import random
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import license_scan as L
from tests.llm.helpers import EN, no_docs, odd_docs, prose

TOKEN = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def grams(line):
    """N-grams, without the code under test."""
    words, out = TOKEN.findall(line.lower()), set()
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            out.add(" ".join(words[i : i + n]))
    return out


def slow(model, line):
    """Family and probability of a line, in plain Python."""
    z = np.array(model.bias) + sum((np.array(model.weights[g]) for g in grams(line) if g in model.weights), np.zeros(len(model.families)))
    e = np.exp(z - z.max())
    return model.families[int(z[:-1].argmax())], 1 - e[-1] / e.sum()


def shares(model, family, line):
    """Of the family's templates: confirmed, overlap."""
    out = []
    for f, _, g, keys in model.templates:
        if f == family:
            overlap = len(set(g) & grams(line)) / len(g)
            out.append((overlap >= L.CONFIRM and set(keys) <= grams(line), overlap))
    return max(out)


def lines():
    out = [t for ts in L.TEMPLATES.values() for t in ts] + list(L.BACKGROUND) + list(L.OTHERS)
    out += [f"SPDX-License-Identifier: {i}" for ids in L.SPDX.values() for i in ids]
    out += ["I have a driving license.", "license", "the MIT people", "Copyright", "Code under the Apache License, Version 2.0, and more words after it", ""]
    return out


def test_scan_equals_plain_python(spark):
    model = L.train()
    docs = spark.createDataFrame([(i, f"first paragraph\n \n\n{line}\n\nlast one", "x") for i, line in enumerate(lines())], "doc_id long, text string, family string")
    got = {(r.doc_id, r.paragraph, r.line): r for r in L.scan_licenses(docs).collect()}
    for i, line in enumerate(lines()):
        family, p = slow(model, line)
        if p >= model.threshold:
            r = got.pop((i, 1, 0))
            assert r.family == family and r.probability == pytest.approx(p, abs=1e-5) and r.notice == line
            assert (r.confirmed, r.overlap) == (shares(model, family, line)[0], pytest.approx(shares(model, family, line)[1], abs=1e-5))
    assert not got


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [set() for _ in texts]
    for r in L.scan_licenses(docs).collect():
        if r.confirmed:
            out[r.doc_id].add(r.family)
    return out


def test_every_template_is_confirmed_and_nothing_else(spark):
    wanted = [(f, t) for f, ts in L.TEMPLATES.items() for t in ts] + [(f, f"SPDX-License-Identifier: {i}") for f, ids in L.SPDX.items() for i in ids]
    assert found(spark, [t for _, t in wanted]) == [{f} for f, _ in wanted]
    assert found(spark, [*L.OTHERS, *L.BACKGROUND]) == [set()] * (len(L.OTHERS) + len(L.BACKGROUND))


def test_licences_that_were_never_seen_are_not_confirmed(spark):
    other = [
        "Licensed under the EUPL, Version 1.2 or later.",
        "Licensed under the Eclipse Public License v2.0 and the Eclipse Distribution License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
        "This work is licensed under CC BY-NC-ND 4.0.",
        "Distributed under the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
        "Licensed under the Mozilla Public License, version 1.1.",
        "Licensed under the Apache License, Version 1.0.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "SPDX-License-Identifier: EUPL-1.2",
        "Released under the X11 License.",
        "GNU Free Documentation License, Version 1.3",
    ]
    assert found(spark, other) == [set()] * len(other)


def test_what_only_sounds_like_a_notice(spark):
    none = ["All rights reserved for tonight's dinner at the house.", "This is not released under the MIT License.", "The code was never licensed under the terms of the Mozilla Public License, version 2.0.", "It is no longer distributed under the BSD License."]
    assert found(spark, none + ["some words\n" + t + "\nmore" for t in none]) == [set()] * (2 * len(none))
    some = ["All rights reserved.", "Copyright 2020, all rights reserved", "Not a word of it.\nReleased under the MIT License."]
    assert found(spark, some) == [{"proprietary"}, {"proprietary"}, {"MIT"}]


def test_threshold_binds():
    """The unknown class is calibrated on licences that training has not seen; most of them stay below, every template above."""
    model = L.train()
    assert 0.55 < model.threshold < 0.95
    unseen = [slow(model, t)[1] for t in L.OTHERS[1::2]]
    assert sum(p < model.threshold for p in unseen) >= 0.8 * len(unseen)
    assert all(slow(model, " ".join(ts))[0] == f and slow(model, " ".join(ts))[1] >= model.threshold for f, _, ts in L.notices())


def test_noisy_notices_are_found_again(spark):
    rng = random.Random(2)
    texts, want = [], []
    for f, ts in L.TEMPLATES.items():
        for t in ts:
            for _ in range(6):
                words = t.split()
                words.insert(rng.randrange(len(words)) if len(words) > 14 else len(words), rng.choice(EN))
                texts.append(prose(rng, EN, 40) + "\n" + " ".join(words) + "\n" + prose(rng, EN, 40))
                want.append(f)
    told = found(spark, texts)
    assert sum(f in t for f, t in zip(want, told)) >= 0.95 * len(want)
    assert all(t <= {f} for f, t in zip(want, told))


def test_a_paragraph_without_anchor_has_no_feature():
    model = L.train()
    assert all(set(g.split()) & set(model.anchors) for g in model.weights)
    assert slow(model, "words without any of them")[1] < model.threshold


def test_odd_rows_and_repeats(spark):
    assert L.scan_licenses(odd_docs(spark)).count() == 0
    assert L.scan_licenses(no_docs(spark)).count() == 0
    twice = spark.createDataFrame([(None, "Released under the MIT License.")] * 2, "doc_id long, text string")
    assert [(r.family, r.confirmed) for r in L.scan_licenses(twice).collect()] == [("MIT", True)] * 2


def test_a_very_long_text(spark):
    text = "some plain words of a long text\n" * 80_000 + "Released under the MIT License.\n" + "and on it goes " * 200_000
    assert len(text) > 5_000_000
    got = L.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.family, r.paragraph, r.line, r.confirmed) for r in got] == [("MIT", 0, 80_000, True)]


def test_no_python_in_the_plan(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(L.C, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    plans.append(L.scan_licenses(odd_docs(spark))._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3 and not any("Python" in p or "Arrow" in p for p in plans)


def test_wrapped_notices_and_two_families_in_a_line(spark):
    long = {f: ts[1] for f, ts in L.TEMPLATES.items() if f in ("MIT", "BSD", "GPL", "CC-BY", "CC-BY-NC")}
    wrapped = [(f, "some words before\n\n" + textwrap.fill(t, 40) + "\n\nand after") for f, t in long.items()]
    within = [(f, "some words before\n" + textwrap.fill(t, 40) + "\nand after") for f, t in long.items()]
    both = "Released under the MIT License. Licensed under the Mozilla Public License, version 2.0."
    docs = spark.createDataFrame([*((i, t) for i, (_, t) in enumerate(wrapped + within)), (100, both)], "doc_id long, text string")
    rows = L.scan_licenses(docs).collect()
    assert {(r.doc_id, r.family) for r in rows if r.confirmed} == {(i, f) for i, (f, _) in enumerate(wrapped + within)} | {(100, "MIT"), (100, "MPL-2.0")}
    assert all((r.paragraph, r.line) == (1, None) and r.probability > 0.9 for r in rows if r.confirmed and r.doc_id < len(wrapped))


def test_many_notices_in_one_paragraph(spark):
    """A paragraph full of notices: apart from each other all are found once; side by side each family is."""
    rng = random.Random(8)
    kinds = {"MIT": "Released under the MIT License.", "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0."}
    plain = [w for w in EN if w != "not"]  # no denials
    picked = [rng.choice(sorted(kinds)) for _ in range(20_000)]
    apart = " ".join(kinds[f] + " " + prose(rng, plain, 150).replace("\n", " ") for f in picked[:1000])
    docs = spark.createDataFrame([(1, apart), (2, " ".join(kinds[f] for f in picked))], "doc_id long, text string")
    rows = L._in_windows(docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "0L AS paragraph", "text"), L.train())
    got = {(r.doc_id, r.family): r.n for r in rows.groupBy("doc_id", "family").agg(F.count("*").alias("n")).collect()}
    assert all(got[1, f] == picked[:1000].count(f) for f in kinds)
    assert set(got) == {(i, f) for i in (1, 2) for f in kinds}
