"""Licence scans against a plain model, on real licence texts and headers, and inheritance by directories."""

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import licenses

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KNOWN = licenses.templates()
FILLER = "plain words of some other text that has nothing to do with it\n"


def _texts():
    found = {}
    for file in sorted(os.listdir(licenses.TEXTS)):
        with open(os.path.join(licenses.TEXTS, file), encoding="utf-8") as f:
            found[file.removesuffix(".txt")] = f.read()
    return found


def _plain(texts, threshold=licenses.THRESHOLD):
    """(license, cosine) of each text, every unit against every template."""
    words = [set(licenses.terms(t or "")) for t in texts]
    held = Counter(w for x in words for w in x)
    n = len(texts)
    idf = lambda w: math.log((1 + n) / (1 + (held[w] if w in vocabulary else 0))) + 1
    vocabulary = {w for _, _, t in KNOWN for w in licenses.terms(t)}

    def vector(ws):
        v = {w: k * idf(w) for w, k in Counter(ws).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = [(name, notice, vector(licenses.terms(t))) for name, notice, t in KNOWN]
    out = []
    for text in texts:
        low = (text or "").lower()
        units = [(x, "line") for x in low.split("\n")] + [(x, "block") for x in re.split(r"\n(?:[\W_]*\n)+", low)] + [(low, "whole")]
        covered, top = Counter(), {}
        for unit, kind in units:
            if ws := licenses.terms(unit):
                v = vector(ws)
                reached = {}
                for name, notice, t in vectors:
                    if notice == (kind == "line"):
                        c = round(sum(x * t.get(w, 0.0) for w, x in v.items()), 9)
                        if c >= threshold:
                            reached[name] = max(c, reached.get(name, 0))
                for name, c in reached.items():
                    covered[name, kind] += c * len(ws)
                    top[name] = max(c, top.get(name, 0))
        best = min(((-round(max(x for (n, _), x in covered.items() if n == name), 6), name) for name in top), default=None)
        out.append((best[1], top[best[1]]) if best else (None, None))
    return out


def _scan(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.id: r for r in licenses.license_units(spark, rows).collect()}


def _same(spark, texts):
    got = _scan(spark, texts)
    for n, (name, cosine) in enumerate(_plain(texts)):
        assert got[n].license == name and (cosine is None or abs(got[n].cosine - cosine) < 1e-6), (n, got[n], name, cosine)


def test_every_unit_against_every_template(spark):
    texts = list(_texts().values())
    cut = [t[len(t) // 3 :] for t in texts[:6]]
    lines = ["Released under the MIT License.", "free software, public domain and source code by the way", "version 2 of the general terms", None, "", "\n \n", "Licensed under the Foo License.", "SPDX-License-Identifier: Foo-1.0"]
    _same(spark, [*texts, *cut, *lines, *(FILLER * 3 + t[:500] for t in texts), FILLER * 20])


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_all_documents(spark):
    _same(spark, [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()])


def test_licence_files(spark):
    texts = _texts()
    filled = {n: t.replace("<year>", "2021").replace("<copyright holders>", "Jo Doe and others").replace("<owner>", "Jo Doe") for n, t in texts.items()}
    rows = [(n, f"{name}/LICENSE", filled[name]) for n, name in enumerate(texts)] + [(100 + n, f"{name}/src/x", FILLER) for n, name in enumerate(texts)]
    out = licenses.license_scan(spark, spark.createDataFrame(rows, "doc_id bigint, p string, text string"), F.col("p"))
    got = {r.id: r for r in out.collect()}
    for n, name in enumerate(texts):
        assert got[n].is_license_file and got[n].own_license == name, (name, got[n])
        assert got[100 + n].license == name and got[100 + n].inherited_from == name


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_headers_of_source_files(spark, mark):
    names = list(licenses.HEADERS)

    def header(text):
        words, lines = text.split(), []
        for n in range(0, len(words), 11):
            lines.append(mark + " ".join(words[n : n + 11]))
        return f"{mark}Copyright 2020 Jo Doe\n{mark}\n" + "\n".join(lines) + "\n\n" + FILLER * 30

    got = _scan(spark, [header(licenses.HEADERS[n]) for n in names])
    assert [got[n].license for n in range(len(names))] == names
    assert all(got[n].license_words < 0.5 * got[n].n_words for n in range(len(names)))


def test_tags_and_notices(spark):
    cases = {
        "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "The MIT License (MIT)": "MIT",
        "SPDX-License-Identifier: Frob-9": licenses.OTHER, "Released under the Frob License.": licenses.OTHER, "Apache License": None, "the version of the software": None, "license plates of the public": None,
    }
    got = _scan(spark, [f"{FILLER}{t}\n{FILLER}" for t in cases])
    for n, (text, want) in enumerate(cases.items()):
        assert got[n].license == want or want is None and (got[n].license is None or got[n].cosine < 0.9), (text, got[n])


def test_rows_of_the_corpus(spark, docs, clashing):
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce(F.col("doc_id").cast("string"), F.lit("x")))
    for d in (docs, clashing):
        rows = licenses.license_scan(spark, d, path).collect()
        got = {r.id: r for r in rows}
        assert Counter(r.id for r in rows) == Counter(r.doc_id for r in d.collect())
        assert got[502].own_license == "MIT" and got[502].cosine == 1.0 and not got[502].is_license_file
        assert got[503].is_license_file and got[503].license == "Apache-2.0"
        assert got[504].license == "Apache-2.0" and got[504].inherited_from == "s2" and got[500].license is None
    assert licenses.license_scan(spark, docs.limit(0), path).count() == 0


def test_nearest_directory(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x", "some text"), (3, "a/b/LICENSE", "Licensed under CC BY-NC 4.0."), (4, "a/y", "t"), (5, "z/y", "t"), (6, None, "t"), (7, "a/b/own", "Licensed under CC BY 4.0.\n" + "text " * 50)]
    got = {r.id: r.license for r in licenses.license_scan(spark, spark.createDataFrame(rows, "doc_id bigint, p string, text string"), F.col("p")).collect()}
    assert got == {1: "MIT", 2: "CC-BY-NC-4.0", 3: "CC-BY-NC-4.0", 4: "MIT", 5: None, 6: None, 7: "CC-BY-4.0"}


def test_units_below_the_bounds_cannot_match():
    weights = licenses.Weights({t: 3 for _, _, x in KNOWN for t in licenses.terms(x)}, 10, KNOWN, 0.6)
    for _, notice, v in weights.templates:
        if notice:
            assert sum(x * x for t, x in v.items() if t not in weights.strong) < 0.36
        else:
            low = [k for k in (0, *licenses.SIZES) if k <= len(v)][-1]
            strong, least = weights.bounds[(0, *licenses.SIZES).index(low)]
            best = sorted((x * x for t, x in v.items() if t in strong), reverse=True)[: least - 1]
            assert sum(x * x for t, x in v.items() if t not in strong) + sum(best) < 0.36


def test_long_lines(spark):
    text = " ".join(f"license w{n}" for n in range(60_000))
    assert _scan(spark, [text, "Released under the MIT License."])[0].license is None


def test_words_of_units_are_not_shuffled(spark, monkeypatch):
    shuffles, staged = {}, licenses.staged

    def counted(spark, df, label):
        shuffles[label] = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        return staged(spark, df, label)

    monkeypatch.setattr(licenses, "staged", counted)
    docs = spark.createDataFrame([(1, KNOWN[0][2]), (2, FILLER), (3, KNOWN[0][2])], "doc_id bigint, text string")
    assert licenses.license_units(spark, docs).where("license is not null").count() == 2
    # units meet once, by the texts' hashes; their words, templates and licenses are summed where they are
    assert "license-units" not in shuffles and shuffles["license-scores"] == 1
