from quire.llm import licenses as L
from tests.llm.common import clash, documents, edge_texts, rows


def test_texts_lines_and_spellings(spark):
    isc = L.KNOWN["ISC"]
    texts = ["Released under the MIT Licence!", "intro\nLicensed under CC BY-NC 4.0.\nend\n licensed under cc by-nc 4.0",
             "Copyright (c) 2020 Someone\n\n" + isc.upper(), isc + " and more", "Copyright 2021 X", *edge_texts()]
    got = rows(L.license_scan(clash(documents(spark, texts)), L.known_licenses(spark)))
    assert [r["license_id"] for r in got[:5]] == ["MIT", None, "ISC", None, None]
    assert [(r["n_license_lines"], r["line_licenses"]) for r in got[:3]] == [(1, "MIT"), (2, "CC-BY-NC-4.0"), (0, "")]
    assert all(r["license_id"] is None and r["n_license_lines"] == 0 for r in got[5:])


def test_empty_and_repeated(spark):
    known = L.known_licenses(spark)
    assert L.license_scan(documents(spark, []), known).count() == 0
    df = documents(spark, ["Released under the MIT License."])
    got = rows(L.license_scan(df.unionByName(df), known))
    assert len(got) == 2 and got[0] == got[1] and got[0]["n_license_lines"] == 1


def test_whole_texts_as_published_and_unwrapped(spark):
    names = [L.SAME.get(n, n) for n in L.TEXTS for _ in range(2)]
    texts = [t for n in L.TEXTS for t in (L.license_text(n), L.unwrapped(L.license_text(n)))]
    mit = L.license_text("MIT").replace("<year> <copyright holders>", "2021 Some One").split("\n", 1)[1]
    isc = L.KNOWN["ISC"].replace("above copyright", "above\ncopyright")
    texts += [mit, isc, "Copyright 2020 The Authors\n" + isc, L.license_text("Apache-2.0") + "\nmore"]
    got = rows(L.license_scan(documents(spark, texts), L.known_licenses(spark)))
    assert [r["license_id"] for r in got] == [*names, "MIT", "ISC", "ISC", None]


def test_only_copyright_statements_are_dropped(spark):
    gone = ["Copyright (c) 2020 X", "copyright 2020", "Copyright The Authors", "(C) 2019 Y", "\u00a9 Z", "# Copyright: A",
            "Copyright [yyyy] [name]", "All rights reserved."]
    kept = ["copyright notice and this", "COPYRIGHT HOLDERS AND", "copyrighted by", "(c) You must retain", "copyright, patent"]
    left = [r["c"] for r in documents(spark, gone + kept).orderBy("doc_id").select(L.canonical(L.F.col("text")).alias("c")).collect()]
    assert left[:len(gone)] == [""] * len(gone) and all(left[len(gone):])
