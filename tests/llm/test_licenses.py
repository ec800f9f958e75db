from spanloom.llm import licenses as L

from tests.llm.conftest import DOCS


def brute(rows):
    out = set()
    for d, text in rows:
        w = L.words_of(text or "")
        places = lambda p, w=w: {i for i in range(len(w)) if w[i : i + len(p)] == p}
        for t in L.TEMPLATES:
            first, *rest = [(at, places(L.words_of(p))) for at, p in t.phrases]
            for i in first[1]:
                if all(any(abs(j - i - at) <= t.slack for j in found) for at, found in rest):
                    out.add((d, t.license_id, t.name, i))
    return out


def laid_out(template, off):
    """The template's phrases where they belong, each later one off its place by some words, with other words between them."""
    words = []
    for at, phrase in template.phrases:
        words += ["filler"] * (at + (min(off, template.slack) if at else 0) - len(words)) + L.words_of(phrase)
    return " ".join(words).upper()


def got(df):
    return {tuple(r) for r in df.select("doc_id", "license_id", "template", "doc_word").collect()}


def test_against_brute_force(documents, prose):
    rows = [(1000 + i, f"{prose(i, 20)} {laid_out(t, i % 3)}, {prose(i + 50, 20)}") for i, t in enumerate(L.TEMPLATES)]
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in it " + "x " * 8 + "without restriction, including without limitation"
    rows += [(100, grant), (101, grant.replace("hereby", "not")), (102, "under the mit " + prose(3, 400) + " license"), (103, ("(under the MIT License) " + prose(1, 9) + " ") * 5)]
    rows += [(104, "permission is hereby granted free of charge " + prose(5, 300) + " without restriction including without limitation"), (105, "under the"), (106, "mit license")]
    expected = brute(rows)
    assert len({i for _, i, *_ in expected}) == len({t.license_id for t in L.TEMPLATES})
    assert got(L.scanned(documents(rows))) == expected


def test_odd_rows_empty_table_and_clashing_names(spark, odd):
    assert L.scanned(odd).count() == 0 and L.scanned(spark.createDataFrame([], DOCS)).count() == 0
    text = "x under the zlib license"
    df = spark.createDataFrame([(1, text, "a", 1), (1, text, "b", 2), (None, text, "c", 3)], "doc_id long, text string, template string, doc_word int")
    assert got(L.scanned(df)) == {(1, "Zlib", "notice", 1), (None, "Zlib", "notice", 1)}


def test_anchors_are_the_rarest_words():
    index = L.index_of((L.Template("X", "n", ((0, "the quick brown fox"),)),), {"the": 100, "quick": 5, "brown": 50, "fox": 1})
    assert index[0][0].anchors == (3, 1)


def test_texts_as_they_stand_in_files(documents, prose):
    comment = lambda text: "\n".join(f" * {line}" for line in text.split("\n"))
    texts = {
        "MIT": "MIT License\n\nCopyright (c) 2020 A. Body\n\n" + L._MIT, "BSD-3-Clause": comment(L._BSD), "ISC": L._ISC, "Zlib": L._ZLIB, "Apache-2.0": comment(L._APACHE), "MPL-2.0": comment(L._MPL),
        "GPL-3.0": comment(L._GNU.format("General Public License", "3")), "AGPL-3.0": L._GNU.format("Affero General Public License", "3"), "LGPL-2.1": L._GNU.format("Lesser General Public License", "2.1"),
        "GPL-2.0-or-later": "// SPDX-License-Identifier: GPL-2.0-or-later",
    }
    rows = [(i, prose(i, 30) + "\n" + t + "\n" + prose(i + 99, 300)) for i, t in enumerate(texts.values())]
    found = {}
    for d, license_id, name, _ in got(L.scanned(documents(rows))):
        if name in ("text", "header", "tag"):
            found.setdefault(d, set()).add(license_id)
    for i, license_id in enumerate(texts):
        assert license_id in found[i]
    assert found[0] == {"MIT"} and found[6] == {"GPL-3.0"} and found[7] == {"AGPL-3.0"} and found[5] == {"MPL-2.0"}
    # a mandatory phrase is missing, or another version
    near = [(0, L._MIT.replace("copyright notice", "notice")), (1, L._BSD.replace("binary form must", "binary form may")), (2, L._GNU.format("General Public License", "4"))]
    assert not {r for r in got(L.scanned(documents(near))) if r[2] in ("text", "header")}
