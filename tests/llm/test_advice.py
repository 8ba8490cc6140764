"""Cases that a reviewer found to be cut short."""

import hashlib
import subprocess
import sys

import pytest

from fernwork.llm import common, html, licenses, lm, quality

GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
import os"""


@pytest.fixture(scope="module")
def matcher():
    return licenses.Matcher(licenses.TEMPLATES)


@pytest.mark.parametrize("name", sorted(licenses.full_texts()))
def test_full_licence_texts(matcher, name):
    text = licenses.full_texts()[name]
    commented = "\n".join("# " + x for x in text.split("\n")) + "\nimport os\n"
    assert matcher.licence(text, True, 0.6)[0] == matcher.licence(commented, False, 0.6)[0] == name


@pytest.mark.parametrize(("name", "text"), [
    ("CC-BY-NC-4.0", "Prose.\nLicensed under CC BY-NC 4.0.\nMore prose."), ("CC-BY-NC-ND-3.0", "https://creativecommons.org/licenses/by-nc-nd/3.0/"), ("CC-BY-SA-3.0", "Creative Commons Attribution-Share Alike 3.0"),
    ("MIT", "// SPDX-License-Identifier: MIT"), ("Apache-2.0 OR MIT", "/* SPDX-License-Identifier: Apache-2.0 OR MIT */"), ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later"), ("OFL-1.1", "SPDX-License-Identifier: OFL-1.1"),
    ("GPL-3.0", GPL_HEADER), ("LGPL-2.1", GPL_HEADER.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")), ("GPL", "Released under the GNU General Public License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"), ("Unlicense", "This is free and unencumbered software released into the public domain."), ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    (None, "Licensed under CC BY-NC 5.0."), (None, "Licensed under the Odd House Licence, version 9."),
])
def test_licence_notices(matcher, name, text):
    got = matcher.licence(text, False, 0.6)
    assert got[0] == name and got[2] == (name is None)


def test_unmatched_notice_inherits_nothing(spark):
    files = [("LICENSE", "Released under the MIT License."), ("a/x", "Licensed under CC BY-NC 4.0."), ("a/y", "Licensed under the Odd House Licence, version 9."), ("a/z", "plain"), ("a/w", "a licence is a nice thing")]
    got = {r["path"]: (r["licence"], r["found"], r["from_path"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"LICENSE": ("MIT", "own", None), "a/x": ("CC-BY-NC-4.0", "own", None), "a/y": (None, "unknown", None), "a/z": ("MIT", "inherited", "LICENSE"), "a/w": ("MIT", "inherited", "LICENSE")}


def test_noise_samples():
    assert lm.NOISE == 128


def test_head_left_open():
    text = "<article><p>The text of the page.</p></article>"
    for start in ("<html><head><title>T</title><body>", "<head><meta charset=x><title>T</title><style>p{}</style>", "<html><head><title>T</title></head><body>", "<head><noscript><link rel=x><body>"):
        assert html.main_text(start + text) == "The text of the page."
    assert html.main_text("<head><title>T</title>bare text") == "bare text" and html.main_text("<head><script>x</script></head>") == ""


def test_one_long_paragraph():
    long, a, b = "word " * 1000, "short one " * 10, "short two " * 10
    parts = ["Title", a.strip(), long.strip(), b.strip()]
    body = f"<h1>Title</h1><p>{a}</p><p>{long}</p><p>{b}</p>"
    for tag in ("<div class='post'>", "<div id='content'>", "<div>", "<section>"):
        assert html.main_text(f"<html><body>{tag}{body}</body></html>").split("\n\n") == parts


def test_unequal_sections():
    long = ("word " * 1000).strip()
    links = "<div class='top'><a href=1>Home</a> <a href=2>News</a></div>"
    assert html.main_text(f"<body>{links}<h1>Title</h1><div><p>{long}</p></div><section><p>Short section.</p></section></body>").split("\n\n") == ["Title", long, "Short section."]
    assert html.main_text(f"<body><div><p>{long}</p></div>{links}</body>") == long
    assert html.main_text(f"<article><p>{long}</p></article><article><p>Short article.</p></article>").split("\n\n") == [long, "Short article."]
    assert html.main_text(f"<main><h1>Title</h1><article><p>{long}</p></article></main>").split("\n\n") == ["Title", long]


def test_rare_stratum_among_many_labels(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.range(1700).selectExpr("id AS doc_id", f"'{text}' AS text", "'es' AS lang")
    labels = spark.range(120_000).selectExpr("id AS doc_id", "1 AS quality")
    assert set(quality.cutoffs(docs, labels)["es"]) == set(quality.RULES)


def test_executors_read_the_same_templates(tmp_path):
    """As executors have it: the package inside a zip file, and no folder of it."""
    path = str(tmp_path / "code.zip")
    common.pack_code(path)
    code = f"import sys; sys.path.insert(0, {path!r}); from fernwork.llm import licenses; assert '.zip' in licenses.__file__; import hashlib; print(hashlib.sha256(repr(licenses.TEMPLATES).encode()).hexdigest())"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.strip()
    assert got == hashlib.sha256(repr(licenses.TEMPLATES).encode()).hexdigest()
