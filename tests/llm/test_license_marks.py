"""Licenses whose names share most of their words."""

import pytest

from tracewarden.llm import licenses

LINES = {
    "Licensed under the GNU General Public License": "gpl",
    "Subject to the terms of the GNU General Public License": "gpl",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
    "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
    "Licensed under the MIT License": "mit",
    "Released under the license": "",
    "Licensed under the license": "",
    "Licensed under the Apache 2.0 License": "apache",
    "Subject to the terms of the Mozilla Public": "mpl",
    "GNU Lesser Public License": "lgpl",
    "GNU Affero General Public License": "agpl",
}


def test_a_license_needs_its_own_word(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string")
    found = {r.doc_id: r.labels for r in licenses.scanned_licenses(df).collect()}
    assert [found[n] for n in range(len(LINES))] == list(LINES.values())


@pytest.mark.parametrize("label, text, mark", [t for t in licenses.TEMPLATES if t[2]])
def test_marked_wordings_are_the_share_with_the_mark(label, text, mark):
    words = sorted(set(text.split()))
    for bits in range(1 << len(words)):
        held = {w for n, w in enumerate(words) if bits >> n & 1}
        met = any(len(held & set(some)) >= need for _, some, need in licenses._sets(label, text, mark))
        assert met == (mark in held and len(held) >= licenses.SHARE * len(words))
