"""License scans against plain search for the notices, edited wordings and odd texts."""

import re

import pytest

from lumenlog.llm import licenses, queries

SF = "/root/testdata/sf0.1"
NOTICES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "All rights reserved.": "Proprietary",
}


def test_every_notice_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in rows}
    want = sorted((r.doc_id, name, m.start()) for r in rows for notice, name in NOTICES.items() for m in re.finditer(re.escape(notice), r.text))
    got = [r for r in queries.op5_licenses(spark, SF).collect() if r.license]
    assert sorted((r.doc_id, r.license, r.start) for r in got) == want and len(want) > 200
    assert all(texts[r.doc_id][r.start : r.end] + "." in NOTICES and not r.missing and not r.extra and r.reduction > 0 for r in got)


@pytest.mark.parametrize("name", [n for n in licenses.TEMPLATES])
def test_each_template_is_found_in_prose(name):
    for text in licenses.TEMPLATES[name]:
        found = licenses.scan(f"Some words before this. And more.\n{text}\nWords behind it, of no license at all.")
        assert [f["license"] for f in found if f["license"]][:1] == [name], text


@pytest.mark.parametrize("notice", [t for texts in licenses.TEMPLATES.values() for t in texts])
@pytest.mark.parametrize("more", [0, 6])
def test_notice_in_a_long_block(notice, more):
    """Plain English between cues, in which long templates save more than a short notice that is there."""
    plain = "We looked at the results of this work and of all other parts of it. They are to be used by any person in the field. The following list is not in any order. "
    cue = "The license applies to the whole report. "
    text = notice + " " + plain + cue + (plain + cue) * more
    name = next(n for n, texts in licenses.TEMPLATES.items() if notice in texts)
    found = [f for f in licenses.scan(text) if f["start"] == 0]
    assert [(f["license"], f["missing"], f["extra"]) for f in found] == [(name, [], [])]


def test_edited_wording():
    mit = licenses.TEMPLATES["MIT"][-1].replace("free of charge", "at no charge").replace("sublicense, ", "")
    found = licenses.scan("Copyright (c) 2020 Somebody\n\n" + mit)
    assert [f["license"] for f in found] == ["MIT"]
    assert "free" in found[0]["missing"] and "sublicense" in found[0]["missing"] and "at" in found[0]["extra"]
    assert [f["license"] for f in licenses.scan("This text is under a license that nobody knows.")] == [None]


def test_odd_rows(spark):
    two = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    rows = [(1, None), (2, ""), (None, two), (4, two), (4, two), (5, "license " * 20000), (6, "no cue here")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = sorted((str(r.doc_id), str(r.license)) for r in licenses.scan_licenses(df).collect())
    assert got == sorted([("5", "None")] + [(i, n) for i in ("None", "4", "4") for n in ("MIT", "Apache-2.0")])
    assert licenses.scan_licenses(df.filter("false")).collect() == []
