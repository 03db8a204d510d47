"""Licence files as they are found, and the canonical form against one written in plain Python."""

import re
from pathlib import Path

import pyspark
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_near_duplicates import DOCS

from textquarry.llm import licences, queries

MIT, ISC = licences.KNOWN["MIT"], licences.KNOWN["ISC"]


def form(text):
    """The canonical form, line by line and word by word."""
    text = (text or "").translate(str.maketrans(licences._FROM, licences._TO))
    kept = []
    for n, line in enumerate(text.split("\n")):
        bare = line.lstrip(" \t#*/;%-")
        mark = bare.lower().startswith(("copyright", "(c)", "©"))
        after = re.match(r"Copyright[ \t]+([A-Z].*)", bare)
        named = after and not after.group(1).startswith(tuple(licences.SENTENCE.strip("()").split("|")))
        signed = bare.startswith("©") or re.match(r"(?i)copyright[ \t]*(\(c\)|©|:|by[ \t])", bare)
        if not (named or signed or (mark and re.search(r"\d{4}|<year>|\[year\]|\[yyyy\]|\{yyyy\}", bare[min(len(bare), 3 if bare.startswith("(") else 1 if bare.startswith("©") else 9):], re.A))):
            kept.append(line)
    words = re.sub(r"[\x00-/:-@\[-`{-\x7f]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in "\n".join(kept))).split(" ")
    words = [w for w in words if w]
    for a, b in licences.EQUIVALENT:
        old, new, out, k = a.split(" "), [x for x in b.split(" ") if x], [], 0
        while k < len(words):
            hit = words[k : k + len(old)] == old
            out += new if hit else [words[k]]
            k += len(old) if hit else 1
        words = out
    return re.sub(licences.TITLE, "", " ".join(words))


def forms(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r["f"] for r in df.select("k", licences.canonical(F.col("text")).alias("f")).orderBy("k").collect()]


LINES = ["Copyright (c) 2020 A", "Copyright Jane Doe", "copyright notice and this", "Copyright Holder means", "(c) You must", "(c) 1999 B", "© C", "# Copyright [yyyy] x", "COPYRIGHT HOLDERS BE LIABLE", "MIT License", "labour labour licence", "sub-license sub license", "All rights reserved.", "“x” – y", "BSD 3-Clause License", "copyright owners owner", "", " per cent percent", "\r"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(LINES), max_size=5).map("\n".join), min_size=20, max_size=40))
def test_form_equals_plain_python(spark, texts):
    assert forms(spark, texts) == [form(t) for t in texts]


def test_files_as_they_are_found(spark, table):
    wrapped = re.sub(r"(.{20,60}) ", r"\1\n# ", ISC)
    cases = [
        ("MIT License\n\nCopyright (c) 2024 Someone\n\n" + MIT, "MIT"), ("The MIT License (MIT)\n\nCopyright (c) 2024 Someone\n\n" + MIT.replace('"AS IS"', "“AS IS”"), "MIT"),
        ("ISC License:\n\nCopyright Someone\n\n" + wrapped, "ISC"), (re.sub(" copyright notice", "\ncopyright notice", ISC), "ISC"), ("BSD 3-Clause License\n© Me\nAll rights reserved.\n" + licences.KNOWN["BSD-3-Clause"].replace("COPYRIGHT HOLDER ", "COPYRIGHT OWNER "), "BSD-3-Clause"),
        ("* " + licences.UNNUMBERED["BSD-2-Clause"].replace("\n", "\n* "), "BSD-2-Clause"), (MIT.replace("sublicense", "sub-licence").replace("sub-licence", "sublicense"), "MIT"), ("MIT License or not", None), (MIT + " more", None), ("", None), (None, None),
    ]
    near = Path(pyspark.__file__).parent / "licenses"
    for name, file in (("MIT", "AnchorJS"), ("CC0-1.0", "CC0"), ("ISC", "d3.min.js"), ("Apache-2.0 notice", "json-formatter"), ("0BSD", "xz")):
        if (near / f"LICENSE-{file}.txt").exists():
            cases.append(((near / f"LICENSE-{file}.txt").read_text(errors="replace"), name))
    folder = Path("/usr/share/common-licenses")
    for file, name in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD", "BSD-3-Clause-UC")):
        if (folder / file).exists():
            cases.append(((folder / file).read_text(errors="replace"), name))
    d = table("documents", [(k, t, "", "", 0) for k, (t, _) in enumerate(cases)], DOCS)
    got = {r["doc_id"]: r["licence"] for r in queries.op6_licences(spark, d).collect()}
    assert got == {k: v for k, (_, v) in enumerate(cases)}
    assert len(licences.KNOWN) + len(set(licences.FULL.values())) >= 25
    assert queries.op6_licences(spark, table("documents", [], DOCS)).collect() == []
    assert len(queries.op6_licences(spark, table("documents", [(1, "x " * 2_000_000, None, None, None), (1, None, None, None, None), (1, None, None, None, None)], DOCS)).collect()) == 3


def test_every_planted_licence_is_found(spark):
    import duckdb

    where = "/root/testdata/sf0.001"
    if not Path(where).is_dir():
        pytest.skip("no bench tables")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{where}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["licences_planted"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.licences_planted(spark, where).select("doc_id", "licence").collect())
