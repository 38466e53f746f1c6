"""Known licences and notices among other texts."""

from pathlib import Path

import duckdb
import pytest

from docdrift.llm import license_scan as S

MIT = S.LICENSES["MIT"]


@pytest.mark.parametrize(
    "text,license_id,notices",
    [
        (MIT, "MIT", ""),
        ("Copyright (c) 2020 Some One\nCopyright © 2021 Other\n\n" + MIT.upper().replace("\n", "\r\n\t"), "MIT", ""),
        ("# " + MIT.replace("sublicense", "sub-license").replace(". ", ".  ").replace("\n", "\n# "), "MIT", ""),
        ("Copyright 2020 One. All rights reserved.\n" + S.LICENSES["BSD-2-Clause"], "BSD-2-Clause", ""),
        (S.LICENSES["ISC"].replace(" ", "\n"), "ISC", ""),
        (MIT + "\nand one more word", None, ""),
        ("story\n  released under the MIT licence\nLicensed under CC BY-NC 4.0.\nend", None, "CC-BY-NC-4.0,MIT"),
        ("Released under the MIT License. Or not.", None, ""),
        ("", None, ""),
        (None, None, ""),
    ],
)
def test_scan(llm, text, license_id, notices):
    df = llm.createDataFrame([(1, text, "x")], "doc_id long, text string, digest string")
    (row,) = S.license_scan(df).collect()
    assert (row.license_id, row.notices) == (license_id, notices)


def test_rows_and_own_table(llm):
    known = S.known_licenses(llm, {"own": "Some Terms."})
    df = llm.createDataFrame([(1, "some terms!"), (1, "some terms!"), (None, "SOME\nterms"), (2, "é terms")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.license_id) for r in S.license_scan(df, known, {}).collect())
    assert got == [("1", "own"), ("1", "own"), ("2", None), ("None", "own")]
    assert S.license_scan(df.limit(0)).collect() == []


def test_known_digests_differ(llm):
    digests = [r.known_digest for r in S.known_licenses(llm).collect()]
    assert len(set(digests)) == len(digests) == len(S.LICENSES)


@pytest.mark.parametrize(
    "head,license_id",
    [
        ("MIT License\n\nCopyright (c) 2020 Jane Doe\n\n", "MIT"),
        ("The MIT License (MIT)\n=====\nCopyright Jane Doe 2020\n", "MIT"),
        ("Copyright Jane Doe and others\nAll rights reserved.\n\nISC License\n\n", "ISC"),
        ("# BSD 2-Clause License\nCopyright 2020, Jane Doe\n\n", "BSD-2-Clause"),
        ("zlib License\n\n(C) 2020 Jane Doe\n", "Zlib"),
    ],
)
def test_usual_licence_files(llm, head, license_id):
    text = S.LICENSES[license_id]
    rows = [(1, head + text), (2, head + text + "\nmore"), (3, head), (4, "Some story.\n" + head + text)]
    got = {r.doc_id: r.license_id for r in S.license_scan(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: license_id, 2: None, 3: None, 4: None}


def test_many_title_lines_are_no_trouble(llm):
    df = llm.createDataFrame([(1, "copyright someone\n" * 200_000)], "doc_id long, text string")
    assert [r.license_id for r in S.license_scan(df).collect()] == [None]


def test_more_licences_and_notices(llm):
    rows = [(i, f"{i} License\n\nCopyright Jane Doe\n\n{t}") for i, t in S.MORE_LICENSES.items()]
    rows += [("notes", "Licensed under the MPL 2.0.\n// SPDX-License-Identifier: GPL-3.0-or-later\nLicensed under the GPLv3.\nLicensed under the MIT licence.")]
    got = {r.doc_id: (r.license_id, r.notices) for r in S.license_scan(llm.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {i: (i, "") for i in S.MORE_LICENSES} | {"notes": (None, "GPL-3.0,MIT")}
    known = S.all_known(llm).collect()
    assert len({r.known_digest for r in known}) == len(known)
    assert {"Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Unlicense"} <= {r.license_id for r in known}


def test_long_licences(llm):
    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(i, (folder / f).read_text()) for f, i in names.items() if (folder / f).exists()]
    if not rows:
        pytest.skip("no licence texts on this machine")
    got = S.license_scan(llm.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: r.license_id for r in got} == {i: i for i, _ in rows}


def test_sql_knows_what_the_query_knows(llm, tmp_path):
    texts = [*(S.LICENSES | S.MORE_LICENSES).values(), *(t.upper() for t in S.LICENSES.values())]
    planted = [f"some words\n  {w}  \nmore words" for wordings in S.all_notices().values() for w in wordings]
    rows = list(enumerate([*texts, *planted, "", None, "no licence at all"]))
    llm.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = sorted(con.sql(S.OP9_SQL).fetchall())
    assert sorted(map(tuple, S.op9_license_scan(llm, str(tmp_path)).collect())) == expected
    assert {r[2] for r in expected} >= set(S.LICENSES | S.MORE_LICENSES) and all(r[3] for r in expected if len(texts) <= r[0] < len(rows) - 3)
