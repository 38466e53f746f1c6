"""Site-relative line frequency against a plain count."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docdrift.llm import line_dedup as L


def plain(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for _, site, text in rows:
        pages[site] += 1
        for line in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
            seen[site, line] += 1
    bad = defaultdict(set)
    for (site, line), n in seen.items():
        if n >= least and n > pages[site] * ratio:
            bad[site].add(line)
    out = []
    for i, site, text in rows:
        parts = [] if text is None else text.split("\n")
        stay = [x for x in parts if x.strip(" \t\r") not in bad[site]]
        out.append((i, site, None if text is None else "\n".join(stay), len(parts), len(parts) - len(stay)))
    return sorted(out, key=str)


ROWS = (
    [(i, "a", f"menu\nown {i}\n  footer \r\n\nmenu") for i in range(30)]
    + [(100 + i, "b", f"own {i}\nmenu" if i < 2 else f"own {i}") for i in range(40)]
    + [(200 + i, None, f"menu\nx{i}") for i in range(8)]
    + [(300, "c", "menu"), (301, "c", None), (302, "c", ""), (None, "a", "menu\nlast"), (None, None, None), (3, "a", "menu\nown 3\n  footer \r\n\nmenu")]
    + [(400, "a", "long line " * 20_000 + "\nmenu")]
)


@pytest.mark.parametrize("ratio,least", [(0.05, 5), (0.5, 1), (0.0, 2)])
def test_lines(llm, ratio, least):
    df = llm.createDataFrame(ROWS, "doc_id long, source string, text string").selectExpr("*", "1 as site", "2 as keys", "3 as n_lines", "4 as row").repartition(6)
    got = L.line_dedup(df, max_ratio=ratio, min_pages=least)
    assert got.selectExpr("row.*").columns == df.columns
    rows = got.select("row.doc_id", "row.source", "row.text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, rows), key=str) == plain(ROWS, ratio, least)
    assert L.line_dedup(df.limit(0)).collect() == []


def test_copies_count_as_one_page(llm):
    rows = [(i, "a", f"menu\nown {i}") for i in range(40)] + [(100 + i, "a", "menu\nfirst \n\n second") for i in range(20)]
    rows += [(200 + i, "b", "x\ny") for i in range(6)] + [(300, "b", None), (301, "b", "")]
    df = llm.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = {r.doc_id: (r.text, r.n_dropped) for r in L.line_dedup(df, copies_once=True).select("row.*", "n_dropped").collect()}
    expected = {i: (f"own {i}", 1) for i in range(40)} | {100 + i: ("first \n\n second", 1) for i in range(20)}
    assert got == expected | {200 + i: ("x\ny", 0) for i in range(6)} | {300: (None, 0), 301: ("", 0)}


def test_host_of_a_url(llm):
    urls = ["http://A.org/x", "https://u:p@b.org:80/", "no url", None, "//c.org/x", "http://d.org"]
    df = llm.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(L.host_of(F.col("u"))).collect()] == ["a.org", "b.org", None, None, None, "d.org"]
