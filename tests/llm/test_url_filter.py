"""Rules and host reputation against plain Python."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from docdrift.llm import url_filter as U


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rule_of(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def names(host):
    labels = host.rsplit("@", 1)[-1].split(":")[0].split(".")
    own = 2 if len(labels) >= 3 and len(labels[-1]) == 2 and labels[-2] in U.SECOND_LEVEL else 1
    if all(c in "0123456789." for c in ".".join(labels)) and host:
        own = len(labels)
    return ".".join(labels[-own - 1 :]), ".".join(labels[-own:])


def plain(rows, rules):
    judged = [(i, *split(u)) for i, u in rows]
    judged = [(i, h, p, *rule_of(h, p, rules)) for i, h, p in judged]
    count = defaultdict(lambda: [0, 0])
    for _, h, _, _, v in judged:
        count[h][0] += v is not None
        count[h][1] += v == "block"
    levels = [dict(count), {}, {}, {}]
    up = [{h: names(h)[0] for h in count}, {names(h)[0]: names(h)[1] for h in count}, {names(h)[1]: 0 for h in count}]
    for k in range(3):
        for child, (n, b) in levels[k].items():
            own = levels[k + 1].setdefault(up[k][child], [0, 0])
            own[0] += n
            own[1] += b

    def strength(k):
        excess = scale = 0.0
        for parent, (pn, pk) in levels[k + 1].items():
            children = [c for c, q in up[k].items() if q == parent and levels[k][c][0]]
            if len(children) < 2 or not 0 < pk < pn:
                continue
            m = pk / pn
            for n, b in (levels[k][c] for c in children):
                excess += (b - n * m) ** 2 - n * m * (1 - m)
                scale += n * (n - 1) * m * (1 - m)
        return U.STRENGTH[1] if not scale or excess <= 0 else min(U.STRENGTH[1], max(U.STRENGTH[0], scale / excess - 1))

    power = [strength(k) for k in range(3)]
    total = levels[3].get(0, [0, 0])
    rate, weight = {0: (total[1] + 1) / (total[0] + 2)}, {0: total[0] + 2}
    for k in (2, 1, 0):
        prior = {c: min(power[k], weight[up[k][c]]) for c in levels[k]}
        above = {c: rate[up[k][c]] for c in levels[k]}
        rate = {c: (b + prior[c] * above[c]) / (n + prior[c]) for c, (n, b) in levels[k].items()}
        weight = {c: n + prior[c] for c, (n, _) in levels[k].items()}

    def verdict(h):
        low = rate[h] - U.DEVIATIONS * math.sqrt(rate[h] * (1 - rate[h]) / (weight[h] + 1))
        return "block" if low > U.TOLERATED else "allow"

    return sorted(((i, h, p, r, v or verdict(h)) for i, h, p, r, v in judged), key=str)


def urls(seed, n=1500):
    rng = random.Random(seed)
    hosts = [f"{s}.{d}{k}.{t}" for s in ("www", "M") for d in ("good", "bad") for k in range(8) for t in ("example.com", "co.uk", "example.org", "net")]
    rows = []
    for i in range(n):
        host = rng.choice(hosts) if rng.random() < 0.7 else "hot.example.com"
        lang = "de" if "bad" in host and rng.random() < 0.8 else rng.choice(["fr", "en", "es", "de"])
        rows.append((i, f"https://{host}/{lang}/{i}" + rng.choice(["", "?page=2", "#top", "/a?b#c"])))
    return rows


ODD = [
    (-1, None), (-2, ""), (-3, "no scheme.org/x"), (-4, "http://"), (-5, "http://ORG"), (-6, "http://org/"), (-7, "http://xorg/"),
    (-8, "http://example.org/es/"), (-9, "http://example.org/es"), (-10, "http://a.example.org/en/12?x"), (-11, "x://u@Ä.CO.UK:80/p"),
    (-12, "http://10.0.0.1/a"), (-13, "a://b.org://c/d"), (-14, "http://h.com?q=/fr/"), (None, "http://h.com/fr/"), (-6, "http://org/"),
    (-15, "http://very.org/" + "x" * 100_000),
]


def test_against_plain_python(llm):
    for seed in range(2):
        rows = urls(seed) + ODD
        df = llm.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS n", "'x' AS verdict")
        got = U.url_filter(df.repartition(7), U.RULES).drop("bound").collect()
        expected = plain(rows, U.RULES)
        assert sorted((tuple(r) for r in got), key=str) == expected
        by_method = {v for _, _, _, rule, v in expected if rule is None}
        assert by_method == {"allow", "block"}  # the method decides both ways
    assert U.url_filter(df.limit(0), U.RULES).collect() == []


def test_equally_long_rules_and_given_labels(llm):
    rows = [(1, "http://b.cc/aa/x"), (2, "http://other.net/y"), (3, None)]
    rules = [("b.cc", "/a", "allow"), ("cc", "/aa/", "block"), ("net", "", "allow")]
    df = llm.createDataFrame([(*r, b) for r, b in zip(rows, [True, None, None], strict=True)], "page_id long, url string, spam boolean")
    got = {r.page_id: (r.rule, r.verdict) for r in U.url_filter(df, rules, F.col("spam")).collect()}
    assert got == {1: ("b.cc/a", "allow"), 2: ("net", "allow"), 3: (None, "allow")}


def test_hosts_without_labels_take_the_level_above(llm):
    rows = [("a.bad.com", True)] * 40 + [("b.bad.com", True)] * 40 + [("new.bad.com", None), ("x.good.com", False)] + [("y.good.com", False)] * 80
    known = {r.host: r for r in U.host_reputation(llm.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert known["new.bad.com"].n == 0 and known["new.bad.com"].rate > 0.9 and known["new.bad.com"].bad
    assert known["x.good.com"].rate < 0.2 and not known["x.good.com"].bad
    none = U.host_reputation(llm.createDataFrame([("a.b", None)], "host string, bad boolean")).first()
    assert none.rate == 0.5 and not none.bad


def test_query_against_plain_python(llm):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url) for r in llm.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in U.op13_url_filter(llm, sf).collect()), key=str) == plain(rows, U.RULES)
