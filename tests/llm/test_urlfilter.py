import re
from collections import Counter, defaultdict

import pytest

from pairsim.llm import urlfilter as uf
from pairsim.llm.queries import REGISTRY, URL_RULES, labelled_pages

SF = "/root/testdata/sf0.1"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules):
    fit = []
    for rule, verdict in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((len(rule), rule, verdict))
    return max(fit, default=(0, None, None))[1:]


def plain_judge(pages, rules):
    rows = []
    for page, url, bad in pages:
        host, path = plain_parts(url)
        segs = [] if path == "" else path.removeprefix("/").split("/")
        rows.append([page, host, path, segs, "", bad])
    for i in range(uf.DEPTH):
        n, lab, bad, total = Counter(), Counter(), Counter(), Counter()
        for _, host, _, segs, t, b in rows:
            if i < len(segs):
                k = (host, t, segs[i])
                n[k] += 1
                total[host, t] += 1
                lab[k] += b is not None
                bad[k] += b or 0
        large = [k for k in n if n[k] >= uf.MIN_PAGES and n[k] >= total[k[:2]] * uf.MIN_SHARE]
        pool = defaultdict(lambda: [0, 0])
        for k in large:
            pool[k[:2]][0] += bad[k]
            pool[k[:2]][1] += lab[k]
        literal = set()
        for k in large:
            b, m = pool[k[:2]]
            if m:
                p = b / m
                if abs(bad[k] - lab[k] * p) > uf.APART * (lab[k] * p * (1 - p)) ** 0.5:
                    literal.add(k)
        for r in rows:
            if i < len(r[3]):
                s = r[3][i]
                shown = re.sub(r"([*\\])", r"\\\1", s) if (r[1], r[4], s) in literal else "*"
                r[4] += "/" + shown
    for r in rows:
        if len(r[3]) > uf.DEPTH:
            r[4] += "/**"
    of, hosts, everything = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), [0, 0]
    for _, host, _, _, t, b in rows:
        for x in (of[host, t], hosts[host], everything):
            x[0] += b or 0
            x[1] += b is not None
    overall = everything[0] / everything[1] if everything[1] else 0.0
    out = []
    for page, host, path, _, t, _ in rows:
        h = (hosts[host][0] + uf.STRENGTH * overall) / (hosts[host][1] + uf.STRENGTH)
        p = (of[host, t][0] + uf.STRENGTH * h) / (of[host, t][1] + uf.STRENGTH)
        rule, verdict = plain_rule(host, path, rules)
        out.append((page, host, path, rule, verdict or ("block" if p >= uf.PURITY else "allow"), t, round(p, 9)))
    return out


def rounded(rows):
    return sorted([(*tuple(r)[:6], round(r.purity, 9)) for r in rows], key=repr)


def test_query(spark):
    pages = [tuple(r) for r in labelled_pages(spark, SF).collect()]
    got = REGISTRY["op7_urlfilter"](spark, SF)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    rows = got.collect()
    assert rounded(rows) == sorted(plain_judge(pages, URL_RULES), key=repr)
    assert {r.verdict for r in rows if r.rule is None} == {"allow", "block"}
    assert any(t for t in {r.template for r in rows} if t.strip("/*"))


def test_trees(spark):
    urls = []
    for i in range(300):
        bad = 1 if i % 3 == 0 else 0
        kind = ["spam", "news", "blog"][i % 3]
        urls.append((i, f"http://A.Example.com/{kind}/{i}/x*y/p/q/r?z#t", bad if i % 2 else None))
        urls.append((i, f"https://b.net/{i}", None))
    odd = [None, "", "no scheme", "://", "http://", "http://H", "http://H?x/y", "x://h/a*/b", "http://example.net/en/1", "http://net/", "ftp://xnet/a"]
    urls += [(1000 + i, u, 1) for i, u in enumerate(odd)] + [(None, "http://q/é//", None)] * 2
    df = spark.createDataFrame(urls, "page_id long, url string, bad int").selectExpr("*", "1 as host", "2 as template", "3 as h")
    got = uf.judge(df, URL_RULES).collect()
    want = plain_judge(urls, URL_RULES)
    assert rounded(got) == sorted(want, key=repr)
    assert {t for *_, t, _ in want} >= {"/spam/*/*/*/**"}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, bad int")
    assert uf.judge(df, URL_RULES).collect() == []
    none = spark.createDataFrame([(1, "http://a/b", None)], "page_id long, url string, bad int")
    assert [r.verdict for r in uf.judge(none).collect()] == ["allow"]


@pytest.mark.parametrize("url, rule", [("http://a.example.net/en/", "example.net/en/"), ("http://a.example.net/en", "net/"), ("http://net", None), ("http://myexample.com/de/1", None), ("http://EXAMPLE.com/de/1", "example.com/de/")])
def test_rules(spark, url, rule):
    df = spark.createDataFrame([(1, url, None)], "page_id long, url string, bad int")
    assert uf.judge(df, URL_RULES).first().rule == rule
