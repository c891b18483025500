import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarn.llm import urls

SCHEMA = "page_id long, url string, html string, host string, path string, raw string, template string, good string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, *["x"] * 6) for i, u in rows], SCHEMA)


def marks(spark, rows):
    return spark.createDataFrame(rows, "page_id long, good boolean")


@pytest.mark.parametrize(
    "url, host, path",
    [
        ("https://WWW.Example.com:80/a/12/b-3.html?x=1&y#top", "example.com", ["a", "{n}", "b-{n}.html", "?x&y"]),
        ("http://user:p@e.org./", "e.org", []),
        ("//cdn.e.org/x", "cdn.e.org", ["x"]),
        ("http://e.org?b=1;a=2", "e.org", ["?a&b"]),
        ("http://e.org/" + "/".join("abcdefghij"), "e.org", list("abcdefghij")),
        ("mailto:x@e.org", None, None),
        ("", None, None),
        (None, None, None),
        ("/only/path", None, None),
    ],
)
def test_parsing(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "url string")
    row = df.select(urls.host_of(F.col("url")).alias("h"), urls.segments(F.col("url")).alias("s")).first()
    assert row.h == host and (host is None or row.s == path)


def segments_by_hand(url):
    rest = re.sub(r"^[a-z]+://[^/?#]*|#.*$", "", url)
    path, _, query = rest.partition("?")
    parts = [re.sub(r"\d+", "{n}", p) for p in path.split("/") if p]
    names = sorted({q.split("=")[0] for q in query.split("&") if q})
    return parts + (["?" + "&".join(names)] if names else [])


def judged_by_hand(rows, good):
    """Templates, counts and purity, by walking each host's URLs from the root."""
    prior_counts = Counter(good[i] for i, _ in rows if i in good)
    prior = prior_counts[True] / sum(prior_counts.values()) if prior_counts else 1.0
    hosts = defaultdict(list)
    for i, u in rows:
        hosts[re.match(r"[a-z]+://(?:www\.)?([^/?#]*)", u)[1]].append((i, segments_by_hand(u)))
    out = {}
    for host, of_host in hosts.items():
        shaped = {}

        def shape(inside, depth):
            counts = Counter(s[depth] for _, s in inside if len(s) > depth)
            labelled = Counter(s[depth] for i, s in inside if len(s) > depth and i in good)
            total = sum(counts.values())
            groups = defaultdict(list)
            for i, s in inside:
                if len(s) > depth:
                    x = s[depth]
                    kind = re.search(urls._KIND, x)
                    wild = "?*" if x.startswith("?") else x if re.match(r"^\{n\}(\.\w+)?$", x) else "{*}" + (kind[0] if kind else "")
                    name = x if counts[x] >= urls.SHARE * total or labelled[x] >= urls.TESTED else wild
                    shaped.setdefault(i, []).append(name)
                    groups[name].append((i, s))
            for g in groups.values():
                shape(g, depth + 1)

        shape(of_host, 0)
        ids = [i for i, _ in of_host]
        table = [(shaped.get(i, []), int(good.get(i) is True), int(good.get(i) is False)) for i in ids]
        names = {ids[k]: (t, p) for k, t, p in urls.merge(table, prior)}
        for i in ids:
            same = [j for j in ids if names[j][0] == names[i][0]]
            out[i] = (host, names[i][0], len(same), sum(good.get(j) is True for j in same), sum(good.get(j) is False for j in same), round(names[i][1], 9))
    return out


def many_urls():
    rows, good = [], {}
    for i in range(900):
        host = ["a.org", "www.b.com", "c.net"][i % 3]
        section = ["news", "shop", "blog", f"rare{i}"][i // 3 % 4]
        tail = ["", ".html", "?page=2&ref=x"][i % 7 % 3]
        rows.append((i, f"http://{host}/{section}/{'item' if i % 2 else 'post'}-{i}{tail}" if section != "blog" else f"http://{host}/{section}/{i}/word{i % 5}"))
        if i % 5 == 0:
            good[i] = not (host == "c.net" and section == "shop") and i % 11 != 0
    return rows, good


@pytest.mark.parametrize("few", [0, urls.FEW])
def test_judging_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(urls, "FEW", few)
    rows, good = many_urls()
    got = {r.page_id: r for r in urls.judge(pages(spark, rows), marks(spark, list(good.items()))).collect()}
    want = judged_by_hand(rows, good)
    assert {i: (r.host, r.template, r.n_pages, r.n_good, r.n_bad, r.purity) for i, r in got.items()} == want
    rejected = {i for i, r in got.items() if not r.keep}
    assert rejected == {i for i, w in want.items() if w[5] < urls.LEAST} and rejected
    assert {got[i].host for i in rejected} == {"c.net"}


def test_deep_paths(spark, monkeypatch):
    """The tree has as many levels as paths have segments: here outcomes differ at the last of twenty."""
    rows = [(i, "http://deep.org/" + "/".join("abcdefghijklmnopqrs") + f"/{'bad' if i % 2 else 'fine'}/{i}") for i in range(200)]
    good = [(i, "/bad/" not in u) for i, u in rows]
    for few in (150, urls.FEW):
        monkeypatch.setattr(urls, "FEW", few)
        assert {r.page_id for r in urls.judge(pages(spark, rows), marks(spark, good)).where("keep").collect()} == {i for i, fine in good if fine}


def test_small_sections_are_judged_by_their_labels(spark):
    rows = [(i, f"http://big.org/{'news' if i % 50 else 'casino'}/{i}") for i in range(2000)]  # casino: 2 % of the pages
    rows += [(2000 + i, f"http://even.org/{chr(97 + i % 20)}/{i}") for i in range(800)]  # 20 sections of 5 %, the last is bad
    rows += [(3000 + i, f"http://dark.org/{'trade' if i % 50 else 'help'}/{i}") for i in range(2000)]  # a clean section amid bad ones
    good = [(i, "/casino/" not in u and "/t/" not in u and "/trade/" not in u) for i, u in rows]
    kept = {r.page_id for r in urls.judge(pages(spark, rows), marks(spark, good)).where("keep").collect()}
    assert kept == {i for i, fine in good if fine}


def test_branches_that_differ_stay_apart():
    table = [(["good", "{n}"], 50, 1), (["bad", "{n}"], 1, 50), (["fine", "{n}"], 40, 1), (["unknown"], 0, 0), ([], 0, 0)]
    names = {i: t for i, t, _ in urls.merge(table, 0.8)}
    assert names[0] == names[2] != names[1] and names[4] == "/"


def test_alike():
    assert urls.alike((0, 0), (5, 5)) and urls.alike((10, 0), (3, 0)) and urls.alike((9, 1), (8, 2)) and not urls.alike((90, 10), (10, 90))


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "no url"), (4, "http://e.org/a"), (4, "http://e.org/a"), (None, "http://e.org/a"), (5, "http://e.org/" + "x" * 100_000), (6, "http://é.org/ü/%20?&&")]
    got = urls.judge(pages(spark, rows), marks(spark, [(4, True), (4, False), (None, True), (77, False), (5, None)]))
    assert got.count() == len(rows)
    by = {r.page_id: r for r in got.collect()}
    assert all(by[i].template is None and by[i].purity is None and by[i].keep for i in (1, 2, 3))
    assert by[4].n_pages == 3 or by[4].n_pages == 4
    assert by[4].n_bad == 2 and by[4].n_good == 0
    assert urls.judge(pages(spark, rows), marks(spark, [])).where("NOT keep").count() == 0
    assert urls.judge(pages(spark, []), marks(spark, [(1, True)])).count() == 0


def test_page_labels(spark):
    rows = [(1, "http://x.org/en/5"), (2, "http://casino-win.example.org/en/5"), (3, "http://x.org/en/6.html"), (4, "http://x.org/en/99999999999999999999"), (5, None), (None, "http://x.org/5/"), (7, "http://m.free-bets.com/")]
    known = spark.createDataFrame([(5, 1, 0), (6, 1, 1), (6, 1, 0), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.page_id, r.good) for r in urls.page_labels(pages(spark, rows), known).collect()}
    assert got == {(1, True), (2, False), (3, False), (None, True), (7, False)}
