from wardflow.llm import urls

from .util import SMALL, rows, table

PAGES = "page_id long, url string, html string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, rest[:end]


def rule(host, path):
    best = None
    for verdict, r in urls.RULES:
        name, _, start = r.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(r) > len(best[0])):
            best = (r, verdict)
    return best


def check(out, pages):
    for r in out.collect():
        host, path = parts(pages[r.page_id])
        want = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, want and want[0])
        assert r.verdict in ("allow", "block") and (want is None or r.verdict == want[1])


def test_rules_on_the_table(spark):
    pages = {r["page_id"]: r["url"] for r in table(SMALL, "pages")}
    out = urls.judge_urls(spark.read.parquet(f"{SMALL}/pages.parquet"))
    assert out.count() == len(pages)
    check(out, pages)


def test_corner_cases(spark):
    pages = dict(enumerate([
        None, "", "no scheme/org/", "http://", "http://ORG/", "HTTP://A.Example.ORG/en/12?x=1#y", "https://x.example.org/es/", "https://org",
        "https://notexample.org/es/1", "https://k.com/de/x", "https://com/fr/", "https://com.evil.net/de/", "a://b://c.org/", "https://u@h.org:8/x",
        "https://Straße.org/ü?q", "https://x.net/" + "a1" * 20_000, "https://x.com/de\n/y", "//x.org/", "https://x.org?y/", "https://x.com/es/1", "https://x.com/es/1",
    ]))
    check(urls.judge_urls(spark.createDataFrame([(i, u, None) for i, u in pages.items()], PAGES)), pages)


def test_trees_learn_held_out_labels(spark):
    """URLs like the blocked ones are blocked though no rule names them."""
    labelled = [(i, f"https://s{i % 7}.example.com/{'de' if i % 2 else 'fr'}/{'9' * 12 if i % 2 else 'page'}{i}", None) for i in range(400)]
    held = [(1000 + i, f"https://s{i}.example.net/xx/{'9' * 12 if i % 2 else 'page'}{i}", None) for i in range(40)]
    out = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(labelled + held, PAGES)).collect()}
    right = sum((out[1000 + i].verdict == "block") == (i % 2 == 1) for i in range(40))
    assert right >= 36
    again = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(labelled + held, PAGES)).collect()}
    assert out == again


def test_no_or_one_class(spark):
    assert urls.judge_urls(spark.createDataFrame([], PAGES)).count() == 0
    none = urls.judge_urls(spark.createDataFrame([(1, "https://x.net/", None), (None, None, None)], PAGES))
    assert rows(none, "page_id", "verdict") == [(None, "allow"), (1, "allow")]
    one = urls.judge_urls(spark.createDataFrame([(1, "https://x.com/de/", None), (2, "https://x.net/", None)], PAGES))
    assert rows(one, "page_id", "verdict") == [(1, "block"), (2, "block")]


def test_clashing_columns(spark):
    extra = spark.createDataFrame([(1, "https://a.org/x", "h", "p", 2.0, "s")], PAGES + ", path string, label double, suffix string")
    assert rows(urls.judge_urls(extra), "host", "path", "rule", "verdict") == [("a.org", "/x", "org/", "allow")]
