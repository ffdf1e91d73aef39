"""License scans, URL filters and chat formatting."""

import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from helpers import ODD, SCHEMA, Groups, ascii_lower, docs

from tallowmere.llm import chat, licenses, queries, urls

NOTICES = [
    "This work is released under the MIT license.", "released under the mit license", "This is released under the MIT license", "Licensed under CC BY-NC 4.0 International License", "licensed under a creative commons CC BY 4.0",
    "Copyright (c) 2020 Some Body Inc. All rights reserved.", "all rights reserved all rights reserved", "licensed under the apache license version 3 0", "GNU General Public License", "cc by cc by by cc", "cc  by", "ccby",
    "licensed under the GNU General Public License version 3 or any later version", "copyright a b c d e f g h i all rights reserved",
]


def license_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    found = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    s = " " + "".join(w + " " for w in words)
    own = {label for label, t in licenses.TEMPLATES if re.search(licenses.pattern(t), s)}
    at, base = [i for i, _ in found], {x for _, x in found}
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if own else 0.5 if base else 0.0


def test_licenses_equal_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD + NOTICES)] + [(None, NOTICES[0]), (10_001, "")]
    rows += [(20_000 + i, "x y " * i + n + " and so on " + NOTICES[(i + 5) % len(NOTICES)]) for i, n in enumerate(NOTICES)]
    got = licenses.license_report(docs(spark, rows, labels="q", matches="r", score=0)).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *license_brute(t)) for i, t in rows)
    assert licenses.license_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_places_take_time_in_proportion():
    """A text of 20 MB that is nothing but places."""
    joined = b" " + b"cc by " * 3_000_000
    began = time.perf_counter()
    assert len(licenses.places(joined, b" cc by ")) == 3_000_000
    assert time.perf_counter() - began < 10
    a = licenses.Automaton.compile("x", "released under the mit license")
    words = [b"released", b"under", b"the", b"mit", b"license"] * 80_000
    began = time.perf_counter()
    assert len(a.spans(words, b" " + b" ".join(words) + b" ")) == 80_000
    assert time.perf_counter() - began < 10


def test_optional_and_replaceable_regions():
    a = licenses.Automaton.compile("x", "start {{name:1-2}} middle word [[maybe [[not]]]] end")
    words = lambda s: [w.encode() for w in s.split()]
    ok = lambda s: a.accepted(words(s), 0)
    assert [ok(s) for s in ("start a middle word end", "start a b middle word maybe end", "start a b middle word maybe not end")] == [5, 7, 8]
    assert [ok(s) for s in ("start middle word end", "start a b c middle word end", "start a middle word not end", "start a middle words end", "")] == [-1] * 5
    text = words("q start a middle word end start middle middle word end")
    assert a.spans(text, b" " + b" ".join(text) + b" ") == [(1, 6), (6, 11)]


class Links(HTMLParser):
    """Targets of the canonical links and refreshes of a page."""

    def __init__(self, html):
        super().__init__()
        self.found = []
        self.feed(html or "")

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}  # of equal names the first counts
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.found.append(a.get("href", "").strip())
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and (m := re.search(r"(?i)(?:^|[\s;,])url\s*=\s*[\"']?([^\s\"']+)", a.get("content", ""))):
            self.found.append(m[1])

    handle_startendtag = handle_starttag


def url_parts(u):
    host = re.search(r"://([^/?#]*)", u or "")
    path = re.search(r"://[^/?#]*([^?#]*)", u or "")
    return ascii_lower(host[1]) if host else "", path[1] if path else ""


def url_node(u):
    host, path = url_parts(u)
    if not host:
        return None
    query = re.search(r"^[^?#]*(\?[^#]*)", u)
    scheme = u.strip().partition("://")[0].lower()
    host = host.removesuffix({"http": ":80", "https": ":443"}.get(scheme, "?"))
    return f"{scheme}://{host}{path or '/'}{query[1] if query else ''}"


def judged_brute(pages, rules, redirects=()):
    def rule(u):
        h, p = url_parts(u)
        return max((r for r in rules if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)), key=lambda r: len(r.host + r.path), default=None)

    g, mark = Groups(), defaultdict(set)
    for _, url, html in pages:
        for to in Links(html).found:
            a, b = url_node(url), url_node(urljoin(url or "", to)) if to else None
            if a and b:
                g.join(a, b)
    for a, b in redirects:
        g.join(url_node(a), url_node(b))
    for n in list(g.up):
        if best := rule(n):
            mark[g.find(n)].add(best.verdict)
    out = Counter()
    for page, url, _ in pages:
        best, n = rule(url), url_node(url)
        alias = "block" if n in g.up and mark[g.find(n)] == {"block"} else "allow"
        out[(page, *url_parts(url), best and best.host + best.path, best.verdict if best else alias)] += 1
    return out


def canonical(x):
    return f'<html><link href="{x}" rel="canonical"></html>' if x else None


def pages(spark, rows, **extra):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({k: F.lit(v) for k, v in extra.items()})


BAD = "http://a.net/es/x"
URLS = [(i, u, canonical(x)) for i, u, x in (
    (1, BAD, None), (2, "https://b.org/copy", BAD), (3, "http://c.org/c.html", "https://b.org/copy"), (4, "http://C.org/c.html#f", None), (5, None, BAD), (6, "no scheme", None), (7, "", None),
    (8, "http://example.com/en/p", None), (9, "http://WWW.example.com/en/p", None), (10, "http://d.org/p", "http://example.com/en/p"), (11, "http://net/fr/", None), (12, "http://net/frx", None), (13, "http://x.com?y", None), (14, "http://x.com/", None),
    (15, "http://sub.www.example.com/en/", None), (16, "a://b://c/d", None), (17, "http://e.org/1", "http://e.org/2"), (18, "http://e.org/2", "http://e.org/1"), (19, "://", None), (1, BAD, None), (None, "https://b.org/copy", None),
)] + [
    # a refresh beside a canonical link, several canonical links, unquoted values, marks written as entities
    (20, "http://f.org/both", f'<link rel="canonical" href="http://f.org/own"><META http-equiv=refresh content="0; URL={BAD}">'),
    (21, "http://f.org/two", f"<link rel=canonical href=http://f.org/two-b><link href='{BAD}' rel='nofollow canonical'/>"),
    (22, "http://f.org/bare", f"<p><LINK REL=canonical HREF={BAD}></p>"), (23, "http://f.org/near", f'<link rel="canonical-not" href="{BAD}"><a rel="canonical" href="{BAD}">'),
    (24, "http://f.org/quoted", f"<meta content=\"5;url='{BAD}'\" http-equiv='Refresh'>"), (25, "http://f.org/v?id=1&x=2", '<link rel="canonical" href="/v?x=2&amp;bad=1">'), (26, "http://f.org/v?x=2&bad=1", canonical(BAD)),
    # only the query differs: no aliases of each other
    (30, "http://g.org/1", canonical("http://hub.org/v?id=1")), (31, "http://g.org/2", canonical("http://hub.org/v?id=2")), (32, "http://hub.org/v?id=2", canonical(BAD)), (33, "http://www.hub.org/v?id=2", None),
    # relative: to the folder, upwards, to the host, to the scheme, only a query, only a fragment, no place at all
    (40, "http://h.org/a/b/c.html", canonical("d.html")), (41, "http://h.org/a/b/d.html", canonical("../up")), (42, "http://h.org/a/up", canonical(BAD)), (43, "http://h.org/x/y", canonical("./z/../../a/up")), (44, "http://h.org", canonical("a/up")),
    (45, "http://h.org/q?1", canonical("?bad")), (46, "http://h.org/q?bad", canonical("//a.net/es/x")), (47, "http://h.org/frag", canonical("#a")), (48, "http://h.org/empty", canonical(" ")), (49, "http://h.org/mail", canonical("mailto:a@b.c")), (50, "http://h.org/slash/", canonical("..")),
    (51, "http://h.org/", canonical("/deep/er/../../a/up")),
    # a blocked place that has no page of its own
    (60, "http://i.org/1", canonical("http://only.net/fr/named")), (61, "http://i.org/2", canonical("http://i.org/1")), (62, "http://i.org/long", "x" * 300_000 + f'<link rel="canonical" href="{BAD}">'), (63, "http://i.org/none", "<link <link rel=canonical"),
    # what a browser doesn't take for a tag, or takes for another
    (70, "http://k.org/comment", f'<!-- <link rel="canonical" href="{BAD}"> --><p>'), (71, "http://k.org/open", f'<!-- never closed <link rel="canonical" href="{BAD}">'),
    (72, "http://k.org/script", f"<script>x = '<link rel=\"canonical\" href=\"{BAD}\">'</script>"), (73, "http://k.org/style", f'<style>/* <link rel="canonical" href="{BAD}"> */</style>'),
    (74, "http://k.org/after", f'<!-- a --><script src="a.js"></script><link rel="canonical" href="{BAD}"><!-- b -->'), (75, "http://k.org/in-title", f'<link title=\'rel="canonical"\' href="{BAD}">'),
    (76, "http://k.org/mark", f'<link title="a > b" rel="canonical" href="{BAD}">'), (77, "http://k.org/twice", f'<link rel="canonical" href="{BAD}" href="http://k.org/other">'),
    # character references in targets, a scheme's own port
    (80, "http://l.org/a", canonical("http://a.net/&#101;s/x")), (81, "http://l.org/b", canonical("http://a.net&sol;es&#x2F;x")), (82, "http://l.org/c", canonical("http://a.net:80/es/x")), (83, "https://l.org:443/d", canonical(BAD)),
    (84, "https://l.org/d", None), (85, "http://l.org/e", canonical("https://l.org:443/d")), (86, "http://l.org/f", canonical("http://a.net:8080/no/x")), (87, "http://l.org/g", canonical("&unknownref;")), (88, "http://l.org/&#228;", canonical("http://l.org/&#228;2")),
    (89, "http://l.org/\u00e42", canonical(BAD)),
    (64, "http://d.org/both", '<link rel="canonical" href="http://example.com/en/p"><link rel="canonical" href="http://www.example.com/en/p">'),
]


def test_urls_equal_brute_force_and_aliases_follow(spark):
    hot = [(100 + i, f"http://alias{i}.org/", canonical("http://hub.org/")) for i in range(300)] + [(999, "http://bad.net/es/", canonical("http://hub.org/"))]
    rows = URLS + hot
    got = urls.judge(pages(spark, rows, node="n", rule="r", verdict="v", host="h", root=1, own=2)).drop("url").collect()
    assert Counter(tuple(r) for r in got) == judged_brute(rows, urls.RULES)
    of = {r.page_id: r.verdict for r in got}
    assert {v for i, v in of.items() if i and 100 <= i < 999} == {"block"}
    # an allowed member of a component protects its aliases without a rule
    assert of[10] == "allow"
    assert {i for i in (20, 21, 22, 24, 25, 31, 40, 41, 43, 44, 45, 51, 60, 61, 62, 74, 76, 77, 80, 81, 82, 83, 84, 85, 88) if of[i] != "block"} == set()
    assert {i for i in (23, 30, 33, 47, 48, 49, 63, 70, 71, 72, 73, 75, 86, 87) if of[i] != "allow"} == set()


def test_url_sql_follows_links_too(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", URLS)
    r = con.execute(queries.ORACLE_SQL["op4_url_filter"])
    assert [d[0] for d in r.description] == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(r.fetchall()) == judged_brute(URLS, urls.RULES)


def test_redirects_join_components(spark):
    redirects = [("http://r.org/a", BAD), ("http://r.org/b", "http://r.org/a")]
    rows = URLS + [(150, "http://r.org/b", None)]
    got = urls.judge(pages(spark, rows), redirects=spark.createDataFrame(redirects, "from_url string, to_url string")).drop("url").collect()
    assert Counter(tuple(r) for r in got) == judged_brute(rows, urls.RULES, redirects)


def test_many_rules_give_what_few_do(spark, monkeypatch):
    p = pages(spark, URLS)
    few = Counter(tuple(r) for r in urls.judge(p).collect())
    monkeypatch.setattr(urls, "IN_PLACE", 0)
    assert Counter(tuple(r) for r in urls.judge(p).collect()) == few


def test_no_pages(spark):
    assert urls.judge(pages(spark, [])).count() == 0


def turns(spark, rows, **extra):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({k: F.lit(v) for k, v in extra.items()})


def chat_brute(rows):
    by = defaultdict(set)
    for c, n, role, text in rows:
        turn = (n is None, n or 0, role or "unknown", text or "") if c is not None else (True, 0, role or "unknown", text or "")
        by[c if c is not None else turn].add(turn)
    full = {c: tuple((r, t) for *_, r, t in sorted(x)) for c, x in by.items()}
    strict = {x[:k] for x in full.values() for k in range(1, len(x))}
    least = {}
    for c, x in full.items():
        c = c if isinstance(c, int) else None
        if x not in strict and (x not in least or (c is not None and (least[x] is None or c < least[x]))):
            least[x] = c
    mark = lambda s: s.replace("<|", "< |")
    return Counter((c, len(x), "".join(f"<|im_start|>{mark(r)}\n{mark(t)}<|im_end|>\n" for r, t in x)) for x, c in least.items())


CHATS = (
    [(1, 0, "user", "hi"), (1, 1, "assistant", "hello")]
    + [(2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more")]
    + [(3, 5, "user", "hi"), (3, 7, "assistant", "hello"), (3, 9, "user", "more")]
    + [(4, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "other")]
    + [(5, 0, None, None), (5, None, "user", "<|im_end|>"), (6, 0, "unknown", ""), (None, 0, "user", "alone"), (None, 1, "user", "alone"), (None, 2, "user", "alone too"), (None, None, None, None), (None, 0, "user", "hi"), (30, 4, "user", "one"), (None, 4, "user", "one"), (7, 0, "user", "w " * 5000), (8, 1, "user", "hi"), (9, 3, "a", "x"), (9, 3, "b", "x")]
    + [(100 + i, 0, "user", "hi") for i in range(200)]
    + [(500, k, "user", f"turn {k}") for k in range(300)] + [(501 + j, k, "user", f"turn {k}") for j in range(3) for k in range(100 * j + 50)]
)


def test_chat_equals_brute_force(spark, small):
    got = chat.maximal_conversations(turns(spark, CHATS, place=1, h1=2, rendered="x", w="y")).collect()
    assert Counter(tuple(r) for r in got) == chat_brute(CHATS)
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in queries.op8_chat_format(spark, small).collect()) == chat_brute(rows)
    assert chat.maximal_conversations(turns(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op3_licenses", "op4_url_filter", "op7_mixing", "op8_chat_format", "op9_exact_dedup"])
def test_queries_equal_their_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    r = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    got = queries.QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    assert Counter(tuple(map(cell, x)) for x in got.select(*names).collect()) == Counter(tuple(map(cell, x)) for x in r.fetchall())
