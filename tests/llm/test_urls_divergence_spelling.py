"""URL filters, divergence audit and spelling variants against brute force."""

from __future__ import annotations

import collections
import random
import re
import zlib
from fractions import Fraction
from urllib.parse import urljoin

import pytest

from tarn.llm import common, divergence, spelling, url_rules

AWKWARD = "doc_id long, text string, lang string, source string, n long, docs long, term string, word string, node string, comp int, host string, rule string, size int"
LONG = " ".join(f"Wort{chr(97 + i % 23)}{chr(97 + i % 19)}lang" for i in range(20_000))
ROWS = [
    (1, "alpha Beta beta GAMMA ünïcode İx", "en", "a"), (1, "alpha Beta beta GAMMA ünïcode İx", "en", "a"), (2, "alpha", "en", None), (3, None, "en", "b"), (4, "", None, None),
    (None, "alpha delta", "en", "a"), (5, LONG, "de", "a"), (6, "12 34 !!", "fr", "x"), (7, "ÀÉ alpha×beta \U0001f600 straße", "en", "c"), (8, "alpha", "", "c"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 0, 0, "t", "w", "x", 0, "h", "r", 1) for r in ROWS], AWKWARD)


# ---------------------------------------------------------------------- URLs
def _parts(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    tail = rest[len(host) :]
    path = re.match(r"[^?#]*", tail)[0]
    query = re.match(r"[^?#]*(\?[^#]*)?", tail)[1] or ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return host, path, (host + (path or "/") + query) if host else None


def _rule(host, path, rules):
    fit = [(-len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fit)[:0:-1] if fit else (None, None)


def _judged(pages, edges, rules):
    """Plain graph search."""
    beside = collections.defaultdict(set)
    for a, b in edges:
        a, b = _parts(a)[2], _parts(b)[2]
        beside[a].add(b)
        beside[b].add(a)
    out = []
    for page_id, url, _ in pages:
        host, path, node = _parts(url)
        rule, verdict = _rule(host, path, rules)
        if verdict is None:
            seen, todo = {node}, [node]
            while todo and node is not None:
                new = [x for x in beside[todo.pop()] if x not in seen]
                seen |= set(new)
                todo += new
            says = set()
            for x in (x for x in seen if x is not None and beside[x]):
                h, rest = x.split("/", 1)
                says.add(_rule(h, "/" + rest.split("?")[0], rules)[1])
            verdict = "allow" if "allow" in says or "block" not in says else "block"
        out.append((page_id, host, path, rule, verdict))
    return sorted(out, key=str)


URL_PAGES = [
    (0, "http://a.org/x", '<html><head><link rel="canonical" href="https://bad.net/es/1"></head></html>'),  # blocked by its alias
    (1, "https://a.org/x#part", None), (2, "http://b.org/", "<META content='0; URL=http://a.org/x?q=1' HTTP-EQUIV=refresh>"), (3, "http://A.org/x?q=1", "<link href=/x rel=canonical>"),
    (4, "http://www.example.com/en/2", "<link rel='canonical' href='//c.org'>"), (5, "http://c.org", "<link rel=canonical href='http://bad.net/fr/9'>"),  # allowed alias first
    (6, "http://d.org/dir/page", '<link rel="canonical" href="../up/./here?a=1&amp;b=2">'), (7, "http://d.org/up/here?a=1&b=2", '<link rel="canonical" href="http://x.net/es/">'),
    (8, "http://e.org/1", '<!-- <link rel="canonical" href="http://x.net/es/"> --><script>"<link rel=canonical href=http://x.net/es/>"</script>'),
    (9, "http://f.org/1", '<link rel="stylesheet" href="http://x.net/es/"><link rel="alternate canonical" href="mailto:x@y.z">'), (10, None, "<link rel=canonical href='http://x.net/es/'>"), (11, "no url", None),
    (12, "", None), (None, "http://net/es/1", ""), (13, "ftp://EXAMPLE.com/en/", ""), (13, "ftp://EXAMPLE.com/en/", ""), (14, "http://com", ""), (15, "http://g.org/a", "<link rel=canonical href='#top'>"),
    (16, "http://g.org/b", "<link rel=canonical href='?z'>"), (17, "x://h.org/é/" + "y" * 5000, "z" * 100_000), (18, "http://notexample.com/en/", ""), (19, "http://e.org\n/q?", "text about canonical form"),
]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", "r") for r in rows], "page_id long, url string, html string, a int, node string, verdict string")


EDGES = [
    ("http://a.org/x", "https://bad.net/es/1"), ("http://b.org/", "http://a.org/x?q=1"), ("http://A.org/x?q=1", "http://a.org/x"), ("http://www.example.com/en/2", "http://c.org"), ("http://c.org", "http://bad.net/fr/9"),
    ("http://d.org/dir/page", "http://d.org/up/here?a=1&b=2"), ("http://d.org/up/here?a=1&b=2", "http://x.net/es/"), ("http://g.org/b", "http://g.org/b?z"),
]


def test_urls_by_graph_search(spark):
    got = url_rules.judge(_frame(spark, URL_PAGES)).drop("via").collect()
    want = _judged(URL_PAGES, EDGES, url_rules.RULES)
    assert sorted(map(tuple, got), key=str) == want
    by_id = {r.page_id: r.verdict for r in got}
    assert [by_id[i] for i in (0, 1, 2, 3, 4, 5, 6, 8)] == ["block", "block", "block", "block", "allow", "allow", "block", "allow"]


def test_links_agree_with_urljoin(spark):
    bases = ["http://h.org/a/b/c?x=1", "http://h.org/a/b/", "http://h.org"]
    targets = ["d", "./d", "../d", "../../../d", "/r/../s", "/r", "?q=2", "d/.", "d/..", "//o.org/p", "https://o.org/p", "x/./y?z=../k"]
    rows = [(i, b, f'<link rel="canonical" href="{t}">') for i, (b, t) in enumerate((b, t) for b in bases for t in targets)]
    got = {(r.source, r.target) for r in url_rules.links(_frame(spark, rows)).collect()}
    strip = lambda u: _parts(u)[2]
    assert {(b, strip(t)) for b, t in got} == {(b, strip(urljoin(b, t))) for b in bases for t in targets}


def test_rule_table_equals_rule_list(spark):
    rng = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org"]
    rules = sorted({(rng.choice(["allow", "block"]), rng.choice(hosts), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(4)))) for _ in range(150)})
    rules = [r for r in rules if r[0] == "allow" or ("allow", *r[1:]) not in rules]
    assert len(rules) > url_rules.INLINE
    pages = [(i, f"http://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice(hosts)}/{''.join(rng.choice('ab/') for _ in range(rng.randrange(6)))}", None) for i in range(400)]
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = url_rules.judge(_frame(spark, pages), table).drop("via").collect()
    assert sorted(map(tuple, got), key=str) == _judged(pages, [], rules)
    few = url_rules.judge(_frame(spark, pages), table.limit(0)).collect()
    assert {(r.rule, r.verdict, r.via) for r in few} == {(None, "allow", "default")}


def test_long_redirect_chain_and_hub(spark):
    """A chain of 300 redirects and a hub of 2,000 aliases, one end of each blocked."""
    chain = [(f"http://c.org/{i}", f"http://c.org/{i + 1}") for i in range(300)] + [("http://c.org/300", "http://z.net/es/")]
    hub = [(f"http://h{i}.org/", "http://hub.org/") for i in range(2000)] + [("http://hub.org/", "http://z.net/fr/")]
    pages = [(0, "http://c.org/0", None), (1, "http://h7.org/", None), (2, "http://h1999.org", None), (3, "http://c.org/301", None)]
    redirects = spark.createDataFrame(chain + hub + [(None, "http://c.org/0"), ("x", None)], "source string, target string")
    got = {r.page_id: (r.verdict, r.via) for r in url_rules.judge(_frame(spark, pages), redirects=redirects).collect()}
    assert got == {0: ("block", "alias"), 1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "default")}


def test_urls_of_an_empty_table(spark):
    assert url_rules.judge(_frame(spark, [])).count() == 0


def test_urls_use_no_python(spark):
    plan = url_rules.judge(_frame(spark, URL_PAGES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


# ---------------------------------------------------------------- divergence
def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def _audited(rows, min_docs, limit):
    docs = [(r[2] or "", r[3] or "", [_lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")]) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= min_docs)
        count = collections.Counter((d[1], t) for d in mine for t in d[2])
        sources = sorted({d[1] for d in mine})
        share = lambda c, n: 1 + Fraction(1_000_000_000 * (c + 5), n + 5 * len(kept)).__floor__()
        sizes = {s: sum(count[s, t] for t in kept) for s in sources}
        p = {(s, t): share(count[s, t], sizes[s]) for s in sources for t in kept}
        q = {t: share(sum(count[s, t] for s in sources), sum(sizes.values())) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s, t] - p[o, t]) for t in kept), o.encode(), o) for o in sources if o != s))
            terms = sorted((q[t] - p[s, t], t.encode(), t) for t in kept if count[s, t] and p[s, t] > q[t])[:limit]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "limit"), [(1, 50), (2, 2), (99, 50)])
def test_divergence_by_brute_force(spark, awkward, min_docs, limit):
    got = sorted(map(tuple, divergence.audit(awkward, min_docs=min_docs, limit=limit).collect()))
    assert got == _audited(ROWS, min_docs, limit)


def test_divergence_in_small_batches(spark, awkward, monkeypatch):
    """Runs that are split over batches and ranges are merged."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("uno dos tres QUATRO cinco".split()) for _ in range(30)), "es", f"s{i % 3}") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    monkeypatch.setattr(common, "ARROW_BYTES", 2000)
    for held in (3, 8, 10_000):
        monkeypatch.setattr(divergence, "HELD", held)
        assert sorted(map(tuple, divergence.audit(table, min_docs=30, limit=3).collect())) == _audited(rows, 30, 3)


def test_divergence_of_an_empty_table(awkward):
    assert divergence.audit(awkward.limit(0)).count() == 0


# ------------------------------------------------------------------ spelling
def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _spelled(rows, least, at_least, ratio, typo):
    n = collections.Counter()
    for r in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", r[1] or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if typo and h % typo == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= least and c >= at_least}
    out, form = [], {}
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and _near(w, x)] for w in words}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def _variants(rng, n):
    rows = []
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(7, 10))) for _ in range(12)]
    for i in range(n):
        words = []
        for _ in range(40):
            w = stems[min(int(rng.expovariate(0.5)), 11)]
            while rng.random() < 0.25:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "zé", w[k] * 2]) + w[k + 1 :]
            words.append(w.upper() if rng.random() < 0.2 and w.isascii() else w)
        rows.append((i, " ".join(words), "en", "a"))
    return rows


@pytest.mark.parametrize("typo", [0, 3, 31])
def test_spelling_by_brute_force(spark, typo):
    rows = _variants(random.Random(typo), 150) + ROWS
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for least, at_least, ratio in ((7, 2, 10), (3, 1, 2)):
        got = spelling.group_spellings(table, typo=typo, least=least, at_least=at_least, ratio=ratio).collect()
        want = _spelled(rows, least, at_least, ratio, typo)
        assert sorted(map(tuple, got), key=str) == want
        assert any(x[1] and x[1] != x[2] for x in want) or at_least == 2  # chains of forms


def test_spelling_of_long_words(spark):
    """Words around the length from which digests travel, and one of 30,000 letters."""
    words = ["ab" * 50, "ab" * 50 + "c", "ab" * 50 + "d", "b" + "ab" * 49 + "a", "x" * 100, "x" * 101, "x" * 102, "y" * 30_000, "y" * 29_999 + "z"]
    rows = [(1, " ".join(words * 2 + words[1:2] * 50 + words[7:8] * 50))]
    got = spelling.group_spellings(spark.createDataFrame(rows, "doc_id long, text string"), typo=0).collect()
    assert sorted(map(tuple, got), key=str) == _spelled(rows, 7, 2, 10, 0)


def test_spelling_of_awkward_and_empty_tables(awkward):
    got = spelling.group_spellings(awkward).collect()
    assert sorted(map(tuple, got), key=str) == _spelled(ROWS, 7, 2, 10, 31)
    assert spelling.group_spellings(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_urls", "op12_divergence", "op13_spelling"])
def test_new_queries_equal_sql(spark, sf, name):
    import duckdb

    from tarn.llm import queries
    from tests.test_oracles import TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(con.sql(queries.ORACLE_SQL[name]).df())
