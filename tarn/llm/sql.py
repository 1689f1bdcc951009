"""DuckDB SQL of the URL filters, the divergence audit and the spelling variants."""

from __future__ import annotations

#: Links: absolute ones and those from the host's root (tables whose relative links have other forms are tested by brute force).
OP11 = r"""
    WITH RECURSIVE rules(verdict, host, path) AS (
        VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
    ),
    seen AS (
        SELECT url, regexp_replace(html, '<!--.*?-->|<script\b.*?</script', ' ', 'gis') AS html
        FROM pages WHERE regexp_matches(html, 'canonical|refresh', 'i') AND instr(url, '://') > 0
    ),
    targets AS (
        SELECT url, regexp_extract(list_filter(regexp_extract_all(html, '<link\b[^>]*>', 0, 'i'), lambda t: regexp_matches(t, 'rel\s*=\s*["'']?canonical', 'i'))[1],
                                   'href\s*=\s*["'']?([^"''\s>]+)', 1, 'i') AS target FROM seen
        UNION ALL
        SELECT url, regexp_extract(list_filter(regexp_extract_all(html, '<meta\b[^>]*>', 0, 'i'), lambda t: regexp_matches(t, 'http-equiv\s*=\s*["'']?refresh', 'i'))[1],
                                   'url\s*=\s*["'']?([^"''\s>]+)', 1, 'i') FROM seen
    ),
    links AS (
        SELECT url, CASE WHEN instr(target, '://') > 0 THEN target WHEN target LIKE '//%' THEN 'http:' || target
                         ELSE 'http://' || regexp_extract(url, '://([^/?#]*)', 1) || target END AS target
        FROM (SELECT url, replace(target, '&amp;', '&') AS target FROM targets) WHERE instr(target, '://') > 0 OR target LIKE '/%'
    ),
    urls AS (SELECT url FROM pages UNION SELECT target FROM links),
    parts AS (
        SELECT url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query
        FROM (SELECT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM urls)
    ),
    nodes AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM parts),
    fits AS (
        SELECT url, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
        FROM nodes JOIN rules r ON (nodes.host = r.host OR ends_with(nodes.host, '.' || r.host)) AND starts_with(nodes.path, r.path) GROUP BY url
    ),
    edges AS (SELECT DISTINCT a.node AS a, b.node AS b FROM links JOIN nodes a ON a.url = links.url JOIN nodes b ON b.url = links.target WHERE a.node <> b.node),
    both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON reach.b = e.a),
    alias AS (
        SELECT reach.a AS node, min(verdict) AS verdict  -- allow before block
        FROM reach JOIN nodes ON nodes.node = reach.b JOIN fits USING (url) GROUP BY reach.a
    )
    SELECT page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, f.rule, coalesce(f.verdict, alias.verdict, 'allow') AS verdict
    FROM pages p LEFT JOIN nodes n ON p.url = n.url LEFT JOIN fits f ON p.url = f.url LEFT JOIN alias ON alias.node = n.node
"""

OP12 = r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (
        SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
        FROM d
    ),
    kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    v AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
    s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (
        SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.size + 5 * v.v) AS p,
               1 + (1000000000::HUGEINT * (k.total + 5)) // (v.size + 5 * v.v) AS q
        FROM s JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
    ),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    found AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

OP13 = r"""
    WITH RECURSIVE crc AS (
        SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps
    ),
    runs AS (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
               translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
    ),
    counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
    bytes AS (
        SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS b
        FROM counted
    ),
    hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, CAST(b AS BIGINT[])), lambda c, x: xor(steps[1 + (xor(c, x) & 255)], c >> 8))) AS h FROM bytes, crc),
    typed AS (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    cuts AS (SELECT word, n, k, word[1 : k] || word[k + 2 :] AS cut FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
    near AS (
        SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.k = b.k AND a.word <> b.word  -- a letter replaced
        UNION SELECT a.word, w.word, w.n FROM cuts a JOIN words w ON a.cut = w.word  -- a letter deleted
        UNION SELECT w.word, a.word, a.n FROM cuts a JOIN words w ON a.cut = w.word  -- a letter inserted
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near),
    formed AS (
        SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
        FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
    ),
    led(word, root) AS (SELECT word, form FROM formed WHERE form IS NOT NULL UNION ALL SELECT led.word, f.form FROM led JOIN formed f ON f.word = led.root WHERE f.form IS NOT NULL),
    ends AS (SELECT led.word, led.root FROM led JOIN formed f ON f.word = led.root WHERE f.form IS NULL)
    SELECT f.word, form, coalesce(root, f.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM formed f LEFT JOIN ends ON ends.word = f.word
"""
