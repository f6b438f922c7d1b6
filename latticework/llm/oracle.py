"""DuckDB SQL for the operators that SQL can express."""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule(host: str, path: str, out: dict[str, str]) -> str:
    fits = [
        ("example.net", "/en/", "example.net/en/"),
        ("example.com", "/de/", "example.com/de/"),
        ("org", "/fr/", "org/fr/"),
        ("net", "/", "net/"),
    ]
    whens = " ".join(
        f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{out[r]}'" for h, p, r in fits
    )
    return f"CASE {whens} END"


_SAME = {r: r for r in ("example.net/en/", "example.com/de/", "org/fr/", "net/")}
_KIND = {"example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow", "net/": "block"}


def _node(url: str) -> str:
    rest = f"regexp_replace(regexp_extract({url}, '(?s)^.*?://(.*)$', 1), '(?s)#.*$', '')"
    low = LOWER.format(f"regexp_extract({rest}, '^[^/?]*', 0)")
    return (
        f"CASE WHEN instr({url}, '://') > 0 THEN concat({low}, regexp_replace("
        f"regexp_extract({rest}, '(?s)^[^/?]*(.*)$', 1), '/(\\?|$)', '\\1')) END"
    )


_HREF = """trim(regexp_replace(regexp_extract(tag, '(?i)\\b{0}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>]+)', 1), '^["'']|["'']$', '', 'g'))"""

URL_FILTER = f"""
WITH RECURSIVE judged AS (
  SELECT page_id, url, html,
    CASE WHEN instr(url, '://') > 0 THEN {LOWER.format("regexp_extract(substring(url, instr(url, '://') + 3), '^[^/?#]*', 0)")} ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substring(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    {_node("url")} AS node
  FROM pages),
ruled AS (SELECT *, {_rule("host", "path", _SAME)} AS rule, {_rule("host", "path", _KIND)} AS own FROM judged),
links AS (
  SELECT node, url, {_HREF.format("href")} AS href FROM (SELECT node, url,
    unnest(regexp_extract_all(html, '(?i)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>')) AS tag FROM judged)
  UNION ALL
  SELECT node, url, regexp_extract({_HREF.format("content")}, '(?i)\\burl\\s*=\\s*[''"]?([^''"\\s]+)', 1) FROM (SELECT node, url,
    unnest(regexp_extract_all(html, '(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>')) AS tag FROM judged)),
full_links AS (SELECT node AS u, CASE WHEN instr(href, '://') > 0 THEN href
    WHEN starts_with(href, '//') THEN concat(regexp_extract(url, '^(.*?)://', 1), ':', href)
    WHEN starts_with(href, '/') THEN concat(regexp_extract(url, '^(.*?://[^/?#]*)', 1), href)
    WHEN href = '' OR starts_with(href, '#') THEN NULL
    ELSE concat(regexp_replace(regexp_extract(url, '^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1), '([^/])$', '\\1/'), href) END AS target FROM links WHERE node IS NOT NULL),
edges AS (SELECT u, v FROM (SELECT u, {_node("target")} AS v FROM full_links) WHERE u <> v),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(a, b) AS (SELECT u, u FROM both_ways UNION SELECT a, v FROM reach JOIN both_ways ON b = u),
member AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
votes AS (
  SELECT root, {_rule("regexp_extract(node, '^[^/?]*', 0)", "concat(regexp_extract(node, '^[^/?]*([^?]*)', 1), '/')", _KIND)} AS own FROM member
  UNION ALL SELECT root, own FROM ruled JOIN member USING (node) WHERE own IS NOT NULL),
shared AS (SELECT root, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' END AS inherited FROM votes GROUP BY root),
decided AS (SELECT node, inherited FROM member JOIN shared USING (root))
SELECT page_id, host, path, rule, coalesce(own, inherited, 'allow') AS verdict,
  CASE WHEN own IS NULL THEN inherited END AS inherited
FROM ruled LEFT JOIN decided USING (node)
"""

_HOLES = ", ".join(
    "[" + ", ".join([f"'{i}'", "lead"] + [f"s{j}" for j in range(5) if j != i]) + "]" for i in range(5)
)

#: The field of a line of four to seven tokens is one of them, after the first or the first two.
_FIELDS = ", ".join(
    f"CASE WHEN n BETWEEN 4 AND 7 AND (CASE WHEN n <= 5 THEN 2 ELSE 3 END) + {i} <= n THEN ['short{i}', n::varchar] || "
    f"t[1 : (CASE WHEN n <= 5 THEN 1 ELSE 2 END) + {i}] || ['<field>'] || t[(CASE WHEN n <= 5 THEN 3 ELSE 4 END) + {i} : n] END"
    for i in range(5)
)

LINE_TEMPLATES = rf"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
words AS (
  SELECT doc_id, text, pos, string_split_regex(regexp_replace(regexp_replace(line, '[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*', '<*>', 'g'),
    '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g'), '[ \t\x0B\f\r]+') AS t FROM lines),
cut AS (
  SELECT doc_id, text, pos, t, len(t) AS n, array_to_string(t[1:3], ' ') || '|' || len(t) AS lead,
    {", ".join(f"array_to_string(t[4 + {i} * greatest(len(t) - 3, 0) // 5 : 3 + {i + 1} * greatest(len(t) - 3, 0) // 5], ' ') AS s{i}" for i in range(5))}
  FROM words WHERE t[1] <> ''),
keyed AS (
  SELECT doc_id, text, pos, 2 AS support, unnest(list_concat([['full', lead, s0, s1, s2, s3, s4]], CASE WHEN n >= 8 THEN [{_HOLES}] ELSE [] END)) AS k
  FROM cut WHERE n >= 3
  UNION ALL SELECT doc_id, text, pos, 10, unnest(CASE WHEN n < 3 THEN [['whole'] || t] ELSE list_filter([{_FIELDS}], lambda x: x IS NOT NULL) END) FROM cut WHERE n < 8),
firsts AS (SELECT k, min(doc_id) AS least FROM keyed GROUP BY k HAVING count(DISTINCT doc_id) >= any_value(support)),
gone AS (SELECT DISTINCT doc_id, text, pos FROM keyed JOIN firsts USING (k) WHERE doc_id > least),
marks AS (SELECT doc_id, text, list(pos) AS gone FROM gone GROUP BY ALL)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
  coalesce(len(gone), 0) AS n_dropped,
  CASE WHEN gone IS NULL THEN d.text ELSE coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS text
FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id AND d.text = m.text
"""
