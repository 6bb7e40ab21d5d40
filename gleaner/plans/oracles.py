"""DuckDB oracle SQL for the registered queries (same column names as the Spark side).

HTML oracles read the raw ``pages.html`` with regular expressions; they are valid for
the supplied page generator (flat anchors, one ``nav``, ``h1`` in ``article``), which is
what the round-trip and inline-HTML tests back up for other shapes.
"""

from __future__ import annotations

from gleaner.plans.presets import SYSTEM_PRESETS


def dec(x: str) -> str:
    """SQL that decodes the HTML entities present in the supplied pages (``&amp;`` last)."""
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"),
                    ("&middot;", "·"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        ch = ch.replace("'", "''")
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def nspace(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'))"


def attr(attrs: str, name: str) -> str:
    return f"coalesce(regexp_extract({attrs}, '\\s{name}=\"([^\"]*)\"', 1), '')"


# every anchor in document order: (page_id, i [1-based], attrs, text)
_ANCHORS = """
WITH x AS (
  SELECT page_id,
         regexp_extract_all(html, '<a\\b([^>]*)>([^<]*)</a>', 1) AS av,
         regexp_extract_all(html, '<a\\b([^>]*)>([^<]*)</a>', 2) AS tv
  FROM pages),
a0 AS (SELECT page_id, unnest(generate_series(1, len(av))) AS i, av, tv FROM x),
a AS (SELECT page_id, i, av[i] AS attrs, tv[i] AS txt FROM a0)
"""


def _links(where: str, cols: str) -> str:
    return (
        _ANCHORS
        + f""", m AS (SELECT *, {attr('attrs', 'href')} AS href, {attr('attrs', 'rel')} AS rel,
                {attr('attrs', 'target')} AS target, {attr('attrs', 'title')} AS title,
                trim({dec('txt')}) AS text FROM a)
SELECT page_id,
       CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS original_index,
       {cols}
FROM m WHERE {where}"""
    )


def _empty(*cols: str) -> str:
    return "(" + " AND ".join(f"trim({c}) = ''" for c in cols) + ")"


_HEADINGS = f"""
WITH x AS (
  SELECT page_id,
         regexp_extract_all(html, '(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1) AS lv,
         regexp_extract_all(html, '(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS tv
  FROM pages),
a AS (SELECT page_id, unnest(generate_series(1, len(lv))) AS i, lv, tv FROM x)
SELECT page_id, CAST(i - 1 AS INTEGER) AS original_index, false AS is_empty,
       lv[i] AS level, {nspace(dec('tv[i]'))} AS text, '' AS id, '' AS class
FROM a
"""

_NOT_REL = "NOT contains(rel, 'nofollow') AND NOT contains(rel, 'sponsored') AND NOT contains(rel, 'ugc')"

# customer pages: the values each rendered element carries (see sources/render.py)
_CUST = """
WITH c AS (
  SELECT c_custkey AS page_id, c_custkey AS k, c_name AS name, c_mktsegment AS seg,
         CAST(c_nationkey AS VARCHAR) AS nat,
         ['nofollow', 'sponsored', 'ugc noopener', ''][CAST(c_custkey % 4 AS INTEGER) + 1] AS rel,
         ['facebook', 'twitter', 'x', 'linkedin', 'instagram', 'youtube', 'tiktok', 'pinterest'][CAST(c_custkey % 8 AS INTEGER) + 1] AS social,
         lower(regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g')) || '.example.com' AS host
  FROM customer),
l AS (
  SELECT page_id, 1 AS pos, name AS text, 'https://' || host || '/c/' || k AS href, name AS title, rel, '_blank' AS target FROM c
  UNION ALL SELECT page_id, 2, seg, '/n/' || nat || '/' || k, '', '', '' FROM c
  UNION ALL SELECT page_id, 3, name, 'https://www.' || social || '.com/' || k, '', '', '' FROM c
  UNION ALL SELECT page_id, 4, name, '#top', '', '', '' FROM c)
"""


def _cust_links(where: str, cols: str) -> str:
    return _CUST + f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS original_index, {cols}
FROM l WHERE {where}"""


_LINK5 = f"{_empty('text', 'href', 'title', 'rel', 'target')} AS is_empty, text AS anchor_text, href AS url, title, rel, target"

_PARTS = """
WITH p AS (SELECT *, CAST(floor(p_partkey / 50) AS BIGINT) AS page_id,
                  row_number() OVER (PARTITION BY floor(p_partkey / 50) ORDER BY p_partkey) - 1 AS ri
           FROM part)
"""

ORACLES: dict[str, str] = {
    "rt_nofollow_links": _cust_links("contains(rel, 'nofollow')", _LINK5),
    "rt_sponsored_links": _cust_links("contains(rel, 'sponsored')", _LINK5),
    "rt_ugc_links": _cust_links("contains(rel, 'ugc')", _LINK5),
    "rt_dofollow_links": _cust_links(_NOT_REL, _LINK5),
    "rt_internal_links": _cust_links(
        "starts_with(href, '/') OR starts_with(href, '#') OR starts_with(href, '?')",
        f"{_empty('text', 'href', 'rel', 'target')} AS is_empty, text AS anchor_text, href AS url, rel, target",
    ),
    "rt_external_links": _cust_links(
        "starts_with(href, 'http')",
        f"{_empty('text', 'href', 'rel', 'target')} AS is_empty, text AS anchor_text, href AS url, "
        "split_part(split_part(href, '://', 2), '/', 1) AS host, rel, target",
    ),
    "rt_social_links": _cust_links(
        "regexp_matches(href, 'facebook\\.com|twitter\\.com|x\\.com|linkedin\\.com|instagram\\.com|youtube\\.com|tiktok\\.com|pinterest\\.com')",
        "false AS is_empty, replace(replace(split_part(split_part(href, '://', 2), '.com', 1), 'w', ''), '.', '') AS platform, "
        "href AS url, text AS anchor_text, rel, regexp_extract(href, '://(?:www\\.)?([^/]*?)\\.com', 1) AS platform_clean",
    ),
    "rt_images": _CUST + """
SELECT page_id, 0 AS original_index, false AS is_empty, '/img/' || k || '.png' AS source, name AS alt_text,
       '' AS title, nat AS width, '' AS height, 'lazy' AS loading FROM c""",
    "rt_forms": _CUST + """
SELECT page_id, 0 AS original_index, false AS is_empty, '/buy/' || k AS action, 'post' AS method,
       'f' || k AS id, seg AS class, '3' AS input_count FROM c""",
    "rt_buttons": _CUST + """
SELECT page_id, 0 AS original_index, false AS is_empty, 'input' AS element_type, '' AS text_value,
       'Buy ' || nat AS value_attr, 'submit' AS type, '' AS class, '' AS href FROM c
UNION ALL SELECT page_id, 1, false, 'button', seg, '', 'button', 'btn', '' FROM c
UNION ALL SELECT page_id, 2, false, 'a', name, '', '', 'cta', '#top' FROM c""",
    "rt_demo_table": _PARTS + """
SELECT page_id, CAST(ri - 1 AS INTEGER) AS original_index, false AS is_empty, CAST(p_partkey AS VARCHAR) AS rank,
       trim(p_name) AS country_territory, trim(p_brand) AS population, CAST(p_size AS VARCHAR) AS percentage,
       CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS date
FROM p WHERE ri BETWEEN 1 AND 10""",
    "part_tables": _PARTS + """
SELECT page_id, 1 AS table_index, CAST(ri AS INTEGER) AS original_index, v.col_index, v.column_name, v.value
FROM p, LATERAL (VALUES (1, 'Key', CAST(p_partkey AS VARCHAR)), (2, 'Name', trim(p_name)), (3, 'Brand', trim(p_brand)),
                        (4, 'Size', CAST(p_size AS VARCHAR)),
                        (5, 'Price', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR))) v(col_index, column_name, value)""",
    "part_table_configs": """
SELECT DISTINCT CAST(floor(p_partkey / 50) AS BIGINT) AS page_id, 1 AS table_index, '(//table)[1]//tr[td]' AS main_selector,
       v.col_pos, v.name, '*[' || (v.col_pos + 1) || ']' AS selector, 'col' || (v.col_pos + 1) AS key
FROM part, (VALUES (0, 'Key'), (1, 'Name'), (2, 'Brand'), (3, 'Size'), (4, 'Price')) v(col_pos, name)""",
    "internal_links": _links(
        "starts_with(href, '/') OR starts_with(href, '#') OR starts_with(href, '?')",
        f"{_empty('text', 'href', 'rel', 'target')} AS is_empty, text AS anchor_text, href AS url, rel, target",
    ),
    "demo_links": _links(
        "true", f"{_empty('text', 'href', 'rel', 'target')} AS is_empty, text AS anchor_text, href AS url, rel, target"
    ),
    "dofollow_links": _links(
        _NOT_REL,
        f"{_empty('text', 'href', 'title', 'rel', 'target')} AS is_empty, text AS anchor_text, "
        "href AS url, title, rel, target",
    ),
    "nofollow_links": _links(
        "contains(rel, 'nofollow')",
        f"{_empty('text', 'href', 'title', 'rel', 'target')} AS is_empty, text AS anchor_text, "
        "href AS url, title, rel, target",
    ),
    "external_links": _links(
        "starts_with(href, 'http')",
        f"{_empty('text', 'href', 'rel', 'target')} AS is_empty, text AS anchor_text, href AS url, "
        "CASE WHEN position('/' IN substr(href, position('://' IN href) + 3)) > 0 AND position('://' IN href) > 0 "
        "THEN substr(substr(href, position('://' IN href) + 3), 1, position('/' IN substr(href, position('://' IN href) + 3)) - 1) "
        "ELSE '' END AS host, rel, target",
    ),
    "headings": _HEADINGS,
    "all_presets_cells": f"""
WITH d AS ({_links(_NOT_REL, "text, href, title, rel, target")}),
i AS ({_links("starts_with(href, '/') OR starts_with(href, '#') OR starts_with(href, '?')", "text, href, rel, target")}),
h AS ({_HEADINGS})
SELECT page_id, 'sys-dofollow-links' AS preset_id, original_index,
       {_empty('text', 'href', 'title', 'rel', 'target')} AS is_empty, k AS col_key, v AS col_value
FROM d, LATERAL (VALUES ('Anchor text', text), ('URL', href), ('Title', title), ('Rel', rel), ('Target', target)) t(k, v)
UNION ALL
SELECT page_id, 'sys-internal-links', original_index, {_empty('text', 'href', 'rel', 'target')}, k, v
FROM i, LATERAL (VALUES ('Anchor Text', text), ('URL', href), ('Rel', rel), ('Target', target)) t(k, v)
UNION ALL
SELECT page_id, 'sys-headings', original_index, is_empty, k, v
FROM h, LATERAL (VALUES ('Level', level), ('Text', text), ('ID', id), ('Class', class)) t(k, v)
""",
    "nav_link_targets": """
WITH x AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a\\b[^>]*\\shref="([^"]*)"', 1) AS hv
           FROM pages WHERE html LIKE '%<nav>%'),
a AS (SELECT page_id, unnest(generate_series(1, len(hv))) AS i, hv FROM x)
SELECT page_id, 0 AS context_index, CAST(i - 1 AS INTEGER) AS value_index, hv[i] AS value FROM a
""",
    "element_counts": """
SELECT page_id,
       CAST(len(regexp_extract_all(html, '<li[\\s>]')) AS BIGINT) AS li_count,
       CAST(len(regexp_extract_all(html, '<a[\\s>]')) AS BIGINT) AS a_count,
       CAST(len(regexp_extract_all(html, '<p[\\s>]')) AS BIGINT) AS p_count,
       CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li[\\s>]')) AS BIGINT) AS nav_li_count
FROM pages
""",
    "selector_validation": """
SELECT '//article/p' AS selector, CAST(sum(len(regexp_extract_all(html, '<p[\\s>]'))) AS BIGINT) AS match_count FROM pages
""",
    "ad_blocks": f"""
WITH x AS (SELECT page_id, regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1) AS tv FROM pages),
a AS (SELECT page_id, unnest(generate_series(1, len(tv))) AS i, tv FROM x)
SELECT page_id, CAST(i - 1 AS INTEGER) AS original_index, false AS is_empty, trim({dec('tv[i]')}) AS text, 'ad' AS class FROM a
""",
    "page_titles": f"""
WITH x AS (SELECT page_id, {dec("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS t FROM pages WHERE html LIKE '%<title>%</title>%')
SELECT page_id, 0 AS original_index, false AS is_empty, trim(t) AS title,
       CAST(length(t) AS VARCHAR) AS title_length,
       split_part({nspace('t')}, ' ', 1) AS first_word
FROM x
""",
    "nav_items": _ANCHORS
    + f""", n AS (SELECT page_id, count(*) AS cnt FROM a GROUP BY page_id)
SELECT a.page_id, CAST(a.i - 2 AS INTEGER) AS original_index, false AS is_empty,
       trim({dec('a.txt')}) AS item, {attr('a.attrs', 'href')} AS href,
       coalesce(trim({dec('b.txt')}), '') AS next, CAST(a.i AS VARCHAR) AS pos
FROM a JOIN n ON a.page_id = n.page_id
LEFT JOIN a b ON b.page_id = a.page_id AND b.i = a.i + 1
WHERE a.i BETWEEN 2 AND 4 AND a.i <= n.cnt
""",
}


# ---- view / events / urls / sessions ------------------------------------------------------
_BOLD = f"""
WITH x AS (SELECT page_id, regexp_extract_all(html, '<p>(?:<b>([^<]*))?', 1) AS bv FROM pages),
a AS (SELECT page_id, unnest(generate_series(1, len(bv))) AS i, bv FROM x),
b AS (SELECT page_id, i, trim({dec('bv[i]')}) AS bold FROM a)
"""


def _url_oracle() -> str:
    from gleaner.operators.urls import BLOCKED_PATTERNS, BLOCKED_PREFIXES, CONTEXTS

    pre = " OR ".join(f"starts_with(url, '{p}')" for p in BLOCKED_PREFIXES)
    pat = " OR ".join(f"regexp_matches(url, '{p}')" for p in BLOCKED_PATTERNS)
    rej = " ".join(f"WHEN starts_with(url, '{p}') THEN '{p}'" for p in BLOCKED_PREFIXES)
    rej += " " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{p}'" for p in BLOCKED_PATTERNS)
    path = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    ctx = " ".join(f"WHEN starts_with(url, 'chrome-extension:') AND contains({path}, '{n}') THEN '{c}'" for n, c in CONTEXTS)
    return f"""
SELECT page_id, url,
       coalesce(url <> '' AND NOT ({pre} OR {pat}), false) AS scrapable,
       CASE WHEN url IS NULL OR url = '' THEN NULL {rej} ELSE NULL END AS rejection,
       coalesce(regexp_matches(url, '^https?://'), false) AS is_http,
       CASE {ctx} ELSE 'unknown' END AS context
FROM pages"""


ORACLES.update({
    "paragraph_row_counts": """
SELECT page_id, CAST(len(regexp_extract_all(html, '<p[\\s>]')) AS BIGINT) AS rows,
       CAST(len(regexp_extract_all(html, '<p[\\s>]')) - len(regexp_extract_all(html, '<p><b>')) AS BIGINT) AS empty_rows,
       CAST(len(regexp_extract_all(html, '<p><b>')) AS BIGINT) AS non_empty_rows
FROM pages WHERE len(regexp_extract_all(html, '<p[\\s>]')) > 0""",
    "paragraph_display_index": _BOLD + """
SELECT page_id, CAST(i - 1 AS INTEGER) AS original_index,
       CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER) AS display_index, bold
FROM b WHERE bold <> ''""",
    "paragraph_widths": _BOLD + """, d AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rn FROM b WHERE bold <> '')
SELECT page_id, 'Bold' AS "column", CAST(greatest(max(length(bold)), 4) AS INTEGER) AS max_len,
       CAST(least(greatest(greatest(max(length(bold)), 4) * 7 + 20, 80), 300) AS INTEGER) AS width
FROM d WHERE rn <= 50 GROUP BY page_id""",
    "link_search": _links(
        "(contains(lower(text), 'th') OR contains(lower(href), 'th')) AND NOT " + _empty('text', 'href', 'rel', 'target'),
        f"{_empty('text', 'href', 'rel', 'target')} AS is_empty, text AS anchor_text, href AS url, rel, target",
    ).replace("CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER)", "CAST(i - 1 AS INTEGER)"),
    "link_page_slice": _ANCHORS + f""", m AS (SELECT *, {attr('attrs', 'href')} AS href, trim({dec('txt')}) AS text FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rn, count(*) OVER (PARTITION BY page_id) AS n FROM m),
s AS (SELECT *, least(1, greatest(1, ceil(n / 2.0)) - 1) AS idx FROM r)
SELECT page_id, CAST(i - 1 AS INTEGER) AS original_index, {_empty('text', 'href')} AS is_empty, text AS anchor_text,
       href AS url, '' AS rel, '' AS target, CAST(rn AS INTEGER) AS display_index
FROM s WHERE rn > idx * 2 AND rn <= idx * 2 + 2""",
    "customer_search": """
SELECT * FROM customer
WHERE contains(lower(concat_ws(chr(1), c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)), 'furniture')""",
    "orders_sorted_page": """
SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus FROM orders
ORDER BY lower(o_orderpriority), o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 60""",
    "recent_event_types": """
WITH l AS (SELECT user_id, trim(event_type) AS selector, max(ts) AS last_used FROM events
           WHERE trim(event_type) <> '' GROUP BY 1, 2)
SELECT user_id, selector, last_used, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_used DESC, selector) AS rank FROM l)
WHERE rank <= 5""",
    "event_queue": """
SELECT event_id, user_id, event_type AS name, ts
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 1000""",
    "events_enriched": """
SELECT event_id, event_type AS name, 'production' AS environment, 'background' AS extension_context,
       '1.0.0' AS extension_version, json_extract_string(props, '$.k') AS k,
       CAST(len(json_keys(props)) + 3 AS INTEGER) AS n_props
FROM events WHERE event_type <> ''""",
    "events_routed": """
WITH l AS (SELECT user_id, arg_max(event_type, ts) AS last FROM events GROUP BY user_id),
c AS (SELECT user_id, CASE last WHEN 'signup' THEN true WHEN 'error' THEN false ELSE NULL END AS consent FROM l)
SELECT e.event_id, e.user_id, c.consent,
       CASE WHEN c.consent IS NULL THEN 'queue' WHEN c.consent THEN 'deliver' ELSE 'drop' END AS route
FROM events e LEFT JOIN c USING (user_id)""",
    "page_url_rules": _url_oracle(),
    "tab_sessions": """
SELECT user_id AS tab_id, event_type AS field, arg_max(props, event_id) AS value_json, max(event_id) AS seq
FROM events GROUP BY 1, 2""",
})

# first navigation link per page: n = number of nav items (each holds one link)
_NAV = """
WITH nv AS (SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li[\\s>]')) AS n
            FROM pages WHERE regexp_matches(html, '<nav>.*?<a\\b'))
"""

ORACLES.update({
    "nav_link_inference": _NAV + """
SELECT page_id,
       CASE WHEN n > 1 THEN '/html/body/nav/ul/li[1]/a' ELSE '/html/body/nav/ul/li/a' END AS path,
       '/html/body/nav/ul/li/a' AS minimal,
       '/html/body/nav/ul/li/a | /html/body/nav/ul/li | /html/body/nav/ul | /html/body/nav' AS candidates,
       n || ',' || n || ',1,1' AS candidate_matches,
       0 AS default_index,
       CASE WHEN n > 1 THEN 'li' END AS row_ancestor_tag,
       CASE WHEN n > 1 THEN 'li' ELSE 'a' END AS repeating_ancestor_tag
FROM nv""",
    "nav_guess_config": _NAV + """
SELECT page_id, '//nav//a' AS main_selector, 0 AS col_pos, 'List Item' AS name, '.' AS selector FROM nv WHERE n > 1
UNION ALL
SELECT page_id, '//nav//a', v.p, v.name, v.sel FROM nv,
       (VALUES (0, 'Anchor text', '.'), (1, 'URL', '@href'), (2, 'Rel', '@rel'), (3, 'Target', '@target')) v(p, name, sel)
WHERE n <= 1""",
    "nav_quick_scrape": _NAV + _ANCHORS.replace("WITH x AS", ", x AS") + f""", m AS (SELECT a.*, nv.n FROM a JOIN nv USING (page_id))
SELECT page_id, '/html/body/nav/ul/li' AS main_selector, CAST(i - 1 AS INTEGER) AS original_index, 0 AS col_pos,
       'List Item' AS name, 'List Item' AS key, trim({dec('txt')}) AS value
FROM m WHERE n > 1
UNION ALL
SELECT page_id, '/html/body/nav/ul/li/a', CAST(i - 1 AS INTEGER), v.p, v.name, v.name,
       CASE v.p WHEN 0 THEN trim({dec('txt')}) WHEN 1 THEN {attr('attrs', 'href')} ELSE '' END
FROM m, (VALUES (0, 'Anchor text'), (1, 'URL'), (2, 'Rel'), (3, 'Target')) v(p, name) WHERE n <= 1""",
})

_TITLE = f"""
WITH tt AS (SELECT page_id, url, {dec("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS raw
            FROM pages WHERE html LIKE '%<title>%</title>%'),
t AS (SELECT page_id, url, trim(raw) AS title FROM tt)
"""


def _tsv(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '\\\\', '\\\\\\\\'), chr(9), '\\\\t'), chr(10), '\\\\n'), chr(13), '\\\\r')"


ORACLES.update({
    "page_search": _TITLE + """
SELECT page_id, url, title FROM t WHERE contains(lower(title), 'example.org') OR contains(lower(url), 'example.org')""",
    "link_tsv_lines": _ANCHORS + f""", m AS (SELECT *, {attr('attrs', 'href')} AS href, trim({dec('txt')}) AS text FROM a)
SELECT page_id, CAST(i - 1 AS INTEGER) AS original_index,
       {_tsv('text')} || chr(9) || {_tsv('href')} || chr(9) || '' || chr(9) || '' AS line FROM m""",
    "link_view_counts": _ANCHORS + f""", m AS (SELECT *, {attr('attrs', 'href')} AS href, trim({dec('txt')}) AS text FROM a)
SELECT page_id,
       CAST(count(*) FILTER (WHERE NOT {_empty('text', 'href')} AND (contains(lower(text), 'th') OR contains(lower(href), 'th'))) AS BIGINT) AS filtered_rows,
       CAST(0 AS BIGINT) AS selected_rows
FROM m GROUP BY page_id""",
    "title_display": _TITLE + """
SELECT page_id,
       CASE WHEN length(regexp_replace(title, '[\\r\\n]+', ' ', 'g')) > 20
            THEN substr(regexp_replace(title, '[\\r\\n]+', ' ', 'g'), 1, 20) || '...'
            ELSE regexp_replace(title, '[\\r\\n]+', ' ', 'g') END AS short_title,
       CASE WHEN title = '' THEN 'Data Export' ELSE title END || ' - 2024-01-31' AS export_name
FROM t""",
    "heading_details": f"""
SELECT page_id, 'h1' AS tag, '/html/body/article/h1' AS xpath,
       {dec("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS text
FROM pages WHERE html LIKE '%<h1>%'""",
})


# ---- committed versions, stored results, changelog state, consent --------------------------
_SCRAPES = """
s AS MATERIALIZED (SELECT user_id AS tab_id, event_id AS seq, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type = 'error' AS closed,
  CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS slice FROM events)
"""
ORACLES["results_feed"] = f"""
WITH {_SCRAPES},
v AS (SELECT n AS version, tab_id, max(seq) AS seq FROM s, range(1, 4) t(n) WHERE slice <= n GROUP BY ALL),
x AS (SELECT v.*, k % 3 AS n_rows FROM v JOIN s USING (tab_id, seq))
SELECT coalesce(a.version, b.version + 1)::INTEGER AS version, coalesce(a.tab_id, b.tab_id) AS tab_id,
  CASE WHEN b.tab_id IS NULL THEN 'insert' WHEN a.tab_id IS NULL THEN 'delete' ELSE 'update' END AS change,
  b.seq AS before_seq, a.seq AS after_seq, b.n_rows::INTEGER AS before_rows, a.n_rows::INTEGER AS after_rows
FROM x a FULL JOIN (SELECT * FROM x WHERE version < 3) b ON a.tab_id = b.tab_id AND a.version = b.version + 1
WHERE a.seq IS DISTINCT FROM b.seq
"""
ORACLES["stored_results"] = f"""
WITH {_SCRAPES},
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY tab_id ORDER BY seq DESC) = 1),
j AS (SELECT l.*, c_custkey, c_name FROM l JOIN customer ON c_custkey = tab_id WHERE c_mktsegment = 'BUILDING' AND NOT closed AND k % 3 > 0)
SELECT tab_id, CASE WHEN c_custkey % 3 = 2 THEN 'https://t/' || c_custkey ELSE 'Unknown URL' END AS tab_url, c_name AS tab_title,
  CASE WHEN event_type = 'signup' THEN '' ELSE '//' || event_type END AS main_selector, CASE WHEN event_type = 'signup' THEN 'Text' ELSE 'Type,K' END AS columns,
  unnest(range(k % 3))::INTEGER AS original_index, event_type || ',' || k AS cells FROM j
"""
ORACLES["session_changelog"] = """
WITH e AS (SELECT user_id AS tab_id, event_id AS seq, ts, event_type, props, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_id % 50 = 7 AS withheld FROM events),
m AS (SELECT max(ts) - INTERVAL 7 DAY AS mark FROM e WHERE NOT withheld),
u AS MATERIALIZED (SELECT e.* FROM e, m WHERE NOT withheld OR ts >= mark),
f AS (SELECT tab_id, seq, '__removed__' AS field, NULL AS value_json FROM u WHERE event_type = 'error'
  UNION ALL SELECT tab_id, seq, event_type, props FROM u WHERE event_type NOT IN ('error', 'signup')
  UNION ALL SELECT tab_id, seq, 'currentScrapeConfig.mainSelector', '"//a[' || k || ']"' FROM u WHERE event_type = 'signup'
  UNION ALL SELECT tab_id, seq, 'currentScrapeConfig.columns', '[' || k || ']' FROM u WHERE event_type = 'signup' AND k % 2 = 0),
r AS (SELECT tab_id, max(seq) AS gone FROM f WHERE field = '__removed__' GROUP BY tab_id)
SELECT f.tab_id, field, value_json, seq FROM f LEFT JOIN r USING (tab_id) WHERE field <> '__removed__' AND (gone IS NULL OR seq > gone)
QUALIFY row_number() OVER (PARTITION BY f.tab_id, field ORDER BY seq DESC) = 1
"""
ORACLES["consent_flow"] = """
WITH a AS (SELECT *, event_id % 3 = 0 AND event_type IN ('signup', 'error') OR event_id % 4 = 0 AND event_type = 'purchase' AS is_consent FROM events),
c AS MATERIALIZED (SELECT user_id, event_id AS id, ts, CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END AS consent FROM a WHERE is_consent),
e AS MATERIALIZED (SELECT user_id, event_id, ts FROM a WHERE NOT is_consent),
s AS (SELECT e.event_id, max(struct_pack(ts := c.ts, id := c.id, consent := c.consent)) AS last
  FROM e LEFT JOIN c ON c.user_id = e.user_id AND c.ts <= e.ts GROUP BY e.event_id),
n AS (SELECT e.event_id, min(struct_pack(ts := c.ts, id := c.id, consent := c.consent)) AS next FROM e JOIN c ON c.user_id = e.user_id AND c.ts > e.ts AND c.consent IS NOT NULL GROUP BY e.event_id),
j AS (SELECT e.*, last.consent AS state, next.ts AS next_ts, next.consent AS next_consent, (SELECT max(ts) FROM events) AS upto FROM e LEFT JOIN s USING (event_id) LEFT JOIN n USING (event_id)),
q AS (SELECT *, CASE WHEN state IS NULL THEN row_number() OVER (PARTITION BY user_id, state IS NULL, next_ts ORDER BY ts DESC, event_id DESC) END AS place FROM j)
SELECT event_id, user_id,
  CASE WHEN state THEN 'deliver' WHEN NOT state THEN 'drop' WHEN place > 3 OR coalesce(next_ts, upto) - ts > INTERVAL 2 DAY THEN 'evicted'
    WHEN next_consent IS NULL THEN 'queue' WHEN next_consent THEN 'flush' ELSE 'clear' END AS route,
  route = 'flush' AS buffered, CASE WHEN route IN ('flush', 'clear') THEN next_ts END AS decided_at FROM q
"""


# ---- inference over all groups, far pages, numbers, the preset library ----------------------
ORACLES["page_groups"] = """
WITH x AS (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS lis, len(regexp_extract_all(html, '<p>')) AS ps FROM pages),
g AS (SELECT page_id, '/html/body/nav/ul/li' AS sel, 'li' AS tag, lis AS n FROM x UNION ALL SELECT page_id, '/html/body/article/p', 'p', ps FROM x)
SELECT page_id, sel || '[1]' AS path, tag, n::INTEGER AS n, tag AS guess_tag, sel AS main_selector, n::BIGINT AS matches FROM g WHERE n > 1
"""
ORACLES["part_page_groups"] = """
WITH p AS (SELECT p_partkey // 50 AS page_id, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT page_id, n, unnest(range(1, n + 1)) AS row FROM p)
SELECT page_id, '/html/body/table/thead/tr/th[1]' AS path, 'th' AS tag, 5::INTEGER AS n, 'th' AS guess_tag, '/html/body/table/thead/tr/th' AS main_selector, 5::BIGINT AS matches FROM p
UNION ALL SELECT page_id, '/html/body/table/tbody/tr[1]', 'tr', n::INTEGER, 'tr', '/html/body/table/tbody/tr', n FROM p WHERE n > 1
UNION ALL SELECT page_id, '/html/body/table/tbody/tr' || CASE WHEN n > 1 THEN '[' || row || ']' ELSE '' END || '/td[1]', 'td', 5, CASE WHEN n > 1 THEN 'tr' ELSE 'td' END,
  '/html/body/table/tbody/tr' || CASE WHEN n > 1 THEN '' ELSE '/td' END, CASE WHEN n > 1 THEN n ELSE 5 END FROM r
"""
ORACLES["link_candidates"] = """
WITH x AS (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages), l AS (SELECT page_id, n, unnest(range(1, n + 1)) AS link FROM x),
c AS (SELECT page_id, n, link, unnest(['/html/body/nav/ul/li/a', '/html/body/nav/ul/li', '/html/body/nav/ul', '/html/body/nav']) AS xpath, unnest(range(4)) AS level FROM l)
SELECT page_id, link::INTEGER AS link, 0::INTEGER AS default_index, level::INTEGER AS level, xpath, (CASE WHEN level < 2 THEN n ELSE 1 END)::BIGINT AS matches FROM c
"""
ORACLES["orders_far_pages"] = """
WITH r AS (SELECT *, row_number() OVER (ORDER BY lower(o_orderpriority), o_totalprice DESC, o_orderkey) AS display_index, count(*) OVER () AS n FROM orders),
p AS (SELECT unnest([0, 49, 300, 10000000]) AS page)
SELECT page::INTEGER AS page, display_index, o_orderkey, o_orderpriority, o_totalprice, o_orderstatus FROM r, p
WHERE (display_index - 1) // 20 = least(page, (n - 1) // 20)
"""
ORACLES["events_numbered"] = "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS queue_pos FROM events"
# The system presets' ids and names, in their order.
_SYSTEM_NAMES = [(pid, name) for pid, (name, _) in SYSTEM_PRESETS.items()]
_LIBRARY = """
l AS (SELECT 'u' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name ELSE p_name END AS name, p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS added,
  '//p[' || p_partkey || ']' AS main_selector FROM part WHERE (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AND p_partkey % 5 <> 0)
"""
ORACLES["preset_library"] = f"""
WITH {_LIBRARY},
s AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{p}', '{n}')" for i, (p, n) in enumerate(_SYSTEM_NAMES))}) t(seq, id, name) WHERE id NOT IN ('sys-images', 'sys-forms'))
SELECT 0::INTEGER AS origin_rank, added::BIGINT AS added, seq::BIGINT AS seq, id, name, main_selector FROM l
UNION ALL SELECT 1, 0, seq, id, name, NULL FROM s
"""
ORACLES["preset_search"] = f"""
WITH {_LIBRARY},
u AS (SELECT '//p[' || user_id || ']' AS selector, max(ts) AS last_used FROM events WHERE user_id < 40 GROUP BY 1),
r AS (SELECT selector, row_number() OVER (ORDER BY last_used DESC, selector) AS rank FROM u)
SELECT 'recent' AS kind, selector AS label, selector, rank::BIGINT AS rank FROM r WHERE rank <= 30 AND contains(selector, '2]') AND selector NOT IN (SELECT main_selector FROM l)
UNION ALL SELECT 'preset', name, main_selector, seq FROM l WHERE contains(lower(name), '2]') OR contains(main_selector, '2]')
"""
ORACLES["preset_imports"] = """
SELECT p_partkey AS file,
  [NULL, NULL, 'Invalid preset at index 1: missing or invalid fields (id, name, config.mainSelector, config.columns, createdAt).',
   'Unsupported preset file version. Expected version between 1 and 1.', 'Unsupported preset file version. Expected version between 1 and 1.',
   'Invalid preset file: missing "version" field.', 'Invalid preset file: missing "presets" field.', 'Invalid preset file: "presets" must be an array.',
   'Invalid JSON file.', 'Invalid preset file: expected an object.'][p_partkey % 10 + 1] AS error,
  (p_partkey % 10 < 2)::BIGINT AS imported, (p_partkey % 10 = 1)::BIGINT AS skipped_system, CASE WHEN p_partkey % 10 < 2 THEN p_partkey::VARCHAR ELSE '' END AS ids
FROM part
"""


# ---- rows whose limits and rules bind on the data ------------------------------------------
ORACLES["heading_html"] = "SELECT page_id, regexp_extract(html, '(?s)<h1>.*?</h1>') AS html FROM pages WHERE contains(html, '<h1>')"
ORACLES["event_queue_bound"] = """
SELECT event_id, user_id, event_type AS name, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20
"""
ORACLES["recent_types_bound"] = """
WITH l AS (SELECT user_id, event_type AS selector, max(ts) AS last_used FROM events WHERE event_type <> 'click' GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_used DESC, selector)::INTEGER AS rank FROM l QUALIFY rank <= 2
"""
ORACLES["url_rules_mixed"] = r"""
WITH r(n, scrapable, rejection, is_http, context) AS (VALUES
  (0, true, NULL, true, 'unknown'), (1, true, NULL, true, 'unknown'), (2, false, 'chrome://', false, 'unknown'), (3, false, 'about:', false, 'unknown'),
  (4, false, 'chrome-extension://', false, 'sidepanel'), (5, false, 'https://chromewebstore.google.com/', true, 'unknown'), (6, false, 'file://', false, 'unknown'),
  (7, false, 'ftp://', false, 'unknown'), (8, false, 'ftps://', false, 'unknown'), (9, false, 'ws://', false, 'unknown'), (10, false, 'wss://', false, 'unknown'),
  (11, false, 'blob://', false, 'unknown'), (12, false, 'data://', false, 'unknown'), (13, false, '^https://chrome\.google\.com/(.+/)?webstore/', true, 'unknown'),
  (14, false, '^https://chrome\.google\.com/(.+/)?webstore/', true, 'unknown'), (15, true, NULL, true, 'unknown'),
  (16, false, NULL, false, 'unknown'), (17, true, NULL, true, 'unknown'), (18, false, 'chrome-extension://', false, 'options'), (19, false, 'chrome-extension://', false, 'full_data_view'), (20, true, NULL, true, 'unknown'))
SELECT c_custkey AS id, scrapable, rejection, is_http, context FROM customer LEFT JOIN r ON n = c_custkey % 21
"""
ORACLES["events_cleaned"] = """
WITH e AS (SELECT event_id, event_id % 7 < 2 AS dead, json_extract_string(props, '$.k') AS k FROM events),
m AS (SELECT event_id, dead, list_concat(['k=' || k], CASE WHEN event_id % 2 = 1 THEN ['referrer=r'] ELSE [] END,
  CASE WHEN event_id % 3 = 0 THEN (CASE WHEN event_id % 9 = 0 THEN ['preset_id=sys-images', 'preset_name=null'] ELSE ['preset_id=null', 'preset_name=null'] END) ELSE ['x=u1'] END,
  CASE WHEN event_id % 3 = 1 THEN ['preset_id=null', 'preset_name=null'] ELSE ['y=mine'] END) AS c FROM e)
SELECT event_id, dead, array_to_string(list_sort(c), ';') AS props FROM m
"""
_NAV = """
x AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS u, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages),
l AS MATERIALIZED (SELECT page_id, i::INTEGER AS original_index, trim(t[i + 1]) AS anchor_text, u[i + 1] AS url, len(u) AS n FROM (SELECT *, unnest(range(len(u))) AS i FROM x)),
k AS (SELECT * FROM l WHERE page_id % 5 = 0 OR page_id % 2 = 0 AND original_index < 2)
"""
ORACLES["links_exported"] = f"""
WITH {_NAV},
c AS (SELECT page_id, count(*) AS selected FROM k GROUP BY page_id)
SELECT page_id, original_index, anchor_text, url FROM l LEFT JOIN c USING (page_id)
WHERE selected IS NULL OR selected = n OR page_id % 2 = 0 AND original_index < 2
"""
ORACLES["links_selected"] = f"""
WITH {_NAV}
SELECT page_id, count(*) FILTER (hit) AS filtered_rows, count(*) FILTER (hit AND (page_id % 5 = 0 OR page_id % 2 = 0 AND original_index < 2)) AS selected_rows
FROM (SELECT *, contains(lower(anchor_text), 'th') OR contains(lower(url), 'th') AS hit FROM l) GROUP BY page_id
"""
ORACLES["links_view"] = f"""
WITH {_NAV},
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY lower(anchor_text) DESC, original_index) AS display_index, count(*) OVER (PARTITION BY page_id) AS shown
  FROM l WHERE contains(url, '/') AND (contains(lower(anchor_text), 'e') OR contains(lower(url), 'e')))
SELECT page_id, original_index, anchor_text, display_index::INTEGER AS display_index FROM f WHERE (display_index - 1) // 2 = least(1, (shown + 1) // 2 - 1)
"""
ORACLES["links_csv"] = f"""
WITH {_NAV}
SELECT '"' || page_id || '","' || original_index || '","' || replace(anchor_text || CASE WHEN page_id % 3 = 0 THEN ' "q", x' ELSE '' END, '"', '""') || '","' || replace(url, '"', '""') || '"' AS line FROM l
"""
ORACLES["links_sheet"] = f"""
WITH {_NAV}
SELECT DISTINCT page_id, 0::INTEGER AS row_number, '["Text","Url"]' AS values_json FROM l
UNION ALL SELECT page_id, original_index + 1, to_json([anchor_text, url])::VARCHAR FROM l
"""


# ---- column templates by rule ----------------------------------------------------------------
ORACLES["element_templates"] = """
WITH t(tag, columns, on_pages, on_customer, on_part) AS (VALUES
  ('html', 'Text=.', 1, 1, 1), ('head', 'Text=.', 1, 1, 1), ('meta', 'Text=.', 1, 1, 1), ('title', 'Text=.', 1, 1, 1), ('body', 'Text=.', 1, 1, 1),
  ('style', 'Text=.', 1, 0, 0), ('script', 'Text=.', 1, 0, 0), ('div', 'Text=.', 1, 0, 0), ('p', 'Text=.', 1, 0, 0), ('b', 'Text=.', 2, 0, 0), ('br', 'Text=.', 3, 0, 0),
  ('nav', 'Text=.|ARIA Label=@aria-label|Links=a/@href', 1, 1, 0), ('ul', 'List Item=li', 1, 0, 0), ('li', 'List Item=.', 1, 0, 0),
  ('a', 'Anchor text=.|URL=@href|Rel=@rel|Target=@target', 1, 1, 1), ('article', 'Text=.|ARIA Label=@aria-label|Headline=h1', 1, 0, 0),
  ('h1', 'Heading=.|ARIA Label=@aria-label', 1, 0, 0), ('h2', 'Heading=.|ARIA Label=@aria-label', 0, 0, 1), ('footer', 'Text=.|ARIA Label=@aria-label', 1, 0, 0),
  ('figure', 'Image Source=.//img/@src|Image Alt=.//img/@alt|Image Title=.//img/@title|Caption=figcaption|Code=pre|code|Blockquote=blockquote|Paragraph=p|Figure Text=.', 0, 1, 0),
  ('img', 'Alt Text=@alt|Source=@src|Title=@title', 0, 1, 0), ('form', 'Action=@action|Method=@method|Input Names=.//input/@name|Input Types=.//input/@type', 0, 1, 0),
  ('input', 'Value=@value|Placeholder=@placeholder|Name=@name|Type=@type', 0, 1, 0), ('button', 'Text=.|Value=@value|ARIA Label=@aria-label|Disabled=@disabled', 0, 1, 0),
  ('table', 'Key=.//tr/td[1]|Name=.//tr/td[2]|Brand=.//tr/td[3]|Size=.//tr/td[4]|Price=.//tr/td[5]|Col Count=count(col)', 0, 0, 1),
  ('thead', 'Text=.', 0, 0, 1), ('tbody', 'Text=.', 0, 0, 1), ('th', 'Text=.', 0, 0, 1), ('td', 'Text=.', 0, 0, 1),
  ('tr', 'Key=*[1]|Name=*[2]|Brand=*[3]|Size=*[4]|Price=*[5]', 0, 0, 1))
SELECT 'pages' AS kind, page_id, tag, columns FROM pages, t WHERE on_pages = 1 OR on_pages = 2 AND contains(html, '<b>') OR on_pages = 3 AND contains(html, '<br>')
UNION ALL SELECT 'customer', c_custkey, tag, columns FROM customer, t WHERE on_customer = 1
UNION ALL SELECT 'part', page_id, tag, columns FROM (SELECT DISTINCT p_partkey // 50 AS page_id FROM part), t WHERE on_part = 1
"""

ORACLES["config_edits"] = f"""
WITH {_LIBRARY},
c AS (SELECT id, main_selector, CASE seq % 5 WHEN 1 THEN '{{"name":"Brand","selector":"."}},{{"name":"New","selector":"."}}' WHEN 2 THEN ''
  WHEN 3 THEN '{{"name":"' || name || '","selector":"."}}' ELSE '{{"name":"Brand","selector":"@d' || seq || '"}}' END AS columns, CASE seq % 5 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS n FROM l)
SELECT id, '{{"mainSelector":"' || main_selector || '","columns":[' || columns || ']}}' AS json, n::INTEGER AS n_columns, main_selector FROM c
"""
ORACLES["own_recent_selectors"] = f"""
WITH {_LIBRARY},
u AS (SELECT ascii(event_type)::BIGINT AS user_id, '//p[' || user_id || ']' AS selector, max(ts) AS last_used FROM events GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_used DESC, selector)::INTEGER AS rank FROM u WHERE selector NOT IN (SELECT main_selector FROM l) QUALIFY rank <= 5
"""
