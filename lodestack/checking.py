"""DuckDB SQL for rules that fold over lists: splitting, tails, overlaps, repeated ends. The queries' SQL is put together from these."""

from __future__ import annotations

SPACE = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{85}\\x0B\\x1C-\\x1F]+"
LAST, LEAST_TAIL, LEAST = 200, 20, 20


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}', ''), '{SPACE}$', '')"


def _full(items: str) -> str:
    """Stripped entries that aren't empty."""
    return f"list_filter(list_transform({items}, lambda x: {strip('x')}), lambda x: x <> '')"


def _after(marks: str, x: str) -> str:
    return f"string_split(regexp_replace({x}, '([{marks}])', '\\1' || chr(1), 'g'), chr(1))"


def tails(parts: str, glue: str) -> str:
    """Parts shorter than the least length glued to the one before."""
    before = f"regexp_replace(s[len(s)], '{SPACE}$', '')" if glue != "''" else "s[len(s)]"
    return f"list_reduce({_full(parts)}, lambda s, p: CASE WHEN len(s) > 0 AND length(p) < {LEAST} THEN list_append(s[:len(s) - 1], {before} || {glue} || p) ELSE list_append(s, p) END, []::VARCHAR[])"


def apart(parts: str) -> str:
    """Each part without the beginning that repeats the end of the one before it."""
    longest = f"least(length(s[len(s)]), length(p), {LAST}, greatest({LEAST}, length(p) // 3))"
    same = f"coalesce(list_max(list_filter(range({LEAST}, {longest} + 1), lambda n: ends_with(s[len(s)], substr(p, 1, n::INT)))), 0)"
    cut = strip(f"substr(p, {same}::INT + 1)")
    return f"list_reduce({parts}, lambda s, p: CASE WHEN len(s) = 0 THEN [p] WHEN {cut} <> '' THEN list_append(s, {cut}) ELSE s END, []::VARCHAR[])"


def pieces(name: str, overlap: int) -> str:
    """CTEs from ``{name}_in`` (key, text, size) to ``{name}_out`` (key, parts): the coarsest units that fit, windows where none do."""
    units = {0: f"{_full('string_split(t, chr(10) || chr(10))')}", 1: f"{_full(_after('。！？；.!?;', 't'))}", 2: f"list_filter({_after('，、；：:' + chr(92) + 'n', 't')}, lambda x: {strip('x')} <> '')"}
    glue = "CASE WHEN lv = 0 THEN chr(10) || chr(10) ELSE '' END"
    joined = f"CASE WHEN s.held = '' THEN u ELSE s.held || {glue} || u END"
    kept = "CASE WHEN s.held = '' THEN s.done ELSE list_append(s.done, {'t': s.held, 'l': 0}) END"
    step = f"""CASE WHEN length({joined}) <= size THEN {{'held': {joined}, 'done': s.done}}
WHEN length(u) <= size THEN {{'held': u, 'done': {kept}}} ELSE {{'held': '', 'done': list_append({kept}, {{'t': u, 'l': lv + 1}})}} END"""
    out = [f"{name}_0 AS (SELECT key, []::BIGINT[] AS path, {strip('text')} AS t, 0 AS l, size FROM {name}_in)"]
    for k in range(3):
        out.append(f"{name}_u{k} AS (SELECT *, CASE WHEN l <= 0 AND len({units[0]}) > 1 THEN 0 WHEN l <= 1 AND len({units[1]}) > 1 THEN 1 WHEN l <= 2 AND len({units[2]}) > 1 THEN 2 ELSE 3 END AS lv FROM {name}_{k} WHERE length(t) > size)")
        out.append(f"{name}_p{k} AS (SELECT key, path, size, CASE WHEN lv = 3 THEN {{'held': '', 'done': [{{'t': t, 'l': 3}}]}} ELSE list_reduce({_full(f'CASE lv WHEN 0 THEN {units[0]} WHEN 1 THEN {units[1]} ELSE {units[2]} END')}, lambda s, u: {step}, {{'held': '', 'done': []::STRUCT(t VARCHAR, l INT)[]}}) END AS s, lv FROM {name}_u{k})")
        out.append(f"{name}_l{k} AS (SELECT key, path, size, {kept} AS done FROM {name}_p{k})")
        out.append(f"{name}_{k + 1} AS (SELECT key, list_append(path, i) AS path, done[i].t AS t, done[i].l AS l, size FROM (SELECT *, unnest(range(1, len(done) + 1)) AS i FROM {name}_l{k}) UNION ALL SELECT key, path, t, l, size FROM {name}_{k} WHERE length(t) <= size)")
    back = f"least({overlap}, greatest(0, size - 1))"
    low, width = "(s.at + greatest(1, size // 2))", "(size - greatest(1, size // 2))"
    window = f"substr(t, {low}::INT + 1, {width}::INT)"
    last = lambda marks: f"length(regexp_extract({window}, '(?s)^(.*[{marks}])', 1))"
    end = f"CASE WHEN {last(chr(92) + 'n。！？；.!?;')} > 0 THEN {low} + {last(chr(92) + 'n。！？；.!?;')} WHEN {last('，、：:')} > 0 THEN {low} + {last('，、：:')} ELSE s.at + size END"
    moved = f"CASE WHEN {back} > 0 THEN greatest(s.at + 1, ({end}) - {back}) ELSE {end} END"
    walk = f"""list_reduce(range(length(t) // greatest(1, size // 2 + 1 - {back}) + 1), lambda s, i: CASE WHEN s.at + size < length(t)
THEN {{'at': ({moved})::BIGINT, 'done': list_append(s.done, {strip(f'substr(t, s.at::INT + 1, (({end}) - s.at)::INT)')})}} ELSE s END, {{'at': 0::BIGINT, 'done': []::VARCHAR[]}})"""
    out.append(f"{name}_w AS (SELECT key, path, t, {walk} AS s FROM {name}_3 WHERE length(t) > size)")
    cut = tails(f"list_append(s.done, {strip('substr(t, s.at::INT + 1)')})", "''")
    out.append(f"{name}_f AS (SELECT key, path, [t] AS parts FROM {name}_3 WHERE length(t) <= size AND t <> '' UNION ALL SELECT key, path, {cut} FROM {name}_w)")
    out.append(f"{name}_out AS (SELECT key, flatten(list(parts ORDER BY path)) AS parts FROM {name}_f GROUP BY key)")
    return ",\n".join(out)


def tidied(parts: str) -> str:
    glue = "chr(10)"
    return tails(apart(tails(parts, glue)), glue)


def sections(name: str) -> str:
    """CTEs from ``{name}_s`` (key, header, body) to ``{name}_parts`` (key, parts, cut): sections whole up to the soft maximum, else cut."""
    head, body = strip("coalesce(header, '')"), strip("coalesce(body, '')")
    return f"""{name}_h AS (SELECT key, {head} AS h, {body} AS b FROM {name}_s),
{name}_in AS (SELECT key, b AS text, CASE WHEN h = '' THEN 500 ELSE greatest(32, 1000 - length(h) - 2) END AS size FROM {name}_h WHERE b <> '' AND (h = '' OR length(h) + 2 + length(b) > 1000)),
{pieces(name, 20)},
{name}_all AS (SELECT key, CASE WHEN h <> '' AND b = '' THEN [h] WHEN h <> '' AND length(h) + 2 + length(b) <= 1000 THEN [h || chr(10) || chr(10) || b] WHEN h <> '' THEN list_transform(o.parts, lambda p: h || chr(10) || chr(10) || p) ELSE coalesce(o.parts, []) END AS parts FROM {name}_h LEFT JOIN {name}_out o USING (key)),
{name}_parts AS (SELECT key, {tidied('parts')} AS parts, len(parts) > 1 AS cut FROM {name}_all)"""


RECURSIVE = f"""WITH r_in AS (SELECT doc_id AS key, coalesce(text, '') AS text, 500 AS size FROM documents),
{pieces('r', 20)}
SELECT key AS doc_id, unnest(range(len(parts)))::INT AS pos, unnest(parts) AS piece FROM r_out"""

SECTIONS = f"""WITH r_s AS (SELECT doc_id AS key, source AS header, text AS body FROM documents),
{sections('r')}
SELECT key AS doc_id, cut, unnest(range(len(parts)))::INT AS pos, unnest(parts) AS piece FROM r_parts"""


def chunks(islands: str, paths: str) -> str:
    """Chunks of documents: of even ids from their sections, of odd ids from the whole text."""
    return f"""WITH path AS ({paths}),
s AS (SELECT doc_id, section::BIGINT AS section, string_agg(text, chr(10) || chr(10) ORDER BY line) FILTER (is_title) AS header, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY line) FILTER (NOT is_title), '') AS body, min(line) + 1 AS page_num, max(line) + 1 AS page_end
FROM {islands} WHERE doc_id::BIGINT % 2 = 0 GROUP BY doc_id, section),
r_s AS (SELECT {{'d': doc_id, 's': section}} AS key, header, body FROM s),
{sections('r')},
bare AS (SELECT doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT doc_id FROM s)),
w_in AS (SELECT doc_id AS key, text, 500 AS size FROM bare),
{pieces('w', 20)},
p AS (SELECT key.d AS doc_id, key.s AS section, unnest(range(len(parts))) AS pos, unnest(parts) AS chunk_text, 'paragraph' AS chunk_kind FROM r_parts
UNION ALL SELECT key, 1, unnest(range(len({tidied('parts')}))), unnest({tidied('parts')}), 'full_text_fallback' FROM w_out),
q AS (SELECT doc_id, section, pos, chunk_kind, {strip('chunk_text')} AS chunk_text FROM p)
SELECT q.doc_id, (row_number() OVER (PARTITION BY q.doc_id ORDER BY q.section, pos) - 1)::INT AS chunk_index, chunk_kind, chunk_text,
       CASE WHEN chunk_kind = 'paragraph' THEN coalesce(nullif(string_split(path.path, ' > ')[-1], ''), string_split(s.header, chr(10) || chr(10))[-1]) END AS section_title, page_num, page_end
FROM q LEFT JOIN s ON chunk_kind = 'paragraph' AND s.doc_id = q.doc_id AND s.section = q.section LEFT JOIN path ON chunk_kind = 'paragraph' AND path.doc_id = q.doc_id AND path.section = q.section WHERE chunk_text <> ''"""


CJK = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}]"


def _count(pattern: str, x: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def fragment(x: str) -> str:
    return f"(length({x}) <= 1 OR regexp_matches({x}, '^[^\\pL\\pM\\p{{Nd}}\\p{{Nl}}]+$') OR (length({x}) <= 3 AND NOT regexp_matches({x}, '{CJK}') AND NOT regexp_matches({x}, '[0-9A-Za-z]')))"


def garbled(x: str) -> str:
    latin = _count("[A-Za-z]", x)
    return f"(length({x}) <= 80 AND NOT regexp_matches({x}, '{CJK}') AND ({latin} >= 8 OR (length({x}) <= 40 AND {latin} >= 6 AND regexp_matches({x}, '[A-Z]{{3,}}/[A-Z]{{2,}}'))))"


def contents_or_watermark(x: str) -> str:
    toc = f"length({x}) < 80 AND (regexp_matches({x}, '^.{{0,40}}[.·…\\s]{{3,}}.{{0,20}}[0-9]+\\s*$') OR ((contains({x}, '…') OR regexp_matches({x}, '\\.{{4,}}')) AND regexp_matches({x}, '[0-9]+\\s*$')))"
    return f"({toc} OR regexp_matches({x}, '(?i)^\\(?\\s*注\\s*[:：].*AI\\s*生成|文档部分内容可能由\\s*AI\\s*生成|本(文档|内容).{{0,20}}由\\s*AI\\s*(生成|撰写)'))"


LIST_LINE = "'^([•·●○◆▪►➤]|[-–—]\\s+|[0-9]+[.、．]|[（(][0-9]+[）)]|[一二三四五六七八九十]+[、．.])'"


def poor_table(html: str) -> str:
    text = f"regexp_replace({html}, '<[^>]+>', ' ', 'g')"
    rows, cjk, latin = _count("(?i)<tr\\b", html), _count(CJK, text), _count("[A-Za-z]", text)
    return f"(trim(regexp_replace({text}, '{SPACE}', ' ', 'g')) = '' OR ({rows} >= 2 AND {cjk} < 4 AND {latin} >= 20 AND {latin} > 5 * {cjk}) OR ({rows} >= 3 AND {cjk} = 0 AND {latin} >= 15))"


REPEATS = "length(s.last) > 0 AND length(y.text) > 0 AND ends_with(s.last, y.text) AND (length(y.text) = length(s.last) OR length(y.text) <= greatest(length(s.last) // 2, 8) OR (length(y.text) < 40 AND length(y.text) < 0.6 * length(s.last)))"


def folded(nodes: str) -> str:
    """Whether each of a list of nodes (text, kind, why) repeats the end of the last text kept before it."""
    copy = f"y.why IS NULL AND y.kind <> 'table' AND {REPEATS}"
    step = f"{{'last': CASE WHEN y.why IS NOT NULL OR ({copy}) THEN s.last WHEN y.kind = 'table' THEN '' ELSE y.text END, 'out': list_append(s.out, coalesce({copy}, false))}}"
    return f"list_reduce({nodes}, lambda s, y: {step}, {{'last': '', 'out': []::BOOLEAN[]}}).out"


SUFFIXES = f"""WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {{'text': x, 'kind': 'paragraph', 'why': NULL::VARCHAR}}) AS n FROM documents)
SELECT doc_id, unnest(range(len(n)))::INT AS line, unnest({folded('n')}) AS dropped FROM d"""


def cleaned(nodes: str) -> str:
    """CTEs that take ``nodes`` (doc_id, pos, sub, kind, text, page; text null for what isn't a node) through the text rules to ``c3`` with why. NFKC is left
    out, as SQL lacks it: the tables hold nothing that it changes."""
    joined = f"regexp_replace(regexp_replace(trim(regexp_replace(text, '{SPACE}', ' ', 'g')), '({CJK}) ', '\\1' || chr(1), 'g'), chr(1) || '({CJK})', '\\1', 'g')"
    tidy = f"regexp_replace(replace({joined}, chr(1), ' '), '^([0-9]+(\\.[0-9]+)*\\.?)([^\\s0-9.])', CASE WHEN kind = 'title' THEN '\\1 \\3' ELSE '\\0' END)"
    return f"""c0 AS (SELECT doc_id, pos, sub, kind, page, CASE WHEN kind = 'table' THEN text ELSE {tidy} END AS text, text IS NULL AS other FROM {nodes}),
c1 AS (SELECT *, CASE WHEN other THEN 'other' WHEN kind = 'table' THEN NULL WHEN text = '' THEN 'element' WHEN {fragment('text')} THEN 'fragment' WHEN {garbled('text')} THEN 'garbled' END AS why FROM c0),
g AS (SELECT doc_id, list({{'pos': pos, 'sub': sub, 'kind': kind, 'page': page, 'text': text, 'why': why}} ORDER BY pos, sub) AS n FROM c1 GROUP BY doc_id),
f AS (SELECT doc_id, unnest(n) AS n, unnest({folded('n')}) AS copy FROM g),
c2 AS (SELECT doc_id, n.pos AS pos, n.sub AS sub, n.kind AS kind, n.page AS page, n.text AS text, coalesce(n.why, CASE WHEN copy THEN 'fragment' END) AS why FROM f),
k AS (SELECT *, count(*) FILTER (why IS NULL AND kind <> 'table' AND length(text) <= 30) OVER (PARTITION BY doc_id, text) AS copies FROM c2),
c3 AS (SELECT doc_id, pos, sub, page, text, CASE WHEN kind = 'paragraph' AND regexp_matches(text, {LIST_LINE}) THEN 'list_item' ELSE kind END AS kind,
coalesce(why, CASE WHEN kind = 'table' THEN CASE WHEN {poor_table('text')} THEN 'table' END WHEN length(text) <= 30 AND copies >= 2 THEN 'element' WHEN {contents_or_watermark('text')} THEN 'element' END) AS why FROM k)"""


LINE_NODES = f"(SELECT doc_id::VARCHAR AS doc_id, line AS pos, 0 AS sub, 'paragraph' AS kind, nullif({strip('text')}, '') AS text, line AS page FROM (SELECT doc_id, unnest(range(len(l)))::INT AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"
LINE_BLOCKS = f"""WITH {cleaned(LINE_NODES)}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1)::INT AS "order", kind AS type, text, page::INT AS page_idx FROM c3 WHERE why IS NULL"""


def reported(blocks: str) -> str:
    """Report rows from ``c3`` and ``blocks`` (doc_id, place, kind, part, n_merged)."""
    n = lambda w, name: f"(count(*) FILTER ({w}))::INT AS {name}"
    return f"""d AS (SELECT doc_id, coalesce(max(page) + 1, 1)::INT AS page_count, {n("why = 'other'", 'discarded_other')}, {n('why IS NOT NULL', 'dropped_elements')}, {n("why = 'fragment'", 'dropped_fragments')}, {n("why = 'garbled'", 'dropped_garbled')}, {n("why = 'table'", 'table_quality_failed')} FROM c3 GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY place) AS t, {n("kind = 'title'", 'title_count')}, {n("kind = 'paragraph'", 'paragraph_count')}, {n("kind = 'list_item'", 'list_item_count')}, {n("kind = 'table'", 'table_count')}, sum(n_merged)::INT AS table_merged_count FROM {blocks} GROUP BY doc_id)
SELECT d.*, length(coalesce(t, ''))::INT AS char_count, sha256(coalesce(t, '')) AS content_hash, coalesce(title_count, 0) AS title_count, coalesce(paragraph_count, 0) AS paragraph_count, coalesce(list_item_count, 0) AS list_item_count, coalesce(table_count, 0) AS table_count, coalesce(table_merged_count, 0) AS table_merged_count FROM d LEFT JOIN b USING (doc_id)"""


LINE_REPORT = f"""WITH {cleaned(LINE_NODES)},
{reported("(SELECT doc_id, pos AS place, kind, text AS part, 0 AS n_merged FROM c3 WHERE why IS NULL)")}"""

# Items of a page: its title, its list, its paragraphs, one or two tables of numbers under one head, a table of words, and an image.
HEAD = "<thead><tr><th>编号</th><th>值</th></tr></thead>"
_TAG = lambda c: strip(f"regexp_replace({c}, '<[^>]+>', ' ', 'g')")
_PARTS = "SELECT page_id::VARCHAR AS doc_id, page_id, url, list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1), lambda x: {tag}) AS items, list_transform(regexp_extract_all(html, '<p>([^\\n]*?)</p>', 1), lambda x: {tag}) AS texts, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title FROM pages".format(tag=_TAG("x"))
PAGE_NODES = f"""x AS ({_PARTS}),
nodes AS (SELECT doc_id, 0 AS pos, 0 AS sub, 'title' AS kind, nullif({strip("page_id || '.章 ' || title")}, '') AS text, 0 AS page FROM x
UNION ALL SELECT doc_id, 1, (i - 1)::INT, 'list_item', full_[i], 0 FROM (SELECT doc_id, list_filter(items, lambda y: y <> '') AS full_, unnest(range(1, greatest(2, len(list_filter(items, lambda y: y <> '')) + 1))) AS i FROM x)
UNION ALL SELECT doc_id, (1 + i)::INT, 0, 'paragraph', nullif(texts[i], ''), 1 FROM (SELECT doc_id, texts, unnest(range(1, len(texts) + 1)) AS i FROM x)
UNION ALL SELECT doc_id, 10000, 0, 'table', '<table><caption>表一</caption>{HEAD}<tbody><tr><td>' || page_id || '</td><td>' || length(url) || '</td></tr></tbody></table>', 1 FROM x
UNION ALL SELECT doc_id, 10001, 0, 'table', '<table>{HEAD}<tbody><tr><td>' || (page_id + 1) || '</td><td>9</td></tr></tbody></table>', 2 FROM x WHERE page_id % 2 = 0
UNION ALL SELECT doc_id, 10002, 0, 'table', '<table>' || list_aggregate(list_transform(items, lambda y: '<tr><td>' || y || '</td></tr>'), 'string_agg', '') || '</table>', 2 FROM x WHERE len(items) > 0
UNION ALL SELECT doc_id, 10003, 0, 'paragraph', NULL, 2 FROM x)"""
PAGE_BLOCKS = f"""{PAGE_NODES},
{cleaned('nodes')},
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) AS place, sum((kind = 'table')::INT) OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1 AS number FROM c3 WHERE why IS NULL),
w AS (SELECT doc_id, place, pos, kind, page, CASE WHEN kind = 'table' THEN NULL ELSE text END AS text, CASE WHEN kind = 'table' THEN '<table data-logical-id="tbl-' || lpad(number::VARCHAR, 3, '0') || '"' || substr(text, 7) END AS html, number FROM t),
m AS (SELECT a.doc_id, a.place, a.kind, a.page, a.text, CASE WHEN a.pos = 10000 AND b.doc_id IS NOT NULL THEN '<table data-logical-id="tbl-' || lpad(a.number::VARCHAR, 3, '0') || '" data-page-span="" data-continued="true"><caption>表一</caption>{HEAD}<tbody>' || regexp_extract(a.html, '<tbody>(.*)</tbody>', 1) || regexp_extract(b.html, '<tbody>(.*)</tbody>', 1) || '</tbody></table>' ELSE a.html END AS html,
CASE WHEN a.kind = 'table' THEN 'tbl-' || lpad(a.number::VARCHAR, 3, '0') END AS logical_table_id, (a.pos = 10000 AND b.doc_id IS NOT NULL)::INT AS n_merged FROM w a LEFT JOIN w b ON a.doc_id = b.doc_id AND a.pos = 10000 AND b.pos = 10001 WHERE a.pos <> 10001)"""
PAGE_BLOCK_ROWS = f"""WITH {PAGE_BLOCKS}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS "order", kind AS type, text, html, logical_table_id, page::INT AS page_idx, n_merged::INT AS n_merged FROM m"""
PAGE_REPORT = f"""WITH {PAGE_BLOCKS},
{reported("(SELECT doc_id, place, kind, coalesce(text, html) AS part, n_merged FROM m)")}"""

# Orders as tables: a caption, a head for even ones, rows that lack a cell or have one too many, a bar in a cell, a comment that may be long.
_ORDER_CELLS = "list_concat([l_linenumber::VARCHAR, l_quantity::INT || '|' || l_linestatus], CASE WHEN l_linenumber % 3 = 0 THEN [] WHEN l_linenumber % 4 = 0 THEN ['é  ' || l_returnflag, 'more'] WHEN l_linenumber % 5 = 0 THEN [repeat('long ', (l_orderkey % 60)::INT) || 'x'] ELSE ['é  ' || l_returnflag] END)"
_LINE = lambda cells: f"'| ' || array_to_string(list_transform(list_concat({cells}, ['', '', '', '', ''])[:width], lambda c: trim(regexp_replace(replace(c, '|', '\\|'), '{SPACE}', ' ', 'g'))), ' | ') || ' |'"
_GROUP = """CASE WHEN fixed + length(y) + 1 + CASE WHEN prefix <> '' AND len(s.done) = 0 AND s.i = s.first THEN length(prefix) + 2 ELSE 0 END > 200
THEN {'i': s.i + 1, 'first': s.i + 1, 'n': 0::BIGINT, 'done': list_append(CASE WHEN s.i > s.first THEN list_append(s.done, {'a': s.first, 'b': s.i - 1}) ELSE s.done END, {'a': s.i, 'b': s.i})}
WHEN s.i > s.first AND fixed + s.n + length(y) + 1 > 200 THEN {'i': s.i + 1, 'first': s.i, 'n': length(y) + 1, 'done': list_append(s.done, {'a': s.first, 'b': s.i - 1})}
ELSE {'i': s.i + 1, 'first': s.first, 'n': s.n + length(y) + 1, 'done': s.done} END"""
ORDER_TABLES = f"""WITH r AS (SELECT l_orderkey AS k, list({_ORDER_CELLS} ORDER BY l_linenumber, l_partkey, l_quantity) AS cells FROM lineitem GROUP BY l_orderkey),
h AS (SELECT k, CASE WHEN k % 2 = 0 THEN ['no', 'amount', 'flag'] ELSE cells[1] END AS head, CASE WHEN k % 2 = 0 THEN cells ELSE cells[2:] END AS rows, CASE WHEN k % 5 = 0 THEN 'order ' || k ELSE '' END AS prefix, len(CASE WHEN k % 2 = 0 THEN ['no', 'amount', 'flag'] ELSE cells[1] END) AS width FROM r),
l AS (SELECT k, prefix, width, 'Table ' || k || chr(10) || chr(10) || {_LINE('head')} || chr(10) || {_LINE("list_transform(range(width), lambda i: '---')")} AS top, list_transform(rows, lambda r: {_LINE('r')}) AS lines FROM h),
f AS (SELECT *, length(top) + 1 AS fixed FROM l),
g AS (SELECT *, list_reduce(lines, lambda s, y: {_GROUP}, {{'i': 0::BIGINT, 'first': 0::BIGINT, 'n': 0::BIGINT, 'done': []::STRUCT(a BIGINT, b BIGINT)[]}}) AS s FROM f),
o AS (SELECT *, CASE WHEN len(lines) = 0 THEN [{{'a': 0::BIGINT, 'b': -1::BIGINT}}] WHEN s.first < len(lines) THEN list_append(s.done, {{'a': s.first, 'b': len(lines) - 1}}) ELSE s.done END AS ranges FROM g),
p AS (SELECT *, unnest(range(len(ranges))) AS pos, unnest(ranges) AS x FROM o)
SELECT k AS table_id, pos::INT AS pos, CASE WHEN prefix <> '' AND pos = 0 THEN prefix || chr(10) || chr(10) ELSE '' END || array_to_string(list_concat([top], lines[x.a + 1:x.b + 1]), chr(10)) AS text, x.a::INT AS row_start, x.b::INT AS row_end, width::INT AS cols FROM p"""


def bigrams(name: str, rows: str) -> str:
    """CTEs that end in ``name`` (doc_id, e): the vectors of bigrams of the texts of ``rows``."""
    return f"""{name}_t AS (SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ''), '<empty>') AS t FROM {rows}),
{name}_g AS (SELECT doc_id, unnest(range(1, greatest(2, length(t)))) AS i, t FROM {name}_t),
{name}_p AS (SELECT doc_id, substr(t, i, 2) AS p, count(*) AS n FROM {name}_g GROUP BY 1, 2),
{name}_h AS (SELECT p, ('0x' || right(md5(p), 2))::INT AS h FROM (SELECT DISTINCT p FROM {name}_p)),
{name}_v AS (SELECT doc_id, h % 64 AS k, sum(CASE WHEN (h >> 1) & 1 = 0 THEN n ELSE -n END)::DOUBLE AS value FROM {name}_p JOIN {name}_h USING (p) GROUP BY 1, 2),
{name} AS (SELECT doc_id, (list_transform(range(64), lambda i: coalesce(m[i::INT], 0) + CASE WHEN i = 0 THEN 1 ELSE 0 END))::DOUBLE[] AS e FROM (SELECT doc_id, map_from_entries(list((k::INT, value))) AS m FROM {name}_v GROUP BY doc_id))"""


_CELLS = "list_transform(regexp_extract_all(x.r, '<t[dh]>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(replace(c, '|', '\\|'), '{S}', ' ', 'g')))".replace("{S}", SPACE)
_MD = lambda cells: f"'| ' || array_to_string({cells}, ' | ') || ' |'"
PAGE_CHUNKS = f"""WITH {PAGE_BLOCKS},
i AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY place) AS section FROM (SELECT *, lag(kind) OVER w IS NULL OR lag(kind) OVER w = 'table' OR kind = 'table' OR (kind = 'title' AND lag(kind) OVER w <> 'title') AS starts FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY place))),
s AS (SELECT doc_id, section::BIGINT AS section, bool_or(kind = 'table') AS is_table, string_agg(text, chr(10) || chr(10) ORDER BY place) FILTER (kind = 'title') AS header, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY place) FILTER (kind NOT IN ('title', 'table')), '') AS body,
max(html) AS html, max(logical_table_id) AS logical_table_id, min(page) + 1 AS page_num, max(page) + 1 AS page_end FROM i GROUP BY doc_id, section),
v AS (SELECT *, NOT is_table AND body = '' AND coalesce(lead(is_table) OVER w, false) AS gone, max(header) FILTER (NOT is_table) OVER (PARTITION BY doc_id ORDER BY section) AS path, lag(header) OVER w AS before FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY section)),
r_s AS (SELECT {{'d': doc_id, 's': section}} AS key, header, body FROM v WHERE NOT is_table AND NOT gone),
{sections('r')},
x0 AS (SELECT doc_id, section, html, before, unnest(regexp_extract_all(html, '<tr>(.*?)</tr>', 1)) AS r, generate_subscripts(regexp_extract_all(html, '<tr>(.*?)</tr>', 1), 1) AS k FROM v WHERE is_table),
x1 AS (SELECT doc_id, section, k, {_CELLS} AS cells FROM x0 x),
x2 AS (SELECT doc_id, section, list(cells ORDER BY k) AS rows FROM x1 GROUP BY doc_id, section),
x3 AS (SELECT v.*, rows, len(rows[1]) AS width FROM x2 JOIN v USING (doc_id, section)),
tp AS (SELECT doc_id, section, 0 AS pos, CASE WHEN lag_gone THEN before || chr(10) || chr(10) ELSE '' END || CASE WHEN contains(html, '<caption>') THEN '表一' || chr(10) || chr(10) ELSE '' END || {_MD('rows[1]')} || chr(10) || {_MD("list_transform(rows[1], lambda c: '---')")} || array_to_string(list_transform(rows[2:], lambda c: chr(10) || {_MD('c')}), '') AS chunk_text, 0 AS table_row_start, len(rows) - 2 AS table_row_end, width AS table_cols
FROM (SELECT x3.*, g.gone AS lag_gone FROM x3 LEFT JOIN v g ON g.doc_id = x3.doc_id AND g.section = x3.section - 1)),
p AS (SELECT key.d AS doc_id, key.s AS section, unnest(range(len(parts))) AS pos, unnest(parts) AS chunk_text, 'paragraph' AS chunk_kind, NULL::INT AS table_row_start, NULL::INT AS table_row_end, NULL::INT AS table_cols FROM r_parts
UNION ALL SELECT doc_id, section, pos, chunk_text, 'table_rows', table_row_start, table_row_end, table_cols FROM tp),
q AS (SELECT p.doc_id, p.section, pos, chunk_kind, {strip('p.chunk_text')} AS chunk_text, table_row_start, table_row_end, table_cols, logical_table_id, page_num, page_end, path FROM p JOIN v USING (doc_id, section)),
z AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY section, pos) - 1)::INT AS chunk_index FROM q WHERE chunk_text <> '')
SELECT doc_id, chunk_index, chunk_kind, chunk_text, length(chunk_text)::INT AS char_count, lag(chunk_index) OVER w AS prev_chunk_index, lead(chunk_index) OVER w AS next_chunk_index, page_num::INT AS page_num, page_end::INT AS page_end, page_end > page_num AS is_cross_page, path AS section_title,
CASE WHEN chunk_kind LIKE 'table%' THEN 'markdown' END AS table_format, logical_table_id, table_cols::INT AS table_cols, table_row_start::INT AS table_row_start, table_row_end::INT AS table_row_end FROM z WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)"""
