"""DuckDB SQL of the registered queries, over the same tables; sequence alignment, places, apexes and pages' trees have none."""

from __future__ import annotations

_SNAPSHOTS = r"""
li AS (
  SELECT l_orderkey AS o, l_linenumber AS ln, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_returnflag) AS flag, max(l_quantity) AS qty, max(l_extendedprice) AS price
  FROM lineitem GROUP BY l_orderkey, l_linenumber
), named AS (
  SELECT li.*, p_name, p_type, CAST(floor(price / 100) AS BIGINT) AS w, CAST(floor(qty * 5) AS BIGINT) AS r FROM li LEFT JOIN part ON part = p_partkey
), base AS (
  SELECT o // 100 AS pair_id, CAST(o * 100 + ln AS BIGINT) AS idx, '1.' || (o + 1) || '.' || ln AS hpid,
         CASE flag WHEN 'A' THEN 'div' WHEN 'N' THEN 'span' ELSE 'a' END AS tag, 'p' || part AS el_id, lower(p_type) AS classes,
         w AS width, CASE WHEN o % 13 = 0 THEN 100 ELSE r END AS red, 'block' AS display, p_name AS text, CAST(NULL AS VARCHAR) AS role,
         CASE WHEN supp % 3 = 0 THEN 't' || o || '-' || ln END AS testid, CAST(ln * 100 + supp % 100 AS DOUBLE) AS y, o
  FROM named WHERE part % 29 <> 0
  UNION ALL
  SELECT o_orderkey // 100, CAST(o_orderkey * 100 AS BIGINT), '1.' || (o_orderkey + 1), 'ul', 'o' || o_orderkey, 'list', NULL,
         CASE WHEN o_orderkey % 13 = 0 THEN 100 ELSE o_orderkey % 250 END, NULL, NULL, NULL, NULL, NULL, o_orderkey FROM orders
), cmp AS (
  SELECT o // 100 AS pair_id, CAST(o * 100 + ln AS BIGINT) AS idx, '1.' || (o + 1) || '.' || ln AS hpid,
         CASE WHEN supp % 31 = 0 THEN 'p' WHEN flag = 'A' THEN 'div' WHEN flag = 'N' THEN 'span' ELSE 'a' END AS tag, 'p' || part AS el_id, lower(p_type) AS classes,
         CASE WHEN part % 7 = 0 THEN w * 8 // 5 WHEN part % 5 = 0 THEN w + 2 ELSE w END AS width,
         CASE WHEN o % 13 = 0 THEN 200 WHEN part % 11 = 0 THEN r + 40 ELSE r END AS red,
         CASE WHEN part % 41 = 0 THEN 'none' ELSE 'block' END AS display, CASE WHEN part % 17 = 0 THEN p_name || ' new' ELSE p_name END AS text,
         CASE WHEN supp % 37 = 0 THEN 'button' END AS role, CASE WHEN supp % 3 = 0 THEN 't' || o || '-' || ln END AS testid
  FROM named WHERE part % 23 <> 0
  UNION ALL
  SELECT o_orderkey // 100, CAST(o_orderkey * 100 AS BIGINT), '1.' || (o_orderkey + 1), 'ul', 'o' || o_orderkey, 'list', NULL,
         CASE WHEN o_orderkey % 13 = 0 THEN 200 ELSE o_orderkey % 250 END, NULL, NULL, NULL, NULL FROM orders
)"""


_PARENT = "CASE WHEN length(hpid) - length(replace(hpid, '.', '')) = 2 THEN split_part(hpid, '.', 1) || '.' || split_part(hpid, '.', 2) ELSE '1' END"


def _diffs(color: int = 5, size: int = 3, text: bool = True, same_tag: bool = True) -> str:
    px = lambda c: f"CASE WHEN {c} = 0 THEN '0px' ELSE {c} || '.00px' END"
    red = lambda c: f"'rgba(' || {c} || ', 0, 0, 1)'"
    texts = "UNION ALL SELECT pair_id, ord, hpid, tag, classes, 'textContent', bt, ct, 'modified', 'content', 'low' FROM m WHERE coalesce(bt, '') <> coalesce(ct, '')" if text else ""
    return f"""{_SNAPSHOTS}, m AS (
  SELECT b.pair_id, b.idx AS ord, b.hpid, b.tag, b.classes, b.width AS bw, c.width AS cw, b.red AS br, c.red AS cr, b.display AS bd, c.display AS cd, trim(b.text) AS bt, trim(c.text) AS ct, c.role
  FROM base b JOIN cmp c ON b.pair_id = c.pair_id AND b.hpid = c.hpid {'AND b.tag = c.tag' if same_tag else ''}
), diffs AS (
  SELECT pair_id, ord, hpid, tag, classes, 'width' AS property, {px("bw")} AS base_value, {px("cw")} AS compare_value, 'modified' AS type, 'layout' AS category,
         CASE WHEN bw <> 0 AND cw <> 0 AND abs((cw - bw) / bw) * 100 > 50 THEN 'critical' ELSE 'high' END AS severity FROM m WHERE abs(cw - bw) > {size}
  UNION ALL SELECT pair_id, ord, hpid, tag, classes, 'color', {red("br")}, {red("cr")}, 'modified', 'visual', 'high' FROM m WHERE abs(cr - br) > {color}
  UNION ALL SELECT pair_id, ord, hpid, tag, classes, 'display', bd, cd, 'modified', 'layout', 'critical' FROM m WHERE bd <> cd
  UNION ALL SELECT pair_id, ord, hpid, tag, classes, 'attr:role', NULL, role, 'modified', 'attribute', 'low' FROM m WHERE role IS NOT NULL
  {texts}
), per_match AS (
  SELECT pair_id, ord, hpid, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
         CAST(0 AS BIGINT) AS medium, count(*) FILTER (severity = 'low') AS low,
         CASE min(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 4 END) WHEN 1 THEN 'critical' WHEN 2 THEN 'high' ELSE 'low' END AS worst
  FROM diffs GROUP BY pair_id, ord, hpid
)"""


def _residual(*options) -> str:
    """diffs without the colours that only follow the parent's."""
    return f"""{_diffs(*options)}, residual AS (
  SELECT * FROM diffs d WHERE NOT (property = 'color' AND EXISTS (SELECT 1 FROM diffs p WHERE p.pair_id = d.pair_id AND p.hpid = ({_PARENT.replace("hpid", "d.hpid")}) AND p.property = 'color' AND p.base_value = d.base_value AND p.compare_value = d.compare_value))
), residual_match AS (
  SELECT pair_id, ord, hpid, count(*) AS total, CASE min(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 4 END) WHEN 1 THEN 'critical' WHEN 2 THEN 'high' ELSE 'low' END AS worst FROM residual GROUP BY pair_id, ord, hpid
)"""


def _summary(*options) -> str:
    worst = ", ".join(f"(SELECT count(*) FROM residual_match WHERE worst = '{s}') AS {s}" for s in ("critical", "high", "medium", "low"))
    return f"WITH {_residual(*options)} SELECT count(*) AS total, count(*) - (SELECT count(*) FROM residual_match) AS unchanged, (SELECT count(*) FROM residual_match) AS modified, (SELECT count(*) FROM residual) AS differences, CAST(0 AS BIGINT) AS ambiguous, {worst} FROM m"


def _keyed(key: str) -> str:
    return f"""WITH {_SNAPSHOTS}, b AS (SELECT pair_id, idx AS b_idx, {key} AS k FROM base), held AS (SELECT pair_id, {key} AS k, count(*) AS n, min(idx) AS c_idx FROM cmp WHERE {key} IS NOT NULL GROUP BY ALL),
firsts AS (SELECT pair_id, k, min(b_idx) AS first FROM b WHERE k IS NOT NULL GROUP BY ALL),
keyed AS (SELECT b.pair_id, b.b_idx, CASE WHEN n = 1 AND b_idx = first THEN 'match' WHEN n > 1 THEN 'ambiguous' ELSE 'orphan' END AS outcome, c_idx AS c, coalesce(n, 0) AS n_candidates
  FROM b LEFT JOIN held ON b.pair_id = held.pair_id AND b.k = held.k LEFT JOIN firsts ON b.pair_id = firsts.pair_id AND b.k = firsts.k)"""


_IDENTITY = f"""WITH {_SNAPSHOTS}, identity AS (
  SELECT coalesce(b.pair_id, c.pair_id) AS pair_id, coalesce(b.hpid, c.hpid) AS hpid, b.idx AS b_idx, c.idx AS c_idx, b.tag AS b_tag, c.tag AS c_tag,
         CASE WHEN c.idx IS NULL THEN 'removed' WHEN b.idx IS NULL THEN 'added' WHEN b.tag = c.tag THEN 'pair' ELSE 'replaced' END AS outcome
  FROM base b FULL JOIN cmp c ON b.pair_id = c.pair_id AND b.hpid = c.hpid
)"""

_ITEMS = f"""WITH {_diffs()}, items AS (
  SELECT pair_id, ord, hpid, concat_ws('.', tag, classes) AS label, count(*) AS total,
         CASE min(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 4 END) WHEN 1 THEN 'critical' WHEN 2 THEN 'high' ELSE 'low' END AS severity,
         string_agg(property || '|' || coalesce(base_value, '') || '|' || coalesce(compare_value, ''), ';' ORDER BY property) AS signature,
         bool_or(property IN ('width', 'display')) AS moved
  FROM diffs GROUP BY pair_id, ord, hpid, tag, classes
), once AS (
  SELECT pair_id, severity, label, signature, min(ord) AS ord, min_by(hpid, ord) AS hpid, min_by(total, ord) AS total, bool_or(moved) AS moved, count(*) AS recurrence
  FROM items GROUP BY pair_id, severity, label, signature
)"""

ORACLE_SQL: dict[str, str] = {
    "compare_static_summary": _summary(5, 3, True),
    "compare_dynamic_summary": _summary(8, 5, False),
    "match_test_attribute": _keyed("'data-testid::' || testid") + " SELECT pair_id, b_idx, CASE WHEN outcome = 'match' THEN c END AS c_idx, outcome FROM keyed",
    "match_id_greedy": _keyed("el_id") + " SELECT pair_id, b_idx, c AS c_idx FROM keyed WHERE outcome = 'match'",
    "match_id_ambiguous": _keyed("el_id") + " SELECT pair_id, b_idx, n_candidates FROM keyed WHERE outcome = 'ambiguous'",
    "match_absolute_hpid": _keyed("hpid") + " SELECT pair_id, outcome, count(*) AS n FROM keyed GROUP BY ALL",
    "match_suffix_realign": _keyed("hpid || '::' || tag") + " SELECT pair_id, b_idx, c AS c_idx FROM keyed WHERE outcome = 'match'",
    "match_identity_full_outer": f"{_IDENTITY} SELECT pair_id, outcome, count(*) AS n FROM identity GROUP BY ALL",
    "match_replacements": f"{_IDENTITY} SELECT pair_id, hpid, b_tag, c_tag FROM identity WHERE outcome = 'replaced'",
    "unmatched_added": f"{_IDENTITY} SELECT pair_id, c_idx, hpid FROM identity WHERE outcome = 'added'",
    "unmatched_removed": f"{_IDENTITY} SELECT pair_id, b_idx, hpid FROM identity WHERE outcome = 'removed'",
    "match_rate": f"""{_IDENTITY}, counts AS (
      SELECT pair_id, count(*) FILTER (outcome = 'pair') AS matched, count(*) FILTER (outcome IN ('removed', 'replaced')) AS removed, count(*) FILTER (outcome IN ('added', 'replaced')) AS added FROM identity GROUP BY pair_id
    ) SELECT *, CAST(floor(100 * matched / (matched + removed + added) + 0.5) AS INT) AS rate FROM counts""",
    "normalize_hex": "SELECT p_partkey, 'rgba(' || (p_partkey % 256) || ', 16, ' || (255 - p_partkey % 256) || ', 1)' AS color FROM part",
    "normalize_named_color": """SELECT p_partkey, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'rgba(255, 0, 0, 1)' WHEN 'blue' THEN 'rgba(0, 0, 255, 1)' WHEN 'green' THEN 'rgba(0, 128, 0, 1)' WHEN 'black' THEN 'rgba(0, 0, 0, 1)' WHEN 'white' THEN 'rgba(255, 255, 255, 1)'
      ELSE upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] END AS color FROM part""",
    "normalize_hsl": """WITH v AS (SELECT p_partkey, p_partkey % 2 = 0 AS grey, CAST(floor(p_partkey % 5 * 20 / 100.0 * 255 + 0.5) AS INT) AS g, p_partkey % 6 AS h FROM part)
      SELECT p_partkey, CASE WHEN grey THEN 'rgba(' || g || ', ' || g || ', ' || g || ', 1)' ELSE 'rgba(' || CASE WHEN h IN (0, 1, 5) THEN 255 ELSE 0 END || ', ' || CASE WHEN h IN (1, 2, 3) THEN 255 ELSE 0 END || ', ' || CASE WHEN h IN (3, 4, 5) THEN 255 ELSE 0 END || ', 1)' END AS color FROM v""",
    "normalize_units": """WITH v AS (SELECT p_partkey, p_partkey % 7 AS u, p_size + (p_partkey % 8) / 8.0 AS x FROM part), f AS (SELECT *, CAST(floor(x * CASE u WHEN 1 THEN 16 WHEN 2 THEN 16 WHEN 3 THEN 96 WHEN 4 THEN 16 ELSE 1 END * 100 + 0.5) AS BIGINT) AS n FROM v)
      SELECT p_partkey, (n // 100) || '.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') || CASE WHEN u = 5 THEN '%' ELSE 'px' END AS size FROM f""",
    "normalize_font": """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ', serif' AS font FROM part""",
    "expand_margin_shorthand": """WITH v AS (SELECT p_partkey, p_size, p_partkey % 4 + 1 AS n, (p_partkey % 3) || 'px' AS a, (p_partkey % 5) || 'px' AS b, (p_partkey % 7) || 'px' AS c, (p_partkey % 11) || 'px' AS d FROM part)
      SELECT p_partkey, a AS top, CASE WHEN n > 1 THEN b ELSE a END AS "right", CASE WHEN n > 2 THEN c ELSE a END AS bottom, CASE WHEN p_size % 2 = 0 THEN '9px' WHEN n > 3 THEN d WHEN n > 1 THEN b ELSE a END AS "left", false AS kept FROM v""",
    "style_diff_long": f"WITH {_diffs()} SELECT pair_id, hpid, property, base_value, compare_value, type, category FROM diffs",
    "severity_per_diff": f"WITH {_diffs()} SELECT property, severity, count(*) AS n FROM diffs GROUP BY ALL",
    "severity_counts": f"WITH {_diffs()} SELECT pair_id, hpid, total, critical, high, medium, low, worst FROM per_match",
    "attr_diff": f"WITH {_diffs()} SELECT pair_id, hpid, property, base_value, compare_value, type, severity FROM diffs WHERE category = 'attribute'",
    "text_diff": f"WITH {_diffs()} SELECT pair_id, hpid, base_value, compare_value, severity FROM diffs WHERE category = 'content'",
    "severity_worst": f"WITH {_diffs()} SELECT pair_id, worst, count(*) AS elements FROM per_match GROUP BY ALL",
    "luminance_delta": "WITH v AS (SELECT p_partkey, p_partkey % 256 / 255.0 AS v FROM part) SELECT p_partkey, CAST(floor(0.2126 * CASE WHEN v <= 0.03928 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END * 1000 + 0.5) AS BIGINT) AS permille FROM v",
    "tolerance_filter": "WITH v AS (SELECT CAST(p_partkey AS VARCHAR) AS hpid, CASE WHEN p_partkey % 7 > 3 THEN 1 ELSE 0 END AS h, CASE WHEN p_partkey % 11 > 5 THEN 1 ELSE 0 END AS c FROM part) SELECT hpid, CAST(h AS BIGINT) AS heights, CAST(c AS BIGINT) AS colors FROM v WHERE h + c > 0",
    "dedupe_current_color": "SELECT 'color' AS property, count(*) AS n FROM part UNION ALL SELECT 'border-top-color', count(*) FROM part WHERE p_partkey % 3 = 0",
    "drop_shorthands": """SELECT property, type, n FROM (SELECT 'padding-left' AS property, 'modified' AS type, count(*) AS n FROM part UNION ALL
      SELECT 'border-' || side || '-' || kind, 'removed', (SELECT count(*) FROM part) FROM (VALUES ('top'), ('right'), ('bottom'), ('left')) s(side), (VALUES ('width'), ('style'), ('color')) k(kind) WHERE NOT (side = 'top' AND kind = 'width'))""",
    "cascade_suppressed": f"WITH {_residual()} SELECT pair_id, hpid, property, base_value, compare_value FROM (SELECT * FROM diffs EXCEPT ALL SELECT * FROM residual)",
    "narrative_badge": f"{_ITEMS} SELECT pair_id, CASE WHEN moved THEN 'LAYOUT SHIFT' ELSE 'STYLE REGRESSION' END AS badge, count(*) AS items FROM once GROUP BY ALL",
    "query_param_diff": """SELECT page_id, 'n' AS key, CAST(NULL AS VARCHAR) AS baseline, CAST(page_id AS VARCHAR) AS compare FROM pages UNION ALL SELECT page_id, 'p', '1', '7' FROM pages WHERE page_id % 2 <> 0""",
    "report_validation": """WITH v AS (SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderkey % 5 = 0 THEN 'Missing or invalid URL' END, CASE WHEN o_orderkey % 7 = 0 THEN 'Missing or invalid timestamp' END,
      CASE WHEN o_orderkey % 11 = 0 THEN 'Element count mismatch: expected 9, got ' || (o_orderkey % 3) END) AS errors FROM orders) SELECT * FROM v WHERE errors <> ''""",
    "csv_header_sniff": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END >= 2 AS header FROM part",
    "rect_clipping": f"""WITH {_SNAPSHOTS}, v AS (SELECT o, ln, ln * 100 - 250 AS y, CAST(qty * 20 AS BIGINT) AS h FROM li), c AS (SELECT o, ln, greatest(0, y) AS y, least(y + h, 600) AS bottom, h FROM v)
      SELECT o, ln, CAST(y AS BIGINT) AS y, CAST(greatest(1, bottom - y) AS BIGINT) AS height, greatest(1, bottom - y) < h AS is_clipped, bottom <= 0 AS is_below FROM c""",
    "text_divergence": f"""WITH {_diffs()} SELECT pair_id, hpid, CAST(floor(CASE WHEN length(ct) < 8 THEN 0.3 ELSE 1.0 END * 4 / length(ct) * 1000 + 0.5) AS BIGINT) AS permille FROM m WHERE bt <> '' AND ct <> '' AND bt <> ct""",
    "cascade_residual": f"""WITH {_diffs()} SELECT d.pair_id, d.property, EXISTS (SELECT 1 FROM diffs p WHERE p.pair_id = d.pair_id AND p.hpid = ({_PARENT.replace("hpid", "d.hpid")}) AND p.property = 'color' AND d.property = 'color' AND p.base_value = d.base_value AND p.compare_value = d.compare_value) AS inherited, count(*) AS n FROM diffs d GROUP BY ALL""",
    "severity_breakdown_parents": f"WITH {_diffs()} SELECT worst, count(*) AS elements FROM per_match a WHERE NOT EXISTS (SELECT 1 FROM per_match p WHERE p.pair_id = a.pair_id AND p.hpid = ({_PARENT.replace('hpid', 'a.hpid')})) GROUP BY worst",
    "nearest_diff_ancestor": f"WITH {_diffs()} SELECT a.pair_id, a.hpid, p.hpid AS nearest FROM per_match a JOIN per_match p ON p.pair_id = a.pair_id AND p.hpid = ({_PARENT.replace('hpid', 'a.hpid')})",
    "descendant_diff_counts": f"WITH {_diffs()}, up AS (SELECT pair_id, '1' AS node FROM per_match UNION ALL SELECT pair_id, {_PARENT} FROM per_match WHERE hpid LIKE '1.%.%') SELECT pair_id, node, count(*) AS below FROM up GROUP BY ALL",
    "tree_structural_nodes": f"""WITH {_diffs()}, own AS (
      SELECT pair_id, hpid AS node, 3 AS k FROM per_match UNION ALL SELECT c.pair_id, c.hpid, 1 FROM cmp c ANTI JOIN base b ON c.pair_id = b.pair_id AND c.hpid = b.hpid UNION ALL SELECT b.pair_id, b.hpid, 2 FROM base b ANTI JOIN cmp c ON c.pair_id = b.pair_id AND c.hpid = b.hpid
    ), both_ AS (SELECT * FROM own UNION ALL SELECT pair_id, '1', 4 FROM own UNION ALL SELECT pair_id, {_PARENT.replace("hpid", "node")}, 4 FROM own)
    SELECT pair_id, node, CASE min(k) WHEN 1 THEN 'DOM_INSERTION' WHEN 2 THEN 'DOM_DELETION' WHEN 3 THEN 'DIFF' ELSE 'STRUCTURAL' END AS kind FROM both_ GROUP BY ALL""",
    "report_tree": f"""{_ITEMS}, apex AS (
      SELECT DISTINCT p.pair_id, p.hpid FROM diffs d JOIN diffs p ON p.pair_id = d.pair_id AND p.hpid = ({_PARENT.replace("hpid", "d.hpid")}) WHERE d.property = 'color' AND p.property = 'color' AND p.base_value = d.base_value AND p.compare_value = d.compare_value
    ), changed AS (
      SELECT i.pair_id, i.hpid, i.severity AS "group", i.label, row_number() OVER (PARTITION BY i.pair_id, i.severity, i.label, i.signature ORDER BY i.ord) AS instance, o.recurrence AS "of", (o.pair_id, o.hpid) IN (SELECT (pair_id, hpid) FROM apex) AS is_apex
      FROM items i JOIN once o ON o.pair_id = i.pair_id AND o.severity = i.severity AND o.label = i.label AND o.signature = i.signature
      UNION ALL SELECT c.pair_id, c.hpid, 'added', concat_ws('.', c.tag, c.classes), 1, 1, false FROM cmp c ANTI JOIN base b ON c.pair_id = b.pair_id AND c.hpid = b.hpid
      UNION ALL SELECT b.pair_id, b.hpid, 'removed', concat_ws('.', b.tag, b.classes), 1, 1, false FROM base b ANTI JOIN cmp c ON c.pair_id = b.pair_id AND c.hpid = b.hpid
    ), deep AS (
      SELECT *, string_split(hpid, '.') AS s, CAST(s[2] AS BIGINT) AS k, list_concat(['1', CAST(k % 7 + 1 AS VARCHAR), CAST(k % 3 + 1 AS VARCHAR)], s[2:]) AS steps FROM changed
    ), above AS (
      SELECT pair_id, array_to_string(steps[1:n], '.') AS node, count(*) AS below FROM deep, (SELECT unnest(range(1, 5)) AS n) WHERE n < len(steps) GROUP BY ALL
    ), calm AS (
      SELECT m.pair_id, string_split(m.hpid, '.') AS s, CAST(s[2] AS BIGINT) AS k, array_to_string(list_concat(['1', CAST(k % 7 + 1 AS VARCHAR), CAST(k % 3 + 1 AS VARCHAR)], s[2:]), '.') AS node, concat_ws('.', tag, classes) AS label FROM m ANTI JOIN diffs d ON d.pair_id = m.pair_id AND d.hpid = m.hpid
    )
    SELECT pair_id, array_to_string(steps, '.') AS node, CAST(len(steps) AS INT) AS depth, CASE WHEN "group" = 'added' THEN 'DOM_INSERTION' WHEN "group" = 'removed' THEN 'DOM_DELETION' WHEN is_apex THEN 'DIFF_APEX' ELSE 'DIFF_DETAIL' END AS kind,
           "group", label, CAST(instance AS INT) AS instance, CAST("of" AS INT) AS "of", CAST(NULL AS BIGINT) AS child_diffs FROM deep
    UNION ALL
    SELECT a.pair_id, a.node, CAST(len(string_split(a.node, '.')) AS INT), 'STRUCTURAL', NULL, coalesce(c.label, a.node), NULL, NULL, below
    FROM above a LEFT JOIN calm c ON c.pair_id = a.pair_id AND c.node = a.node WHERE (a.pair_id, a.node) NOT IN (SELECT (pair_id, array_to_string(steps, '.')) FROM deep)""",
    "breadcrumbs": f"""WITH {_diffs()}, labels AS (SELECT pair_id, hpid, tag || '#' || el_id || coalesce('.' || classes, '') AS label FROM base)
      SELECT a.pair_id, a.hpid AS node, '1 > ' || coalesce(p.label || ' > ', '') || l.label AS crumbs FROM per_match a JOIN labels l ON l.pair_id = a.pair_id AND l.hpid = a.hpid LEFT JOIN labels p ON a.hpid LIKE '1.%.%' AND p.pair_id = a.pair_id AND p.hpid = ({_PARENT.replace("hpid", "a.hpid")})""",
    "diffs_by_category": f"WITH {_diffs()} SELECT pair_id, hpid, category, string_agg(property, ',' ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 4 END, CASE property WHEN 'width' THEN 1 WHEN 'color' THEN 2 WHEN 'display' THEN 3 WHEN 'textContent' THEN 4 ELSE 5 END) AS properties FROM diffs GROUP BY pair_id, hpid, category",
    "dedupe_recurrence": f"{_ITEMS} SELECT pair_id, severity, label, hpid, total, recurrence FROM once",
    "impact_score": f"""{_ITEMS}, counts AS (
      SELECT pair_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, CAST(0 AS BIGINT) AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS root_causes, CAST(0 AS BIGINT) AS content_demoted FROM once GROUP BY pair_id
    ) SELECT *, (100 * critical + 40 * high + 3 * low) / 10 AS raw_penalty, CAST(greatest(0, floor((1000 - (100 * critical + 40 * high + 3 * low)) / 10 + 0.5)) AS INT) AS impact_score FROM counts""",
    "change_distribution": f"""{_ITEMS}, dom AS (SELECT pair_id FROM (SELECT c.pair_id FROM cmp c ANTI JOIN base b ON c.pair_id = b.pair_id AND c.hpid = b.hpid UNION ALL SELECT b.pair_id FROM base b ANTI JOIN cmp c ON c.pair_id = b.pair_id AND c.hpid = b.hpid)),
      counted AS (SELECT pair_id, count(*) FILTER (moved) AS layout, count(*) FILTER (NOT moved) AS style FROM once GROUP BY pair_id), doms AS (SELECT pair_id, count(*) AS dom FROM dom GROUP BY pair_id)
      SELECT pair_id, coalesce(layout, 0) AS layout, coalesce(style, 0) AS style, CAST(0 AS BIGINT) AS content, coalesce(dom, 0) AS dom FROM counted FULL JOIN doms USING (pair_id)""",
    "top_root_causes": f"{_ITEMS}, placed AS (SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY total DESC, ord) AS INT) AS place, hpid, total FROM once) SELECT * FROM placed WHERE place <= 3",
    "url_compatibility": r"""WITH u AS (
      SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_replace(lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '/$', '') AS path, regexp_extract(url, '#(.*)$', 1) AS ref,
             list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '^(utm_.*|gclid|gad_source|fbclid|msclkid|_ga|_gl)$', 'i'))) AS q FROM pages
    ), n AS (SELECT *, lead(page_id) OVER w AS other_id, lead(path) OVER w AS path2, lead(ref) OVER w AS ref2, lead(q) OVER w AS q2 FROM u WINDOW w AS (PARTITION BY host ORDER BY page_id))
    SELECT page_id, other_id, CASE WHEN path <> path2 THEN 'INCOMPATIBLE' WHEN q = q2 AND ref = ref2 THEN 'COMPATIBLE' ELSE 'CAUTION' END AS compatibility FROM n WHERE other_id IS NOT NULL""",
    "strip_tracking_params": r"SELECT page_id, array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '^(utm_.*|gclid|gad_source|fbclid|msclkid|_ga|_gl)$', 'i')), '&') AS params FROM pages",
    "env_tag": r"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '://', '://preview.') WHEN 1 THEN replace(url, '://', '://qa-') WHEN 2 THEN '' ELSE url END AS url FROM pages)
      SELECT page_id, CASE WHEN url = '' THEN 'UNKNOWN' WHEN regexp_matches(lower(regexp_extract(url, '://([^/?#]*)', 1)), '\b(stage|staging|dev|test|qa|uat|preview|sandbox|canary)\b') THEN 'STAGE' ELSE 'PROD' END AS env FROM u""",
    "last_path_segment": r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '^[^:]*://[^/?#]*', 0) || '/' WHEN 1 THEN 'no address' ELSE url END AS url FROM pages), p AS (SELECT page_id, url, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM u)
      SELECT page_id, CASE WHEN NOT contains(url, '://') THEN '' ELSE '/' || regexp_extract(path, '([^/]*)/*$', 1) END AS segment FROM p""",
    "class_occurrence": f"WITH {_SNAPSHOTS} SELECT idx, CASE WHEN coalesce(classes, '') = '' THEN 0 ELSE count(*) OVER (PARTITION BY pair_id, coalesce(classes, '')) END AS \"classOccurrenceCount\" FROM base",
    "filter_top_level_roots": f"WITH {_SNAPSHOTS}, w AS (SELECT * FROM base WHERE (tag = 'ul' AND idx % 3 = 0) OR el_id LIKE '%7') SELECT pair_id AS page_id, hpid FROM w a WHERE NOT EXISTS (SELECT 1 FROM w p WHERE p.pair_id = a.pair_id AND a.hpid LIKE '1.%.%' AND p.hpid = ({_PARENT.replace('hpid', 'a.hpid')}))",
    "tier_classification": f"WITH {_SNAPSHOTS} SELECT CASE WHEN tag = 'a' OR role = 'button' THEN 'T3' WHEN tag IN ('p', 'span') THEN 'T2' ELSE 'T1' END AS tier, count(*) AS n FROM cmp GROUP BY ALL",
    "report_retention": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 50",
    "comparison_upsert": "WITH new AS (SELECT o_orderkey + 5 AS o_orderkey, 'NEW' AS o_orderstatus FROM orders WHERE o_orderkey % 10 = 0) SELECT o_orderkey, o_orderstatus FROM orders ANTI JOIN new USING (o_orderkey) UNION ALL SELECT * FROM new",
    "report_search": "SELECT CAST(page_id AS VARCHAR) AS id FROM pages WHERE contains(lower(url), 'en/1') OR contains(CAST(page_id AS VARCHAR), 'EN/1')",
    "storage_stats": "SELECT count(*) AS reports, CAST(sum(p_size) AS BIGINT) AS elements, CAST(floor(sum(p_size) / count(*) + 0.5) AS BIGINT) AS average FROM part",
    "csv_escape": """WITH v AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '''=' WHEN 1 THEN '' ELSE '"' END || p_name || CASE WHEN p_partkey % 2 = 0 THEN ', x' ELSE '' END AS c FROM part)
      SELECT p_partkey, CASE WHEN contains(c, ',') OR contains(c, '"') THEN '"' || replace(c, '"', '""') || '"' ELSE c END AS cell FROM v""",
    "pivot_rects": f"WITH {_SNAPSHOTS} SELECT o, max(qty) FILTER (flag = 'A') AS a, max(qty) FILTER (flag = 'N') AS n, max(qty) FILTER (flag = 'R') AS r FROM li GROUP BY o",
    "keyframe_clusters": f"WITH {_SNAPSHOTS} SELECT pair_id, {_PARENT} AS root, min(y) AS top, max(y) AS bottom, count(*) AS n FROM base WHERE y IS NOT NULL GROUP BY ALL",
    "readiness_session_gap": """WITH v AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 HOURS THEN 0 ELSE 1 END AS fresh FROM events WHERE event_type <> 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM v)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts) + INTERVAL 10 HOURS, '%Y-%m-%d %H:%M:%S.%f') AS ready, count(*) AS n FROM s GROUP BY user_id, burst""",
    "error_dedup": "SELECT 'E:' || json_extract_string(props, '$.k') AS key, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM events WHERE event_type = 'error' GROUP BY ALL",
    "perf_percentiles_nearest_rank": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events),
      xs AS (SELECT event_type, list_sort(list(value)) AS x FROM r WHERE k <= 100 GROUP BY event_type),
      a AS (SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY event_type)
      SELECT a.*, x[CAST(greatest(1, ceil(len(x) * 0.5)) AS INT)] AS p50, x[CAST(greatest(1, ceil(len(x) * 0.95)) AS INT)] AS p95, x[CAST(greatest(1, ceil(len(x) * 0.99)) AS INT)] AS p99 FROM a JOIN xs USING (event_type)""",
    "rolling_100_samples": "SELECT event_id, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS BIGINT) AS cents FROM events",
}

ORACLE_SQL["sql_functions"] = f"""WITH n AS ({ORACLE_SQL["normalize_named_color"]})
  SELECT p_partkey, color, CASE WHEN p_partkey % 3 * 1000.0 / p_size > 50 THEN 'critical' ELSE 'high' END AS severity, CASE WHEN p_partkey % 3 = 1 THEN 'COMPATIBLE' ELSE 'CAUTION' END AS compatibility,
         CAST(depth AS INT) AS depth, CASE depth WHEN 1 THEN '1' ELSE '1.' || p_size END AS ancestor FROM part JOIN n USING (p_partkey), (VALUES (1), (2)) d(depth)"""

# Anchors and paths pair all elements of one path, whatever their tags; ids of what is left never meet.
ORACLE_SQL["compare_end_to_end"] = f"""WITH {_residual(5, 3, True, False)}, pairs AS (
    SELECT pair_id, count(*) AS matched FROM m GROUP BY pair_id
  ), ub AS (SELECT b.pair_id, count(*) AS n FROM base b ANTI JOIN cmp c ON c.pair_id = b.pair_id AND c.hpid = b.hpid GROUP BY b.pair_id
  ), uc AS (SELECT c.pair_id, count(*) AS n FROM cmp c ANTI JOIN base b ON c.pair_id = b.pair_id AND c.hpid = b.hpid GROUP BY c.pair_id
  ), worst AS (SELECT pair_id, count(*) AS modified, sum(total)::BIGINT AS differences, {", ".join(f"count(*) FILTER (worst = '{s}') AS {s}" for s in ("critical", "high", "medium", "low"))} FROM residual_match GROUP BY pair_id)
  SELECT pair_id, matched AS total, matched - coalesce(modified, 0) AS unchanged, coalesce(modified, 0) AS modified, coalesce(differences, 0) AS differences, {", ".join(f"coalesce({s}, 0) AS {s}" for s in ("critical", "high", "medium", "low"))},
         matched, coalesce(ub.n, 0) AS unmatched_baseline, coalesce(uc.n, 0) AS unmatched_compare, CAST(floor(100 * matched / (matched + coalesce(ub.n, 0) + coalesce(uc.n, 0)) + 0.5) AS INT) AS match_rate
  FROM pairs LEFT JOIN ub USING (pair_id) LEFT JOIN uc USING (pair_id) LEFT JOIN worst USING (pair_id)"""
ORACLE_SQL["report_round_trip"] = f"""WITH {_SNAPSHOTS} SELECT 'r' || pair_id AS report_id, row_number() OVER (PARTITION BY pair_id ORDER BY idx) - 1 AS idx, hpid, tag AS "tagName", el_id AS "elementId", classes AS "className", text AS "textContent",
  CASE WHEN width IS NOT NULL THEN width || 'px' END AS width, 'rgb(' || red || ', 0, 0)' AS color, role FROM cmp"""
ORACLE_SQL["store_round_trip"] = f"""WITH {_SNAPSHOTS}, kept AS (SELECT pair_id FROM (SELECT DISTINCT pair_id FROM cmp) ORDER BY pair_id DESC LIMIT 50)
  SELECT 'r' || pair_id AS report_id, count(*) AS elements, sum(idx)::BIGINT AS places, any_value(pair_id)::BIGINT AS pair_id FROM cmp WHERE pair_id IN (SELECT pair_id FROM kept) GROUP BY pair_id"""
