"""DuckDB SQL for the queries of ``bindings``, over the driver's tables."""

from __future__ import annotations

BRANCH = "'and','or','if','und','oder','wenn','et','ou','si','y','o'"
GLOBAL = "'the','der','die','das','le','la','les','el','los'"


def _tokens(table: str = "documents", cols: str = "doc_id, lang, source, n_chars") -> str:
    return rf"""
tk0 AS (SELECT {cols}, coalesce(text, '') AS text FROM {table}),
tk AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(text, '([.,;:!?|])', ' \1 ', 'g'), '[ \n\t]+'), lambda x: x <> '') AS toks,
  string_split(text, chr(10)) AS lns FROM tk0)"""


_COMMENT = r"'^[ \t]*(#|//|--|/\*|\*)'"
DOC = _tokens() + rf""",
d1 AS (SELECT doc_id, lang, source, n_chars, len(lns)::BIGINT AS loc, len(list_filter(lns, lambda x: regexp_matches(x, {_COMMENT})))::BIGINT AS cloc,
  greatest(len(list_filter(lns, lambda x: regexp_matches(x, '[^ \t]') AND NOT regexp_matches(x, {_COMMENT}))), 1)::BIGINT AS lloc,
  (1 + len(list_filter(toks, lambda x: lower(x) IN ({BRANCH}))))::BIGINT AS cc,
  list_filter(toks, lambda x: regexp_matches(x, '^[.,;:!?|]$')) AS o, list_filter(toks, lambda x: NOT regexp_matches(x, '^[.,;:!?|]$')) AS w FROM tk),
d2 AS (SELECT doc_id, lang, source, n_chars, loc, cloc, lloc, cc, len(o)::BIGINT AS operators, len(w)::BIGINT AS operands,
  len(list_distinct(o))::BIGINT AS unique_operators, len(list_distinct(w))::BIGINT AS unique_operands FROM d1),
d3 AS (SELECT *, CASE WHEN unique_operands > 0 THEN unique_operators + unique_operands ELSE 0 END AS vocabulary,
  CASE WHEN unique_operands > 0 THEN operators + operands ELSE 0 END AS length,
  CASE WHEN unique_operands > 0 THEN log2(unique_operators + unique_operands) ELSE 0.0 END AS lg,
  CASE WHEN unique_operands > 0 THEN unique_operators / 2 * (operands / unique_operands) ELSE 0.0 END AS difficulty FROM d2),
d4 AS (SELECT *, vocabulary * lg AS calc_length, length * lg AS volume, difficulty * length * lg AS effort,
  CASE WHEN unique_operands > 0 THEN difficulty / (vocabulary + length) ELSE 0.0 END AS complexity_density FROM d3),
d AS (SELECT *, CASE WHEN volume > 0 THEN greatest(171 - 5.2 * ln(volume) - 0.23 * cc - 16.2 * ln(lloc), 0) ELSE 171.0 END AS mi_wo,
  CASE WHEN volume > 0 THEN 50 * sin(sqrt(2.4 * cloc / loc)) ELSE 0.0 END AS cw FROM d4)"""
LOG = "lg AS (SELECT CAST(props->>'$.k' AS BIGINT) AS path, event_id, user_id, ts, event_type, value FROM events)"
BETTER = "CASE WHEN {0} IN ('click', 'view', 'purchase') THEN 'high' WHEN {0} = 'error' THEN 'low' ELSE 'none' END"
EDGES = """
rv AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, sum(l_extendedprice::DECIMAL(18,2)) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
e AS (SELECT src, dst FROM rv QUALIFY row_number() OVER (PARTITION BY src ORDER BY revenue DESC, dst) <= 3)"""
CLASSES = """
cl AS (SELECT n_nationkey::BIGINT AS name, n_regionkey::BIGINT AS package,
  coalesce((SELECT avg(s_acctbal::DECIMAL(18,2)) FROM supplier WHERE s_nationkey = n_nationkey) < (SELECT avg(s_acctbal::DECIMAL(18,2)) FROM supplier), false) AS is_abstract FROM nation)"""
COUPLED = f"""{EDGES}, {CLASSES},
cp AS (SELECT name, package, is_abstract, (SELECT count(*) FROM e WHERE src = name) AS uses, (SELECT count(*) FROM e JOIN cl k ON k.name = dst WHERE src = cl.name) AS uip,
  (SELECT count(*) FROM e WHERE dst = name) AS ub FROM cl),
ci AS (SELECT *, CASE WHEN uip + ub > 0 THEN uip / (uip + ub) ELSE 0.0 END AS inst FROM cp)"""
PACKAGES = f"""{COUPLED},
x AS (SELECT DISTINCT a.package AS p, b.package AS q, src, dst FROM e JOIN cl a ON a.name = src JOIN cl b ON b.name = dst WHERE a.package <> b.package),
pk AS (SELECT package, count(*) AS classes, sum(is_abstract::INT) / count(*) AS abstractness,
  (SELECT count(DISTINCT dst) FROM x WHERE p = package) AS uses, (SELECT count(DISTINCT src) FROM x WHERE q = package) AS used_by FROM cl GROUP BY package),
pi AS (SELECT *, CASE WHEN uses + used_by > 0 THEN uses / (uses + used_by) ELSE 0.0 END AS instability FROM pk)"""
#: Components by mutual reachability.
SCC = f"""{EDGES},
v AS (SELECT DISTINCT unnest([src, dst]) AS n FROM e),
rc AS (SELECT src AS a, dst AS b FROM e UNION SELECT rc.a, e.dst FROM rc JOIN e ON e.src = rc.b),
sc AS (SELECT n AS node, least(n, coalesce((SELECT min(r1.b) FROM rc r1 JOIN rc r2 ON r1.b = r2.a AND r2.b = r1.a WHERE r1.a = n), n)) AS scc FROM v),
cy AS (SELECT scc, count(*) AS cycle_length, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM sc GROUP BY scc)"""
MEASURED = f"""{DOC}, {LOG},
ch AS (SELECT path, count(DISTINCT event_id) AS churn, count(DISTINCT user_id) AS authors FROM lg GROUP BY path),
me AS (SELECT lang, avg(effort) AS mean_effort, avg(mi_wo + cw) AS mean_mi FROM d GROUP BY lang),
ms AS (SELECT d.*, mi_wo + cw AS mi, mean_effort, mean_mi, coalesce(churn, 0) AS churn, coalesce(authors, 0) AS authors,
  EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS has_test, unique_operands % 40 AS uses, operators % 4 AS lcom
  FROM d JOIN me USING (lang) LEFT JOIN ch ON ch.path = d.doc_id % 100)"""
PROBLEMS = f"""{MEASURED},
pr AS (
  SELECT doc_id, 'too_long' AS rule, 'WARNING' AS level FROM ms WHERE lloc > 20
  UNION ALL SELECT doc_id, 'god_class', 'ERROR' FROM ms WHERE (cc > 10)::INT + (uses > 10)::INT + (lcom > 1)::INT + (lloc > 20)::INT >= 3
  UNION ALL SELECT doc_id, 'too_complex_cc', 'ERROR' FROM ms WHERE cc > CASE WHEN lloc > 20 THEN 20 ELSE 10 END
  UNION ALL SELECT doc_id, 'too_complex_difficulty', 'ERROR' FROM ms WHERE lloc > 5 AND difficulty > 30
  UNION ALL SELECT doc_id, 'too_complex_effort', 'WARNING' FROM ms WHERE lloc > 5 AND effort > mean_effort * 1.3
  UNION ALL SELECT doc_id, 'too_complex_mi', 'WARNING' FROM ms WHERE lloc > 5 AND mi < mean_mi * 0.8
  UNION ALL SELECT doc_id, 'too_dependent', 'INFO' FROM ms WHERE uses > 20
  UNION ALL SELECT doc_id, 'untested_complex', 'WARNING' FROM ms WHERE lang <> 'es' AND NOT has_test AND cc >= 8
  UNION ALL SELECT doc_id, 'hotspot', 'WARNING' FROM ms WHERE churn >= 10 AND cc >= 15)"""
PRIORITY = f"""{PROBLEMS},
pc AS (SELECT doc_id, sum((level = 'ERROR')::INT)::BIGINT AS errors, sum((level = 'WARNING')::INT)::BIGINT AS warnings, sum((level = 'INFO')::INT)::BIGINT AS infos FROM pr GROUP BY doc_id),
pa AS (SELECT ms.*, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(infos, 0) AS infos, doc_id % 7 = 0 AS in_cycle, CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END AS cycle_length,
  doc_id % 3 AS lv, doc_id % 2 AS sv, unique_operators AS used_by, doc_id % 400 AS age FROM ms LEFT JOIN pc USING (doc_id)),
pb AS (SELECT *, least(errors * 12 + warnings * 4 + infos, 100)::DOUBLE AS s1, greatest(0, least(100, (cc - 5) * 4))::DOUBLE AS s2, greatest(0, least(100, (lcom - 1) * 20))::DOUBLE AS s3,
  greatest(0, least(100, (lloc - 100) * 0.25))::DOUBLE AS s4, least(CASE WHEN in_cycle THEN 30 ELSE 0 END + least(cycle_length * 5, 30) + least(lv * 10, 20) + least(sv * 5, 20), 100)::DOUBLE AS s5,
  errors + warnings + infos > 0 OR in_cycle OR lv > 0 OR sv > 0 OR lcom > 1 AS op FROM pa),
pp AS (SELECT *, CASE WHEN op THEN least(100.0::DOUBLE, round((s1 * 0.30::DOUBLE + s2 * 0.25::DOUBLE + s3 * 0.15::DOUBLE + s4 * 0.10::DOUBLE + s5 * 0.20::DOUBLE)
    * (1.0::DOUBLE + least(used_by * 0.04::DOUBLE, 0.4::DOUBLE) + least(churn * 0.015::DOUBLE, 0.3::DOUBLE) + least(authors * 0.05::DOUBLE, 0.15::DOUBLE)
      + CASE WHEN age > 0 AND age < 90 THEN 0.15::DOUBLE WHEN age > 0 AND age < 365 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END) / 2.0::DOUBLE, 1)) ELSE 0.0::DOUBLE END AS priority FROM pb)"""
PATHS = r"ph AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages)"
HALVES = f"""{LOG},
hb AS (SELECT * FROM lg WHERE ts < TIMESTAMP '2024-01-16'), ha AS (SELECT * FROM lg WHERE ts >= TIMESTAMP '2024-01-16'),
p1 AS (SELECT path AS entity, event_type AS message, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN count(*) > 3 THEN 'WARNING' ELSE 'INFO' END AS level FROM hb GROUP BY 1, 2 HAVING count(*) >= 2),
p2 AS (SELECT path AS entity, event_type AS message, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN count(*) > 3 THEN 'WARNING' ELSE 'INFO' END AS level FROM ha GROUP BY 1, 2 HAVING count(*) >= 2)"""
DAILY = f"""{LOG},
dl AS (SELECT event_type AS metric, ts::DATE AS run, count(*)::DOUBLE AS value, {BETTER.format('event_type')} AS better FROM lg GROUP BY 1, 2)"""
DUP = _tokens() + """,
wn AS (SELECT doc_id, i, md5(array_to_string(toks[i:i + 49], '|')) AS h FROM tk, unnest(range(1, greatest(len(toks) - 48, 1))) AS u(i) WHERE len(toks) >= 50),
sh AS (SELECT h FROM wn GROUP BY h HAVING count(DISTINCT doc_id) > 1),
dc AS (SELECT doc_id, count(*) AS k FROM wn WHERE h IN (SELECT h FROM sh) GROUP BY doc_id),
du AS (SELECT tk.doc_id, len(lns)::BIGINT AS loc, least(coalesce(k, 0), len(lns))::BIGINT AS duplicated_lines FROM tk LEFT JOIN dc USING (doc_id))"""
GNODES = """
gn AS (SELECT 'package:' || r_regionkey AS id, 'package' AS type, r_name AS name FROM region UNION ALL SELECT 'class:' || n_nationkey, 'class', n_name FROM nation
  UNION ALL SELECT 'function:' || s_suppkey, 'function', s_name FROM supplier UNION ALL SELECT 'method:' || p_partkey, 'method', p_name FROM part
  UNION ALL SELECT 'author:' || c_custkey, 'author', c_name FROM customer)"""
GEDGES = f"""{EDGES},
ge AS (SELECT 'class:' || n_nationkey AS source, 'package:' || n_regionkey AS target, 'belongs_to' AS type, 1::BIGINT AS weight FROM nation
  UNION ALL SELECT 'class:' || s_nationkey, 'function:' || s_suppkey, 'declares', 1 FROM supplier
  UNION ALL SELECT 'class:' || c_nationkey, 'author:' || c_custkey, 'authored_by', 1 FROM customer
  UNION ALL SELECT 'class:' || src, 'class:' || dst, 'depends_on', 1 FROM e
  UNION ALL SELECT 'method:' || l_partkey, 'function:' || l_suppkey, 'calls', count(*) FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def _w(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select}"


def _limits(entity: str, source: str, metric: str, expr: str) -> str:
    return f"SELECT '{entity}' AS entity, '{metric}' AS metric, round(min(v), 6) AS lo, round(greatest(max(v), 0.0), 6) AS hi, round(avg(v), 6) AS mean FROM (SELECT coalesce(({expr})::DOUBLE, 0.0) AS v FROM {source})"


def _rule(prefix: str) -> str:
    return _w(PROBLEMS, f"SELECT doc_id, rule, level FROM pr WHERE rule = '{prefix}' OR starts_with(rule, '{prefix}_')")


ORACLE: dict[str, str] = {
    "loc_by_document": _w(DOC, "SELECT doc_id, loc, cloc, lloc FROM d"),
    "cc_by_document": _w(DOC, "SELECT doc_id, cc FROM d"),
    "halstead_by_document": _w(DOC, """SELECT doc_id, operators, operands, unique_operators, unique_operands, vocabulary::BIGINT AS vocabulary, length::BIGINT AS length, round(calc_length, 6) AS calc_length,
      round(volume, 6) AS volume, round(difficulty, 6) AS difficulty, round(effort, 6) AS effort, round(complexity_density, 6) AS complexity_density FROM d"""),
    "maintainability_index": _w(DOC, "SELECT doc_id, round(mi_wo + cw, 6) AS mi, round(mi_wo, 6) AS mi_without_comments, round(cw, 6) AS comment_weight FROM d"),
    "variables_summary": _w(_tokens() + f""",
v AS (SELECT doc_id, list_filter(toks, lambda x: NOT regexp_matches(x, '^[.,;:!?|]$')) AS w FROM tk),
k AS (SELECT doc_id, list_filter(w, lambda x: lower(x) IN ({GLOBAL})) AS g, list_filter(w, lambda x: lower(x) NOT IN ({GLOBAL}) AND regexp_matches(x, '^[A-Z]{{2,}}$')) AS c,
  list_filter(w, lambda x: lower(x) NOT IN ({GLOBAL}) AND NOT regexp_matches(x, '^[A-Z]{{2,}}$')) AS o FROM v)""", """
SELECT doc_id, len(g)::BIGINT AS superglobals_used, len(list_distinct(g))::BIGINT AS distinct_superglobals_used, len(c)::BIGINT AS constants_used, len(list_distinct(c))::BIGINT AS distinct_constants_used,
  len(o)::BIGINT AS variables_used, len(list_distinct(o))::BIGINT AS distinct_variables_used,
  CASE WHEN len(g) + len(c) + len(o) > 0 THEN round((len(g) + len(c)) * 100.0::DOUBLE / (len(g) + len(c) + len(o)), 2) ELSE 0.0 END AS superglobal_metric FROM k"""),
    "cognitive_by_conversation": _w(_tokens("conversations", "conv_id, turn"), f"SELECT conv_id, sum(len(list_filter(toks, lambda x: lower(x) IN ({BRANCH}))) * (1 + turn))::BIGINT AS cognitive FROM tk GROUP BY conv_id"),
    "runtime_complexity_bucket": "SELECT CASE WHEN m <= 0 THEN 'O(1)' WHEN m = 1 THEN 'O(n)' WHEN m = 2 THEN 'O(n²)' ELSE 'O(n³+)' END AS runtime, count(*) AS n FROM (SELECT max(turn) AS m FROM conversations GROUP BY conv_id) GROUP BY 1",
    "duplication_rate": _w(DUP, "SELECT doc_id, duplicated_lines, round(duplicated_lines * 100 / loc, 2) AS duplication_rate FROM du"),
    "duplication_project": _w(DUP, "SELECT sum(duplicated_lines)::BIGINT AS duplicated_lines, round(sum(duplicated_lines) * 100.0::DOUBLE / sum(loc), 2) AS duplication_rate FROM du"),
    "limits_averages": _w(DOC, " UNION ALL ".join([
        _limits("document", "d", "cc", "cc"), _limits("document", "d", "mi", "mi_wo + cw"), _limits("document", "d", "difficulty", "difficulty"), _limits("document", "d", "effort", "effort"),
        _limits("part", "part", "p_size", "p_size"), _limits("part", "part", "p_retailprice", "p_retailprice"), _limits("event", "events", "value", "value")])),
    "most_complex_with_ties": _w(DOC, """SELECT 'document' AS entity, string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) AS names, max(cc) AS top FROM d WHERE cc = (SELECT max(cc) FROM d)
UNION ALL SELECT 'part', string_agg(p_partkey::VARCHAR, ', ' ORDER BY p_partkey), max(p_size)::BIGINT FROM part WHERE p_size = (SELECT max(p_size) FROM part)"""),
    "project_rollup": _w(DOC, """SELECT count(*) AS files, count(DISTINCT source) AS sources, sum(loc)::BIGINT AS loc, sum(lloc)::BIGINT AS lloc, sum(cloc)::BIGINT AS cloc, sum(cc)::BIGINT AS cc, max(cc) AS max_cc,
  round(avg(cc), 4) AS avg_cc, round(avg(mi_wo + cw), 4) AS avg_mi FROM d"""),
    "above_average_effort": _w(DOC, "SELECT doc_id, lang FROM d JOIN (SELECT lang, avg(effort) AS m FROM d GROUP BY lang) USING (lang) WHERE effort > m * 1.3 AND lloc > 5"),
    "package_assignment": _w(PATHS + r", pg AS (SELECT path, array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:2], '\') AS pk FROM ph)", "SELECT CASE WHEN pk = '' THEN '_global' ELSE pk END AS package, count(*) AS pages, count(DISTINCT path) AS paths FROM pg GROUP BY 1"),
    "common_path": """WITH p AS (SELECT string_split('corpus/texts/' || source || '/' || lang || '/' || doc_id, '/') AS s FROM documents),
q AS (SELECT i, min(s[i]) AS lo, max(s[i]) AS hi, count(s[i]) AS n FROM p, unnest(range(1, len(s) + 1)) AS u(i) GROUP BY i),
f AS (SELECT coalesce(min(i) FILTER (WHERE lo <> hi OR n <> (SELECT count(*) FROM p)), max(i) + 1) AS cut FROM q)
SELECT string_agg(lo, '/' ORDER BY i) AS common_path FROM q, f WHERE i < cut""",
    "relative_paths": _w(PATHS, "SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS base_name, regexp_replace(path, '/?[^/]*$', '') AS dir_name FROM ph"),
    "security_smells": """SELECT page_id, k AS smells, CASE WHEN contains(url, 'utm_') THEN 'ERROR' WHEN k > 0 THEN 'WARNING' END AS level FROM
  (SELECT page_id, url, (len(regexp_extract_all(html, '<script')) + len(regexp_extract_all(html, 'track\\(')))::BIGINT AS k FROM pages)""".replace("\\\\", "\\"),
    "too_much_html": """WITH p AS (SELECT page_id, length(html) AS a, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS t, len(regexp_extract_all(html, '<p>'))::BIGINT AS o FROM pages),
q AS (SELECT page_id, o, CASE WHEN a > 0 THEN 100 / a * (a - t) ELSE 0.0 END AS s FROM p)
SELECT page_id, round(s, 6) AS share, o AS outputs, CASE WHEN s > 25 OR o > 10 THEN 'WARNING' END AS level FROM q""",
    "rule_slug": """WITH p AS (SELECT DISTINCT p_name, p_type FROM part)
SELECT p_name, p_type, 'STR/size/' || left(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || ' / ' || p_type, '[^a-zA-Z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 60) AS slug FROM p""",
    "output_count": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "git_churn": _w(LOG, """SELECT path, count(DISTINCT event_id) AS churn, count(DISTINCT user_id) AS authors, md5((SELECT string_agg(u::VARCHAR, ',' ORDER BY u) FROM (SELECT DISTINCT user_id AS u FROM lg b WHERE b.path = a.path))) AS author_list_md5,
  CAST(round((epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts)))) / 86400) AS BIGINT) AS age_days FROM lg a GROUP BY path"""),
    "git_totals": _w(LOG, "SELECT count(DISTINCT event_id) AS commits, count(DISTINCT user_id) AS active_authors, min(ts)::DATE::VARCHAR AS since, max(ts)::DATE::VARCHAR AS until FROM lg"),
    "weekly_commits": _w(LOG, "SELECT date_trunc('week', ts)::DATE::VARCHAR AS week, count(DISTINCT event_id) AS commits FROM lg GROUP BY 1"),
    "author_rollup": _w(LOG + ", c AS (SELECT path, count(DISTINCT event_id) AS churn FROM lg GROUP BY path)", "SELECT author, count(*) AS files, sum(churn)::BIGINT AS churn FROM (SELECT DISTINCT user_id AS author, path FROM lg) JOIN c USING (path) GROUP BY author"),
    "hotspots_topk": _w(DOC + ", " + LOG + """,
c AS (SELECT path, count(DISTINCT event_id) AS churn FROM lg GROUP BY path), f AS (SELECT doc_id % 100 AS path, max(cc) AS cc FROM d GROUP BY 1),
j AS (SELECT path, coalesce(churn, 0) AS churn, coalesce(cc, 0) AS cc FROM c FULL JOIN f USING (path))""",
        "SELECT path, churn, cc, round(churn / greatest((SELECT max(churn) FROM j), 1), 3) AS frequency, churn * cc AS score FROM j WHERE churn > 0 OR cc > 0 ORDER BY score DESC, churn DESC, path LIMIT 50"),
    "hotspot_rule": _w(DOC + ", " + LOG + ", c AS (SELECT path, count(DISTINCT event_id) AS churn FROM lg GROUP BY path), f AS (SELECT doc_id % 100 AS path, max(cc) AS cc FROM d GROUP BY 1)", "SELECT path, churn, cc, 'WARNING' AS level FROM c JOIN f USING (path) WHERE churn >= 10 AND cc >= 15"),
    "history_delta": _w(DAILY + ", x AS (SELECT *, round(value - lag(value) OVER (PARTITION BY metric ORDER BY run), 2) AS delta FROM dl)", """SELECT metric, run::VARCHAR AS run, value, delta, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' WHEN delta = 0 THEN 'sideways' END AS direction,
  CASE WHEN delta = 0 OR better = 'none' THEN NULL WHEN better = 'high' THEN delta > 0 ELSE delta < 0 END AS is_better FROM x"""),
    "trend_series": _w(DAILY, "SELECT run::VARCHAR AS run, " + ", ".join(f"coalesce(max(value) FILTER (WHERE metric = '{m}'), 0.0) AS {m}" for m in ("click", "error", "purchase", "view")) + " FROM dl GROUP BY run"),
    "report_compare": _w(HALVES + ", a AS (SELECT event_type AS metric, count(*)::DOUBLE AS v FROM hb GROUP BY 1), b AS (SELECT event_type AS metric, count(*)::DOUBLE AS v FROM ha GROUP BY 1)", f"""SELECT metric, a.v AS before, b.v AS after, round(b.v - a.v, 2) AS delta,
  CASE {BETTER.format('metric')} WHEN 'low' THEN -round(b.v - a.v, 2) WHEN 'high' THEN round(b.v - a.v, 2) ELSE 0.0 END AS improvement FROM a FULL JOIN b USING (metric)"""),
    "new_resolved_problems": _w(HALVES, """SELECT *, 'new' AS change FROM p2 WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.entity = p2.entity AND p1.message = p2.message AND p1.level = p2.level)
UNION ALL SELECT *, 'resolved' FROM p1 WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p1.entity = p2.entity AND p1.message = p2.message AND p1.level = p2.level)"""),
    "level_compare": _w(HALVES + ", a AS (SELECT coalesce(level, 'Total') AS level, count(*) AS n FROM p1 GROUP BY ROLLUP (level)), b AS (SELECT coalesce(level, 'Total') AS level, count(*) AS n FROM p2 GROUP BY ROLLUP (level))", "SELECT level, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (level)"),
    "coupling_instability": _w(COUPLED, "SELECT name, uses, uip AS uses_in_project, ub AS used_by, round(inst, 6) AS instability FROM ci"),
    "coupling_totals": _w(COUPLED, """SELECT count(*) AS classes, round(avg(uses), 6) AS avg_uses, round(avg(ub), 6) AS avg_used_by, round(avg(inst), 6) AS avg_instability, round(sum(is_abstract::INT) / count(*), 6) AS abstractness,
  round(abs(sum(is_abstract::INT) / count(*) + avg(inst) - 1), 6) AS distance FROM ci"""),
    "package_abstractness": _w(PACKAGES, "SELECT package, classes, uses, used_by, round(abstractness, 6) AS abstractness, round(instability, 6) AS instability, round(abs(abstractness + instability - 1), 6) AS distance FROM pi"),
    "package_cohesion": _w(COUPLED, """SELECT package, members, relations, CASE WHEN members = 1 THEN 1.0 ELSE least(1.0, round((relations + 1) / members, 2)) END AS cohesion FROM (
  SELECT package, count(*) AS members, (SELECT count(*) FROM e JOIN cl a ON a.name = src JOIN cl b ON b.name = dst WHERE a.package = cl.package AND b.package = cl.package) AS relations FROM cl GROUP BY package)"""),
    "ai_scatter": _w(PACKAGES, "SELECT round(abstractness, 2) AS abstractness, round(instability, 2) AS instability, count(*) AS n, string_agg(package::VARCHAR, ', ' ORDER BY package::VARCHAR) AS packages FROM pi GROUP BY 1, 2"),
    "layer_violations": _w(COUPLED, """SELECT src AS name, count(*) AS violations, string_agg(ra.r_name || ' → ' || rb.r_name || ' (' || dst || ')', '; ' ORDER BY ra.r_name || ' → ' || rb.r_name || ' (' || dst || ')') AS list
FROM e JOIN cl a ON a.name = src JOIN cl b ON b.name = dst JOIN region ra ON ra.r_regionkey = a.package JOIN region rb ON rb.r_regionkey = b.package WHERE b.package > a.package GROUP BY src"""),
    "solid_checks": _w(COUPLED + """,
sz AS (SELECT name, (SELECT count(*) FROM customer WHERE c_nationkey = name) AS customers, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = name) AS segments FROM cl),
m AS (SELECT ci.name, is_abstract, customers % 40 AS mc, segments AS lcom, uses + ub * 3 AS u FROM ci JOIN sz USING (name)),
dp AS (SELECT src, round(100.0::DOUBLE * sum(is_abstract::INT) / count(*), 2) AS s FROM e JOIN cl ON cl.name = dst GROUP BY src),
f AS (SELECT name, mc > 15 AND lcom > 2 AND u > 8 AS srp, is_abstract AND mc > 10 AS isp, coalesce(s, 100.0) AS dip_score FROM m LEFT JOIN dp ON src = name)""",
        "SELECT *, CASE WHEN srp AND isp THEN 'SRP,ISP' WHEN srp THEN 'SRP' WHEN isp THEN 'ISP' ELSE '' END AS violations FROM f"),
    "dependency_cycles": _w(SCC, "SELECT * FROM cy WHERE cycle_length > 1", True),
    "dependency_cycle_members": _w(SCC, "SELECT node, scc, cycle_length, CASE WHEN cycle_length > 1 THEN 'ERROR' END AS level FROM sc JOIN cy USING (scc)", True),
    "impact_bfs": _w(EDGES + ", s1 AS (SELECT src AS node, src || '>7' AS path FROM e WHERE dst = 7), s2 AS (SELECT e.src AS node, min(e.src || '>' || s1.path) AS path FROM e JOIN s1 ON e.dst = s1.node WHERE e.src <> 7 AND e.src NOT IN (SELECT node FROM s1) GROUP BY e.src)", "SELECT node, 1::BIGINT AS depth, path FROM s1 UNION ALL SELECT node, 2, path FROM s2"),
    "forward_calls": _w(EDGES, "SELECT src, dst FROM e WHERE src = 7"),
    "degree_ranking": _w(EDGES, "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node ORDER BY degree DESC, node LIMIT 5"),
    "class_dependencies": _w(EDGES, "SELECT 'out' AS direction, dst AS other FROM e WHERE src = 3 UNION ALL SELECT 'in', src FROM e WHERE dst = 3"),
    "inheritance_depth": """WITH RECURSIVE t AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS parent FROM part),
r AS (SELECT node, 0::BIGINT AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.node, r.depth + 1 FROM t JOIN r ON t.parent = r.node)
SELECT node, depth, (SELECT count(*) FROM t c WHERE c.parent = r.node) AS children, CASE WHEN depth >= 6 THEN 'ERROR' WHEN depth >= 4 THEN 'WARNING' END AS level FROM r""",
    "dead_members": """WITH x AS (SELECT p_brand, p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate < TIMESTAMP '1995-04-01')),
y AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM x)
SELECT p_brand AS class_id, count(*) AS unused, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) FILTER (WHERE k <= 5) AS first_five, 'INFO' AS level FROM y GROUP BY p_brand""",
    "method_calls_weighted": "SELECT l_suppkey AS dst, count(DISTINCT l_partkey) AS callers, count(*) AS weight FROM lineitem GROUP BY l_suppkey",
    "type_coverage_weighted": """WITH c AS (SELECT p_brand, round(100 * (0.25::DOUBLE * (sum((p_size > 10)::INT) / count(*)) + 0.35::DOUBLE * (sum((p_type IN ('ECONOMY', 'SMALL', 'PROMO'))::INT) / count(*)) + 0.40::DOUBLE * (sum((p_retailprice > 950)::INT) / count(*))), 2) AS t FROM part GROUP BY p_brand)
SELECT p_brand, t AS type_coverage, CASE WHEN t < 40 THEN 'ERROR' WHEN t < 60 THEN 'WARNING' END AS level FROM c""",
    "doc_coverage": "SELECT lang, round(100.0::DOUBLE * count(l.doc_id) / count(*), 2) AS doc_coverage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang",
    "class_members": "SELECT p_brand AS class_id, count(*) AS method_count, count(*) FILTER (WHERE p_size % 3 <> 0) AS public_count, count(*) FILTER (WHERE p_size % 3 = 0) AS private_count, count(*) FILTER (WHERE p_size % 5 = 0) AS static_count FROM part GROUP BY p_brand",
    "too_many_parameters": "SELECT CASE WHEN k > 7 THEN 'ERROR' ELSE 'WARNING' END AS level, count(*) AS orders, max(k) AS most FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey) WHERE k > 4 GROUP BY 1",
    "problem_rows": _w(PROBLEMS, "SELECT * FROM pr"),
    **{r: _rule(r) for r in ("too_long", "too_complex", "too_dependent", "god_class", "untested_complex")},
    "problem_union_counts": _w(PROBLEMS, "SELECT coalesce(level, 'Total') AS level, count(*) AS n FROM pr GROUP BY ROLLUP (level)"),
    "rule_counts": _w(PROBLEMS, """SELECT regexp_replace(rule, '^too_complex_.*', 'too_complex') AS rule, count(*) AS n,
  CASE WHEN regexp_replace(rule, '^too_complex_.*', 'too_complex') IN ('god_class', 'too_complex') THEN 'ERROR' WHEN rule = 'too_dependent' THEN 'INFO' ELSE 'WARNING' END AS count_level FROM pr GROUP BY 1, 3"""),
    "technical_debt": _w(PROBLEMS + ", pt AS (SELECT doc_id, sum(CASE level WHEN 'ERROR' THEN 3.0 WHEN 'WARNING' THEN 1.0 ELSE 0.5 END)::DOUBLE AS p FROM pr GROUP BY doc_id)", "SELECT doc_id, coalesce(p, 0.0) AS points, round(coalesce(p, 0.0) / lloc * 100, 2) AS debt FROM ms LEFT JOIN pt USING (doc_id)"),
    "health_score": _w(PROBLEMS + "," + SCC + "," + CLASSES + """,
k AS (SELECT count(*) AS classes, sum(is_abstract::INT) / count(*) AS ab, avg(CASE WHEN u + b > 0 THEN u / (u + b) ELSE 0.0 END) AS ins FROM
  (SELECT is_abstract, (SELECT count(*) FROM e WHERE src = name) AS u, (SELECT count(*) FROM e WHERE dst = name) AS b FROM cl)),
q AS (SELECT avg(mi) AS mi, avg(cc) AS cc, sum(lloc) AS lloc, sum(loc) AS loc, sum(CASE WHEN lang = 'es' THEN lloc ELSE 0 END) AS outside, sum(cloc) AS html, count(*) AS files, sum(has_test::INT) AS tested,
  (SELECT count(*) FROM pr WHERE level = 'ERROR') AS errors, (SELECT count(*) FROM pr WHERE level = 'WARNING') AS warnings,
  (SELECT count(*) FROM cy WHERE cycle_length > 1) AS cycles, (SELECT coalesce(sum(cycle_length), 0)::BIGINT FROM cy WHERE cycle_length > 1) AS cic,
  (SELECT count(*) FROM part) AS m, (SELECT count(*) FROM part WHERE p_size % 3 <> 0) AS pub, (SELECT count(*) FROM part WHERE p_size % 5 = 0) AS st FROM ms),
z AS (SELECT 0.13 * greatest(0, least(100, (mi - 40) * 1.25)) + 0.09 * greatest(0, 100 - 30 * ln(1 + (errors + warnings) / greatest(classes + files, 1))) + 0.09 * greatest(0, least(100, 100 - (cc - 1) * 5))
  + 0.09 * greatest(0, least(100, (1 - abs(abs(ab + ins - 1))) * 100)) + 0.05 * greatest(0, (1 - outside / lloc) * 100) + 0.13 * 100 * pow(1 - html / loc, 3)
  + 0.13 * (0.6 * least(100, (m - pub) / m * 333) + 0.4 * greatest(0, least(100, 100 - greatest(0, st / m - 0.10) * 200)))
  + 0.09 * greatest(0, least(100, 100 * pow(1 - cic / classes, 2) - 5 * cycles)) + 0.10 * least(100, ab * 1000) + 0.10 * least(100, 100.0 * tested / files) AS h, errors, warnings, cycles, cic FROM q, k)""",
        "SELECT round(h, 4) AS health_score, CASE WHEN h >= 90 THEN 'A' WHEN h >= 80 THEN 'B' WHEN h >= 65 THEN 'C' WHEN h >= 50 THEN 'D' ELSE 'F' END AS health_grade, errors, warnings, cycles, cic AS classes_in_cycles FROM z", True),
    "refactoring_priority": _w(PRIORITY + """,
dr AS (SELECT *, list_filter([CASE WHEN op AND s2 >= 60 THEN 'high complexity' END, CASE WHEN op AND NOT has_test AND cc > 5 THEN 'untested' END, CASE WHEN op AND s3 >= 40 THEN 'low cohesion' END,
  CASE WHEN op AND s5 >= 40 AND in_cycle THEN 'dependency cycle' END, CASE WHEN op AND s5 >= 40 AND lv > 0 THEN 'layer violations' END, CASE WHEN op AND s5 >= 40 AND sv > 0 THEN 'SOLID violations' END,
  CASE WHEN op AND s1 >= 50 THEN 'many issues' END, CASE WHEN op AND s4 >= 50 THEN 'excessive size' END], lambda x: x IS NOT NULL) AS dv,
  list_filter([CASE WHEN op AND s2 >= 60 THEN 'CC=' || cc || ': extract methods, or split into strategies.' END, CASE WHEN op AND NOT has_test AND cc > 5 THEN 'No tests found: add them before changing this class.' END,
  CASE WHEN op AND s3 >= 40 THEN 'LCOM=' || lcom || ': split into focused classes.' END, CASE WHEN op AND s5 >= 40 AND in_cycle THEN 'In a cycle of ' || cycle_length || ' classes: break it with interfaces.' END,
  CASE WHEN op AND s5 >= 40 AND lv > 0 THEN lv || ' layer violation(s): depend on interfaces.' END, CASE WHEN op AND s1 >= 50 THEN errors || ' errors and ' || warnings || ' warnings: errors first.' END,
  CASE WHEN op AND s4 >= 50 THEN lloc || ' logical lines: extract helpers.' END], lambda x: x IS NOT NULL) AS rv2 FROM pp)""", """
SELECT doc_id, priority, CASE WHEN priority > 75 THEN 'CRITICAL' WHEN priority > 50 THEN 'HIGH' WHEN priority > 25 THEN 'MEDIUM' ELSE 'LOW' END AS urgency,
  CASE WHEN op AND len(dv) = 0 AND s2 > 0 THEN 'moderate complexity' ELSE array_to_string(dv, ',') END AS drivers,
  md5(CASE WHEN op AND len(dv) = 0 AND s2 > 0 THEN 'Minor issues: simplify when next changing this class.' ELSE array_to_string(rv2[1:3], ' ') END) AS recommendation_md5 FROM dr"""),
    "score_distribution": _w(PRIORITY, "SELECT CASE WHEN priority <= 0 THEN 'clean' WHEN priority <= 25 THEN 'low' WHEN priority <= 50 THEN 'medium' WHEN priority <= 75 THEN 'high' ELSE 'critical' END AS band, count(*) AS n FROM pp GROUP BY 1"),
    "priority_totals": _w(PRIORITY, "SELECT round(avg(priority), 1) AS avg_priority, max(priority) AS max_priority, count(*) FILTER (WHERE priority > 0) AS needing FROM pp"),
    "refactoring_ranking": _w(PRIORITY, "SELECT doc_id, priority, cc FROM pp WHERE priority > 0 ORDER BY priority DESC, doc_id LIMIT 15"),
    "test_mapping": r"""WITH c AS (SELECT 'Corpus\' || lang || '\D' || doc_id AS name, 'D' || doc_id AS short FROM documents),
t AS (SELECT item_id AS test, CASE item_id % 3 WHEN 0 THEN 'unit' WHEN 1 THEN 'integration' ELSE 'unknown' END AS tt FROM benchmark),
k AS (SELECT test, name, 1 AS p FROM t JOIN c ON short = 'D' || (test * 3) WHERE test % 4 = 0
  UNION SELECT test, name, 2 FROM t JOIN c ON name = 'Corpus\en\D' || (test + 1) WHERE tt = 'integration'
  UNION SELECT test, name, 3 FROM t JOIN c ON name = 'Corpus\en\D' || test UNION SELECT test, name, 4 FROM t JOIN c ON short = 'D' || test),
b AS (SELECT * FROM k QUALIFY p = min(p) OVER (PARTITION BY test))
SELECT name, count(DISTINCT test) AS tests, arg_min(tt, CASE tt WHEN 'unit' THEN 0 WHEN 'integration' THEN 1 ELSE 2 END) AS test_type FROM b JOIN t USING (test) GROUP BY name""",
    "coverage_totals": """WITH x AS (SELECT n_chars AS st, lang = 'es' AS ab, quality AS q FROM documents LEFT JOIN labels USING (doc_id)),
y AS (SELECT count(*) FILTER (WHERE coalesce(q = 1, false)) AS tested, count(*) FILTER (WHERE NOT coalesce(q = 1, false) AND NOT ab) AS untested, round(coalesce(sum(q * st) / sum(st) FILTER (WHERE q IS NOT NULL) * 100, 0.0), 2) AS coverage FROM x)
SELECT *, round(tested * 100.0::DOUBLE / (tested + untested), 2) AS ratio FROM y""",
    "coverage_suffix_join": _w(PATHS, "SELECT page_id, doc_id FROM ph JOIN documents ON path = lang || '/' || doc_id OR ends_with(path, '/' || lang || '/' || doc_id)"),
    "coverage_gaps": _w(DOC, "SELECT doc_id AS name, cc FROM d WHERE cc >= 8 AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY cc DESC, doc_id LIMIT 20"),
    "knowledge_graph_nodes": _w(GNODES, "SELECT * FROM gn"),
    "knowledge_graph_edges": _w(GEDGES, "SELECT * FROM ge"),
    "graph_histogram": _w(GNODES + "," + GEDGES, "SELECT type, count(*) AS n, 'node' AS part FROM gn GROUP BY type UNION ALL SELECT type, count(*), 'edge' FROM ge GROUP BY type"),
    "graph_clusters": "SELECT n_regionkey::BIGINT AS package, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS members FROM nation GROUP BY 1",
    "class_list": "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_size DESC, p_partkey LIMIT 50",
    "search_entities": "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'customer#00000012') ORDER BY c_name LIMIT 20",
    "entity_metrics": "SELECT p_partkey, 'size' AS metric, p_size::DOUBLE AS value FROM part WHERE contains(lower(p_name), 'widget') UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE contains(lower(p_name), 'widget')",
    "sarif_results": _w(PROBLEMS + ", sr AS (SELECT 'STR/' || level AS c, rule, level, doc_id::VARCHAR AS path FROM pr)", """SELECT 'STR/' || lower(level) || '/' || replace(rule, '_', '-') AS rule_id, count(*) AS n_results,
  md5('[' || string_agg('{"ruleId":"' || 'STR/' || lower(level) || '/' || replace(rule, '_', '-') || '","level":"' || CASE level WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'note' END || '","message":{"text":"' || rule || ' ' || path
    || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || path || '"},"region":{"startLine":1}}}]}', ',' ORDER BY path, rule) || ']') AS results_md5 FROM sr GROUP BY level, rule"""),
    "lcom_components": """WITH RECURSIVE li AS (SELECT DISTINCT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem),
e AS (SELECT l_suppkey, month, a AS x, b AS y FROM li UNION ALL SELECT l_suppkey, month, b, a FROM li),
r AS (SELECT l_suppkey, month, x AS node, x AS reach FROM e UNION SELECT e.l_suppkey, e.month, e.y, r.reach FROM r JOIN e ON e.l_suppkey = r.l_suppkey AND e.month = r.month AND e.x = r.node),
c AS (SELECT l_suppkey, month, node, min(reach) AS c FROM r GROUP BY 1, 2, 3),
s AS (SELECT l_suppkey, month, c, count(*) AS n FROM c GROUP BY 1, 2, 3)
SELECT l_suppkey, month, count(*) AS components, sum(n)::BIGINT AS nodes, max(n) AS largest FROM s GROUP BY 1, 2""",
}
