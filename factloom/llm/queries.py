"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from factloom.llm import leaks, mixture, sources, spam, survivors

QUERIES = {
    "p1_found": sources.p1_found,
    "p1_faults": sources.p1_faults,
    "p1_rates": sources.p1_rates,
    "p2_found": sources.p2_found,
    "p2_pairs": sources.p2_pairs,
    "p5_found": survivors.p5_found,
    "p5_survivors": survivors.p5_survivors,
    "p6_found": leaks.p6_found,
    "p6_items": leaks.p6_items,
    "p7_mix": mixture.p7_mix,
    "p7_shares": mixture.p7_shares,
    "p8_found": spam.p8_found,
    "p8_scores": spam.p8_scores,
}

_MISSING = "('" + "', '".join(survivors.MISSING) + "')"


def _present(c: str) -> str:
    v = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN lower({v}) NOT IN {_MISSING} THEN {v} END"


def _without_dots(c: str, rounds: int = 6) -> str:
    """Parts that go up are taken away with the part before them, innermost first."""
    p = rf"regexp_replace(regexp_replace({c}, '/(\./|/)+', '/', 'g'), '/(\./)+', '/', 'g')"
    for _ in range(rounds):
        p = rf"regexp_replace({p}, '/[^/]+/\.\./', '/')"
    return p


#: Records with cleaned values, their group, what the order of survivors needs.
_UNITS = rf"""v AS (SELECT unit_id, {_present('module_name')} AS m, {_present('main_file')} AS f, {_present('output_file')} AS o, {_present('toolchain')} AS c, {_present('target_triple')} AS t, recorded_at AS ts, is_swiftpm_plugin_tool AS flag FROM index_units WHERE unit_id IS NOT NULL),
u AS (SELECT *, coalesce(m, nullif(regexp_extract(o, '(?:^|/)([^/]+?)(-tool)?\.build/', 1), '')) AS module, CASE WHEN starts_with(f, 'file:') THEN url_decode(substr(f, 8)) ELSE f END AS p,
  coalesce(regexp_matches(o, '(?:^|/)[^/]*-tool\.build/'), false) AS tool, (m IS NOT NULL)::INT + (o IS NOT NULL)::INT + (c IS NOT NULL)::INT + (t IS NOT NULL)::INT + (ts IS NOT NULL)::INT AS n FROM v),
k AS (SELECT *, {_without_dots('p')} AS path FROM u),
q AS (SELECT *, CASE WHEN module IS NULL OR path IS NULL THEN unit_id END AS own FROM k),
r AS (SELECT *, row_number() OVER w AS rn, min(unit_id) OVER g AS group_id, count(*) OVER g AS records FROM q WINDOW g AS (PARTITION BY module, path, own), w AS (PARTITION BY module, path, own ORDER BY tool, n DESC, ts DESC NULLS LAST, unit_id DESC))"""

#: The currency of values: states of each group, transitions between patterns over all groups, the latest value.
_CURRENT = r"""ls AS (SELECT module, path, own, ts, unit_id, 'output_file' AS field, o AS val, regexp_replace(regexp_replace(o, '[^/]*$', ''), '[^/]+?((?:-tool)?\.build/)', '*\1', 'g') AS pattern, coalesce(regexp_matches(o, '\.build/|/debug/|/release/'), false) AS trust FROM q WHERE o IS NOT NULL
  UNION ALL SELECT module, path, own, ts, unit_id, 'is_plugin_tool', CAST(x AS VARCHAR), CAST(x AS VARCHAR), flag IS NOT NULL FROM (SELECT *, coalesce(flag, CASE WHEN o IS NOT NULL THEN tool END) AS x FROM q) WHERE x IS NOT NULL),
s0 AS (SELECT module, path, own, field, pattern, trust, max((ts, unit_id)) FILTER (WHERE ts IS NOT NULL) AS at_, arg_max(val, (ts, unit_id)) FILTER (WHERE ts IS NOT NULL) AS timed, arg_max(val, unit_id) FILTER (WHERE ts IS NULL) AS untimed, max(unit_id) FILTER (WHERE ts IS NULL) AS untimed_id FROM ls GROUP BY 1, 2, 3, 4, 5, 6),
s1 AS (SELECT * FROM (SELECT *, bool_or(trust) OVER (PARTITION BY module, path, own, field) AS most FROM s0) WHERE trust = most),
s2 AS (SELECT s1.*, x.top FROM s1 LEFT JOIN (SELECT module, path, own, field, arg_max(pattern, at_) AS top FROM s1 WHERE at_ IS NOT NULL GROUP BY 1, 2, 3, 4) x
  ON x.module IS NOT DISTINCT FROM s1.module AND x.path IS NOT DISTINCT FROM s1.path AND x.own IS NOT DISTINCT FROM s1.own AND x.field = s1.field),
st AS (SELECT field, pattern AS a, lead(pattern) OVER (PARTITION BY module, path, own, field ORDER BY at_) AS b FROM s1 WHERE at_ IS NOT NULL AND path IS NOT NULL),
le AS (SELECT field, a, b, sum(i) AS n FROM (SELECT field, a, b, 1 AS i FROM st WHERE b IS NOT NULL UNION ALL SELECT field, b, a, -1 FROM st WHERE b IS NOT NULL) GROUP BY 1, 2, 3 HAVING sum(i) > 0),
la AS (SELECT s2.*, le.n FROM s2 LEFT JOIN le ON le.field = s2.field AND le.a = s2.top AND le.b = s2.pattern WHERE at_ IS NULL AND (top IS NULL OR le.n IS NOT NULL)),
ca AS (SELECT module, path, own, field, timed AS val, 0 AS level, true AS latest, 0 AS n, 0 AS untimed_id FROM s2 WHERE pattern = top AND at_ IS NOT NULL
  UNION ALL SELECT module, path, own, field, untimed, 1, NOT EXISTS (SELECT 1 FROM la y JOIN le ON le.field = y.field AND le.a = la.pattern AND le.b = y.pattern WHERE y.module IS NOT DISTINCT FROM la.module AND y.path IS NOT DISTINCT FROM la.path AND y.own IS NOT DISTINCT FROM la.own AND y.field = la.field AND y.pattern <> la.pattern), coalesce(n, 0), untimed_id FROM la),
cu AS (SELECT module, path, own, max(val) FILTER (WHERE field = 'output_file') AS output_file, CAST(max(val) FILTER (WHERE field = 'is_plugin_tool') AS BOOLEAN) AS is_plugin_tool
  FROM (SELECT *, row_number() OVER (PARTITION BY module, path, own, field ORDER BY level DESC, latest DESC, n DESC, untimed_id DESC) AS z FROM ca) WHERE z = 1 GROUP BY 1, 2, 3)"""

SQL: dict[str, str] = {
    "p5_found": f"WITH {_UNITS} SELECT group_id, unit_id AS survivor_id FROM r WHERE rn = 1 AND records > 1 AND own IS NULL",
    "p5_survivors": f"""WITH {_UNITS}, {_CURRENT} SELECT group_id, unit_id AS survivor_id, records AS n_records, r.module AS module_name, r.path AS main_file, output_file, is_plugin_tool
FROM r LEFT JOIN cu ON cu.module IS NOT DISTINCT FROM r.module AND cu.path IS NOT DISTINCT FROM r.path AND cu.own IS NOT DISTINCT FROM r.own WHERE rn = 1""",
}
