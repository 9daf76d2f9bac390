"""The registered queries of the core and their SQL."""

from __future__ import annotations

from factloom.plans import changes, facts, inheritance, occurrence_groups, packages, relations, selections

QUERIES = {
    "p3_found": occurrence_groups.p3_found,
    "p3_symbol_groups": occurrence_groups.p3_symbol_groups,
    "p4_found": inheritance.p4_found,
    "p4_paths": inheritance.p4_paths,
    "p4_descendants": inheritance.p4_descendants,
    "inheritance_closure": inheritance.inheritance_closure,
    "conformers": inheritance.conformers,
}

_OCC = "SELECT DISTINCT usr, module, file, line, col, roles FROM occurrences WHERE usr IS NOT NULL AND usr <> ''"

#: Newest state of each type, its entries without attributes, generic arguments and outer spaces, and superclass links.
_LINKS = r"""
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type_id ORDER BY observed_at DESC NULLS LAST, received_at DESC NULLS LAST) AS rn
      FROM type_decls WHERE type_id IS NOT NULL) WHERE rn = 1 AND keyword = 'class'),
c AS (SELECT module, qualified_name, min(type_id) AS parent FROM t GROUP BY ALL),
x AS (SELECT type_id, module, unnest(inherited) AS e, generate_subscripts(inherited, 1) AS pos FROM t),
y AS (SELECT type_id, module, pos, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        trim(e, ' ' || chr(9)), '^(@[A-Za-z_]\w*(\([^)]*\))?\s+)+', ''), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g')) AS e FROM x),
h AS (SELECT y.type_id, pos, 0 AS rank, parent FROM y JOIN c ON c.module = y.module AND c.qualified_name = y.e
      UNION ALL SELECT y.type_id, pos, 1, parent FROM y JOIN c ON strpos(y.e, '.') > 0 AND c.module = split_part(y.e, '.', 1) AND c.qualified_name = substr(y.e, strpos(y.e, '.') + 1)),
l AS (SELECT type_id AS node, arg_min(parent, (pos, rank)) AS parent FROM h GROUP BY type_id),
up AS (SELECT node, parent AS anc, CAST(1 AS INT) AS d FROM l UNION ALL SELECT up.node, l.parent, up.d + 1 FROM up JOIN l ON up.anc = l.node WHERE up.d < 1000),
r AS (SELECT node, arg_max(anc, d) AS root, max(d) AS depth FROM up GROUP BY node),
tree AS (SELECT * FROM r WHERE depth < 1000)"""

_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(e, ' ' || chr(9)), '^(@[A-Za-z_]\w*(\([^)]*\))?\s+)+', ''), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'))"
_CLOSURE = _LINKS + f""",
nt AS (SELECT type_id, module, qualified_name, inherited FROM (SELECT *, row_number() OVER (PARTITION BY type_id ORDER BY observed_at DESC NULLS LAST, received_at DESC NULLS LAST) AS rn FROM type_decls WHERE type_id IS NOT NULL) WHERE rn = 1),
en AS (SELECT DISTINCT type_id, {_PLAIN} AS name FROM (SELECT type_id, unnest(inherited) AS e FROM nt)),
pa AS (SELECT type_id AS node, type_id AS anc, 0 AS d FROM nt UNION ALL SELECT node, anc, min(d) FROM up GROUP BY node, anc),
cl AS (SELECT pa.node, en.name, min(pa.d) AS level FROM pa JOIN en ON en.type_id = pa.anc WHERE en.name <> '' GROUP BY 1, 2)"""

SQL = {
    "inheritance_closure": f"WITH RECURSIVE {_CLOSURE} SELECT node, name, CAST(level AS INT) AS level FROM cl",
    "conformers": f"WITH RECURSIVE {_CLOSURE} SELECT type_id, module, qualified_name FROM nt WHERE type_id IN (SELECT node FROM cl WHERE name = 'Codable')",
    "p3_found": f"WITH d AS ({_OCC}) SELECT usr FROM d GROUP BY usr HAVING count(*) >= 0.02 * (SELECT count(*) FROM (SELECT DISTINCT usr, module, file, line, col, roles FROM occurrences))",
    "p3_symbol_groups": f"""WITH d AS ({_OCC}), r AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY module NULLS FIRST, file NULLS FIRST, line NULLS FIRST, col NULLS FIRST, roles NULLS FIRST) AS k FROM d),
g AS (SELECT usr, count(*) AS n_occurrences, count(DISTINCT module) AS n_modules FROM d GROUP BY usr)
SELECT g.usr, n_occurrences, n_modules, module AS first_module, file AS first_file, line AS first_line, col AS first_col, roles AS first_roles FROM g JOIN r ON r.usr = g.usr AND k = 1""",
    "p4_found": f"WITH RECURSIVE {_LINKS} SELECT l.node AS type_id, coalesce(tree.root, -1) AS root_id, CAST(coalesce(tree.depth, -1) AS BIGINT) AS depth FROM l LEFT JOIN tree ON l.node = tree.node",
    "p4_paths": f"""WITH RECURSIVE {_LINKS}, nodes AS (SELECT node FROM l UNION SELECT parent FROM l), ring AS (SELECT DISTINCT node FROM up WHERE node = anc),
lab AS (SELECT type_id, concat_ws('.', module, qualified_name) AS label FROM t),
chain AS (SELECT up.node, up.anc, up.d FROM up JOIN tree ON tree.node = up.node UNION ALL SELECT node, node, 0 FROM nodes),
p AS (SELECT node, string_agg(label, ' > ' ORDER BY d DESC) AS path FROM chain JOIN lab ON lab.type_id = anc GROUP BY node),
b AS (SELECT anc AS node, count(*) AS n, max(d) AS h FROM up JOIN tree ON tree.node = up.node GROUP BY anc),
s AS (SELECT node, CASE WHEN node IN (SELECT node FROM ring) THEN 'cycle' WHEN node IN (SELECT node FROM l) AND node NOT IN (SELECT node FROM tree) THEN 'below_cycle' ELSE 'tree' END AS state FROM nodes)
SELECT s.node AS type_id, l.parent, CASE WHEN state = 'tree' THEN coalesce(tree.root, s.node) END AS root, CASE WHEN state = 'tree' THEN CAST(coalesce(tree.depth, 0) AS INT) END AS depth, state,
CASE WHEN state = 'tree' THEN p.path END AS path, CASE WHEN state = 'tree' THEN coalesce(b.n, 0) END AS n_descendants, CASE WHEN state = 'tree' THEN CAST(coalesce(b.h, 0) AS INT) END AS height
FROM s LEFT JOIN l ON l.node = s.node LEFT JOIN tree ON tree.node = s.node LEFT JOIN p ON p.node = s.node LEFT JOIN b ON b.node = s.node""",
    "p4_descendants": f"WITH RECURSIVE {_LINKS} SELECT up.anc AS ancestor, up.node AS descendant, up.d AS distance FROM up JOIN tree ON tree.node = up.node",
}

for _part in (selections, relations, packages, changes):
    QUERIES |= _part.Q
    SQL |= _part.SQL
QUERIES |= facts.Q
SQL |= facts.SQL
