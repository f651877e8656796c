"""Queries that flatten nested issue records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.operators import nested
from threadloom.session import table


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    return nested.issue_records(table(spark, d, "raw_record"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.typed_found(table(spark, d, "raw_issue")).unionByName(nested.found_children(nested.issue_children(_payloads(spark, d)))).distinct()


def _kind(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        read = nested.child_table(nested.issue_children(_payloads(spark, d), kind), kind)
        return nested.typed_children(table(spark, d, "raw_issue"), kind).unionByName(read).distinct()

    return query


def p3_rejects(spark: SparkSession, d: str) -> DataFrame:
    return nested.rejects(table(spark, d, "raw_record"), "snapshot_id", "payload")


def _typed(kind: str):
    """The same for the typed rows alone, which SQL can check."""
    return lambda spark, d: nested.typed_children(table(spark, d, "raw_issue"), kind)


def queries() -> dict:
    both = {"p3_labels": "label", "p3_comments": "comment", "p3_timeline_items": "timeline_item", "p3_sources": "source"}
    return {"p3_found": p3_found, **{n: _kind(k) for n, k in both.items()}, "p3_rejects": p3_rejects, **{n.replace("p3_", "p3_typed_"): _typed(k) for n, k in both.items()}}


_ITEMS = """
i AS (SELECT snapshot_id, unnest(timelineItems) AS e, generate_subscripts(timelineItems, 1) AS k FROM (SELECT DISTINCT snapshot_id, timelineItems FROM raw_issue)),
t AS (SELECT snapshot_id, k - 1 AS child_pos, e FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, e ORDER BY k) AS nth FROM i WHERE e IS NOT NULL) WHERE nth = 1)"""


_LIST = """from_json({0}, '["json"]')"""


def _unwrapped(v: str) -> str:
    """A list of the elements of an array or of what it comes wrapped in; null if it is neither."""
    edge = "list_transform(" + _LIST.format(f"{v}->'edges'") + ", lambda e: CASE WHEN json_type(e) = 'OBJECT' THEN e->'node' ELSE e END)"
    return f"CASE WHEN json_type({v}) = 'ARRAY' THEN {_LIST.format(v)} WHEN json_type({v}) = 'OBJECT' AND json_type({v}->'nodes') = 'ARRAY' THEN {_LIST.format(f'{v}->{chr(39)}nodes{chr(39)}')} WHEN json_type({v}) = 'OBJECT' AND json_type({v}->'edges') = 'ARRAY' THEN {edge} END"


_FOUND = f"""
WITH p AS (SELECT DISTINCT snapshot_id, payload::JSON AS j FROM raw_record WHERE json_valid(payload)),
x AS (SELECT snapshot_id, unnest(CASE json_type(j) WHEN 'ARRAY' THEN {_LIST.format("j")} ELSE [j] END) AS j, generate_subscripts(CASE json_type(j) WHEN 'ARRAY' THEN {_LIST.format("j")} ELSE [j] END, 1) AS page FROM p),
r AS (SELECT snapshot_id, page, CASE WHEN json_type(j->'data'->'repository'->'issue') = 'OBJECT' THEN j->'data'->'repository'->'issue' ELSE j END AS j FROM x WHERE json_type(j) = 'OBJECT'),
c AS (SELECT snapshot_id, page, 'label' AS kind, j->'labels' AS v FROM r UNION ALL SELECT snapshot_id, page, 'comment', j->'comments' FROM r UNION ALL SELECT snapshot_id, page, 'timeline_item', j->'timelineItems' FROM r),
d AS (SELECT snapshot_id, page, kind, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v->>'$') THEN CASE WHEN json_type((v->>'$')::JSON) IN ('ARRAY', 'OBJECT') THEN (v->>'$')::JSON ELSE v END ELSE v END AS v FROM c WHERE v IS NOT NULL AND json_type(v) <> 'NULL'),
u AS (SELECT snapshot_id, page, kind, coalesce({_unwrapped("v")}, CASE WHEN json_type(v->'pages') = 'ARRAY' THEN flatten(list_transform({_LIST.format("v->'pages'")}, lambda q: coalesce({_unwrapped("q")}, []))) END, [v]) AS l FROM d),
w AS (SELECT snapshot_id, kind, flatten(list(l ORDER BY page)) AS l FROM u GROUP BY ALL),
e AS (SELECT snapshot_id, kind, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM w),
k AS (SELECT *, CASE WHEN kind = 'label' THEN CASE json_type(e) WHEN 'OBJECT' THEN e->>'name' ELSE e->>'$' END WHEN json_type(e) = 'OBJECT' THEN CASE kind WHEN 'comment' THEN coalesce(e->>'id', chr(1) || pos)
  ELSE from_json(e, '{{"__typename":"VARCHAR","createdAt":"VARCHAR","actor":{{"login":"VARCHAR"}},"willCloseTarget":"VARCHAR","stateReason":"VARCHAR","label":{{"name":"VARCHAR"}},"source":{{"__typename":"VARCHAR","number":"VARCHAR","url":"VARCHAR","title":"VARCHAR","state":"VARCHAR","merged":"VARCHAR","mergedAt":"VARCHAR"}}}}')::VARCHAR END END AS key FROM e),
f AS (SELECT snapshot_id, kind, min(pos) AS pos, max(json_type(e->'source')) AS source FROM k WHERE key IS NOT NULL AND (kind <> 'label' OR regexp_replace(key, '^\\s+|\\s+$', '', 'g') <> '') GROUP BY snapshot_id, kind, key),
{_ITEMS},
l AS (SELECT snapshot_id, unnest(labels).name AS name, generate_subscripts(labels, 1) - 1 AS pos FROM raw_issue),
m AS (SELECT snapshot_id, unnest(comments) AS c, generate_subscripts(comments, 1) - 1 AS pos FROM raw_issue)
SELECT snapshot_id, kind AS child_kind, pos::INTEGER AS child_pos FROM f UNION SELECT snapshot_id, 'source', pos::INTEGER FROM f WHERE source = 'OBJECT'
UNION SELECT snapshot_id, 'label', min(pos)::INTEGER FROM l WHERE regexp_replace(name, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY snapshot_id, name
UNION SELECT snapshot_id, 'comment', min(pos)::INTEGER FROM m WHERE c IS NOT NULL GROUP BY snapshot_id, coalesce(c.id, chr(1) || pos)
UNION SELECT snapshot_id, 'timeline_item', child_pos::INTEGER FROM t UNION SELECT snapshot_id, 'source', child_pos::INTEGER FROM t WHERE e.source IS NOT NULL"""


#: The flat tables of payloads: what of an element each column is.
_PAYLOAD = {
    "p3_labels": ("label", "CASE json_type(e) WHEN 'OBJECT' THEN e->>'name' ELSE e->>'$' END AS name"),
    "p3_comments": ("comment", "e->>'id' AS id, e->>'url' AS url, e->>'body' AS body, e->>'createdAt' AS created_at, e->>'authorAssociation' AS author_association, e->'author'->>'login' AS author_login"),
    "p3_timeline_items": ("timeline_item", "e->>'__typename' AS event_type, e->>'createdAt' AS created_at, e->'actor'->>'login' AS actor_login, try_cast(e->>'willCloseTarget' AS BOOLEAN) AS will_close_target, e->>'stateReason' AS state_reason, e->'label'->>'name' AS label_name"),
    "p3_sources": ("timeline_item", "e->'source'->>'__typename' AS source_type, try_cast(e->'source'->>'number' AS BIGINT) AS number, e->'source'->>'url' AS url, e->'source'->>'title' AS title, e->'source'->>'state' AS state, try_cast(e->'source'->>'merged' AS BOOLEAN) AS merged, e->'source'->>'mergedAt' AS merged_at"),
}


def _with_payloads(name: str, typed: str) -> str:
    kind, columns = _PAYLOAD[name]
    first = _FOUND[: _FOUND.rindex("\nSELECT snapshot_id, kind AS child_kind")]
    only = " AND f.source = 'OBJECT'" if name == "p3_sources" else ""
    return first + f"\nSELECT f.snapshot_id, f.pos AS child_pos, {columns} FROM f JOIN e ON e.snapshot_id = f.snapshot_id AND e.kind = f.kind AND e.pos = f.pos WHERE f.kind = '{kind}'{only} UNION SELECT * FROM ({typed})"


def oracle_sql() -> dict[str, str]:
    typed = _typed_sql()
    return typed | {n: _with_payloads(n, typed[n.replace("p3_", "p3_typed_")]) for n in _PAYLOAD}


def _typed_sql() -> dict[str, str]:
    return {
        "p3_found": _FOUND,
        "p3_rejects": "SELECT DISTINCT snapshot_id AS record_id, CASE WHEN payload IS NULL THEN 'null' ELSE 'invalid' END AS reason FROM raw_record WHERE payload IS NULL OR NOT json_valid(payload)",
        "p3_typed_labels": r"""WITH i AS (SELECT snapshot_id, unnest(labels).name AS name, generate_subscripts(labels, 1) AS k FROM (SELECT DISTINCT snapshot_id, labels FROM raw_issue))
SELECT snapshot_id, min(k) - 1 AS child_pos, name FROM i WHERE regexp_replace(name, '^\s+|\s+$', '', 'g') <> '' GROUP BY snapshot_id, name""",
        "p3_typed_comments": """WITH i AS (SELECT snapshot_id, unnest(comments) AS c, generate_subscripts(comments, 1) AS k FROM (SELECT DISTINCT snapshot_id, comments FROM raw_issue)),
n AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, c.id ORDER BY k) AS nth FROM i WHERE c IS NOT NULL)
SELECT snapshot_id, k - 1 AS child_pos, c.id AS id, c.url AS url, c.body AS body, c.createdAt AS created_at, c.authorAssociation AS author_association, c.author.login AS author_login FROM n WHERE c.id IS NULL OR nth = 1""",
        "p3_typed_timeline_items": f"WITH {_ITEMS} SELECT snapshot_id, child_pos, e.__typename AS event_type, e.createdAt AS created_at, e.actor.login AS actor_login, e.willCloseTarget AS will_close_target, e.stateReason AS state_reason, e.label.name AS label_name FROM t",
        "p3_typed_sources": f"WITH {_ITEMS} SELECT snapshot_id, child_pos, e.source.__typename AS source_type, e.source.number AS number, e.source.url AS url, e.source.title AS title, e.source.state AS state, e.source.merged AS merged, e.source.mergedAt AS merged_at FROM t WHERE e.source IS NOT NULL",
    }
