"""Deeply nested records to flat tables: path-value-ordinal triples, grouped by repeated ancestor, pivoted.

A record (JSON text) is read as a stream (`json_stream`): each element of a collection is turned into triples ``(path, ordinals,
value)`` as it is reached. A path such as ``timelineItems[].actor.login`` names where a scalar stands, the ordinals say in which
element of each repeated ancestor. Triples that share the same repeated ancestor belong to the same table; each element
becomes one row there, keyed by ``(record, ordinals)``, and ``ordinals`` without its last entry is the key of the parent row. Nothing
is shuffled: a record's triples never leave its task.

Shapes that mean the same give the same rows. A declared collection may stand as an array, as ``{nodes: [...]}``,
``{edges: [{node: ...}]}``, ``{pages: [...]}`` of either (ordinals run on over pages), as JSON text, or as a lone
element at ordinal 0.

Records that are typed already (`typed_children`) are flattened by the engine's own generators and need no Python.
"""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.json_stream import Pivot, Reader, ShredSpec

SHRED_SCHEMA = (
    "record_id long, relation string, ordinals array<int>, is_null boolean, is_first boolean, "
    "fields map<string,string>"
)


#: The children of an issue record.
ISSUE_SPEC = ShredSpec(
    roots=(("data", "repository", "issue"),),
    collections=frozenset({"labels", "comments", "timelineItems"}),
    promoted=frozenset({"timelineItems[].source"}),
    identity={"labels[]": ("name", ""), "comments[]": ("id",), "timelineItems[]": ()},
)


def shred(df: DataFrame, record_id: str | Column, text: str | Column, spec: ShredSpec = ISSUE_SPEC) -> DataFrame:
    """Rows of all relations of each record: ``record_id, relation, ordinals, is_null, is_first, fields``.

    Null text, text that is no JSON and JSON that is no object or array of objects give no rows (`rejects` lists the first two).
    Null elements keep their ordinal and come out with is_null; elements that repeat an earlier identity come out with
    is_first false. Empty arrays give no row. Repeated input rows give repeated output rows. Of a key that repeats in an object the last counts.
    """
    pivot = Pivot(spec)

    def rows_of(text: str):
        try:
            return Reader(text, pivot).rows()
        except ValueError:
            return ()

    kind = pa.schema([("record_id", pa.int64()), ("relation", pa.string()), ("ordinals", pa.list_(pa.int32())), ("is_null", pa.bool_()), ("is_first", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string()))])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, t in zip(ids, texts, strict=True):
                if t is None:
                    continue
                for relation, ordinals, null, mark, fields in rows_of(t):
                    for column, value in zip(out, (i, relation, ordinals, null, mark, list(fields.items())), strict=True):
                        column.append(value)
                    if len(out[0]) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind, strict=True)], schema=kind)
                        out = ([], [], [], [], [], [])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind, strict=True)], schema=kind)

    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(as_col(record_id).cast("long").alias("record_id"), as_col(text).cast("string").alias("text")).mapInArrow(run, SHRED_SCHEMA)


def rejects(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """Records whose text is null or isn't JSON, as ``record_id, reason``: those that `shred` can't read, by the same reader."""

    def run(batches):
        for batch in batches:
            ids, why = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    reader = Reader(t or "")
                    if t is not None and reader.space(reader.skip(reader.space(0))) == len(t):
                        continue
                except ValueError:
                    pass
                ids.append(i)
                why.append("null" if t is None else "invalid")
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(why, pa.string())], ["record_id", "reason"])

    return df.select(F.col(record_id).cast("long").alias("record_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "record_id long, reason string").distinct()


# ---------------------------------------------------------------- the issue's children

KINDS = {"labels[]": "label", "comments[]": "comment", "timelineItems[]": "timeline_item", "timelineItems[].source": "source"}

#: Columns of each flat table: name, type, paths in the relation of which the first non-null counts.
TABLES: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {
    "label": [("name", "string", ("name", ""))],
    "comment": [("id", "string", ("id",)), ("url", "string", ("url",)), ("body", "string", ("body",)), ("created_at", "string", ("createdAt",)), ("author_association", "string", ("authorAssociation",)), ("author_login", "string", ("author.login",))],
    "timeline_item": [("event_type", "string", ("__typename",)), ("created_at", "string", ("createdAt",)), ("actor_login", "string", ("actor.login",)), ("will_close_target", "boolean", ("willCloseTarget",)), ("state_reason", "string", ("stateReason",)), ("label_name", "string", ("label.name",))],
    "source": [("source_type", "string", ("__typename",)), ("number", "long", ("number",)), ("url", "string", ("url",)), ("title", "string", ("title",)), ("state", "string", ("state",)), ("merged", "boolean", ("merged",)), ("merged_at", "string", ("mergedAt",))],
}


def issue_records(raw_record: DataFrame) -> DataFrame:
    """The payloads as ``snapshot_id, text``."""
    return raw_record.select("snapshot_id", F.col("payload").alias("text"))


def issue_children(records: DataFrame, kind: str | None = None) -> DataFrame:
    """All children in payloads: ``snapshot_id, child_kind, child_pos, is_case, fields``; with the fields that a case is told by, or
    those of the flat table of one kind.

    A child is a case unless its element is null, it repeats an earlier one, or (labels) its name is null or blank.
    A source has its timeline item's place and is a case with it.
    """
    told = {"labels[]": frozenset(("name", "")), "comments[]": frozenset(("",)), "timelineItems[]": frozenset(("",)), "timelineItems[].source": frozenset(("",))}
    wanted = {r: f | (frozenset(p for _, _, paths in TABLES[kind] for p in paths) if kind else frozenset()) for r, f in told.items() if kind in (None, KINDS[r])}
    name = F.regexp_replace(F.coalesce(F.col("fields")["name"], F.col("fields")[""]), r"(?U)^\s+|\s+$", "")
    child_kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("relation")]
    named = F.when(F.col("relation") == "labels[]", F.coalesce(name != "", F.lit(False))).otherwise(~F.map_contains_key("fields", F.lit("")))
    return (
        shred(records, "snapshot_id", "text", replace(ISSUE_SPEC, wanted=wanted))
        .where(F.col("relation").isin(*KINDS))
        .select(F.col("record_id").alias("snapshot_id"), child_kind.alias("child_kind"), F.col("ordinals")[0].cast("int").alias("child_pos"), (~F.col("is_null") & F.col("is_first") & named).alias("is_case"), "fields")
    )


def child_table(children: DataFrame, kind: str) -> DataFrame:
    """One flat table of children that are cases, each linked to its snapshot (and a source to its item) by position."""
    pick = lambda paths: F.coalesce(*[F.col("fields")[p] for p in paths])
    return children.where((F.col("child_kind") == kind) & F.col("is_case")).select("snapshot_id", "child_pos", *[pick(p).try_cast(t).alias(n) for n, t, p in TABLES[kind]]).distinct()


def found_children(children: DataFrame) -> DataFrame:
    """``snapshot_id, child_kind, child_pos`` of each child that is a case, once."""
    return children.where("is_case").select("snapshot_id", "child_kind", F.col("child_pos")).distinct()


# ---------------------------------------------------------------- typed records


def _identity(kind: str, e: Column) -> Column:
    """What tells an element from a later one that repeats it, as text; null if nothing does."""
    return {"label": e["name"], "comment": e["id"], "timeline_item": F.to_json(e, {"ignoreNullFields": "false"})}[kind]


ARRAYS = {"label": "labels", "comment": "comments", "timeline_item": "timelineItems", "source": "timelineItems"}


def _blank(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "") == ""


def _halves(key: Column, pos: Column) -> list[Column]:
    """Two hashes of an identity, or of the position where there is none."""
    alone = F.when(key.isNull(), pos)
    return [F.xxhash64(key, alone).alias("k1"), F.xxhash64(F.lit(1), key, alone).alias("k2")]


def _marked(kind: str) -> Column:
    """The elements of one array of a typed row that can be a case: their kind, place, identity, and whether they have a source."""
    source = lambda e: e["source"].isNotNull() if kind == "timeline_item" else F.lit(False)
    each = F.transform(ARRAYS[kind], lambda e, i: F.struct(F.lit(kind).alias("child_kind"), i.alias("child_pos"), _identity(kind, e).alias("key"), source(e).alias("has_source"), e.isNull().alias("none")))
    kept = F.filter(each, lambda m: ~m["none"] & (~_blank(m["key"]) if kind == "label" else F.lit(True)))
    return F.coalesce(kept, F.array().cast("array<struct<child_kind:string,child_pos:int,key:string,has_source:boolean,none:boolean>>"))


def typed_found(raw_issue: DataFrame) -> DataFrame:
    """``snapshot_id, child_kind, child_pos`` of the children of typed rows: one scan, and one shuffle of hashes that also drops repeats.

    Elements of an identity meet at the first of them (the least position); two hashes of 64 bits stand for an identity.
    """
    each = raw_issue.select("snapshot_id", F.inline(F.concat(*[_marked(k) for k in ("label", "comment", "timeline_item")])))
    first = each.groupBy("snapshot_id", "child_kind", *_halves(F.col("key"), F.col("child_pos"))).agg(F.min("child_pos").alias("child_pos"), F.max("has_source").alias("has_source"))
    kinds = F.when(F.col("has_source"), F.array("child_kind", F.lit("source"))).otherwise(F.array("child_kind"))
    return first.select("snapshot_id", F.explode(kinds).alias("child_kind"), F.col("child_pos").cast("int").alias("child_pos"))


def typed_children(raw_issue: DataFrame, kind: str) -> DataFrame:
    """The flat table of one kind of the typed rows, as `child_table` gives it of payloads."""
    e, own = F.col("e"), "timeline_item" if kind == "source" else kind
    inside = e["source"] if kind == "source" else e

    def pick(path: str) -> Column:
        at = inside
        for part in path.split("."):
            at = at[part]
        return at

    each = raw_issue.select("snapshot_id", F.posexplode(ARRAYS[kind]).alias("pos", "e")).where("e is not null")
    if kind == "label":
        each = each.where(~_blank(e["name"]))
    row = F.struct("pos", *[pick(p[0]).try_cast(t).alias(n) for n, t, p in TABLES[kind]], inside.isNotNull().alias("there"))
    first = each.groupBy("snapshot_id", *_halves(_identity(own, e), F.col("pos"))).agg(F.min_by(row, F.col("pos")).alias("r"))
    return first.where("r.there").select("snapshot_id", F.col("r.pos").alias("child_pos"), *[f"r.{n}" for n, _, _ in TABLES[kind]])
