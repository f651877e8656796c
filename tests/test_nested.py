import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import json_stream, nested


def rows(spark, *payloads):
    df = spark.createDataFrame([(k, p) for k, p in enumerate(payloads)], "snapshot_id long, text string")
    return nested.issue_children(df)


def found(spark, payload):
    return {(r.child_kind, r.child_pos) for r in nested.found_children(rows(spark, payload)).collect()}


ISSUE = {"labels": [{"name": "a"}, None, {"name": " "}, {"name": "a"}, "b"], "comments": [{"id": "1", "body": "x"}, {"id": None}, {"id": None}, {"id": "1"}, None], "timelineItems": [{"__typename": "L", "source": {"number": 1}}, {"__typename": "L", "source": {"number": 1}, "actor": None}, {"__typename": "M"}]}
CASES = {("label", 0), ("label", 4), ("comment", 0), ("comment", 1), ("comment", 2), ("timeline_item", 0), ("source", 0), ("timeline_item", 2)}


def nodes(x):
    return {k: {"nodes": v, "pageInfo": {"hasNextPage": False}} for k, v in x.items()}


SHAPES = [
    ISSUE,
    [ISSUE],
    {"data": {"repository": {"issue": ISSUE}}},
    nodes(ISSUE),
    {k: {"edges": [{"node": e, "cursor": "c"} for e in v]} for k, v in ISSUE.items()},
    {k: {"pages": [{"nodes": v[:2]}, {"nodes": v[2:]}]} for k, v in ISSUE.items()},
    {k: json.dumps(v) for k, v in ISSUE.items()},
]


@pytest.mark.parametrize("shape", range(len(SHAPES)))
def test_shapes_give_the_same_rows(spark, shape):
    assert found(spark, json.dumps(SHAPES[shape])) == CASES


def test_lone_elements_and_nothing(spark):
    assert found(spark, json.dumps({"labels": "bug", "comments": {"id": "1"}, "timelineItems": None})) == {("label", 0), ("comment", 0)}
    assert found(spark, None) == found(spark, "{oops") == found(spark, "[]") == found(spark, "3") == found(spark, '{"labels": []}') == set()


def test_flat_tables_and_repeats(spark):
    p = json.dumps({"labels": [{"name": "a"}], "comments": [{"id": "1", "author": {"login": "me"}, "body": "é" * 50_000}], "timelineItems": [{"source": {"number": 7, "merged": True}}]})
    df = spark.createDataFrame([(1, p), (1, p)], "snapshot_id long, text string")
    flat = lambda kind: nested.child_table(nested.issue_children(df, kind), kind)
    assert [tuple(r) for r in flat("label").collect()] == [(1, 0, "a")]
    comment = flat("comment").collect()
    assert len(comment) == 1 and comment[0].author_login == "me" and len(comment[0].body) == 50_000
    source = flat("source").collect()
    assert len(source) == 1 and source[0].number == 7 and source[0].merged is True


def test_any_array_is_a_relation(spark):
    df = spark.createDataFrame([(5, '{"a": [{"b": [1, 2]}, {"b": [3]}], "c": 1}')], "i long, t string")
    got = {(r.relation, tuple(r.ordinals), r.fields.get("")) for r in nested.shred(df, "i", "t", nested.ShredSpec()).collect() if r.relation == "a[].b[]"}
    assert got == {("a[].b[]", (0, 0), "1"), ("a[].b[]", (0, 1), "2"), ("a[].b[]", (1, 0), "3")}


def test_empty_tables_and_rejects(spark):
    empty = spark.createDataFrame([], "snapshot_id long, text string")
    assert nested.found_children(nested.issue_children(empty)).count() == 0
    df = spark.createDataFrame([(1, "{}"), (2, "{"), (3, None)], "id long, p string")
    assert {tuple(r) for r in nested.rejects(df, "id", "p").collect()} == {(2, "invalid"), (3, "null")}


ODD = {
    "a long integer in a field that nobody wants": '{"number": ' + "9" * 5000 + ', "labels": ["a"]}',
    "a long integer in an item": '{"labels": ["a"], "timelineItems": [], "comments": [{"id": 1' + "0" * 6000 + "}]}",
    "deep nesting beside": '{"labels": ["a"], "x": ' + "[" * 60_000 + "]" * 60_000 + "}",
    "deep nesting inside": '{"labels": [{"name": "a", "x": ' + '{"y": [' * 2_000 + "]}" * 2_000 + "}]}",
    "a key twice": '{"labels": ["b", "c"], "labels": ["a"]}',
    "blanks": '\n {"labels" :\t[ "a" ] } \r\n',
    "an envelope after the record": '{"labels": ["b", "c"], "data": {"x": {}, "repository": {"issue": {"labels": ["a"], "body": "y"}}}}',
    "an envelope that is none": '{"labels": ["a"], "data": {"repository": {"issue": 3}}}',
}


@pytest.mark.parametrize("name", ODD)
def test_odd_records(spark, name):
    want = {("label", 0)} | ({("comment", 0)} if "in an item" in name else set())
    assert found(spark, ODD[name]) == want
    assert nested.rejects(spark.createDataFrame([(1, ODD[name])], "id long, p string"), "id", "p").count() == 0


@pytest.mark.parametrize("text", ["{", '{"labels": ["a"]', '{"labels": ["a"]} x', '{"labels": ["a",]}', '{"labels": ["a"], }', '{"a": 01, "labels": ["a"]}', '{"labels": [NaN]}', "{'labels': []}", '{"labels": ["a\n"]}', '["labels": 1]', '{"labels": ["a"], "x": [[[[[[1,]]]]]]}', ""])
def test_no_json_gives_no_rows(spark, text):
    with pytest.raises(ValueError):
        json.loads(text, parse_constant=json_stream._constant)
    assert found(spark, text) == set()
    assert nested.rejects(spark.createDataFrame([(1, text)], "id long, p string"), "id", "p").count() == 1


def test_deep_reads_what_the_parser_reads():
    for text in ('{"a": [1, -2.5e3, true, null, {"b": "\\u00e9\\n"}, [], {}], "c": ""}', "[]", "3", '"x"', ' [ { } , [ ] ] '):
        assert json_stream.deep(text, 0)[0] == json.loads(text)


def test_typed_rows_give_the_same_as_payloads(spark):
    schema = "snapshot_id long, labels array<struct<name:string>>, comments array<struct<id:string,url:string,body:string,createdAt:string,authorAssociation:string,author:struct<login:string>>>, timelineItems array<struct<__typename:string,createdAt:string,actor:struct<login:string>,willCloseTarget:boolean,stateReason:string,label:struct<name:string>,source:struct<__typename:string,number:long,url:string,title:string,state:string,merged:boolean,mergedAt:string>>>"
    item = ("L", None, None, None, None, None, None)
    cross = ("C", "t", ("me",), True, None, None, ("P", 7, "u", None, "OPEN", True, None))
    rows = [
        (1, [("a",), None, (" ",), ("a",), (None,), ("b",)], [("1", None, "x", None, None, None), (None,) * 6, (None,) * 6, ("1",) + (None,) * 5, None, ("\x001",) + (None,) * 5], [item, item, cross, None, cross, ("L", None, None, False, None, None, None), ("L", "", None, None, None, None, None)]),
        (2, None, [], None),
    ]
    df = spark.createDataFrame(rows + rows[:1], schema)
    payload = df.select("snapshot_id", F.to_json(F.struct("labels", "comments", "timelineItems")).alias("text"))
    same = lambda a, b: sorted(map(tuple, a.select(b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    assert same(nested.typed_found(df), nested.found_children(nested.issue_children(payload)))
    for kind in nested.TABLES:
        assert same(nested.typed_children(df, kind), nested.child_table(nested.issue_children(payload, kind), kind))


def test_a_very_large_record_needs_little_more_than_its_text():
    """Elements are let go as they are read: what is held beside the text stays far below what the parsed record would take."""
    import tracemalloc

    text = '{"comments": [' + ", ".join('{"id": "%d", "body": "%s", "x": [1, 2, {"y": "z"}]}' % (k, "b" * 200) for k in range(40_000)) + "]}"
    spec = nested.replace(nested.ISSUE_SPEC, wanted={"comments[]": frozenset(("",))})
    tracemalloc.start()
    n = sum(1 for _ in json_stream.Reader(text, json_stream.Pivot(spec)).rows())
    streamed = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    json.loads(text)
    whole = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40_000 and streamed < whole
