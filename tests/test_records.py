"""Paths, JSON texts, rules, purges and incremental reading."""

import json

import pytest
from pyspark.sql import functions as F

from siltsieve.functions import jsontext as J
from siltsieve.functions import paths as P
from siltsieve.operators import dedupe, ingest, profile, purge, rules
from siltsieve.operators.rewrite import Rewrite, rewrite_lines
from siltsieve.operators.search import Target
from siltsieve.streaming import incremental


def test_lexemes_and_texts():
    o = J.parse('{"a":1e6,"b":2.50,"c":null,"d":{"y":true,"x":[1,"z"]},"big":12345678901234567890}')
    assert J.dump(o) == '{"a":1e6,"b":2.50,"c":null,"d":{"y":true,"x":[1,"z"]},"big":12345678901234567890}'
    assert J.text_of(o["a"]) == "1e6" and J.text_of(o["c"]) == "<nil>" and J.text_of(o["d"]) == "map[x:[1 z] y:true]"
    assert [J.type_name(v) for v in o.values()] == ["number", "number", "null", "object", "integer"] and J.type_name(o["a"], True) == "string"
    assert J.repair("{'a': [1,],}") == '{"a": [1]}' and J.repair("{") is None
    for bad in ('{"a":1} x', "{'a':1}", '{"a":NaN}', "", "[" * 100_000):
        with pytest.raises(ValueError):
            J.parse(bad)
    assert J.fnv1a64(b"") == 0xCBF29CE484222325 and J.fnv1a64(b"a") == 0xAF63DC4C8601EC8C


def test_paths():
    o = J.parse('{"a":{"b":[{"c":"1"},{"d":2},{"c":"3"}]},"x.y":"lit","w":{"p":{"q":1},"r":{"q":2}}}')
    assert P.find(o, P.parse_path("$.a.b[*].c")) == [("a.b[0].c", "1"), ("a.b[2].c", "3")]
    assert P.find(o, P.parse_path(".a.b[2].c")) == [("a.b[2].c", "3")] and len(P.find(o, P.parse_path("w.*.q"))) == 2
    assert P.lookup(o, "x.y") == (True, "lit", "x.y") and P.lookup(o, "a.b[*].d")[1] == "2" and P.lookup(o, "none") == (False, None, "")
    assert [P.path_kind(x) for x in ("a.b", "a[1]", "*.a", "a[*]")] == ["simple", "array", "wildcard", "wildcard_array"]
    assert P.path_complexity("a") == "simple" and P.path_complexity("a[*]") == "complex" and P.path_complexity("*.*") == "very_complex"
    for bad in ("", ".", "a..b", "a b", "a[-1]", "a[x]", "a["):
        with pytest.raises(ValueError):
            P.parse_path(bad)


def test_mutations():
    o = J.parse('{"k":true,"in":[{"k":true},{"k":"true"}],"deep":{"k":[1]},"nest":[[{"k":true}]]}')
    assert J.update_values(o, "k", "true", "0") and J.dump(o) == '{"k":false,"in":[{"k":false},{"k":"0"}],"deep":{"k":[1]},"nest":[[{"k":true}]]}'
    w = J.parse('{"items":{"@n":"2","item":[{"id":"1"},{"id":"2"}]}}')
    assert J.delete_items(w, "items", "id", {"1"}) and w["items"]["item"] == {"id": "2"}
    assert J.delete_items(w, "items", "id", {"2"}) and "item" not in w["items"] and not J.delete_items(w, "items", "id", {"2"})
    s = J.parse('{"a":[{"k":"1"},{"k":"2","z":1},{"k":"1","y":1}]}')
    assert J.delete_sub_key(s, P.parse_path("a[*].k"), {"1"}) and J.dump(s) == '{"a":[{"k":"2","z":1},{"y":1}]}'
    assert not J.delete_sub_key(s, P.parse_path("a[9].k"), set()) and J.delete_sub_key(s, P.parse_path("a[0].k"), set()) and J.dump(s) == '{"a":[{"z":1},{"y":1}]}'
    assert J.delete_path(s, ["a"]) and not J.delete_path(s, ["a"])
    assert J.completeness(J.parse('{"a":"","b":null,"c":0,"d":[]}')) == 2 and J.normalise_semantic({"a": [" X  y "]}) == {"a": ["x y"]}


def test_rules(spark):
    recs = ['{"id":"a","items":[{"s":"X"},{"s":"y"}],"n":{"m":"x"}}', "bad", '{"id":"A"}', None]
    targets = [Target("id", "id", ["a", "A"]), Target("arr", "items[*].s", ["x"], kind="nested_array"), Target("cs", "id", ["A"], True), Target("obj", "n.m", ["X"], kind="nested_object"), Target("any", "*.m", ["x"], kind="jsonpath"), Target("p", "$.items[*].s", ["y"], kind="path")]
    job = [rules.Rule("arr", "delete_matches"), rules.Rule("obj", "delete_matches"), rules.Rule("p", "delete_sub_key", sub_key_path="items[*].s", sub_key_values=["y"]), rules.Rule("cs", "delete_row"), rules.Rule("cs", "mark_for_deletion")]
    df = spark.createDataFrame([("f", i, r) for i, r in enumerate(recs)], "source_path string, line_number int, raw string")
    out = rules.apply_rules(df, targets, job).cache()
    r = {x["line_number"]: x for x in out.collect()}
    assert sorted((m["target"], m["path"], m["matched_value"]) for m in r[0]["matches"]) == [("any", "n.m", "x"), ("arr", "items[0].s", "x"), ("id", "id", "A"), ("id", "id", "a"), ("obj", "n.m", "X"), ("p", "items[1].s", "y")]
    assert r[0]["new_raw"] == '{"id":"a","items":[{"s":"X"}],"n":{}}' and [a["action"] for a in r[2]["actions"]] == ["delete_row", "mark_for_deletion"] and r[1]["malformed"]
    assert json.loads(r[2]["new_raw"]) == {"id": "A", "_marked_for_deletion": True, "_deletion_reason": "cs", "_deletion_matches": 1}
    s = rules.rule_statistics(out).first()
    assert (s["total_rows"], s["deleted_rows"], s["modified_rows"], s["errors"]) == (4, 1, 2, 2)
    assert rules.rule_output(out, "cs", "delete_row").count() == 1
    with pytest.raises(ValueError):
        rules.apply_rules(df, [], job)


def test_rewrite_edge_cases(spark):
    df = spark.createDataFrame([(x,) for x in ('{"id":1000000,"s":"o"}', '{ "id" : 2 }', "", None, "[1]")], "raw string")
    out = [tuple(r)[1:] for r in rewrite_lines(df, Rewrite("id", frozenset(["1000000"]), state_key="s", state_value="o")).collect()]
    assert out == [(None, True, False, False, False), ('{ "id" : 2 }', False, False, False, False), ("", False, False, False, False), (None, False, False, False, False), ("[1]", False, False, False, True)]
    for bad in ({}, {"top_level_key": "a"}, {"update_key": "a", "state_key": "b"}):
        with pytest.raises(ValueError):
            Rewrite(**bad)


def test_purges(spark):
    rows = spark.createDataFrame([("a", i, k) for i, k in enumerate(["x", "y", "x", None, None, "x"])], "source_path string, line_number int, k string")
    assert sorted(r["line_number"] for r in purge.surplus(rows, "k").collect()) == [2, 5] and sorted(r["line_number"] for r in purge.surplus(rows, "k", "last").collect()) == [0, 2]
    assert purge.without(rows, purge.surplus(rows, "k")).count() == 4
    df = spark.createDataFrame([('{"o":{"id":"1","l":[{"x":{"y":"q"}},{"x":1}]}}',), ('{"o":{"id":"2"}}',), ("bad",)], "raw string")
    out = purge.purge_lines(df, [purge.Purge("array_purge", "o.l", frozenset("q"), "x.y"), purge.Purge("id_purge", "o.id", frozenset("2"))]).collect()
    assert [(r["deleted"], r["items_removed"], r["malformed"]) for r in out] == [(False, 1, False), (True, 0, False), (False, 0, True)] and out[0]["new_raw"] == '{"o":{"id":"1","l":[{"x":1}]}}'


def test_profile_levels(spark):
    df = spark.createDataFrame([("f", '{"a":1,"b":{"c":[{"d":"x"},{"d":null}]}}'), ("f", '{"a":"","b":null}'), ("g", "bad")], "folder string, t string")
    p = {r["path"]: r for r in profile.profile_json(df, "t").collect()}
    assert p["a"]["type"] == "mixed" and p["b"]["type"] == "mixed" and p["b"]["nullable"] and p["b.c"]["type"] == "array" and p["b.c[].d"]["occurrences"] == 2 and p["a"]["min_length"] == 0
    assert {r["path"] for r in profile.profile_json(df, "t", max_depth=1).collect()} == {"a", "b"}
    by = profile.profile_json(df, "t", ["folder"]).filter("path = 'a'").collect()
    assert [(r["folder"], r["percentage"]) for r in by] == [("f", 100.0)]


def test_profile_cells_are_never_broadcast(spark, tmp_path):
    df = spark.createDataFrame([("x", '{"a":1}'), ("x", '{"a":null}'), (None, '{"b":[{"c":2}]}')], "folder string, t string")
    df.write.parquet(f"{tmp_path}/t")
    p = profile.profile_json(spark.read.parquet(f"{tmp_path}/t"), "t", ["folder"], overall=True)
    assert "Broadcast" not in p._jdf.queryExecution().sparkPlan().toString()
    assert {(r["folder"], r["path"], r["occurrences"], r["percentage"]) for r in p.filter("path <> 'b[].c'").collect()} == {("x", "a", 2, 100.0), (None, "b", 1, 100.0), (None, "a", 2, 200 / 3), (None, "b", 1, 100 / 3)}


def test_hashes_and_times(spark):
    df = spark.createDataFrame([("2020-01-02", None), (None, "2021-03-04 05:06:07"), ("x", None)], "created_at string, updated_at string")
    assert [None if r[0] is None else r[0].year for r in df.select(dedupe.row_time(df)).collect()] == [2020, 2021, None]
    assert df.select(dedupe.row_hash(F.lit("a"), "fnv")).first()[0] == str(0xAF63DC4C8601EC8C)
    with pytest.raises(ValueError):
        dedupe.row_hash(F.lit("a"), "crc")
    assert df.select(dedupe.canonical_row(df, "selective", include=["none"])).distinct().count() == 1


def test_unify_record_precedence():
    m = ingest.Mapping(columns={"a": "Id", "b": "Id", "c.d": "Email"}, defaults={"DataSource": "d", "SourceModifiedDate": "x"}, data_source="m", source_modified_date_field="t", include_unmapped=True)
    v, attrs, missing = ingest.unify_record(J.parse('{"a":"1","b":" n/a ","c":{"d":1.50},"t":"T","rest":{"k":1},"none":null}'), m, "file")
    assert (v["Id"], v["Email"], v["DataSource"], v["SourceModifiedDate"]) == ("1", "1.50", "d", "T") and attrs == [("rest", '{"k":1}')] and missing == []
    with pytest.raises(ValueError):
        ingest.Mapping(columns={"a": "Nope"})


def test_streaming_resumes(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    (src / "a.jsonl").write_text('{"id":1}\n\n{"id":2}\n')
    go = lambda: incremental.process_available(incremental.stream_lines(spark, str(src)), str(tmp_path / "cp"), lambda df, _: seen.extend(r["raw"] for r in df.collect()))
    go()
    (src / "b.jsonl").write_text('{"id":3}\n')
    go()
    assert sorted(seen) == ['{"id":1}', '{"id":2}', '{"id":3}']
    done = spark.createDataFrame([("a",)], "source_path string")
    assert incremental.pending(spark.createDataFrame([("a",), ("b",)], "source_path string"), done).count() == 1
