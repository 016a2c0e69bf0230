"""The general data-preparation operators against brute force and on edge cases."""

import datetime as dt
import json
import random
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltsieve.operators import drift, eav, instants, nested, rawload
from siltsieve.session import dim_join

TYPES = "attr_name string, value_type string, aliases array<string>"
EAV = "attr_row_id bigint, row_id bigint, attr_key string, attr_value string, loaded_at int, entity string"


def wide(spark, rows):
    types = spark.createDataFrame([("Points", "integer", ["Pts"]), ("Spend", "decimal", None), ("OptIn", "boolean", []), ("Since", "date", []), ("Tier", "string", [])], TYPES)
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], EAV)
    return eav.eav_to_wide(df, types, "row_id", "attr_key", "attr_value", ["loaded_at", "attr_row_id"])


def test_eav_values_and_issues(spark):
    rows = [
        (1, "p-t-s", "1,028", 1), (1, "POINTS", "+1028.0", 2), (1, "Points", "00", 3), (2, "points", "7x", 1), (2, "Spend", "$ 2,035.90", 1), (2, "spend ", "2035.9", 2),
        (3, "Opt In", "Y", 1), (3, "opt_in", "1", 2), (3, "optin", "tru", 3), (4, "since", "2016/02/29", 1), (4, "since", "29 Feb 2016", 2), (4, "since", "2015-02-29", 3),
        (5, "tier", " Gold ", 1), (5, "tier", "gold", 2), (5, "tier", None, 3), (5, "tier", " N/A", 4), (5, "other", "x", 5), (None, "tier", "x", 1), (6, "unknown", "x", 1), (7, "tier", "x" * 100_000, 1), (7, "tier", "x" * 100_000, 1),
    ]
    w = {r["entity"]: r for r in wide(spark, rows).collect()}
    assert set(w) == {1, 2, 3, 4, 5, 7}
    issues = {k: sorted((i["attr_name"], i["issue"]) for i in r["issues"]) for k, r in w.items()}
    assert issues == {1: [("Points", "conflict")], 2: [("Points", "unreadable")], 3: [("OptIn", "unreadable")], 4: [("Since", "unreadable")], 5: [], 7: []}
    assert w[1]["Points"] == 0 and float(w[2]["Spend"]) == 2035.9 and w[3]["OptIn"] is True and w[4]["Since"] == dt.date(2016, 2, 29) and w[5]["Tier"] == "gold"


def test_eav_values_beyond_their_column(spark):
    out = wide(spark, [(1, "points", "9" * 30, 1), (2, "spend", "1" * 40, 1), (2, "spend", "2", 2), (3, "points", "9" * 30, 2), (3, "points", "12", 1)]).orderBy("entity").collect()
    issues = [sorted((i["attr_name"], i["issue"]) for i in r["issues"]) for r in out]
    assert issues == [[("Points", "out_of_range")], [("Spend", "conflict")], [("Points", "conflict"), ("Points", "out_of_range")]] and out[0]["Points"] is None and float(out[1]["Spend"]) == 2


def test_eav_empty_and_hot_entity(spark):
    assert wide(spark, []).count() == 0
    rows = [(1, "tier", f"v{i % 3}", i) for i in range(3000)]
    out = wide(spark, rows).collect()
    assert len(out) == 1 and [i["issue"] for i in out[0]["issues"]] == ["conflict"] and out[0]["Tier"] == "v2"


PROFILES = [("syd", "Australia/Sydney", True), ("den", "America/Denver", False), ("kat", "Asia/Kathmandu", True)]


def outcomes(spark, pairs):
    prof = spark.createDataFrame(PROFILES, "datasource string, zone_name string, day_first boolean")
    df = spark.createDataFrame([(i, s, v, "clash", 1) for i, (s, v) in enumerate(pairs)], "n int, src string, v string, outcome string, mask int")
    return [r["outcome"] for r in instants.normalise_timestamps(df, "v", "src", prof).orderBy("n").collect()]


def test_timestamps_by_example(spark):
    cases = [
        ("syd", "2020-01-05 02:10:39", "2020-01-04T15:10:39.000Z"), (" SYD ", "05/01/2020 02:10", "2020-01-04T15:10:00.000Z"), ("den", "1/5/2020 2:10:39 PM", "2020-01-05T21:10:39.000Z"), ("den", "1/5/2020 12:10:39 AM", "2020-01-05T07:10:39.000Z"),
        ("syd", "2021-10-03 02:30", "nonexistent"), ("syd", "2021-04-04 02:30", "ambiguous"), ("syd", "2021-04-04T02:30:00+11:00", "2021-04-03T15:30:00.000Z"), ("den", "2021-11-07 01:30:00", "ambiguous"),
        (None, "2020-01-05 02:10:39", "no_zone"), ("nobody", "05/01/2020", "no_zone"), (None, "1653957338", "2022-05-31T00:35:38.000Z"), ("kat", "1651706422963", "2022-05-04T23:20:22.963Z"), ("kat", "2022-02-03 09:22:50.511987", "2022-02-03T03:37:50.511Z"),
        ("syd", "31/11/2021 08:00", "unreadable"), ("den", "25/12/2021", "unreadable"), ("syd", "12:40", "unreadable"), ("syd", "2024-05-04T10:71:00Z", "unreadable"), ("syd", "2021-06-31", "unreadable"), ("syd", "yesterday", "unreadable"),
        ("syd", "13/10/20", "2020-10-12T13:00:00.000Z"), ("den", "Thu, 03 Oct 2024 21:18:55 GMT", "2024-10-03T21:18:55.000Z"), ("den", "2023-05-08 14:03:47 CEST", "2023-05-08T12:03:47.000Z"), ("den", "20200427T203531Z", "2020-04-27T20:35:31.000Z"),
        ("den", "20220704020407", "2022-07-04T08:04:07.000Z"), ("den", "Jan 12, 2023 10:10 AM", "2023-01-12T17:10:00.000Z"), ("syd", "6 Sep 2021 18:51:12", "2021-09-06T08:51:12.000Z"), ("den", "2020-01-05 02:10:39 Australia/Sydney", "2020-01-04T15:10:39.000Z"),
        ("den", "2020-03-07T03:21:19.538930147Z", "2020-03-07T03:21:19.538Z"), ("syd", "\t2022-06-19 09:52:10 ", "2022-06-18T23:52:10.000Z"), ("syd", None, None), ("syd", " n/A ", None), ("syd", "", None), ("syd", "9" * 100_000, "unreadable"),
        ("den", "13/13/2020", "unreadable"), ("den", "2020-01-05 02:10 Nowhere/City", "unreadable"), ("den", "2/29/2023 1:00:00 AM", "unreadable"), ("den", "12/31/2020 13:00:00 PM", "unreadable"),
    ]
    got = outcomes(spark, [c[:2] for c in cases])
    assert {c[:2]: (g, c[2]) for c, g in zip(cases, got, strict=True) if g != c[2]} == {}


def test_format_mixtures_depend_on_shares_only(spark):
    bit = instants.BIT
    both = bit["dmy"] | bit["mdy"]
    some = [("a", both, 1000), ("a", bit["mdy"], 40), ("a", bit["dmy"], 10), ("b", both, 500), ("b", bit["dmy"], 60), ("c", both, 7), ("d", bit["iso"], 9), ("e", bit["compact"] | bit["epoch_ms"], 3), ("e", bit["compact"], 2)]
    seen = []
    for k in (1, 1000, 1_000_000):
        df = spark.createDataFrame([(s, m, n * k) for s, m, n in some], "__src string, mask int, n bigint")
        seen.append({(r[0], r[1]): (instants.INTERPRETATIONS[r[2]], round(r[3], 9)) for r in instants.fit_formats(df).collect()})
    assert seen[0] == seen[1] == seen[2] and set(seen[0]) == {("a", both), ("b", both), ("c", both), ("e", bit["compact"] | bit["epoch_ms"])}
    assert {k[0]: v[0] for k, v in seen[0].items()} == {"a": "mdy", "b": "dmy", "c": "dmy", "e": "compact"}
    assert seen[0][("c", both)][1] < 0.9  # nothing of its own decides: it stays open


def test_undeclared_sources_have_their_own_order(spark):
    rows = [("us", "12/25/2020 10:00 UTC")] * 9 + [("us", "03/04/2020 10:00 UTC"), ("eu", "03/04/2020 10:00 UTC")] + [("eu", "25/12/2020 10:00 UTC")] * 9 + [("syd", "04/03/2020 10:00 UTC"), ("eu", "3 March 2020," + " " * 80 + "10:00 UTC"), ("mainframe", "198001021530"), ("phone", "946684800000")] + [("mainframe", "20191231235959")] * 30
    got = outcomes(spark, rows)
    assert got[9] == "2020-03-04T10:00:00.000Z" and got[10] == "2020-04-03T10:00:00.000Z" and got[20:24] == ["2020-03-04T10:00:00.000Z", "2020-03-03T10:00:00.000Z", "no_zone", "2000-01-01T00:00:00.000Z"]
    assert outcomes(spark, [("x", "03/04/2020 10:00 UTC"), ("x", "03/04/2020 10:00")]) == ["unreadable", "no_zone"]


def test_timestamps_against_zoneinfo(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(400):
        s, z, _d = rng.choice(PROFILES)
        t = dt.datetime(2021, rng.choice([3, 4, 10, 11]), rng.randint(1, 30), rng.randint(0, 3), rng.randint(0, 59))
        zone = ZoneInfo(z)
        a, b = t.replace(tzinfo=zone, fold=0), t.replace(tzinfo=zone, fold=1)
        if a.utcoffset() == b.utcoffset():
            want = a.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")
        else:
            want = "ambiguous" if a.astimezone(dt.timezone.utc).astimezone(zone).replace(tzinfo=None) == t else "nonexistent"
        cases.append((s, t.strftime("%Y-%m-%d %H:%M"), want))
    got = outcomes(spark, [c[:2] for c in cases])
    assert [c for c, g in zip(cases, got, strict=True) if g != c[2]] == []


def test_day_order_is_learned_without_a_declaration(spark):
    prof = spark.createDataFrame([("x", "UTC", None)], "datasource string, zone_name string, day_first boolean")
    df = spark.createDataFrame([("x", f"{d:02d}/03/2021") for d in range(1, 29)], "src string, v string")
    out = {r["v"]: r["outcome"] for r in instants.normalise_timestamps(df, "v", "src", prof).collect()}
    assert out["05/03/2021"] == "2021-03-05T00:00:00.000Z"
    tie = spark.createDataFrame([("x", "05/03/2021")], "src string, v string")
    assert instants.normalise_timestamps(tie, "v", "src", prof).first()["outcome"] == "unreadable"


def test_canonical_form(spark):
    df = spark.createDataFrame([(v,) for v in ("2020-02-29T00:00:00Z", "2021-02-29T00:00:00Z", " 2020-02-29T00:00:00Z", "2020-02-29T24:00:00Z", None)], "v string")
    assert [r[0] for r in df.select(instants.is_canonical("v")).collect()] == [True, False, False, False, False]


def brute_tokens(text, sep):
    out, field, state = [], "", "start"
    for c in text:
        if state == "quoted":
            field, state = (field, "closed") if c == '"' else (field + c, state)
        elif state == "closed":
            if c == '"':
                field, state = field + c, "quoted"
            elif c == sep:
                out.append(field)
                field, state = "", "start"
            else:
                return None
        elif c == '"':
            if state == "bare":
                return None
            state = "quoted"
        elif c == sep:
            out.append(field)
            field, state = "", "start"
        else:
            field, state = field + c, "bare"
    return None if state == "quoted" else [*out, field]


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_tokenizer_against_brute_force(chunk, monkeypatch):
    monkeypatch.setattr(rawload.scan_states, "__defaults__", (chunk,))
    rng = random.Random(chunk)
    texts = ["".join(rng.choice('ab",,"\n ') for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["", "x" * 5000 + ',"' + "y" * 5000 + '"', '"' * 1001, "💯,ä"]
    got = rawload.tokenize(texts, ",")
    assert [g[0] for g in got] == [brute_tokens(t, ",") for t in texts]
    assert rawload.tokenize(['ab"c'], ",")[0][1] == 2 and rawload.tokenize(['"abc'], ",")[0][1] == 4


def raw(spark, rows, files, bound=None):
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "line_id bigint, file_id bigint, line_number int, raw_text string")
    f = spark.createDataFrame(files, "file_id bigint, file_format string")
    s = spark.createDataFrame([("id", "[a-z]+"), ("joined", r"\d{4}-\d{2}-\d{2}"), ("points", "-?[0-9]+")], "field_name string, value_pattern string")
    return rawload.load_raw(r, f, s, ("joined",), **({} if bound is None else {"bound": bound}))


RAW = [
    (1, 1, '﻿id,"joined",x', None), (1, 2, 'ab,2021-02-03,"a,b"', None), (1, 3, "ab,2021-02-30,", "value"), (1, 4, 'ab,2021-02-03,a"b', "quoting"), (1, 5, "ab,2021-02-03", "columns"), (1, 6, "  ", None), (1, 7, None, None), (1, 8, "A,,", "value"), (1, 9, ",,", None),
    (2, 1, "id\tx", None), (2, 2, 'ab\t"two\nlines"\r', None), (2, 3, "ab,c", "columns"), (3, 1, '{"id":"ab","points":1191}', None), (3, 2, '{"id":"ab","points":5e9}', "value"), (3, 3, '{"id":"ab"} {}', "malformed"), (3, 4, "[1]", "malformed"), (3, 5, '{"id":null,"points":"-3","deep":{"a":1}}', None),
    (3, 6, '{"id":NaN}', "malformed"), (4, 2, "orphan", "columns"), (5, 1, "{'a':1}", "malformed"),
]


@pytest.mark.parametrize("bound", [None, 0])
def test_raw_records(spark, bound):
    out = raw(spark, [r[:3] for r in RAW], [(1, "csv"), (2, "tsv"), (3, "jsonl"), (4, "csv"), (5, "ndjson")], bound)
    got = {r["line_id"]: r["reason"] for r in out.collect()}
    assert got == {i: r[3] for i, r in enumerate(RAW)}
    counts = rawload.file_counts(out).filter("file_id = 1").first()
    assert (counts["rows_read"], counts["rows_written"], counts["blank_lines"], counts["bad_columns"]) == (6, 2, 2, 1)
    assert raw(spark, [], [(1, "csv")]).count() == 0


def test_raw_offsets_names_and_types(spark):
    lines = [(1, 1, "note,points,joined,points"), (1, 2, "a\x00b,7,2020-01-02,8"), (1, 3, "a,7"), (1, 4, "a,7,2020-01-02,8,9"), (1, 5, 'a,"x"y,1,2'), (1, 6, "abc,x,2020-01-02,8"), (1, 7, "a,,2020-02-30,8"), (1, 8, "a,,,"), (2, 1, '{"points": 1} x'), (2, 2, '{"note":1, "points": "q"}'), (2, 3, '{"points": 99999999999999999999}')]
    out = raw(spark, lines, [(1, "csv"), (2, "jsonl")], None).orderBy("line_id").collect()
    bad = {(r["file_id"], r["line_number"]): (r["reason"], r["error_offset"], r["error_field"]) for r in out if r["kind"] == "bad"}
    assert bad == {(1, 3): ("columns", 3, None), (1, 4): ("columns", 17, None), (1, 5): ("quoting", 5, None), (1, 6): ("value", 4, "points"), (1, 7): ("value", 3, "joined"), (2, 1): ("malformed", 14, None), (2, 2): ("value", 11, "points")}
    assert dict(out[1]["fields"]) == {"note": "a\x00b", "points": "7", "joined": "2020-01-02", "points_2": "8"}
    t = rawload.typed_rows(raw(spark, lines, [(1, "csv"), (2, "jsonl")], None), {"note": "string", "points": "bigint", "joined": "date"}).orderBy("line_id").collect()
    assert (t[0]["points"], t[0]["joined"], dict(t[0]["further"])) == (7, dt.date(2020, 1, 2), {"points_2": "8"}) and t[1]["points"] is None and dict(t[2]["further"]) == {"points": "99999999999999999999"}


def items(spark, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "record_no bigint, payload string")
    rel = nested.decide_relations(nested.schema_graph(df, "payload"))
    t = nested.relation_table(nested.shred(df, "record_no", "payload", rel), rel["line_items"].name, ["item_id"])
    return [(r["record_no"], r["node_no"], r["same_parent_no"], r["item_id"] or "") for r in t.orderBy("record_no", "node_no").collect()]


def test_items_in_every_writing(spark):
    a, b = {"item_id": "a", "components": [{"item_id": "a1"}, None, {"qty": 2, "components": [{"item_id": "a2x"}]}]}, {"item_id": 5}
    docs = [
        {"line_items": [a, None, b]}, {"line_items": a}, {"line_items": {"0": b, "1": a}}, {"line_items": json.dumps([b])}, {"orders": [{"line_items": [b]}, {"line_items": None}, {"line_items": [a]}]},
        {"history": {"years": [{"orders": [{"line_items": [b]}]}]}}, {"line_items": []}, {}, {"line_items": "text"}, {"line_items": [3, "x", {}]},
    ]
    got = items(spark, [*map(json.dumps, docs), None, "", "{", "[]"])
    by = {}
    for no, i, p, x in got:
        by.setdefault(no, []).append((i, p, x))
    of_a = [(1, 0, "a"), (2, 1, "a1"), (3, 1, ""), (4, 3, "a2x")]
    assert by[0] == [*of_a, (5, 0, "5")] and by[1] == of_a and by[2][0] == (1, 0, "5") and len(by[2]) == 5 and by[2][2] == (3, 2, "a1")
    assert by[3] == [(1, 0, "5")] and by[4] == [(1, 0, "5"), (2, 0, "a"), (3, 2, "a1"), (4, 2, ""), (5, 4, "a2x")] and by[5] == [(1, 0, "5")] and by[9] == [(1, 0, "")]
    assert set(by) == {0, 1, 2, 3, 4, 5, 9}


def test_relations_follow_the_graph(spark):
    df = spark.createDataFrame([(1, json.dumps({"home": {"zip": 1}, "tags": ["x"], "node": {"node": {"v": 1}}}))], "record_no bigint, payload string")
    rel = nested.decide_relations(nested.schema_graph(df, "payload"))
    assert {k: (r.name, r.objects) for k, r in rel.items()} == {"tags": ("tags", False), "node": ("node", True)}
    assert nested.inlined_paths(nested.schema_graph(df, "payload"), rel, "") == ["home.zip"] and nested.inlined_paths(nested.schema_graph(df, "payload"), rel, "node") == ["v"]
    rows = {(r["relation"], r["node_no"]): (r["parent_relation"], r["parent_no"], dict(r["fields"])) for r in nested.shred(df, "record_no", "payload", rel).collect()}
    assert rows[("", 1)][2] == {"home.zip": "1"} and rows[("tags", 1)] == ("", 1, {"value": "x"}) and rows[("node", 2)][:2] == ("node", 1)


def test_inline_struct_names(spark):
    df = spark.sql("SELECT 1 AS a_b, named_struct('b', 2, 'c', named_struct('d', 3)) AS a")
    assert nested.inline_struct(df).columns == ["a_b", "a_b_2", "a_c_d"]


def changes(spark, files, order=None):
    rows, n = [], 0
    meta = []
    for i, recs in enumerate(files, 1):
        meta.append((i, 7, (order or list(range(1, len(files) + 1)))[i - 1], f"/l/contacts_{i}.jsonl", "jsonl"))
        for r in recs:
            n += 1
            rows.append((n, i, json.dumps(r) if not isinstance(r, str) else r))
    meta += [(99, 7, 99, "/l/contacts_99.jsonl", "jsonl")]
    d = drift.Drift(spark.createDataFrame(rows, "row_id bigint, file_id bigint, payload string"), spark.createDataFrame(meta, "file_id bigint, feed_id bigint, seq_no int, source_path string, file_format string"))
    return d, sorted(tuple(r) for r in d.changes.collect())


def test_drift(spark):
    people = [{"id": f"m{i}", "phone": f"05{i}", "state": ["x", "y", "z"][i % 3], "old": i} for i in range(12)]
    one = people
    two = [{"id": p["id"], "contact": {"mobile": int(p["phone"])}, "state": p["state"], "fresh": None} for p in people[3:]]
    three = [{"key": p["id"], "contact": {"mobile": p["phone"]}, "status": p["state"], "fresh": "a"} for p in reversed(people)]
    d, got = changes(spark, [one, two, three])
    assert got == sorted([(2, "renamed", "phone", "contact.mobile"), (2, "removed", "old", ""), (2, "added", "", "fresh"), (3, "renamed", "id", "key"), (3, "renamed", "state", "status"), (3, "retyped", "contact.mobile", "contact.mobile")])
    steps = [(r["version"], r["step_no"], r["step"], r["path"], r["to"]) for r in d.steps().orderBy("version", "step_no").collect()]
    assert steps == [(2, 1, "rename", "contact.mobile", "phone"), (2, 2, "default", "old", None), (2, 3, "keep", "fresh", None), (3, 1, "rename", "key", "id"), (3, 2, "rename", "status", "state"), (3, 3, "cast", "contact.mobile", "number")]
    maps = spark.createDataFrame([("contacts_*.jsonl", None, "phone", "Mobile"), ("contacts_*.jsonl", "jsonl", "id", "Id")], "match_name string, file_format string, source_field string, target_field string")
    c = d.contacts(maps, ["Id", "Mobile"])
    assert c.count() == 33 and c.filter("id is null or mobile is null").count() == 0
    _, late = changes(spark, [two, one], order=[2, 1])
    assert {x[0] for x in late} == {1}


def test_contacts_keep_every_field(spark):
    one = [{"id": f"m{i}", "mail": f"a{i}@x.y", "state": ["x", "y", "z"][i % 3], "points": i} for i in range(12)]
    two = [{"id": p["id"], "mail": p["mail"], "status": p["state"], "points": str(p["points"]) if i else "many", "loyalty": {"tier": "gold"}} for i, p in enumerate(one)]
    two[1] |= {"contact": {"mail": "other@x.y"}, "note": None}
    d, _ = changes(spark, [one, two, ["broken", {}]])
    maps = spark.createDataFrame([(1, "contacts_*", None, "mail", "Email", None), (2, "contacts_*", None, "contact.mail", "Email", None), (3, "contacts_*", None, "origin", "DataSource", "unknown")], "mapping_id int, match_name string, file_format string, source_field string, target_field string, default_value string")
    c = {r["row_id"]: r.asDict(recursive=True) for r in d.contacts(maps, ["Email", "DataSource"]).collect()}
    assert len(c) == 26 and c[1]["fields"] == {"id": {"json_type": "string", "value": "m0"}, "state": {"json_type": "string", "value": "x"}, "points": {"json_type": "number", "value": "0"}}
    assert c[14]["fields"]["state"]["value"] == "y" and c[14]["fields"]["points"] == {"json_type": "number", "value": "1"} and c[14]["fields"]["loyalty.tier"]["value"] == "gold" and c[14]["fields"]["note"]["value"] is None
    assert c[14]["email"] == "a1@x.y" and c[14]["conflicts"] == [{"name": "Email", "path": "contact.mail", "value": "other@x.y"}] and c[14]["cast_failures"] == []
    assert c[13]["cast_failures"] == [{"name": "points", "path": "points", "json_type": "string", "wanted": "number", "value": "many"}] and c[13]["fields"]["points"]["value"] is None
    assert c[25]["fields"] == c[26]["fields"] == {} and c[1]["datasource"] == "unknown" and c[25]["email"] is None


def test_equal_fingerprints_are_one_version(spark):
    d, got = changes(spark, [[{"a": 1, "b": "x"}], [{"b": "y", "a": 2}], [{"a": 3, "c": "z"}]])
    assert [r["version"] for r in d.versions.orderBy("seq_no").collect()] == [1, 1, 2] and [r["changed"] for r in d.versions.orderBy("seq_no").collect()] == [True, False, True]
    assert {x[0] for x in got} == {3}


def test_drift_edge_cases(spark):
    _, got = changes(spark, [[{"a": 1, "e": {}}, "broken", "[1]"], [{"a": 1}, {"a": "x"}], [{"a": "x"}, {"a": 1}, {"a": None}], [{"a": "1"}]])
    assert got == [(2, "retyped", "a", "a")] or all(k == "retyped" for _, k, _, _ in got)
    empty = drift.Drift(spark.createDataFrame([], "row_id bigint, file_id bigint, payload string"), spark.createDataFrame([], "file_id bigint, feed_id bigint, seq_no int, source_path string, file_format string"))
    assert empty.changes.count() == 0


def test_dim_join_ways_agree(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    a, b = ([(r["id"], r["v"]) for r in dim_join(big, dim, ["k"], bound=x).orderBy("id").collect()] for x in (10, 0))
    assert a == b and len(a) == 1000


def test_transitions_compose():
    classes = np.random.default_rng(1).integers(0, 4, 5000).astype(np.uint8)
    state, want = 0, []
    for c in classes:
        want.append(state)
        state = rawload.TRANSITIONS[c, state]
    for chunk in (1, 13, 256, 9999):
        assert rawload.scan_states(classes, chunk).tolist() == want
