"""Queries of the sources, sinks, JSON mutations, profiles and purges over whole tables, each with its SQL equivalent.

Files are written by the engine's own sinks below the shared folder and read back by its sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltsieve.functions import jsontext as J
from siltsieve.functions.paths import column_at
from siltsieve.operators import dedupe, ingest, profile, purge, rewrite, rules, search
from siltsieve.report import _facts, human_size
from siltsieve.session import shared_folder, table
from siltsieve.sinks import writers as W
from siltsieve.sources.discovery import Source, discover
from siltsieve.sources.records import read_records
from siltsieve.streaming import incremental

QUERIES = {}
ORACLES = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _at(path: str, kind: str = "string", data: str = "data") -> Column:
    return column_at(F.try_parse_json(data), path, kind)


# ---- files ---------------------------------------------------------------------------------------------


@_query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment, 'jsonl' AS kind FROM customer")
def file_jsonl(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "jsonl")
    W.write_table(table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path, "jsonl")
    r = read_records(s, path).filter("decode_error is null")
    return r.select(_at("c_custkey", "bigint").alias("c_custkey"), _at("c_name").alias("c_name"), _at("c_nationkey", "int").alias("c_nationkey"), _at("c_mktsegment").alias("c_mktsegment"), F.lit("jsonl").alias("kind"))


@_query("""SELECT * FROM (SELECT row_number() OVER (ORDER BY c_custkey)::INTEGER AS line_number, CASE WHEN c_custkey % 17 <> 5 AND c_custkey % 19 <> 6 THEN '{"id":' || c_custkey || ',"n":1.0}' END AS data,
c_custkey % 17 = 5 OR c_custkey % 19 = 6 AS failed, c_custkey % 10 = 3 AS blank FROM customer) WHERE NOT blank""")
def file_line_numbers(s: SparkSession, d: str) -> DataFrame:
    """Numbers of lines in a file of valid, blank and broken lines."""
    k = F.col("c_custkey")
    line = F.when(k % 10 == 3, "  ").when(k % 17 == 5, "{oops").when(k % 19 == 6, "[1]").otherwise(F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "n": 1.0}')))
    path = shared_folder(s, "lines") + ".jsonl"
    table(s, d, "customer").orderBy(k).select(line.alias("value")).coalesce(1).write.text(path)
    r = read_records(s, _parts(s, path, "jsonl"))
    return r.select("line_number", "data", F.col("decode_error").isNotNull().alias("failed"), F.lit(False).alias("blank"))


def _parts(s: SparkSession, path: str, fmt: str) -> list[Source]:
    """The part files of a written folder, whatever their extension, as sources of a format."""
    p = s._jvm.org.apache.hadoop.fs.Path(path)
    found = [f for f in p.getFileSystem(s._jsc.hadoopConfiguration()).listStatus(p) if f.getPath().getName().startswith("part-")]
    return [Source(f.getPath().toString(), path, fmt, f.getLen(), 0.0) for f in found]


@_query("SELECT doc_id::VARCHAR AS doc_id, coalesce(title, '') AS title FROM documents")
def file_csv(s: SparkSession, d: str) -> DataFrame:
    """Titles with separators, quotes and line breaks through a CSV file and back."""
    path = shared_folder(s, "csv")
    W.write_table(table(s, d, "documents").select("doc_id", "title"), path, "csv")
    return read_records(s, path).select(_at("doc_id").alias("doc_id"), _at("title").alias("title"))


@_query("SELECT c_nationkey, 1::BIGINT AS files, count(*) AS items FROM customer GROUP BY c_nationkey")
def file_documents(s: SparkSession, d: str) -> DataFrame:
    """JSON documents, one a nation, found in their folders and read whole."""
    c = table(s, d, "customer").select("c_nationkey", F.struct("c_custkey", "c_name").alias("item"))
    path = shared_folder(s, "documents")
    W.write_table(c.groupBy("c_nationkey").agg(F.collect_list("item").alias("items")), path, "json", ("c_nationkey",))  # a document holds one nation's customers
    r = read_records(s, discover(path, ("json",), s), json_mode="document")
    nation = F.regexp_extract("folder", "c_nationkey=(.*)$", 1).cast("int")
    items = F.from_json(F.get_json_object("data", "$.items"), "array<struct<c_custkey:bigint>>")
    return r.select(nation.alias("c_nationkey"), "source_path", F.size(items).alias("n")).groupBy("c_nationkey").agg(F.count_distinct("source_path").alias("files"), F.sum("n").alias("items"))


@_query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS nation FROM supplier")
def file_xml(s: SparkSession, d: str) -> DataFrame:
    """Suppliers through XML with an attribute and a nested element."""
    path = shared_folder(s, "xml")
    t = table(s, d, "supplier").select(F.col("s_suppkey").alias("_key"), "s_name", F.struct(F.col("s_nationkey").alias("nation")).alias("home"))
    t.write.format("xml").option("rootTag", "suppliers").option("rowTag", "supplier").save(path)
    r = read_records(s, _parts(s, path, "xml"), xml_path="suppliers.supplier")
    return r.select(_at("@key").alias("s_suppkey"), _at("s_name").alias("s_name"), _at("home.nation").alias("nation"))


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'")
def file_stream(s: SparkSession, d: str) -> DataFrame:
    """New files of a folder through the incremental stream into a table."""
    path, out = shared_folder(s, "arriving"), shared_folder(s, "arrived")
    W.write_table(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, "jsonl")
    each = lambda batch, n: batch.filter(_at("o_orderpriority", data="raw") == "1-URGENT").select(_at("o_orderkey", "bigint", "raw").alias("o_orderkey"), _at("o_orderstatus", data="raw").alias("o_orderstatus")).write.mode("append").parquet(out)
    for _ in range(2):  # the second run finds nothing new
        incremental.process_available(incremental.stream_lines(s, path), f"{out}-checkpoint", each)
    return s.read.schema("o_orderkey bigint, o_orderstatus string").parquet(out)


@_query("""SELECT file_id::VARCHAR AS "Id", regexp_extract(source_path, '([^/]*)$', 1) AS "SourceFile", coalesce(CASE WHEN status <> 'failed' THEN status END, 'none') AS "LastName",
coalesce(strftime(completed_at, '%Y-%m-%dT%H:%M:%SZ'), strftime(delivered_at, '%Y-%m-%dT%H:%M:%SZ')) AS "SourceModifiedDate",
'A=' || feed_id || ';B=' || seq_no AS attributes, CASE WHEN file_id % 2 = 0 THEN 'gone' ELSE '' END AS missing FROM file_stats""")
def ingest_records(s: SparkSession, d: str) -> DataFrame:
    """Schemaless records: defaults, precedence of dates, sorted attributes, null texts, missing fields, file names and times."""
    f = table(s, d, "file_stats")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.struct(F.col("file_id").alias("id"), F.when(F.col("status") == "failed", " N/A ").otherwise(F.concat(F.lit("  "), "status")).alias("name"), F.struct(F.col("seq_no").alias("seq"), F.col("feed_id").alias("feed")).alias("in"), iso("completed_at").alias("done"))
    rows = f.select("source_path", F.col("delivered_at").alias("file_mtime"), F.when(F.col("file_id") % 2 == 0, F.to_json(body)).otherwise(F.to_json(F.struct(body["id"].alias("id"), body["name"].alias("name"), body["in"].alias("in"), body["done"].alias("done"), F.lit("x").alias("gone")))).alias("data"))
    m = ingest.Mapping(columns={"id": "Id", "name": "LastName"}, attributes={"in.seq": "B", "in.feed": "A"}, defaults={"LastName": "none"}, source_modified_date_field="done")
    gone = ingest.Mapping(columns={"gone": "PostCode"})
    u = ingest.unify_records(rows, m, "2024-01-01T00:00:00Z")
    w = ingest.unify_records(rows.withColumn("source_path", F.get_json_object("data", "$.id")), gone, "2024-01-01T00:00:00Z").select(F.col("source_path").alias("Id"), F.concat_ws(",", "missing").alias("missing"))
    u = u.join(w, "Id")
    pairs = F.array_join(F.transform("Attributes", lambda a: F.concat(a["Key"], F.lit("="), a["Value"])), ";")
    return u.select("Id", "SourceFile", "LastName", "SourceModifiedDate", pairs.alias("attributes"), w["missing"])


@_query("SELECT source_path FROM file_stats WHERE source_path NOT IN (SELECT source_path FROM file_stats WHERE status = 'success' AND source_path IS NOT NULL)")
def pending_files(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "file_stats")
    return incremental.pending(f.filter("source_path is not null").select("source_path"), f.filter("status = 'success'"))


@_query("""SELECT f.feed_id, count(*) AS rows_processed, count(DISTINCT c.file_id) AS files_processed, count(*)::DOUBLE / count(DISTINCT c.file_id) AS rows_per_file FROM contact_rows c JOIN file_stats f ON c.file_id = f.file_id GROUP BY f.feed_id""")
def folder_files(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "contact_rows").join(table(s, d, "file_stats").select("file_id", "feed_id"), "file_id")
    return dedupe.folder_files(rows, "feed_id", "file_id")


# ---- mutations of records ------------------------------------------------------------------------------


def _orders(s: SparkSession, d: str, *fields: Column) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", F.to_json(F.struct(*fields)).alias("raw"))


_ID = "'{\"id\":' || o_orderkey || '"


@_query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN NULL ELSE {_ID},"state":"' || o_orderstatus || '","meta":[{{"level":"' ||
CASE WHEN o_orderpriority = '1-URGENT' THEN '0-NOW' ELSE o_orderpriority END || '"}}],"n":1.50}}' END AS new_raw FROM orders""")
def rewrite_records(s: SparkSession, d: str) -> DataFrame:
    """Whole records after a guarded deletion and a recursive update; number lexemes stay as they were."""
    o = table(s, d, "orders")
    raw = F.concat(F.lit('{"id":'), F.col("o_orderkey").cast("string"), F.lit(',"state":"'), "o_orderstatus", F.lit('","meta":[{"level":"'), "o_orderpriority", F.lit('"}],"n":1.50}'))
    ids = frozenset(["F"])
    job = rewrite.Rewrite(top_level_key="state", top_level_values=ids, state_key="third", state_value="yes", update_key="level", update_old_value="1-URGENT", update_new_value="0-NOW")
    third = F.regexp_replace(raw, r"\}$", ',"third":"yes"}')
    out = rewrite.rewrite_lines(o.select("o_orderkey", F.when((F.col("o_orderkey") % 3 == 0) & (F.col("o_orderstatus") == "F"), third).otherwise(raw).alias("raw")), job)
    return out.select("o_orderkey", "new_raw")


@_query(f"SELECT o_orderkey, {_ID},\"v\":' || CASE o_orderkey % 3 WHEN 0 THEN '7' WHEN 1 THEN '\"7\"' ELSE '{{\"v\":[true]}}' END || '}}' AS new_raw FROM orders")
def rewrite_typed(s: SparkSession, d: str) -> DataFrame:
    """Replacements take the type of the value they replace."""
    k = F.col("o_orderkey")
    v = F.when(k % 3 == 0, "5").when(k % 3 == 1, '"5"').otherwise('{"v":[true]}')
    raw = F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"v":'), v, F.lit("}"))
    job = rewrite.Rewrite(update_key="v", update_old_value="5", update_new_value="7")
    return rewrite.rewrite_lines(table(s, d, "orders").select("o_orderkey", raw.alias("raw")), job).select("o_orderkey", "new_raw")


@_query(f"""SELECT o_orderkey, {_ID}' || CASE o_orderkey % 3 WHEN 0 THEN ',"items":{{"i":{{"k":"2"}}}}' WHEN 1 THEN ',"items":{{}}' ELSE ',"items":{{"i":[{{"k":"2"}},{{"k":"3"}}]}}' END || '}}' AS new_raw FROM orders""")
def rewrite_container(s: SparkSession, d: str) -> DataFrame:
    """Items of a wrapper object: none, one or several stay."""
    k = F.col("o_orderkey")
    items = F.when(k % 3 == 0, '[{"k":"1"},{"k":"2"}]').when(k % 3 == 1, '{"k":"1"}').otherwise('[{"k":"2"},{"k":"1"},{"k":"3"}]')
    raw = F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"items":{"i":'), items, F.lit("}}"))
    job = rewrite.Rewrite(array_key="items", array_delete_key="k", array_delete_values=frozenset(["1"]))
    return rewrite.rewrite_lines(table(s, d, "orders").select("o_orderkey", raw.alias("raw")), job).select("o_orderkey", "new_raw")


@_query(f"SELECT o_orderkey, {_ID},\"a\":{{' || CASE WHEN o_orderstatus = 'O' THEN '' ELSE '\"s\":\"' || o_orderstatus || '\",' END || '\"t\":1}}}}' AS new_raw FROM orders")
def delete_at_path(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d, F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("s"), F.lit(1).alias("t")).alias("a"))
    out = rules.apply_rules(o, [search.Target("open", "a.s", ["o"], kind="nested_object")], [rules.Rule("open", "delete_matches")])
    return out.select("o_orderkey", "new_raw")


@_query(f"""SELECT o_orderkey, {_ID},"homes":[' || CASE WHEN o_orderkey % 2 = 0 THEN '{{"s":"x","t":2}}' ELSE '{{"s":"y"}},{{"s":"x","t":2}}' END || ']}}' AS new_raw FROM orders""")
def delete_sub_key_records(s: SparkSession, d: str) -> DataFrame:
    """Values at a wildcard path go; objects left empty go with them."""
    y = F.when(F.col("o_orderkey") % 2 == 0, "drop").otherwise("y")
    o = _orders(s, d, F.col("o_orderkey").alias("id"), F.array(F.to_json(F.struct(y.alias("s")))).alias("homes"))
    raw = F.concat(F.lit('{"id":'), F.col("o_orderkey").cast("string"), F.lit(',"homes":[{"s":"'), y, F.lit('"},{"s":"x","t":2}]}'))
    o = o.select("o_orderkey", raw.alias("raw"))
    out = rules.apply_rules(o, [search.Target("any", "homes[*].s", ["x"], kind="path")], [rules.Rule("any", "delete_sub_key", sub_key_path="homes[*].s", sub_key_values=["drop"])])
    return out.select("o_orderkey", "new_raw")


@_query(f"""SELECT o_orderkey, 'mark_for_deletion' AS action, {_ID},"p":"' || o_orderpriority || '","_marked_for_deletion":true,"_deletion_reason":"low","_deletion_matches":1}}' AS record FROM orders WHERE o_orderpriority = '5-LOW'""")
def rule_artefact(s: SparkSession, d: str) -> DataFrame:
    """The derived output of one rule."""
    o = _orders(s, d, F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"))
    out = rules.apply_rules(o, [search.Target("low", "p", ["5-low"])], [rules.Rule("low", "mark_for_deletion", "out")])
    return rules.rule_output(out, "low", "mark_for_deletion").select(F.get_json_object("record", "$.id").cast("bigint").alias("o_orderkey"), "action", "record")


@_query("""SELECT o_orderstatus AS source_path, count(*) AS total_rows, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS deleted_rows, 0::BIGINT AS modified_rows,
count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS matches, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS errors FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS p2 FROM orders) o
GROUP BY o_orderstatus""".replace("o_orderpriority = '5-LOW'", "p2 = '5-LOW'"))
def deletion_batch(s: SparkSession, d: str) -> DataFrame:
    """Statistics of a batch of inputs, malformed lines counted."""
    o = table(s, d, "orders").select(F.col("o_orderstatus").alias("source_path"), F.when(F.col("o_orderkey") % 11 == 0, "{oops").otherwise(F.to_json(F.struct(F.col("o_orderpriority").alias("p")))).alias("raw"))
    return rules.batch_report(rules.apply_rules(o, [search.Target("low", "p", ["5-LOW"], True)], [rules.Rule("low", "delete_row")]))


@_query("SELECT o_orderkey, '{\"id\":' || o_orderkey || ',\"a\":[\"' || o_orderstatus || '\"]}' AS fixed FROM orders")
def repaired_json(s: SparkSession, d: str) -> DataFrame:
    """Single quotes and trailing commas mended."""
    raw = F.concat(F.lit("{'id':"), F.col("o_orderkey").cast("string"), F.lit(",'a':['"), "o_orderstatus", F.lit("',],}"))
    mend = F.pandas_udf(lambda x: x.map(J.repair), "string")
    return table(s, d, "orders").select("o_orderkey", F.regexp_replace(mend(raw), r"\s", "").alias("fixed"))


@_query("""SELECT sha256('{"a":{"s":"' || o_orderstatus || '","t":[' || o_custkey % 5 || ']},"p":"' || o_orderpriority || '"}') AS row_hash, count(*) * 2 AS occurrences FROM orders GROUP BY o_orderstatus, o_custkey % 5, o_orderpriority""")
def canonical_hash(s: SparkSession, d: str) -> DataFrame:
    """Records that differ in the order of their keys are one row."""
    o = table(s, d, "orders")
    s1, t, p = F.col("o_orderstatus").alias("s"), F.array(F.col("o_custkey") % 5).alias("t"), F.col("o_orderpriority").alias("p")
    raw = o.select(F.explode(F.array(F.to_json(F.struct(F.struct(s1, t).alias("a"), p)), F.to_json(F.struct(p, F.struct(t, s1).alias("a"))))).alias("raw"))
    return dedupe.duplicate_groups(raw.select(dedupe.row_hash(_facts("a", "full_row", [], [])("raw")["row"]).alias("row_hash")), ["row_hash"])


@_query("""SELECT sha256('{"a":["' || lower(c_mktsegment) || ' x"],"n":' || c_nationkey || '}') AS row_hash, count(*) AS occurrences FROM customer GROUP BY c_mktsegment, c_nationkey HAVING count(*) > 1""")
def semantic_hash(s: SparkSession, d: str) -> DataFrame:
    """Texts at any depth compared in lower case with blanks collapsed."""
    blank = F.when(F.col("c_custkey") % 2 == 0, "  X ").otherwise(" x")
    raw = table(s, d, "customer").select(F.to_json(F.struct(F.col("c_nationkey").alias("n"), F.array(F.concat("c_mktsegment", blank)).alias("a"))).alias("raw"))
    return dedupe.duplicate_groups(raw.select(dedupe.row_hash(_facts("a", "full_row", [], [], True)("raw")["row"]).alias("row_hash")), ["row_hash"])


@_query("SELECT c_nationkey AS folder, count(*) AS rows_processed, count(*) FILTER (WHERE c_custkey % 4 <> 0) AS keys_found FROM customer GROUP BY c_nationkey")
def key_presence(s: SparkSession, d: str) -> DataFrame:
    """A key counts as present whatever its value, null included."""
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, '{"other":1}').when(k % 4 == 1, '{"id":null}').otherwise(F.concat(F.lit('{"id":'), k.cast("string"), F.lit("}")))
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("folder"), _facts("id", "full_row", [], [])(raw)["key"].alias("key"))
    return c.groupBy("folder").agg(F.count("*").alias("rows_processed"), F.count("key").alias("keys_found"))


# ---- search --------------------------------------------------------------------------------------------


def _places(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    return c.select("c_custkey", F.to_json(F.struct(F.struct(F.col("c_mktsegment").alias("x"), F.col("c_nationkey").alias("y"), F.array(F.lit("BUILDING")).alias("z")).alias("a"))).alias("raw"))


@_query("SELECT c_custkey, 'a.x' AS path, 'building' AS matched_value FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'a.y', '3' FROM customer WHERE c_nationkey = 3")
def search_wildcard(s: SparkSession, d: str) -> DataFrame:
    """Any key of an object; arrays are not entered."""
    t = search.Target("any", "a.*", ["building", "3"], kind="jsonpath")
    return search.wildcard_match(_places(s, d), F.try_parse_json("raw"), "a.*", t).select("c_custkey", "path", "matched_value")


@_query("SELECT c_custkey, 'any' AS target, 'a.x' AS path, 'BUILDING' AS value FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'any', 'a.y', '3' FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, 'first', 'a.z[0]', 'BUILDING' FROM customer")
def match_rows(s: SparkSession, d: str) -> DataFrame:
    """All matches of a record for all targets, with the concrete path of each."""
    out = rules.apply_rules(_places(s, d), [search.Target("any", "a.*", ["building", "3"], kind="jsonpath"), search.Target("first", "$.a.z[*]", ["BUILDING"], True, kind="path")], [])
    return out.select("c_custkey", F.explode("matches").alias("m")).select("c_custkey", "m.target", "m.path", "m.value")


@_query("""SELECT l_orderkey, 'items[' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey) - 1) || '].l_returnflag' AS path, l_returnflag FROM lineitem QUALIFY l_returnflag = 'R'""")
def search_array_paths(s: SparkSession, d: str) -> DataFrame:
    """Matches inside arrays with the path of the element."""
    li = table(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_returnflag", "l_partkey").alias("item"))
    o = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list("item")).alias("items"))).alias("raw"))  # an order has few items
    out = rules.apply_rules(o, [search.Target("returned", "items[*].l_returnflag", ["R"], True, kind="nested_array")], [])
    return out.select("l_orderkey", F.explode("matches").alias("m")).select("l_orderkey", "m.path", F.col("m.value").alias("l_returnflag"))


_KINDS = ["null", "string", "boolean", "number", "array", "object"]


@_query("SELECT o_orderkey % 6 AS kind, CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END AS name, count(*) AS n FROM orders GROUP BY o_orderkey % 6")
def search_types(s: SparkSession, d: str) -> DataFrame:
    texts = ["null", '"x"', "true", "1.5", "[1]", '{"a":1}']
    raw = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    o = table(s, d, "orders").select((F.col("o_orderkey") % 6).alias("kind"), F.try_parse_json(raw).alias("v"))
    name = F.coalesce(*[F.when(search.has_type(F.col("v"), k), k) for k in _KINDS])
    return o.groupBy("kind", name.alias("name")).agg(F.count("*").alias("n"))


@_query("SELECT c_custkey, c_mktsegment AS segment, 'BUILDING' AS first, CASE WHEN c_nationkey > 9 THEN c_nationkey END AS nation FROM customer")
def path_lookup(s: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("raw")
    y = column_at(v, "a.y", "int")
    return _places(s, d).select("c_custkey", column_at(v, ".a.x").alias("segment"), column_at(v, "$.a.z[0]").alias("first"), F.when(y > 9, y).alias("nation"))


# ---- purges --------------------------------------------------------------------------------------------

_LOC = "SELECT file_id::VARCHAR AS source_path, line_number, raw_text FROM raw_lines"


def _located(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_lines").select(F.col("file_id").cast("string").alias("source_path"), "line_number", "raw_text")


@_query(f"SELECT source_path, line_number FROM (SELECT *, row_number() OVER (PARTITION BY raw_text ORDER BY source_path, line_number) AS r FROM ({_LOC}) WHERE raw_text IS NOT NULL) WHERE r > 1")
def purge_surplus(s: SparkSession, d: str) -> DataFrame:
    """Locations of all but the first row of each group of equal rows."""
    return purge.surplus(_located(s, d), "raw_text")


@_query(f"SELECT source_path, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY raw_text ORDER BY source_path DESC, line_number DESC) AS r FROM ({_LOC})) WHERE r = 1 OR raw_text IS NULL GROUP BY source_path")
def purge_remaining(s: SparkSession, d: str) -> DataFrame:
    """Rows left per file when the last of each group is kept."""
    rows = _located(s, d)
    return purge.without(rows, purge.surplus(rows, "raw_text", "last")).groupBy("source_path").agg(F.count("*").alias("n"))


def _purgeable(s: SparkSession, d: str) -> DataFrame:
    item = lambda k: F.struct(F.struct(k.alias("id")).alias("part"))
    return _orders(s, d, F.struct(F.col("o_orderpriority").alias("p")).alias("meta"), F.struct(F.array(item(F.col("o_orderstatus")), item(F.lit("X"))).alias("list")).alias("items"))


@_query("SELECT o_orderkey, o_orderpriority = '5-LOW' AS deleted FROM orders")
def purge_ids(s: SparkSession, d: str) -> DataFrame:
    return purge.purge_lines(_purgeable(s, d), [purge.Purge("id_purge", "meta.p", frozenset(["5-LOW"]))]).select("o_orderkey", "deleted")


@_query("""SELECT o_orderkey, '{"meta":{"p":"' || o_orderpriority || '"},"items":{"list":[' || CASE WHEN o_orderstatus = 'O' THEN '' ELSE '{"part":{"id":"' || o_orderstatus || '"}},' END || '{"part":{"id":"X"}}]}}' AS new_raw,
CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS items_removed FROM orders""")
def purge_items(s: SparkSession, d: str) -> DataFrame:
    return purge.purge_lines(_purgeable(s, d), [purge.Purge("array_purge", "items.list", frozenset(["O"]), "part.id")]).select("o_orderkey", "new_raw", "items_removed")


@_query("""SELECT o_orderkey, o_orderpriority = '5-LOW' AS deleted, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END + 1 AS items_removed FROM orders""")
def purge_batch(s: SparkSession, d: str) -> DataFrame:
    """Several purges of one batch, one pass over the rows."""
    batch = [purge.Purge("array_purge", "items.list", frozenset(["O", "X"]), "part.id"), purge.Purge("id_purge", "meta.p", frozenset(["5-LOW"]))]
    return purge.purge_lines(_purgeable(s, d), batch).select("o_orderkey", "deleted", "items_removed")


@_query("SELECT count(*) AS total_keys, count(*) FILTER (WHERE n > 1) AS duplicate_keys, sum(n)::BIGINT AS total_rows, count(*) AS kept_rows, (sum(n) - count(*))::BIGINT AS purged_rows, 'newest' AS strategy FROM (SELECT count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id)")
def dedup_totals(s: SparkSession, d: str) -> DataFrame:
    return dedupe.dedup_summary(table(s, d, "events"), "user_id", "newest")


@_query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE strftime(o_orderdate::DATE, '%Y-%m-%d') || CASE WHEN o_orderkey % 5 < 2 THEN ' 03:00:00' ELSE ' 00:00:00' END END AS at FROM orders""")
def row_times(s: SparkSession, d: str) -> DataFrame:
    """The first field that reads as a time under one of the layouts."""
    day = F.col("o_orderdate").cast("date")
    text = lambda f: F.date_format(day, f)
    k = F.col("o_orderkey") % 5
    o = table(s, d, "orders").select("o_orderkey", F.when(k == 0, F.concat(text("yyyy-MM-dd"), F.lit("T03:00:00Z"))).when(k == 4, "soon").alias("updated_at"), F.when(k == 1, F.concat(text("yyyy-MM-dd"), F.lit(" 03:00:00"))).when(k == 2, text("yyyy-MM-dd")).when(k == 3, text("MM/dd/yyyy")).alias("created_at"))
    return o.select("o_orderkey", F.date_format(dedupe.row_time(o), "yyyy-MM-dd HH:mm:ss").alias("at"))


# ---- profiles ------------------------------------------------------------------------------------------

_DEEP = """WITH t AS (SELECT c_nationkey AS folder, c_custkey AS id, c_mktsegment AS s FROM customer),
cells AS (SELECT folder, 'id' AS path, id::VARCHAR AS value, CASE WHEN id % 3 = 0 THEN 'string' ELSE 'integer' END AS kind, NULL AS element FROM t
UNION ALL SELECT folder, 'home', '{"segment":"' || s || '"}', 'object', NULL FROM t UNION ALL SELECT folder, 'home.segment', s, 'string', NULL FROM t
UNION ALL SELECT folder, 'tags', CASE WHEN id % 2 = 0 THEN '["' || s || '",1]' ELSE '[2.5]' END, 'array', CASE WHEN id % 2 = 0 THEN 'string' ELSE 'number' END FROM t
UNION ALL SELECT folder, 'items', '[{"k":' || folder || '},{"k":null}]', 'array', 'object' FROM t UNION ALL SELECT folder, 'items[].k', folder::VARCHAR, 'integer', NULL FROM t UNION ALL SELECT folder, 'items[].k', NULL, 'null', NULL FROM t)
"""
_FIELDS = """path, count(*) AS occurrences, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS type, CASE WHEN count(DISTINCT element) <= 1 THEN min(element) ELSE 'mixed' END AS element_type,
least(count(DISTINCT value), 10000) AS unique_values, min(strlen(value)) AS min_length, max(strlen(value)) AS max_length, count(*) FILTER (WHERE kind = 'null') > 0 AS nullable, array_to_string(list_slice(list_sort(list(DISTINCT value) FILTER (WHERE value IS NOT NULL)), 1, 5), '|') AS examples"""


def _deep(s: SparkSession, d: str) -> DataFrame:
    c, k = table(s, d, "customer"), F.col("c_custkey")
    raw = F.concat(F.lit('{"id":'), F.when(k % 3 == 0, F.concat(F.lit('"'), k.cast("string"), F.lit('"'))).otherwise(k.cast("string")), F.lit(',"home":{"segment":"'), "c_mktsegment", F.lit('"},"tags":'), F.when(k % 2 == 0, F.concat(F.lit('["'), "c_mktsegment", F.lit('",1]'))).otherwise("[2.5]"), F.lit(',"items":[{"k":'), F.col("c_nationkey").cast("string"), F.lit('},{"k":null}]}'))
    return c.select(F.col("c_nationkey").alias("folder"), raw.alias("raw"))


def _shown(p: DataFrame, *more: str) -> DataFrame:
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return p.select(*more, "path", "occurrences", "type", "element_type", big("unique_values"), big("min_length"), big("max_length"), "nullable", F.array_join("examples", "|").alias("examples"), F.round("percentage", 6).alias("percentage"))


@_query(_DEEP + f"SELECT {_FIELDS}, round(count(*) * 100.0 / (SELECT count(*) FROM t), 6)::DOUBLE AS percentage FROM cells GROUP BY path")
def profile_nested(s: SparkSession, d: str) -> DataFrame:
    """Types, element types, lengths, examples and percentages of nested fields."""
    return _shown(profile.profile_json(_deep(s, d), "raw"))


@_query(_DEEP + f"SELECT folder, {_FIELDS}, round(count(*) * 100.0 / max(n), 6)::DOUBLE AS percentage FROM (SELECT cells.*, n FROM cells JOIN (SELECT folder AS f, count(*) AS n FROM t GROUP BY folder) ON f = folder UNION ALL SELECT NULL, path, value, kind, element, (SELECT count(*) FROM t) FROM cells) GROUP BY folder, path")
def profile_folders(s: SparkSession, d: str) -> DataFrame:
    """The profile of all rows and that of each folder from one pass."""
    return _shown(profile.profile_json(_deep(s, d), "raw", ["folder"], overall=True), "folder")


@_query("SELECT least(count(*), 500) AS sampled_rows, count(*) AS total_rows, least(count(*), 500)::DOUBLE / count(*) AS sample_rate FROM customer")
def sampling_rate(s: SparkSession, d: str) -> DataFrame:
    """The sampling operator with its cap, and the rate it reports."""
    c = table(s, d, "customer")
    return profile.sample_rate(profile.sampled(c, 1.0, 17, 500), c)


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576.0) ELSE printf('%.1f GiB', b / 1073741824.0) END AS size FROM (SELECT l_orderkey, l_linenumber, l_partkey * l_partkey * l_suppkey AS b FROM lineitem)")
def human_sizes(s: SparkSession, d: str) -> DataFrame:
    size = F.pandas_udf(lambda x: x.map(human_size), "string")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", size(F.col("l_partkey") * F.col("l_partkey") * F.col("l_suppkey")).alias("size"))
