"""Queries of the record operators over the star-schema tables, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltsieve.operators import dedupe, ingest, profile, rewrite, rules, search
from siltsieve.session import table

QUERIES = {}
ORACLES = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


@_query("SELECT l_orderkey, count(*) AS occurrences FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def dup_keys(s: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_groups(table(s, d, "lineitem"), ["l_orderkey"])


@_query("""SELECT l.l_orderkey, l.l_linenumber, n.occurrences FROM lineitem l
JOIN (SELECT l_orderkey, count(*) AS occurrences FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1) n ON l.l_orderkey = n.l_orderkey""")
def dup_key_locations(s: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_members(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")


@_query("SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def dup_composite(s: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_groups(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("SELECT sha256(text) AS row_hash, count(*) AS occurrences FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1")
def dup_rows(s: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_groups(table(s, d, "documents").filter("text is not null"), [dedupe.row_hash(F.col("text")).alias("row_hash")])


@_query("""SELECT sum(n)::BIGINT AS instances, count(*) AS n_groups FROM (SELECT count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus HAVING count(*) > 1)""")
def dup_rows_exclude(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem")
    g = dedupe.duplicate_groups(t, [dedupe.row_hash(dedupe.canonical_row(t, "exclude_keys", exclude=["l_shipdate"])).alias("r")], "n")
    return g.agg(F.sum("n").alias("instances"), F.count("*").alias("n_groups"))


@_query("SELECT c_nationkey, c_mktsegment, count(*) AS occurrences FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1")
def dup_rows_selective(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "customer")
    h = dedupe.row_hash(dedupe.canonical_row(t, "selective", include=["c_nationkey", "c_mktsegment"]))
    return t.groupBy(h.alias("h")).agg(F.first("c_nationkey").alias("c_nationkey"), F.first("c_mktsegment").alias("c_mktsegment"), F.count("*").alias("occurrences")).filter("occurrences > 1").drop("h")


@_query("""SELECT sum(n)::BIGINT AS total_occurrences, count(*) FILTER (WHERE n > 1) AS keys_duplicated,
coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS duplicate_instances FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)""")
def dup_summary(s: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_summary(table(s, d, "lineitem"), ["l_orderkey"])


@_query("""WITH k AS (SELECT *, count(*) OVER (PARTITION BY thread_id) AS ids, count(*) OVER (PARTITION BY text) AS texts FROM documents)
SELECT source, count(*) AS rows_processed, count(thread_id) AS keys_found,
count(*) FILTER (WHERE thread_id IS NOT NULL AND ids > 1) AS duplicate_ids, count(*) FILTER (WHERE text IS NOT NULL AND texts > 1) AS duplicate_rows FROM k GROUP BY source""")
def folder_rollup(s: SparkSession, d: str) -> DataFrame:
    return dedupe.folder_rollup(table(s, d, "documents").select("source", "thread_id", "text"), "source", "thread_id", "text")


@_query("SELECT o_orderkey, t.v AS matched_value, 'priority' AS target FROM orders JOIN (VALUES ('1-urgent'), ('2-HIGH')) t(v) ON lower(o_orderpriority) = lower(t.v)")
def search_direct(s: SparkSession, d: str) -> DataFrame:
    t = search.Target("priority", "o_orderpriority", ["1-urgent", "2-HIGH"])
    return search.direct_match(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), t).select("o_orderkey", "matched_value", "target")


@_query("SELECT event_id, t.v AS matched_value FROM events JOIN (VALUES ('click'), ('CLICK'), ('view')) t(v) ON lower(event_type) = lower(t.v)")
def search_bag(s: SparkSession, d: str) -> DataFrame:
    t = search.Target("kinds", "event_type", ["click", "CLICK", "view"])
    return search.direct_match(table(s, d, "events").select("event_id", "event_type"), t).select("event_id", "matched_value")


@_query("SELECT event_id, json_extract_string(props, '$.k') AS matched_value FROM events WHERE json_extract_string(props, '$.k') IN ('69', '7')")
def search_nested(s: SparkSession, d: str) -> DataFrame:
    t = search.Target("k", "k", ["69", "7"], kind="nested_object")
    e = table(s, d, "events")
    return search.nested_match(e.select("event_id", F.try_parse_json("props").alias("v")), F.col("v"), "k", t).select("event_id", "matched_value")


def _order_items(s: SparkSession, d: str) -> DataFrame:
    """Orders with their items as an array; an order's items are bounded by the model (seven lines)."""
    li = table(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_returnflag", "l_partkey").alias("item"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("item")).alias("items"))


@_query("SELECT l_orderkey, count(*) AS matches FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey")
def search_array(s: SparkSession, d: str) -> DataFrame:
    t = search.Target("returned", "items[*].l_returnflag", ["R"], True, "nested_array")
    return search.array_match(_order_items(s, d), "items", "l_returnflag", t).groupBy("l_orderkey").agg(F.count("*").alias("matches"))


@_query("""SELECT t.n AS target, count(o.o_orderkey) AS matches FROM (VALUES ('open', 'o'), ('nothing', 'zz')) t(n, v)
LEFT JOIN orders o ON lower(o.o_orderstatus) = t.v GROUP BY t.n""")
def search_summary(s: SparkSession, d: str) -> DataFrame:
    return search.summary(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), [search.Target("open", "o_orderstatus", ["O"]), search.Target("nothing", "o_orderstatus", ["zz"])])


@_query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%greenhouse%'")
def search_contains(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").filter(search.contains(F.col("text"), "Greenhouse")).select("doc_id")


@_query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)a.*e$')")
def search_regex(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").filter(search.regex(F.col("p_name"), "A.*e$")).select("p_partkey")


def _profile_sql(t: str, cols: dict[str, str]) -> str:
    one = "SELECT '{c}' AS path, count(*) AS occurrences, least(count(DISTINCT {c}), 10000) AS unique_values, '{k}' AS type, min(strlen({c}::VARCHAR)) AS min_length, max(strlen({c}::VARCHAR)) AS max_length, count(*) > count({c}) AS nullable FROM {t}"
    return " UNION ALL ".join(one.format(c=c, k=k, t=t) for c, k in cols.items())


@_query(_profile_sql("customer", {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_mktsegment": "string"}))
def profile_columns(s: SparkSession, d: str) -> DataFrame:
    p = profile.profile_columns(table(s, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return p.select("path", "occurrences", F.col("unique_values").cast("bigint").alias("unique_values"), "type", F.col("min_length").cast("bigint").alias("min_length"), F.col("max_length").cast("bigint").alias("max_length"), "nullable")


@_query("SELECT 'k' AS path, count(*) AS occurrences, count(DISTINCT json_extract_string(props, '$.k')) AS unique_values, 'integer' AS type FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def profile_json(s: SparkSession, d: str) -> DataFrame:
    return profile.profile_json(table(s, d, "events"), "props", max_depth=3).select("path", "occurrences", F.col("unique_values").cast("bigint").alias("unique_values"), "type")


@_query("SELECT source AS folder, lang AS value, count(*) AS occurrences FROM documents GROUP BY GROUPING SETS ((lang), (source, lang))")
def profile_by_group(s: SparkSession, d: str) -> DataFrame:
    return profile.profile_groups(table(s, d, "documents"), "lang", "source")


@_query("""SELECT c_custkey::VARCHAR AS "Id", trim(c_name) AS "LastName", 'customers' AS "DataSource" FROM customer
UNION ALL SELECT s_suppkey::VARCHAR, trim(s_name), 'suppliers' FROM supplier""")
def ingest_unified(s: SparkSession, d: str) -> DataFrame:
    a = ingest.unify_table(table(s, d, "customer"), ingest.Mapping(columns={"c_custkey": "Id", "c_name": "LastName"}, data_source="customers"), "customer", "2024-01-01T00:00:00Z")
    b = ingest.unify_table(table(s, d, "supplier"), ingest.Mapping(columns={"s_suppkey": "Id", "s_name": "LastName"}, data_source="suppliers"), "supplier", "2024-01-01T00:00:00Z")
    return a.unionByName(b).select("Id", "LastName", "DataSource")


@_query("""SELECT p_partkey::VARCHAR AS "Id", t.k AS attr_key, t.v AS attr_value FROM part,
LATERAL (VALUES ('Brand', trim(p_brand)), ('Kind', trim(p_type)), ('p_size', p_size::VARCHAR)) t(k, v) WHERE lower(t.v) NOT IN ('', 'null', 'n/a')""")
def ingest_attributes(s: SparkSession, d: str) -> DataFrame:
    m = ingest.Mapping(columns={"p_partkey": "Id", "p_name": "LastName"}, attributes={"p_brand": "Brand", "p_type": "Kind"}, include_unmapped=True)
    u = ingest.unify_table(table(s, d, "part").drop("p_retailprice"), m, "part", "2024-01-01T00:00:00Z")
    return u.select("Id", F.explode("Attributes").alias("a")).select("Id", F.col("a.Key").alias("attr_key"), F.col("a.Value").alias("attr_value"))


@_query("SELECT o_orderkey FROM orders o WHERE NOT (o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING'))")
def rewrite_delete(s: SparkSession, d: str) -> DataFrame:
    listed = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return rewrite.matches_list(table(s, d, "orders"), "o_custkey", listed, F.col("o_orderstatus") == "F").select("o_orderkey")


@_query("SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS left_items, count(*) FILTER (WHERE l_returnflag = 'R') AS deleted_items FROM lineitem GROUP BY l_orderkey")
def rewrite_array_delete(s: SparkSession, d: str) -> DataFrame:
    t = _order_items(s, d).withColumn("kept", rewrite.drop_items("items", "l_returnflag", ["R"]))
    return t.select("l_orderkey", F.size("kept").cast("bigint").alias("left_items"), (F.size("items") - F.size("kept")).cast("bigint").alias("deleted_items"))


@_query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN '0-NOW' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def rewrite_update(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", rewrite.guarded_update("o_orderpriority", "1-URGENT", "0-NOW", F.col("o_orderstatus") == "O").alias("o_orderpriority"))


@_query("""SELECT o_orderstatus AS source_path, count(*) AS lines_read, count(*) FILTER (WHERE o_orderkey % 10 = 0 AND o_orderpriority = '5-LOW') AS lines_deleted,
0::BIGINT AS lines_modified, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS lines_updated, 0::BIGINT AS errors FROM orders GROUP BY o_orderstatus""")
def rewrite_counters(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    raw = F.to_json(F.struct("o_orderkey", F.struct(F.col("o_orderpriority").alias("level")).alias("meta"), F.when((F.col("o_orderkey") % 10 == 0) & (F.col("o_orderpriority") == "5-LOW"), "yes").otherwise("no").alias("drop")))
    job = rewrite.Rewrite(top_level_key="drop", top_level_values=frozenset(["yes"]), update_key="level", update_old_value="1-URGENT", update_new_value="0-NOW")
    return rewrite.counters(rewrite.rewrite_lines(o.select(F.col("o_orderstatus").alias("source_path"), raw.alias("raw")), job))


@_query("""SELECT c_custkey, true AS marked, 'segment' AS reason, 1 AS n_matches FROM customer WHERE lower(c_mktsegment) = 'building'""")
def mark_for_deletion(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", "c_mktsegment")).alias("raw"))
    out = rules.apply_rules(c, [search.Target("segment", "c_mktsegment", ["Building"])], [rules.Rule("segment", "mark_for_deletion")])
    v = F.try_parse_json("new_raw")
    return out.filter(F.size("actions") > 0).select("c_custkey", F.try_variant_get(v, "$._marked_for_deletion", "boolean").alias("marked"), F.try_variant_get(v, "$._deletion_reason", "string").alias("reason"), F.try_variant_get(v, "$._deletion_matches", "int").alias("n_matches"))


@_query("""SELECT count(*) AS total_rows, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS deleted_rows, count(*) FILTER (WHERE c_nationkey = 3) AS modified_rows,
(count(*) FILTER (WHERE c_mktsegment = 'BUILDING') + count(*) FILTER (WHERE c_nationkey = 3))::BIGINT AS matches, 0::BIGINT AS errors FROM customer""")
def rule_statistics(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select(F.to_json(F.struct("c_custkey", "c_mktsegment", F.struct("c_nationkey").alias("home"))).alias("raw"))
    targets = [search.Target("segment", "c_mktsegment", ["building"]), search.Target("nation", "home.c_nationkey", ["3"], kind="nested_object")]
    return rules.rule_statistics(rules.apply_rules(c, targets, [rules.Rule("segment", "delete_row"), rules.Rule("nation", "delete_matches")]))


@_query("SELECT c_custkey, count(*) AS kept FROM customer WHERE c_nationkey <> 3 GROUP BY c_custkey")
def delete_sub_key(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", F.array(F.struct(F.col("c_nationkey").alias("nation"))).alias("homes"))).alias("raw"))
    out = rules.apply_rules(c, [search.Target("any", "homes[*].nation", ["3"], kind="path")], [rules.Rule("any", "delete_sub_key", sub_key_path="homes[*].nation", sub_key_values=["3"])])
    v = F.try_variant_get(F.try_parse_json("new_raw"), "$.homes[0].nation", "int")
    return out.filter(v.isNotNull()).groupBy("c_custkey").agg(F.count("*").alias("kept"))


def _ranked(order: str) -> str:
    return f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rn FROM events) WHERE rn = 1"


@_query(_ranked("event_id"))
def dedup_first(s: SparkSession, d: str) -> DataFrame:
    return dedupe.survivors(table(s, d, "events"), "user_id", "first", ["event_id"]).select("user_id", "event_id")


@_query(_ranked("event_id DESC"))
def dedup_last(s: SparkSession, d: str) -> DataFrame:
    return dedupe.survivors(table(s, d, "events"), "user_id", "last", ["event_id"]).select("user_id", "event_id")


@_query(_ranked("ts DESC NULLS LAST, event_id"))
def dedup_newest(s: SparkSession, d: str) -> DataFrame:
    return dedupe.survivors(table(s, d, "events"), "user_id", "newest", ["event_id"], newest="ts").select("user_id", "event_id")


@_query(_ranked("ts NULLS LAST, event_id"))
def dedup_oldest(s: SparkSession, d: str) -> DataFrame:
    return dedupe.survivors(table(s, d, "events"), "user_id", "oldest", ["event_id"], newest="ts").select("user_id", "event_id")


_COMPLETE = " + ".join(f"CASE WHEN {c} IS NOT NULL AND {c}::VARCHAR <> '' THEN 1 ELSE 0 END" for c in ("event_type", "value", "props"))


@_query(_ranked(f"({_COMPLETE}) DESC, event_id"))
def dedup_best(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return dedupe.survivors(e, "user_id", "most_complete", ["event_id"], score=dedupe.completeness(e, ["event_type", "value", "props"])).select("user_id", "event_id")


@_query(f"SELECT event_id, {_COMPLETE} AS completeness FROM events")
def completeness(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", dedupe.completeness(e, ["event_type", "value", "props"]).alias("completeness"))


@_query("""SELECT sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) AS row_hash, count(*) AS occurrences FROM documents
WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def semantic_dups(s: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_groups(table(s, d, "documents").filter("text is not null"), [dedupe.row_hash(dedupe.semantic_text("text")).alias("row_hash")])


@_query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS occurrences, count(DISTINCT {c}) AS unique_values, count(DISTINCT {c})::DOUBLE / count({c}) AS variance, count(DISTINCT {c})::DOUBLE / count({c}) > 0.8 AS suggest_exclude FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_returnflag")))
def key_variance(s: SparkSession, d: str) -> DataFrame:
    return dedupe.key_variance(table(s, d, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag"])


@_query("""SELECT sum(n)::BIGINT AS total_rows, count(*) AS unique_hashes, count(*) FILTER (WHERE n > 1) AS collided, 1 - count(*)::DOUBLE / sum(n)::DOUBLE AS collision_rate
FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text)""")
def hash_metrics(s: SparkSession, d: str) -> DataFrame:
    return dedupe.hash_metrics(table(s, d, "documents").filter("text is not null"), F.sha2("text", 256))


@_query("SELECT source, lang FROM documents EXCEPT ALL SELECT source, lang FROM documents WHERE lang = 'en'")
def incremental_sources(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").select("source", "lang")
    return dedupe.unprocessed(t, t.filter("lang = 'en'"))


@_query("SELECT c_custkey, sha256(sha256(c_name) || ':' || sha256(c_mktsegment)) AS row_hash FROM customer")
def composite_hash(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", dedupe.composite_hash(F.sha2("c_name", 256), F.sha2("c_mktsegment", 256)).alias("row_hash"))
