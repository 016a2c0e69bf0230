"""Queries of the general data-preparation problems over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltsieve.operators import drift, eav, instants, nested, rawload
from siltsieve.session import table

CONTACT_FIELDS = ["Id", "FirstName", "LastName", "Email", "Mobile", "PostCode", "DataSource"]


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return eav.eav_to_wide(table(spark, d, "unified_attributes"), table(spark, d, "attribute_types"), "row_id", "attr_key", "attr_value", ["loaded_at", "attr_row_id"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return eav.cell_issues(_wide(spark, d)).filter("issue in ('unreadable', 'conflict')")


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).drop("issues").withColumnRenamed("entity", "row_id")


def _drift(spark: SparkSession, d: str) -> drift.Drift:
    return drift.Drift(table(spark, d, "contact_rows"), table(spark, d, "file_stats"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).changes


def p3_contacts(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).contacts(table(spark, d, "file_mappings"), CONTACT_FIELDS)


def p3_versions(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).versions.select("file_id", "feed_id", "seq_no", "prev_id", "fingerprint", "version")


def p3_steps(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).steps()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.timestamp_report(table(spark, d, "unified_records"), table(spark, d, "profiles"), table(spark, d, "source_profiles"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The typed and the textual documents in one form: record_no, payload."""
    fields = F.struct("id", "customer_id", "state", "line_items", "placed_at")
    typed = table(spark, d, "order_docs").select("record_no", F.to_json(fields, {"ignoreNullFields": "true"}).alias("payload"))
    return typed.unionByName(table(spark, d, "customer_docs").select("record_no", "payload"))


def _relation(spark: SparkSession, d: str, element: str) -> DataFrame:
    """The relation of an element of the documents (the root for ''), with all its inlined columns."""
    docs = _documents(spark, d)
    edges = nested.schema_graph(docs, "payload")
    relations = nested.decide_relations(edges)
    name = relations[element].name if element in relations else element
    return nested.relation_table(nested.shred(docs, "record_no", "payload", relations), name, nested.inlined_paths(edges, relations, name))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_items(spark, d).select("record_no", F.col("node_no").alias("item_no"), F.col("same_parent_no").alias("parent_no"), F.coalesce("item_id", F.lit("")).alias("item_id"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return _relation(spark, d, "line_items")


def p6_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders inside customer documents; items point to them by parent_relation and parent_no."""
    return _relation(spark, d, "orders")


def p6_years(spark: SparkSession, d: str) -> DataFrame:
    return _relation(spark, d, "years")


def p6_tags(spark: SparkSession, d: str) -> DataFrame:
    """A relation of plain values: each has its value and its parent."""
    return _relation(spark, d, "tags")


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    return _relation(spark, d, "")


def p6_profiles(spark: SparkSession, d: str) -> DataFrame:
    return nested.inline_struct(table(spark, d, "profiles"))


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    return rawload.load_raw(table(spark, d, "raw_lines"), table(spark, d, "file_stats"), table(spark, d, "field_specs"), dates=("joined",))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return rawload.failed_records(_loaded(spark, d))


def p7_files(spark: SparkSession, d: str) -> DataFrame:
    return rawload.file_counts(_loaded(spark, d))


def p7_errors(spark: SparkSession, d: str) -> DataFrame:
    """The failing records with the offset in their text and the field of the failure."""
    return _loaded(spark, d).filter("kind = 'bad'").select("line_id", "file_id", "line_number", "reason", "error_offset", "error_field")


def p7_rows(spark: SparkSession, d: str) -> DataFrame:
    """The loaded rows: declared numbers and dates typed, other declared fields as text, all further fields as a map."""
    return rawload.typed_rows(_loaded(spark, d), {"customer_id": "string", "first_name": "string", "last_name": "string", "email": "string", "mobile": "string", "postcode": "string", "status": "string", "points": "bigint", "joined": "date", "notes": "string"})


QUERIES = {f.__name__: f for f in (p1_found, p1_wide, p3_found, p3_contacts, p3_versions, p3_steps, p4_found, p6_found, p6_items, p6_orders, p6_years, p6_tags, p6_documents, p6_profiles, p7_found, p7_errors, p7_files, p7_rows)}

_NOTHING = "('', 'null', 'n/a')"
_NUMBER = "CASE WHEN regexp_full_match(val, '[+-]?{m}(?:[0-9]+|[0-9]{{1,3}}(?:,[0-9]{{3}})+)(?:\\.{f})?') THEN CAST(CAST(regexp_replace(val, '[+$, ]', '', 'g') AS DECIMAL(30,8)) AS VARCHAR) END"
_CELLS = f"""WITH names AS (SELECT DISTINCT attr_name, value_type, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS k
FROM (SELECT attr_name, value_type, unnest(list_append(aliases, attr_name)) AS n FROM attribute_types)),
v AS (SELECT a.row_id, n.attr_name, n.value_type, regexp_replace(attr_value, '^\\s+|\\s+$', '', 'g') AS val FROM unified_attributes a
JOIN names n ON regexp_replace(lower(a.attr_key), '[^a-z0-9]', '', 'g') = n.k WHERE a.row_id IS NOT NULL AND lower(regexp_replace(attr_value, '^\\s+|\\s+$', '', 'g')) NOT IN {_NOTHING}),
c AS (SELECT row_id, attr_name, CASE value_type WHEN 'integer' THEN {_NUMBER.format(m="", f="0+")} WHEN 'decimal' THEN {_NUMBER.format(m="(?:[$] ?)?", f="[0-9]+")}
WHEN 'boolean' THEN CASE WHEN lower(val) IN ('true', 't', 'yes', 'y', '1', 'on') THEN 'true' WHEN lower(val) IN ('false', 'f', 'no', 'n', '0', 'off') THEN 'false' END
WHEN 'date' THEN CAST(CAST(try_strptime(val, ['%Y-%m-%d', '%Y/%m/%d', '%Y%m%d', '%Y-%m-%dT00:00:00Z', '%d %b %Y', '%b %d, %Y']) AS DATE) AS VARCHAR) ELSE lower(val) END AS canon FROM v),
cells AS (SELECT row_id, attr_name, count(*) > count(canon) AS unreadable, count(DISTINCT canon) > 1 AS conflict FROM c GROUP BY row_id, attr_name)
"""
ORACLES = {
    "p1_found": _CELLS + "SELECT row_id, attr_name, 'unreadable' AS issue FROM cells WHERE unreadable UNION ALL SELECT row_id, attr_name, 'conflict' FROM cells WHERE conflict",
    "p6_profiles": """SELECT row_id, person.id AS person_id, person.profile.first_name AS person_profile_first_name, person.profile.last_name AS person_profile_last_name, person.profile.email AS person_profile_email,
person.contact.mobile AS person_contact_mobile, person.contact.postcode AS person_contact_postcode, person.preferences.channel AS person_preferences_channel, person.preferences.segment AS person_preferences_segment,
person.loyalty.tier AS person_loyalty_tier, person.loyalty.points AS person_loyalty_points, metadata.source AS metadata_source, metadata.created_at AS metadata_created_at, metadata.updated_at AS metadata_updated_at, metadata.import_batch AS metadata_import_batch FROM profiles""",
    "p6_documents": """SELECT record_no, 1 AS node_no, '' AS parent_relation, 0 AS parent_no, 0 AS same_parent_no, customer_id, NULL AS email, id, strftime(placed_at, '%Y-%m-%dT%H:%M:%S.%g') AS placed_at, NULL AS profile_first_name, state FROM order_docs
UNION ALL SELECT record_no, 1, '', 0, 0, payload->>'$.customer_id', payload->>'$.email', payload->>'$.id', payload->>'$.placed_at', payload->>'$.profile.first_name', payload->>'$.state' FROM customer_docs""",
    "p6_tags": """WITH t AS (SELECT record_no, unnest(list_filter(CAST(payload->'$.profile.tags' AS JSON[]), lambda x: x IS NOT NULL AND json_type(x) <> 'NULL')) AS x, generate_subscripts(list_filter(CAST(payload->'$.profile.tags' AS JSON[]), lambda x: x IS NOT NULL AND json_type(x) <> 'NULL'), 1) AS n
FROM customer_docs WHERE json_type(payload, '$.profile.tags') = 'ARRAY') SELECT record_no, n::INTEGER AS node_no, '' AS parent_relation, 1 AS parent_no, 0 AS same_parent_no, x->>'$' AS value FROM t""",
}
