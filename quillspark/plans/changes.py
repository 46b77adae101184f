"""Changes of JSON properties and of stored ranges, as rewrites of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import json_values as js
from quillspark.operators import state
from quillspark.registry import query
from quillspark.sources.tables import table


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


# Each event brings the properties it has, its number under its type, a list, and a null if it is an error.
def _brought() -> Column:
    own = F.concat(F.lit('{"'), "event_type", F.lit('":'), F.col("event_id").cast("string"), F.lit(',"pair":['), F.col("event_id").cast("string"), F.lit(',"'), "event_type", F.lit('"],"ok":'), F.when(F.col("event_type") == "error", "null").otherwise("true"), F.lit("}"))
    return js.merge(F.col("props"), own)


_MEMBERS = """m AS (
  SELECT user_id, event_id, 'k' AS name, json_extract(props, '$.k')::VARCHAR AS v FROM events UNION ALL SELECT user_id, event_id, event_type, event_id::VARCHAR FROM events
  UNION ALL SELECT user_id, event_id, 'pair', '[' || event_id || ',"' || event_type || '"]' FROM events UNION ALL SELECT user_id, event_id, 'ok', CASE WHEN event_type = 'error' THEN 'null' ELSE 'true' END FROM events)"""


@query(f"""WITH {_MEMBERS}, l AS (SELECT user_id, name, arg_max(v, event_id) AS v FROM m GROUP BY ALL)
SELECT user_id, '{{' || string_agg('"' || name || '":' || v, ',' ORDER BY name) || '}}' AS props, count(*) AS n_members FROM l GROUP BY user_id""")
def merged_properties(spark: SparkSession, folder: str) -> DataFrame:
    """The properties of each user's events merged in their order: of each member
    the last value stands, also where it is a list or null."""
    e = _events(spark, folder).select("user_id", "event_id", _brought().alias("props"))
    out = js.merged(e, ["user_id"], ["event_id"], "props")
    return out.select("user_id", "props", F.size(F.json_object_keys("props")).cast("long").alias("n_members"))


@query(f"""WITH {_MEMBERS},
o AS (SELECT user_id, name, arg_max(v, event_id) AS v FROM m WHERE event_id % 3 <> 0 GROUP BY ALL), n AS (SELECT user_id, name, arg_max(v, event_id) AS v FROM m WHERE event_id % 3 = 0 AND name <> 'ok' GROUP BY ALL),
b AS (SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.name, o.name) AS name, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.user_id = n.user_id AND o.name = n.name),
p AS (SELECT user_id, '{{' || string_agg('"' || name || '":' || v, ',' ORDER BY name) || '}}' AS props FROM b GROUP BY user_id),
t AS (SELECT user_id, string_agg('"' || event_type || '"', ',' ORDER BY event_id) FILTER (WHERE event_id % 3 <> 0) AS a, string_agg('"' || event_type || '"', ',' ORDER BY event_id) FILTER (WHERE event_id % 3 = 0) AS b,
  arg_max(event_type, event_id) FILTER (WHERE event_id % 3 = 0 AND event_type <> 'view') AS nm, arg_max(event_type, event_id) FILTER (WHERE event_id % 3 <> 0 AND event_type <> 'view') AS om FROM events GROUP BY user_id)
SELECT user_id, props, '[' || concat_ws(',', a, b) || ']' AS tags, coalesce(nm, om) AS mode, CASE WHEN a IS NULL THEN 'created' WHEN b IS NULL THEN 'unchanged' ELSE 'updated' END AS outcome FROM p JOIN t USING (user_id)""")
def merged_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """New rows over old ones of the same user: properties are merged, lists
    joined, other columns replaced where the new value is not null."""
    e = _events(spark, folder).select("user_id", "event_id", "event_type", _brought().alias("props"))

    def rows(some: DataFrame, props: Column) -> DataFrame:
        tags = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.concat(F.lit('"'), x.event_type, F.lit('"')))
        mode = F.max(F.when(F.col("event_type") != "view", F.struct("event_id", "event_type"))).getField("event_type")
        return js.merged(some, ["user_id"], ["event_id"], "props").withColumn("props", props).join(some.groupBy("user_id").agg(js.array_text(tags).alias("tags"), mode.alias("mode")), "user_id")

    old = rows(e.where("event_id % 3 <> 0"), F.col("props"))
    new = rows(e.where("event_id % 3 = 0"), js.delete_path(F.col("props"), ["ok"]))
    return state.upsert(old, new, ["user_id"], merged=("props", "tags"))


@query("""WITH p AS (SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k, event_type AS t, user_id AS u FROM events)
SELECT event_id, '{"at":{"parts":[' || k || ',"x",' || u || '],"type":"' || t || '"},"k":' || k || '}' AS was,
  '{"at":{"parts":[' || k || ',' || event_id || ',' || u || '],"type":"' || t || '"},"k":' || k || '}' AS set_item, '{"at":{"parts":[' || k || ',"x",' || u || '],"type":"' || t || '"},"k":' || k || '}' AS set_nowhere,
  '{"at":{"new":{"u":' || u || '},"parts":[' || k || ',"x",' || u || '],"type":"' || t || '"},"k":' || k || '}' AS set_new, '{"at":{"parts":[' || k || ',"x",null,' || u || '],"type":"' || t || '"},"k":' || k || '}' AS inserted,
  '{"at":{"parts":["x",' || u || '],"type":"' || t || '"},"k":' || k || '}' AS item_deleted, '{"at":{"parts":[' || k || ',"x",' || u || ']},"k":' || k || '}' AS key_deleted,
  CASE WHEN t = 'view' THEN '{"at":{"parts":[' || k || ',"x",' || u || '],"type":"seen"},"k":' || k || '}' ELSE '{"at":{"parts":[' || k || ',"x",' || u || '],"type":"' || t || '"},"k":' || k || '}' END AS renamed FROM p""")
def rewritten_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Values set, added, inserted and deleted by their paths; what leads nowhere
    changes nothing, and a value is rewritten where a condition on a path holds."""
    nested = F.concat(F.lit('{"parts":['), F.get_json_object("props", "$.k"), F.lit(',"x",'), F.col("user_id").cast("string"), F.lit('],"type":"'), "event_type", F.lit('"}'))
    p = F.col("was")
    e = _events(spark, folder).select("event_id", "user_id", js.set_path(F.col("props"), ["at"], nested).alias("was"))
    number = F.col("event_id").cast("string")
    user = F.concat(F.lit('{"u":'), F.col("user_id").cast("string"), F.lit("}"))
    return e.select(
        "event_id", "was", js.set_path(p, ["at", "parts", "1"], number).alias("set_item"), js.set_path(p, ["none", "parts", "1"], number).alias("set_nowhere"), js.set_path(p, ["at", "new"], user).alias("set_new"),
        js.insert_path(p, ["at", "parts", "-1"], F.lit("null")).alias("inserted"), js.delete_path(p, ["at", "parts", "0"]).alias("item_deleted"), js.delete_path(p, ["at", "type"]).alias("key_deleted"),
        F.when(F.get_json_object(p, "$.at.type") == "view", js.set_path(p, ["at", "type"], F.lit('"seen"'), create=False)).otherwise(p).alias("renamed"),
    )


@query("""WITH f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE json_extract(props, '$.k')::INTEGER >= 50 GROUP BY user_id)
SELECT e.event_id, CASE WHEN f.event_id IS NOT NULL THEN '{"isPrimary":true,"k":' || json_extract(props, '$.k')::VARCHAR || '}' ELSE '{"k":' || json_extract(props, '$.k')::VARCHAR || '}' END AS props FROM events e LEFT JOIN f ON f.event_id = e.event_id""")
def primary_marked(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of each key that a property admits gets a mark merged into
    its properties; the others stay as they are."""
    e = _events(spark, folder)
    first = e.where(F.get_json_object("props", "$.k").cast("int") >= 50).groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("f")).select(F.col("f.event_id").alias("event_id"), F.lit(True).alias("_hit"))
    j = e.join(first, "event_id", "left")
    return j.select("event_id", F.when(F.col("_hit"), js.merge(F.col("props"), F.lit('{"isPrimary":true}'))).otherwise(js.canonical(F.col("props"))).alias("props"))
