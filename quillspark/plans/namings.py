"""The composed read queries over namings, memos and constructs.

Customers, suppliers and orders are what is named; orders are relations between
a customer and the supplier of their first item; suppliers with a type are maps,
on which customers and orders appear; events are the log of acts and of phases;
first turns of conversations are memos.  The SQL derives the same tables on its
own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import intervals, state
from quillspark.operators import namings as ops
from quillspark.operators.positions import order, upto
from quillspark.registry import query
from quillspark.sources.tables import ELEMENTS_SQL, document_elements, lines, table

AI = 0
#: Ids of orders and suppliers among the namings.
ORDER, SUPPLIER = 1_000_000_000_000, 2_000_000_000_000


def _case(of: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(of == k, v).otherwise(out)
    return out


def _namings(spark: SparkSession, folder: str) -> DataFrame:
    c, s, o = (table(spark, folder, x) for x in ("customer", "supplier", "orders"))
    front = F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") % 2 == 0), "MemoDiscussion: researcher ").when((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_nationkey") % 3 == 0), "Discussion: ").otherwise("")
    row = lambda df, key, label, by, gone: df.select(key.cast("long").alias("id"), (key % 2).cast("long").alias("project_id"), label.alias("inscription"), by.cast("long").alias("created_by"), (-key).cast("long").alias("created_at"), key.cast("long").alias("seq"), F.when(gone, 1).alias("deleted_at"))
    out = row(c, F.col("c_custkey"), F.concat(front, "c_name"), F.col("c_nationkey") % 4, F.col("c_acctbal") < 0)
    out = out.unionByName(row(s, F.col("s_suppkey") + SUPPLIER, F.col("s_name"), F.col("s_nationkey") % 4, F.col("s_acctbal") < -500))
    return out.unionByName(row(o, F.col("o_orderkey") + ORDER, F.concat(F.lit("o"), "o_orderkey"), F.col("o_orderkey") % 4, F.col("o_orderstatus") == "P"))


def _acts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    designation = _case(kind, {"view": "cue", "click": "characterization", "purchase": "specification"})
    said = F.when(kind == "signup", F.concat(F.lit("x"), F.col("event_id").cast("string")))
    return table(spark, folder, "events").select(F.col("user_id").alias("naming_id"), F.col("event_id").alias("seq"), (F.col("user_id") % 10 + 1 + SUPPLIER).alias("by"), designation.alias("designation"), said.alias("inscription"))


def _appearances(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each naming and perspective."""
    li = table(spark, folder, "lineitem").join(table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    first = lambda key: li.groupBy(key.alias("naming_id"), (F.col("l_suppkey") + SUPPLIER).alias("perspective_id")).agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_returnflag")).alias("f"))
    valence = _case(F.col("f.l_orderkey") % 4, {0: "codes", 1: "references"})
    row = lambda df, mode, source: df.select("naming_id", "perspective_id", mode.alias("mode"), F.lit("{}").alias("properties"), valence.alias("valence"), source.cast("long").alias("directed_from"))
    people = row(first(F.col("o_custkey")), F.coalesce(_case(F.col("f.l_linenumber"), {1: "entity", 2: "relation", 3: "silence", 4: "perspective"}), F.lit("entity")), F.when(F.col("f.l_returnflag") == "R", F.col("naming_id")))
    relations = row(first(F.col("l_orderkey") + ORDER), F.lit("relation"), F.lit(None))
    s = table(spark, folder, "supplier")
    key = F.col("s_suppkey") + SUPPLIER
    kind = F.when(F.col("s_nationkey") % 3 != 2, F.concat(F.lit('{"mapType":"t'), (F.col("s_nationkey") % 2).cast("string"), F.lit('"}'))).otherwise("{}")
    maps = s.select(key.alias("naming_id"), key.alias("perspective_id"), F.lit("perspective").alias("mode"), kind.alias("properties"), F.lit(None).cast("string").alias("valence"), F.lit(None).cast("long").alias("directed_from"))
    return people.unionByName(relations).unionByName(maps)


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").where("l_linenumber = 1").select("l_orderkey", (F.col("l_suppkey") + SUPPLIER).alias("participant_id"))
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("naming_id"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_orderkey") + ORDER).alias("id"), "naming_id", "participant_id")


def _memos(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "conversations").where("turn = 0").select("conv_id", F.substring("text", 1, 12).alias("content"), F.when(F.col("conv_id") % 3 != 0, "open").alias("status"))
    near = t.select((F.col("conv_id") % 10 + 1 + SUPPLIER).alias("naming_id"), "conv_id", "content", "status").groupBy("naming_id").agg(F.min(F.struct("conv_id", "content", "status")).alias("f")).select("naming_id", "f.content", "f.status")
    return t.where("conv_id > 0").select(F.col("conv_id").alias("naming_id"), "content", "status").unionByName(near)


def _memberships(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select((F.col("event_id") % 7 + 1 + SUPPLIER).alias("phase_id"), F.col("user_id").alias("naming_id"), F.when(F.col("event_type") == "error", "remove").otherwise("assign").alias("action"), F.col("event_id").alias("seq"))


def _researchers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").where("s_nationkey % 5 = 3").select((F.col("s_suppkey") + SUPPLIER).alias("naming_id"))


def _constructs(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    type_ = F.coalesce(_case(kind, {"view": "EXPOSITION", "click": "SYNTHESE", "purchase": "EXKURS"}), F.lit("GRUNDLAGENTHEORIE"))
    content = F.concat(F.lit('{"text":"t'), k, F.lit('","n":'), (F.col("event_id") % 5).cast("string"), F.lit("}"))
    return table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), type_.alias("type"), F.when(F.col("event_id") % 3 == 0, "BEFUND").otherwise("PROFIL").alias("kind"), content.alias("content"), (k.cast("int") % 8).alias("anchor"), F.col("ts").alias("created_at"))


def _elements(spark: SparkSession, folder: str) -> DataFrame:
    e = lines(table(spark, folder, "documents"))
    return e.select("document_id", F.col("seq").cast("long").alias("seq"), F.col("seq").alias("element_id"), (F.col("char_end") - F.col("char_start") > 40).alias("paragraph"), F.substring("content", 1, 20).alias("text"))


def _containers(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 20
    text = lambda x: x.cast("string")
    ranges = F.concat(F.lit('[{"start_seq":'), text(k), F.lit(',"end_seq":'), text(k + 3), F.lit('},{"start_seq":'), text(k + 10), F.lit(',"end_seq":'), text(k + 11), F.lit("}]"))
    return table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), ranges.alias("ranges"))


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("paragraph"), F.concat(F.lit("A"), F.col("l_linenumber").cast("string")).alias("local_id"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """Items support the first one of their order, or contradict the item of the
    same part in the order before."""
    from pyspark.sql import Window

    li = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    inside = li.where("l_linenumber > 1").select(F.col("id").alias("from_node"), (F.col("l_orderkey") * 10 + 1).alias("to_node"), F.when(F.col("l_returnflag") == "R", "refines").otherwise("supports").alias("kind"))
    before = F.lag("id").over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber"))
    return inside.unionByName(li.select(F.col("id").alias("from_node"), before.alias("to_node"), F.lit("contradicts").alias("kind")).where("to_node is not null"))


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "person_name").otherwise("email")
    return table(spark, folder, "customer").select(F.col("c_nationkey").alias("document_id"), kind.alias("category"), F.col("c_name").alias("value"), (F.col("c_acctbal") > 0).alias("active"))


def _briefs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") % 2 == 1, F.col("n_regionkey")).alias("created_by"))


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 != 3, F.col("s_nationkey")).alias("brief_id"))


_DERIVED = {f.__name__[1:]: f for f in (_namings, _acts, _appearances, _parts, _memos, _memberships, _researchers, _constructs, _elements, _containers, _nodes, _edges, _seeds, _briefs, _cases)}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return _DERIVED[name](spark, folder)


_FIRST = """SELECT {0} AS naming_id, l_suppkey + 2000000000000 AS perspective_id, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS o, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS n, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS f
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL"""
#: The derived tables in SQL.
_SQL = {
    "namings": """SELECT c_custkey AS id, c_custkey % 2 AS project_id, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0 THEN 'MemoDiscussion: researcher ' WHEN c_mktsegment = 'MACHINERY' AND c_nationkey % 3 = 0 THEN 'Discussion: ' ELSE '' END || c_name AS inscription,
    (c_nationkey % 4)::BIGINT AS created_by, -c_custkey AS created_at, c_custkey AS seq, CASE WHEN c_acctbal < 0 THEN 1 END AS deleted_at FROM customer
  UNION ALL SELECT s_suppkey + 2000000000000, s_suppkey % 2, s_name, s_nationkey % 4, -s_suppkey - 2000000000000, s_suppkey + 2000000000000, CASE WHEN s_acctbal < -500 THEN 1 END FROM supplier
  UNION ALL SELECT o_orderkey + 1000000000000, o_orderkey % 2, 'o' || o_orderkey, o_orderkey % 4, -o_orderkey - 1000000000000, o_orderkey + 1000000000000, CASE WHEN o_orderstatus = 'P' THEN 1 END FROM orders""",
    "acts": """SELECT user_id AS naming_id, event_id AS seq, user_id % 10 + 2000000000001 AS "by", CASE event_type WHEN 'view' THEN 'cue' WHEN 'click' THEN 'characterization' WHEN 'purchase' THEN 'specification' END AS designation,
    CASE WHEN event_type = 'signup' THEN 'x' || event_id END AS inscription FROM events""",
    "appearances": f"""SELECT naming_id, perspective_id, CASE n WHEN 2 THEN 'relation' WHEN 3 THEN 'silence' WHEN 4 THEN 'perspective' ELSE 'entity' END AS mode, '{{{{}}}}' AS properties, CASE o % 4 WHEN 0 THEN 'codes' WHEN 1 THEN 'references' END AS valence, CASE WHEN f = 'R' THEN naming_id END AS directed_from
    FROM ({_FIRST.format('o_custkey')})
  UNION ALL SELECT naming_id, perspective_id, 'relation', '{{{{}}}}', CASE o % 4 WHEN 0 THEN 'codes' WHEN 1 THEN 'references' END, NULL FROM ({_FIRST.format('o_orderkey + 1000000000000')})
  UNION ALL SELECT s_suppkey + 2000000000000, s_suppkey + 2000000000000, 'perspective', CASE WHEN s_nationkey % 3 <> 2 THEN '{{{{"mapType":"t' || s_nationkey % 2 || '"}}}}' ELSE '{{{{}}}}' END, NULL, NULL FROM supplier""".replace("{{", "{").replace("}}", "}"),
    "parts": "SELECT o_orderkey + 1000000000000 AS id, o_custkey AS naming_id, l_suppkey + 2000000000000 AS participant_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1",
    "memos": """SELECT conv_id AS naming_id, substring(text, 1, 12) AS content, CASE WHEN conv_id % 3 <> 0 THEN 'open' END AS status FROM conversations WHERE turn = 0 AND conv_id > 0
  UNION ALL SELECT conv_id % 10 + 2000000000001, arg_min(substring(text, 1, 12), conv_id), nullif(arg_min(CASE WHEN conv_id % 3 <> 0 THEN 'open' ELSE '' END, conv_id), '') FROM conversations WHERE turn = 0 GROUP BY 1""",
    "memberships": "SELECT event_id % 7 + 2000000000001 AS phase_id, user_id AS naming_id, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'assign' END AS action, event_id AS seq FROM events",
    "researchers": "SELECT s_suppkey + 2000000000000 AS naming_id FROM supplier WHERE s_nationkey % 5 = 3",
    "constructs": """SELECT event_id AS id, user_id AS document_id, CASE event_type WHEN 'view' THEN 'EXPOSITION' WHEN 'click' THEN 'SYNTHESE' WHEN 'purchase' THEN 'EXKURS' ELSE 'GRUNDLAGENTHEORIE' END AS type, CASE WHEN event_id % 3 = 0 THEN 'BEFUND' ELSE 'PROFIL' END AS kind,
    '{"text":"t' || json_extract_string(props, '$.k') || '","n":' || event_id % 5 || '}' AS content, json_extract_string(props, '$.k')::INTEGER % 8 AS anchor, ts AS created_at FROM events""",
    "elements": """SELECT document_id, seq::BIGINT AS seq, seq AS element_id, length(l) > 40 AS paragraph, substring(l, 1, 20) AS text FROM (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS seq FROM documents)""",
    "containers": """SELECT event_id AS id, user_id AS document_id, json_extract_string(props, '$.k')::INTEGER % 20 AS k FROM events""",
    "nodes": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS paragraph, 'A' || l_linenumber AS local_id FROM lineitem",
    "edges": """SELECT l_orderkey * 10 + l_linenumber AS from_node, l_orderkey * 10 + 1 AS to_node, CASE WHEN l_returnflag = 'R' THEN 'refines' ELSE 'supports' END AS kind FROM lineitem WHERE l_linenumber > 1
  UNION ALL SELECT * FROM (SELECT l_orderkey * 10 + l_linenumber, lag(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS b, 'contradicts' FROM lineitem) WHERE b IS NOT NULL""",
    "seeds": "SELECT c_nationkey AS document_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'person_name' ELSE 'email' END AS category, c_name AS value, c_acctbal > 0 AS active FROM customer",
    "briefs": "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey % 2 = 1 THEN n_regionkey END AS created_by FROM nation",
    "cases": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 3 THEN s_nationkey END AS brief_id FROM supplier",
}


def _cte(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({_SQL[n]})" for n in names)


_LIVE = "live AS (SELECT * FROM namings WHERE deleted_at IS NULL)"
_BOTH = f"""{_LIVE}, ends AS (SELECT naming_id, id AS relation_id, participant_id AS partner_id, 'source' AS role FROM parts UNION ALL SELECT participant_id, id, naming_id, 'target' FROM parts),
seen AS (SELECT e.*, p.inscription AS partner_inscription FROM ends e JOIN live r ON r.id = e.relation_id JOIN live p ON p.id = e.partner_id)"""


def _history(dimension: str) -> str:
    return f"""{_cte('namings', 'acts')} SELECT a.naming_id, a.seq, a.{dimension}, n.inscription AS by_inscription FROM acts a JOIN namings n ON n.id = a."by" WHERE a.{dimension} IS NOT NULL"""


@query(_history("inscription"))
def inscription_history(spark: SparkSession, folder: str) -> DataFrame:
    return ops.history(_table(spark, folder, "acts"), _table(spark, folder, "namings"), "inscription")


@query(_history("designation"))
def designation_history(spark: SparkSession, folder: str) -> DataFrame:
    return ops.history(_table(spark, folder, "acts"), _table(spark, folder, "namings"), "designation")


@query(f"{_cte('namings')} SELECT project_id, id, inscription, seq, row_number() OVER (PARTITION BY project_id ORDER BY seq)::INTEGER AS place FROM namings WHERE deleted_at IS NULL")
def namings_by_project(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("project_id").orderBy("seq")
    return ops.alive(_table(spark, folder, "namings")).select("project_id", "id", "inscription", "seq", F.row_number().over(w).alias("place"))


@query(f"{_cte('namings', 'parts')}, {_BOTH} SELECT DISTINCT naming_id, relation_id, partner_id, role, partner_inscription FROM seen")
def naming_participations(spark: SparkSession, folder: str) -> DataFrame:
    return ops.participations_of(_table(spark, folder, "parts"), _table(spark, folder, "namings")).drop("related_at").distinct()


@query(f"{_cte('namings', 'appearances')} SELECT a.perspective_id, a.mode, a.naming_id, n.inscription, a.valence FROM appearances a JOIN namings n ON n.id = a.naming_id WHERE n.deleted_at IS NULL AND a.mode = 'entity'")
def appearances_in_perspective(spark: SparkSession, folder: str) -> DataFrame:
    """What appears in each perspective, in one mode."""
    n = ops.alive(_table(spark, folder, "namings")).select(F.col("id").alias("naming_id"), "inscription")
    return _table(spark, folder, "appearances").where("mode = 'entity'").join(n, "naming_id").select("perspective_id", "mode", "naming_id", "inscription", "valence")


_MAPS = f"""{_LIVE}, maps AS (SELECT a.naming_id AS map_id, n.inscription AS map_label, json_extract_string(a.properties, '$.mapType') AS map_type FROM appearances a JOIN live n ON n.id = a.naming_id
  WHERE a.naming_id = a.perspective_id AND a.mode = 'perspective' AND json_extract_string(a.properties, '$.mapType') IS NOT NULL)"""


@query(f"""{_cte('namings', 'appearances', 'memberships')}, {_MAPS},
ph AS (SELECT m.naming_id, a.perspective_id, m.phase_id, m.seq FROM memberships m JOIN appearances a ON a.naming_id = m.phase_id
  WHERE m.action = 'assign' AND NOT EXISTS (SELECT 1 FROM memberships x WHERE x.phase_id = m.phase_id AND x.naming_id = m.naming_id AND x.action = 'remove' AND x.seq > m.seq)),
last AS (SELECT naming_id, perspective_id, arg_max(phase_id, seq) AS phase_id FROM ph GROUP BY ALL)
SELECT a.naming_id, a.perspective_id, map_label, map_type, a.mode, a.valence, l.phase_id, p.inscription AS phase_label FROM appearances a JOIN maps ON map_id = a.perspective_id
LEFT JOIN last l ON l.naming_id = a.naming_id AND l.perspective_id = a.perspective_id LEFT JOIN namings p ON p.id = l.phase_id WHERE a.naming_id <> a.perspective_id""")
def aggregated_appearances(spark: SparkSession, folder: str) -> DataFrame:
    return ops.aggregated_appearances(_table(spark, folder, "appearances"), _table(spark, folder, "namings"), _table(spark, folder, "memberships"))


@query(f"""{_cte('namings', 'acts', 'appearances', 'parts')}, {_MAPS.replace(_LIVE + ', ', '')}""".replace("maps AS", _BOTH + ", maps AS") + """
SELECT s.naming_id, s.relation_id, s.partner_id, s.partner_inscription, (SELECT arg_max(designation, seq) FROM acts WHERE acts.naming_id = s.partner_id AND designation IS NOT NULL) AS partner_designation, s.role,
  (SELECT min(valence) FROM appearances a WHERE a.naming_id = s.relation_id AND a.mode = 'relation') AS valence,
  (SELECT string_agg(DISTINCT map_label, ', ' ORDER BY map_label) FROM appearances a JOIN maps ON map_id = a.perspective_id WHERE a.naming_id = s.relation_id AND a.perspective_id <> a.naming_id) AS map_labels FROM seen s""")
def aggregated_participations(spark: SparkSession, folder: str) -> DataFrame:
    return ops.aggregated_participations(_table(spark, folder, "parts"), _table(spark, folder, "namings"), _table(spark, folder, "acts"), _table(spark, folder, "appearances"))


@query(f"""{_cte('namings', 'acts', 'appearances', 'parts', 'memos', 'researchers')}, {_BOTH}
SELECT n.project_id, n.id AS naming_id, n.inscription, n.seq, (SELECT arg_max(designation, seq) FROM acts WHERE acts.naming_id = n.id AND designation IS NOT NULL) AS designation,
  (SELECT arg_max(a.inscription, a.seq) FROM acts a WHERE a.naming_id = n.id AND a.inscription IS NOT NULL) AS current_inscription,
  EXISTS (SELECT 1 FROM appearances a WHERE a.directed_from = n.id AND a.valence = 'codes') AS has_document_anchor, EXISTS (SELECT 1 FROM seen s JOIN memos m ON m.naming_id = s.partner_id WHERE s.naming_id = n.id) AS has_memo_link,
  (SELECT min(a.mode) FROM appearances a WHERE a.naming_id = n.id AND a.mode IN ('entity', 'relation', 'silence')) AS mode, p.naming_id AS directed_from, p.participant_id AS directed_to, s.inscription AS source_inscription, t.inscription AS target_inscription,
  (SELECT min(a.valence) FROM appearances a WHERE a.naming_id = n.id AND a.mode = 'relation') AS valence,
  (SELECT '[' || string_agg(x.j, ',' ORDER BY x.id) || ']' FROM (SELECT DISTINCT m.id, '{{"id":' || m.id || ',"label":"' || m.inscription || '"}}' AS j FROM appearances a JOIN live m ON m.id = a.perspective_id WHERE a.naming_id = n.id AND a.perspective_id <> n.id) x) AS appears_on_maps
FROM live n LEFT JOIN parts p ON p.id = n.id LEFT JOIN namings s ON s.id = p.naming_id LEFT JOIN namings t ON t.id = p.participant_id
WHERE EXISTS (SELECT 1 FROM appearances a WHERE a.naming_id = n.id AND a.mode IN ('entity', 'relation', 'silence') AND (a.valence IS NULL OR a.valence <> 'codes')) OR n.id IN (SELECT naming_id FROM researchers)""")
def project_namings(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: _table(spark, folder, name)
    return ops.project_namings(t("namings"), t("acts"), t("appearances"), t("parts"), t("memos"), t("researchers"))


_TALK = "({0} LIKE 'MemoDiscussion:%' OR {0} LIKE 'Discussion:%')"


@query(f"""{_cte('namings', 'appearances', 'parts', 'memos')}, {_BOTH}, own AS (SELECT n.*, m.content, m.status FROM live n JOIN memos m ON m.naming_id = n.id WHERE NOT {_TALK.format('n.inscription')}),
far AS (SELECT DISTINCT * EXCLUDE (relation_id, role) FROM seen WHERE naming_id IN (SELECT id FROM own) AND partner_id NOT IN (SELECT id FROM own)),
links AS (SELECT naming_id, string_agg(partner_id || '/' || partner_inscription || '/' || coalesce((SELECT min(mode) FROM appearances a WHERE a.naming_id = far.partner_id), 'entity'), ' ' ORDER BY partner_id) AS links FROM far
  WHERE NOT {_TALK.format('partner_inscription')} AND partner_id NOT IN (SELECT naming_id FROM memos) GROUP BY naming_id),
talk AS (SELECT far.naming_id, string_agg(far.partner_id || '/' || CASE WHEN n.created_by = {AI} THEN 'ai' ELSE 'researcher' END || '/' || CASE WHEN contains(partner_inscription, ': researcher') THEN 'researcher' ELSE 'response' END || '/' || m.content, ' ' ORDER BY n.created_at) AS discussion
  FROM far JOIN live n ON n.id = far.partner_id JOIN memos m ON m.naming_id = n.id WHERE partner_inscription LIKE 'MemoDiscussion:%' GROUP BY far.naming_id)
SELECT project_id, o.id, o.inscription AS label, content, coalesce(status, 'active') AS status, o.created_by = {AI} AS is_ai, links, discussion FROM own o LEFT JOIN links l ON l.naming_id = o.id LEFT JOIN talk t ON t.naming_id = o.id""")
def memos_by_project(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: _table(spark, folder, name)
    m = ops.memos_of_projects(t("namings"), t("memos"), t("parts"), t("appearances"), AI)
    link = F.transform("links", lambda x: F.concat_ws("/", x["id"].cast("string"), x["label"], x["mode"]))
    said = F.transform("discussion", lambda x: F.concat_ws("/", x["id"].cast("string"), x["role"], x["type"], x["content"]))
    return m.withColumn("links", F.array_join(link, " ")).withColumn("discussion", F.array_join(said, " "))


@query(f"""{_cte('namings', 'parts', 'memos')}, {_BOTH} SELECT DISTINCT s.naming_id, s.partner_id AS memo_id, s.partner_inscription AS label, m.content FROM seen s JOIN memos m ON m.naming_id = s.partner_id""")
def memos_of_namings(spark: SparkSession, folder: str) -> DataFrame:
    p = ops.participations_of(_table(spark, folder, "parts"), _table(spark, folder, "namings"))
    m = _table(spark, folder, "memos").select(F.col("naming_id").alias("partner_id"), "content")
    return p.join(m, "partner_id").select("naming_id", F.col("partner_id").alias("memo_id"), F.col("partner_inscription").alias("label"), "content").distinct()


@query(f"""{_cte('briefs', 'cases')} SELECT b.id, b.name, count(c.id) AS n_cases, count(c.id) = 0 AS can_go, row_number() OVER (ORDER BY (b.created_by IS NULL) DESC, b.name)::INTEGER AS place FROM briefs b LEFT JOIN cases c ON c.brief_id = b.id GROUP BY b.id, b.name, b.created_by""")
def brief_list(spark: SparkSession, folder: str) -> DataFrame:
    """Briefs with the number of their cases; one without any can be deleted."""
    from pyspark.sql import Window

    n = _table(spark, folder, "cases").groupBy(F.col("brief_id").alias("id")).agg(F.count("*").alias("n_cases"))
    b = _table(spark, folder, "briefs").join(n, "id", "left").withColumn("n_cases", F.coalesce("n_cases", F.lit(0).cast("long")))
    place = F.row_number().over(Window.orderBy(F.col("created_by").isNull().desc(), "name"))  # a short list
    return b.select("id", "name", "n_cases", (F.col("n_cases") == 0).alias("can_go"), place.alias("place"))


@query(f"""{_cte('constructs')} SELECT document_id, type, kind, arg_max(json_extract_string(content, '$.text'), created_at) AS latest, count(*) AS versions FROM constructs GROUP BY ALL""")
def export_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The latest construct of each type and kind of a document, to be exported."""
    text = F.get_json_object("content", "$.text")
    return _table(spark, folder, "constructs").groupBy("document_id", "type", "kind").agg(F.max_by(text, "created_at").alias("latest"), F.count("*").alias("versions"))


@query(f"""{_cte('constructs')} SELECT document_id, string_agg(id::VARCHAR, ',' ORDER BY created_at) AS constructs, count(*) FILTER (WHERE kind = 'BEFUND') AS n_findings FROM constructs GROUP BY document_id""")
def all_constructs(spark: SparkSession, folder: str) -> DataFrame:
    c = _table(spark, folder, "constructs")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id"))), lambda x: x["id"].cast("string"))
    return c.groupBy("document_id").agg(F.array_join(ids, ",").alias("constructs"), F.count_if(F.col("kind") == "BEFUND").alias("n_findings"))


@query(f"""{_cte('constructs')} SELECT document_id, sum(json_extract(content, '$.n')::BIGINT)::BIGINT AS total, max(json_extract(content, '$.n')::BIGINT) AS most, count(DISTINCT type) AS types FROM constructs WHERE kind = 'PROFIL' GROUP BY document_id""")
def profile_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of a work's parts as one."""
    n = F.get_json_object("content", "$.n").cast("long")
    return _table(spark, folder, "constructs").where("kind = 'PROFIL'").groupBy("document_id").agg(F.sum(n).alias("total"), F.max(n).alias("most"), F.countDistinct("type").alias("types"))


@query(f"""{_cte('constructs', 'elements')} SELECT c.document_id, c.id, json_extract_string(c.content, '$.text') AS finding, e.text AS anchored_at FROM constructs c LEFT JOIN elements e ON e.document_id = c.document_id AND e.element_id = c.anchor WHERE c.kind = 'BEFUND'""")
def findings_with_text(spark: SparkSession, folder: str) -> DataFrame:
    """Findings with the text of the element that they are anchored at."""
    e = _table(spark, folder, "elements").select("document_id", F.col("element_id").alias("anchor"), F.col("text").alias("anchored_at"))
    c = _table(spark, folder, "constructs").where("kind = 'BEFUND'")
    return c.join(e, ["document_id", "anchor"], "left").select("document_id", "id", F.get_json_object("content", "$.text").alias("finding"), "anchored_at")


@query(f"""{_cte('containers', 'elements')}, r AS (SELECT id, document_id, unnest([k, k + 10]) AS a, unnest([k + 3, k + 11]) AS b FROM containers),
x AS (SELECT DISTINCT r.id, e.seq FROM r JOIN elements e ON e.document_id = r.document_id AND e.seq BETWEEN r.a AND r.b WHERE e.paragraph)
SELECT id, count(*) AS n_paragraphs, min(seq) AS first_seq, max(seq) AS last_seq FROM x GROUP BY id""")
def container_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of containers that are stored as ranges."""
    ranges = F.from_json("ranges", "array<struct<start_seq:bigint,end_seq:bigint>>")
    c = _table(spark, folder, "containers").select("id", "document_id", F.explode(ranges).alias("r")).select("id", "document_id", F.col("r.start_seq").alias("a"), (F.col("r.end_seq") + 1).alias("b"))
    both = intervals.matches(_table(spark, folder, "elements").where("paragraph").select("document_id", "seq"), c, "document_id", "seq", "a", "b").select("id", "seq").distinct()
    return both.groupBy("id").agg(F.count("*").alias("n_paragraphs"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"""{_cte('nodes', 'edges')}, l AS (SELECT e.*, a.paragraph AS from_paragraph, b.paragraph AS to_paragraph, a.local_id AS from_local, b.local_id AS to_local FROM edges e JOIN nodes a ON a.id = e.from_node JOIN nodes b ON b.id = e.to_node),
s AS (SELECT from_paragraph AS paragraph, from_local AS local_id, 'out' AS direction, kind, to_paragraph AS other_paragraph, to_local AS other FROM l
  UNION ALL SELECT to_paragraph, to_local, 'in', kind, from_paragraph, from_local FROM l WHERE from_paragraph <> to_paragraph)
SELECT paragraph, local_id, direction, kind, CASE WHEN other_paragraph <> paragraph THEN other_paragraph END AS other_paragraph, other FROM s""")
def paragraph_arguments(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the arguments of each paragraph, from its side; one inside a
    paragraph is told once, as going out."""
    n = lambda end, name: _table(spark, folder, "nodes").select(F.col("id").alias(end), F.struct("paragraph", "local_id").alias(name))
    e = _table(spark, folder, "edges").join(n("from_node", "a"), "from_node").join(n("to_node", "b"), "to_node")
    inside = F.col("a.paragraph") == F.col("b.paragraph")
    side = lambda own, other, d: F.struct(F.col(own).alias("own"), F.col(other).alias("other"), F.lit(d).alias("direction"))
    s = e.select("kind", F.explode(F.when(inside, F.array(side("a", "b", "out"))).otherwise(F.array(side("a", "b", "out"), side("b", "a", "in")))).alias("s"))
    far = F.when(F.col("s.other.paragraph") != F.col("s.own.paragraph"), F.col("s.other.paragraph"))
    return s.select(F.col("s.own.paragraph").alias("paragraph"), F.col("s.own.local_id").alias("local_id"), "s.direction", "kind", far.alias("other_paragraph"), F.col("s.other.local_id").alias("other"))


@query(f"""{_cte('seeds')} SELECT document_id, count(*) AS n_seeds, count(*) FILTER (WHERE active) AS n_active, string_agg(value, ' ' ORDER BY value) FILTER (WHERE active AND category = 'email') AS emails FROM seeds GROUP BY document_id""")
def active_seeds(spark: SparkSession, folder: str) -> DataFrame:
    mine = F.array_sort(F.collect_list(F.when(F.col("active") & (F.col("category") == "email"), F.col("value"))))
    return _table(spark, folder, "seeds").groupBy("document_id").agg(F.count("*").alias("n_seeds"), F.count_if("active").alias("n_active"), F.nullif(F.array_join(mine, " "), F.lit("")).alias("emails"))


@query(f"""{_cte('acts')} SELECT naming_id, arg_max(designation, seq) FILTER (WHERE designation IS NOT NULL) AS designation, arg_max(inscription, seq) FILTER (WHERE inscription IS NOT NULL) AS inscription FROM acts GROUP BY naming_id""")
def current_states(spark: SparkSession, folder: str) -> DataFrame:
    return state.latest(_table(spark, folder, "acts"), ["naming_id"], ["seq"], "designation", "inscription")


@query(f"""{_cte('constructs')}, {ELEMENTS_SQL}, x AS (SELECT document_id, seq, char_start, last_value(CASE WHEN element_type = 'heading' AND function_type IS NOT NULL THEN content END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY char_start ROWS UNBOUNDED PRECEDING) AS heading FROM e),
j AS (SELECT c.*, x.heading, x.char_start AS place FROM constructs c JOIN x ON x.document_id = c.document_id AND x.seq = c.anchor)
SELECT document_id, heading, count(*) FILTER (WHERE kind = 'BEFUND') AS n_findings, count(*) FILTER (WHERE kind = 'PROFIL') AS n_profiles, min(place)::BIGINT AS first_place, max(place)::BIGINT AS last_place,
  string_agg(json_extract_string(content, '$.text'), ' ' ORDER BY created_at, id) FILTER (WHERE kind = 'BEFUND') AS findings FROM j GROUP BY ALL""")
def constructs_by_container(spark: SparkSession, folder: str) -> DataFrame:
    """What was found in each container of a work: constructs of two kinds under
    the nearest typed heading before what they are anchored at, with the range of
    their places and the findings in the order they were made."""
    typed = F.when((F.col("element_type") == "heading") & F.col("function_type").isNotNull(), F.col("content"))
    e = document_elements(spark, folder).withColumn("heading", typed).drop("content")
    e = e.withColumn("heading", F.last("heading", ignorenulls=True).over(upto(order()))).select("document_id", F.col("seq").alias("anchor"), "heading", F.col("char_start").alias("place"))
    j = _table(spark, folder, "constructs").join(e, ["document_id", "anchor"])
    finding = F.col("kind") == "BEFUND"
    said = F.transform(F.array_sort(F.collect_list(F.when(finding, F.struct("created_at", "id", F.get_json_object("content", "$.text").alias("t"))))), lambda x: x["t"])
    return j.groupBy("document_id", "heading").agg(F.count_if(finding).alias("n_findings"), F.count_if(F.col("kind") == "PROFIL").alias("n_profiles"), F.min("place").alias("first_place"), F.max("place").alias("last_place"), F.nullif(F.array_join(said, " "), F.lit("")).alias("findings"))


@query("""WITH c AS (SELECT c_nationkey AS project, count(*) AS n_cases, count(*) FILTER (WHERE c_acctbal < 0) AS n_debtors FROM customer GROUP BY ALL), o AS (SELECT c_nationkey AS project, count(*) AS n_documents, max(o_orderdate) AS last_change, count(DISTINCT o_custkey) AS n_used FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
u AS (SELECT s_nationkey AS project, count(*) AS n_members FROM supplier GROUP BY ALL)
SELECT n_nationkey AS project, n_name AS name, coalesce(n_members, 0) AS n_members, coalesce(n_cases, 0) AS n_cases, coalesce(n_documents, 0) AS n_documents, coalesce(n_cases, 0) - coalesce(n_used, 0) AS n_bare, last_change, row_number() OVER (ORDER BY last_change DESC NULLS LAST, n_name)::INTEGER AS place
FROM nation LEFT JOIN c ON c.project = n_nationkey LEFT JOIN o ON o.project = n_nationkey LEFT JOIN u ON u.project = n_nationkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)""")
def project_overview(spark: SparkSession, folder: str) -> DataFrame:
    """The projects that have a member in good standing, with their members,
    cases, documents and cases without any, the latest changed first."""
    from pyspark.sql import Window

    c, o, s, n = (table(spark, folder, x) for x in ("customer", "orders", "supplier", "nation"))
    cases = c.groupBy(F.col("c_nationkey").alias("project")).agg(F.count("*").alias("n_cases"))
    used = o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("project")), "o_custkey").groupBy("project", "o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("t"))
    docs = used.groupBy("project").agg(F.sum("n").alias("n_documents"), F.max("t").alias("last_change"), F.count("*").alias("n_used"))
    members = s.groupBy(F.col("s_nationkey").alias("project")).agg(F.count("*").alias("n_members"), F.max(F.col("s_acctbal") > 0).alias("_in"))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    out = n.select(F.col("n_nationkey").alias("project"), F.col("n_name").alias("name")).join(members.where("_in"), "project").join(cases, "project", "left").join(docs, "project", "left")
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("last_change"), "name"))  # a short list
    return out.select("project", "name", zero("n_members").alias("n_members"), zero("n_cases").alias("n_cases"), zero("n_documents").alias("n_documents"), (zero("n_cases") - zero("n_used")).alias("n_bare"), "last_change", place.alias("place"))
