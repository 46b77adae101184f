"""Queries over a star of projects, cases and entries (the order tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import graph, state
from quillspark.registry import query
from quillspark.sources.tables import table


def t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name)


@query("""SELECT c_custkey, n_name, r_name, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2)::DOUBLE AS total
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def project_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every project with its counts (pre-aggregated, left joined, 0 if none)."""
    o = t(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    c = t(spark, folder, "customer").join(t(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(o, "c_custkey", "left").select("c_custkey", "n_name", "r_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("""SELECT o_orderkey, count(l_linenumber) AS n_returned FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R'
  AND EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25) GROUP BY o_orderkey""")
def left_join_with_exists(spark: SparkSession, folder: str) -> DataFrame:
    """All orders, with those lines only that a condition elsewhere admits."""
    big = t(spark, folder, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    lines = t(spark, folder, "lineitem").where("l_returnflag = 'R'").join(big, "l_partkey", "left_semi").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t(spark, folder, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_returned"))


@query("""SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 49 AND (l_partkey = p_partkey OR l_suppkey = p_partkey OR l_orderkey = p_partkey))""")
def in_no_case(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that none of three key columns names: one anti-join of their union."""
    li = t(spark, folder, "lineitem").where("l_quantity > 49")
    named = li.select(F.explode(F.array("l_partkey", "l_suppkey", "l_orderkey")).alias("p_partkey")).distinct()
    return t(spark, folder, "part").select("p_partkey").join(named, "p_partkey", "left_anti")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR c_custkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def semi_join_of_two(spark: SparkSession, folder: str) -> DataFrame:
    keys = t(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).union(t(spark, folder, "supplier").where("s_acctbal < 0").select("s_suppkey"))
    return t(spark, folder, "customer").select("c_custkey").join(keys, "c_custkey", "left_semi")


@query("""WITH a AS (SELECT o_orderkey, o_orderpriority FROM orders), d AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'A'), f AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 49)
SELECT o_orderpriority AS phase, count(*) AS total, count(*) FILTER (WHERE o_orderkey IN (FROM d)) AS done, count(*) FILTER (WHERE o_orderkey NOT IN (FROM d) AND o_orderkey NOT IN (FROM f)) AS pending FROM a GROUP BY 1""")
def preflight(spark: SparkSession, folder: str) -> DataFrame:
    """All, done and pending (neither done nor failed) work of each phase."""
    li = t(spark, folder, "lineitem")
    key = F.col("l_orderkey").alias("id")
    work = t(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("phase"))
    return graph.preflight(work, li.where("l_returnflag = 'A'").select(key), li.where("l_quantity > 49").select(key))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def pending_work(spark: SparkSession, folder: str) -> DataFrame:
    done = t(spark, folder, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, folder, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


G = "WITH g AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_suppkey <> l_partkey)"


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).where("a <> b").distinct()


@query(f"{G} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM g UNION ALL SELECT b FROM g) GROUP BY node")
def node_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(edges(spark, folder), "a", "b")


@query(f"{G} SELECT p_partkey AS node, other, direction FROM part JOIN (SELECT a AS node, b AS other, 'out' AS direction FROM g UNION ALL SELECT b, a, 'in' FROM g) ON node = p_partkey WHERE p_size = 7")
def edges_of_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of some nodes with their other ends, by both directions."""
    some = t(spark, folder, "part").where("p_size = 7").select(F.col("p_partkey").alias("node"))
    return graph.symmetric(edges(spark, folder), "a", "b").join(some, "node", "left_semi")


@query("""SELECT l_suppkey AS id FROM lineitem UNION SELECT l_partkey FROM lineitem""")
def both_directions(spark: SparkSession, folder: str) -> DataFrame:
    li = t(spark, folder, "lineitem")
    return li.select(F.col("l_suppkey").alias("id")).union(li.select("l_partkey")).distinct()


@query("""WITH l AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey), m AS (SELECT s_suppkey AS merged, s_suppkey - s_suppkey % 10 AS survivor FROM supplier WHERE s_suppkey % 10 IN (1, 2) AND s_suppkey > 10)
SELECT DISTINCT coalesce(x.survivor, a) AS a, coalesce(y.survivor, b) AS b FROM l LEFT JOIN m x ON x.merged = a LEFT JOIN m y ON y.merged = b WHERE coalesce(x.survivor, a) <> coalesce(y.survivor, b)""")
def merged_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Links after some entities are merged into others."""
    links = t(spark, folder, "orders").join(t(spark, folder, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    s = F.col("s_suppkey")
    mapping = t(spark, folder, "supplier").where((s % 10).isin(1, 2) & (s > 10)).select(s.alias("merged"), (s - s % 10).alias("survivor"))
    return state.merge_entities(links, mapping, "a", "b")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Children whose parents are not deleted."""
    gone = t(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("""SELECT p_brand, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY lower(trim(p_brand)), p_type ORDER BY p_partkey) = 1""")
def first_of_each_key(spark: SparkSession, folder: str) -> DataFrame:
    """Deduplication by a normalised key; the first wins."""
    p = t(spark, folder, "part").withColumn("k", F.lower(F.trim("p_brand")))
    return state.newest(p, ["k", "p_type"], [F.col("p_partkey")]).select("p_brand", "p_type", "p_partkey")


@query("""WITH s AS (SELECT o_orderkey, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS a FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT array_to_string(a, ',') AS members, count(*) AS n, min(o_orderkey) AS first_key FROM s GROUP BY a""")
def equal_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal sets, whatever the order of their members."""
    s = t(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("a"))
    s = s.join(t(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return s.groupBy("a").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key")).select(F.array_join(F.col("a").cast("array<string>"), ",").alias("members"), "n", "first_key")


@query("""WITH d AS (SELECT l_partkey AS k, count(*) AS degree FROM lineitem GROUP BY 1), s AS (SELECT p_partkey, (CASE WHEN p_type LIKE '%BRASS%' THEN 2 WHEN p_type LIKE '%STEEL%' THEN 1 ELSE 0 END + (p_size > 25)::INT + least(coalesce(degree, 0), 4))::INTEGER AS score FROM part LEFT JOIN d ON k = p_partkey)
SELECT p_partkey, score, row_number() OVER (ORDER BY score DESC, p_partkey)::INTEGER AS rank FROM s ORDER BY score DESC, p_partkey LIMIT 12""")
def best_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve best by a sum of grounding, citation and degree."""
    d = t(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("degree"))
    p = t(spark, folder, "part").join(d, "p_partkey", "left")
    ground = F.when(F.col("p_type").contains("BRASS"), 2).when(F.col("p_type").contains("STEEL"), 1).otherwise(0)
    score = graph.candidate_score(ground, F.col("p_size") > 25, F.coalesce("degree", F.lit(0)))
    top = p.select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(12)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "p_partkey")))  # twelve rows


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 99 END::INTEGER AS type_rank, o_orderstatus LIKE 'F%' AS is_final FROM orders
ORDER BY type_rank, (o_totalprice IS NULL) DESC, o_orderkey LIMIT 50""")
def ordered_by_rank(spark: SparkSession, folder: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(99)
    o = t(spark, folder, "orders").select("o_orderkey", rank.alias("type_rank"), F.col("o_orderstatus").startswith("F").alias("is_final"), "o_totalprice")
    return o.orderBy("type_rank", F.col("o_totalprice").isNull().desc(), "o_orderkey").limit(50).drop("o_totalprice")


@query("""WITH w AS (SELECT o_custkey, max(o_orderdate) AS a FROM orders GROUP BY 1), l AS (SELECT o_custkey, max(l_shipdate) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_nationkey, max(greatest(a, b)) AS last_change, count(*) AS n FROM customer LEFT JOIN w ON w.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey GROUP BY 1""")
def last_change_by_group(spark: SparkSession, folder: str) -> DataFrame:
    o, li = t(spark, folder, "orders"), t(spark, folder, "lineitem")
    ship = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("b"))
    at = o.join(ship, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.greatest("o_orderdate", "b")).alias("at"))
    return t(spark, folder, "customer").join(at, "c_custkey", "left").groupBy("c_nationkey").agg(F.max("at").alias("last_change"), F.count("*").alias("n"))


@query("""SELECT conv_id, turn, role, lag(role) OVER w AS role_before, lead(turn) OVER w AS next_turn, length(text)::BIGINT AS n_chars,
  coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS context_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_context(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn with its neighbours and the size of its prior context."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return t(spark, folder, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("role_before"), F.lead("turn").over(w).alias("next_turn"), F.length("text").cast("long").alias("n_chars"), F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long").alias("context_chars"))


@query("""SELECT d.doc_id, l.quality, l.toxic IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)""")
def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "documents").select("doc_id").join(t(spark, folder, "labels"), "doc_id", "left").select("doc_id", "quality", F.col("toxic").isNotNull().alias("labelled"))
