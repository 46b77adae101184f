"""Queries over the event log: usage rollups and folds of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import state
from quillspark.registry import query
from quillspark.sources.tables import table


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


SUM = "round(coalesce(sum(value), 0), 4)::DOUBLE"


def _sum(c: str = "value"):
    return F.round(F.coalesce(F.sum(c), F.lit(0.0)), 4).alias("total")


@query(f"SELECT count(*) AS calls, {SUM} AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).agg(F.count("*").alias("calls"), _sum(), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"SELECT event_type, count(*) AS calls, {SUM} AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def usage_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).groupBy("event_type").agg(F.count("*").alias("calls"), _sum(), F.countDistinct("user_id").alias("users"))


@query(f"SELECT ts::DATE AS day, count(*) AS calls, {SUM} AS total FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def usage_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """The latest 30 days that have rows."""
    return events(spark, folder).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), _sum()).orderBy(F.desc("day")).limit(30)


@query(f"SELECT user_id, count(*) AS calls, {SUM} AS total FROM events WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-12' + INTERVAL 1 DAY GROUP BY user_id")
def usage_in_dates(spark: SparkSession, folder: str) -> DataFrame:
    """A window of dates, both ends inclusive."""
    first, last = F.lit("2024-01-05").cast("date"), F.lit("2024-01-12").cast("date")
    return events(spark, folder).where((F.col("ts") >= first) & (F.col("ts") < F.date_add(last, 1))).groupBy("user_id").agg(F.count("*").alias("calls"), _sum())


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(value) AS with_value,
  (count(*) FILTER (WHERE event_type = 'error') > 0)::INTEGER AS has_error, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE value > 50) / count(*), 6) END::DOUBLE AS ratio
FROM events GROUP BY user_id""")
def progress_by_user(spark: SparkSession, folder: str) -> DataFrame:
    n = F.count("*")
    return events(spark, folder).groupBy("user_id").agg(
        n.alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count("value").alias("with_value"),
        (F.count_if(F.col("event_type") == "error") > 0).cast("int").alias("has_error"), F.round(F.count_if(F.col("value") > 50) / n, 6).alias("ratio"),
    )


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id""")
def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """Latest values of an append-only log, each where it is not null."""
    e = events(spark, folder).withColumn("purchase", F.when(F.col("event_type") == "purchase", F.col("value")))
    return state.latest(e, ["user_id"], ["ts", "event_id"], "event_type", "purchase")


@query("""SELECT user_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click') AS click, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS view,
  arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'signup') AS signup FROM events GROUP BY user_id""")
def latest_of_each_kind(spark: SparkSession, folder: str) -> DataFrame:
    at = F.struct("ts", "event_id", F.col("value").alias("v"))
    return events(spark, folder).groupBy("user_id").agg(*[F.max(F.when((F.col("event_type") == k) & F.col("value").isNotNull(), at)).getField("v").alias(k) for k in ("click", "view", "signup")])


@query("""SELECT user_id FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) = 'signup'""")
def current_members(spark: SparkSession, folder: str) -> DataFrame:
    """Who is in after assigning (signup) and removing (error) events."""
    kind = F.col("event_type")
    return state.members(events(spark, folder), ["user_id"], ["ts", "event_id"], kind == "signup", kind == "error")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def history_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of the log after a cursor."""
    return events(spark, folder).where("event_id > 500").orderBy("event_id").limit(100).select("event_id", "user_id", "event_type")


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'view') DESC, ts DESC, event_id DESC) = 1""")
def latest_active(spark: SparkSession, folder: str) -> DataFrame:
    """The latest active run, else the latest run."""
    return state.newest(events(spark, folder), ["user_id"], [(F.col("event_type") == "view").desc(), F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT json_extract_string(props, '$.k')::INTEGER AS k, count(*) AS n FROM events WHERE json_exists(props, '$.k') GROUP BY 1""")
def json_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by a property, for those that have the key."""
    has = F.array_contains(F.json_object_keys("props"), "k")
    k = F.get_json_object("props", "$.k").cast("int")
    return events(spark, folder).where(has).groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id),
n AS (SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type <> 'view') AS value, max(event_type) AS event_type FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY user_id)
SELECT user_id, CASE WHEN o.event_type = 'click' THEN o.value ELSE coalesce(n.value, o.value) END AS value, CASE WHEN o.event_type = 'click' THEN o.event_type ELSE coalesce(n.event_type, o.event_type) END AS event_type,
  CASE WHEN o.event_type IS NULL THEN 'created' WHEN n.event_type IS NULL THEN 'unchanged' WHEN o.event_type = 'click' THEN 'skipped' ELSE 'updated' END AS outcome
FROM o FULL JOIN n USING (user_id)""")
def conditional_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """New values over old ones, but for rows that a user has set."""
    e = events(spark, folder)
    old = e.where("event_type in ('view', 'click')").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max_by("event_type", "event_id").alias("event_type"))
    new = e.where("event_type not in ('view', 'click')").groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "view", F.struct("event_id", "value"))).getField("value").alias("value"), F.max("event_type").alias("event_type"))
    return state.upsert(old, new, ["user_id"], keep=F.col("o.event_type") == "click")


@query("""WITH a AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY user_id), b AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id)
SELECT * FROM a UNION ALL SELECT b.* FROM b ANTI JOIN a USING (user_id)""")
def insert_missing(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder)
    first = lambda df: df.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return state.insert_missing(first(e.where("event_type = 'signup'")), first(e), ["user_id"])


@query("""WITH s AS (SELECT user_id, event_type, CASE WHEN event_type = 'signup' THEN 'origin' ELSE event_type END AS k, max(event_id) AS event_id FROM events GROUP BY ALL),
v AS (SELECT s.*, e.value FROM s JOIN events e USING (event_id))
SELECT v.user_id, count(*) AS depth, coalesce(arg_max(v.value, v.event_id) FILTER (WHERE v.k <> 'origin'), arg_max(v.value, v.event_id) FILTER (WHERE v.k = 'origin')) AS current FROM v GROUP BY v.user_id""")
def version_stacks(spark: SparkSession, folder: str) -> DataFrame:
    """Stacks in which a re-specification replaces that of the same anchors."""
    e = events(spark, folder).withColumn("kind", F.when(F.col("event_type") == "signup", "origin").otherwise("re_spec")).withColumn("anchors", F.array("event_type"))
    return state.version_stack(e, "user_id", ["event_id"], "anchors", "value")


@query("""SELECT user_id, 'view' AS log, event_id, ts FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, 'error', event_id, ts FROM events WHERE event_type = 'error'""")
def joined_logs(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder)
    part = lambda k: e.where(F.col("event_type") == k).select("user_id", F.lit(k).alias("log"), "event_id", "ts")
    return part("view").unionByName(part("error"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, count(*) AS days, sum(n)::BIGINT AS n, max(n) AS most, round(avg(n), 3)::DOUBLE AS mean FROM d GROUP BY user_id""")
def two_level_counts(spark: SparkSession, folder: str) -> DataFrame:
    d = events(spark, folder).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return d.groupBy("user_id").agg(F.count("*").alias("days"), F.sum("n").alias("n_"), F.max("n").alias("most"), F.round(F.avg("n"), 3).alias("mean")).withColumnRenamed("n_", "n")


@query("""SELECT user_id, greatest(max(ts) FILTER (WHERE event_type = 'view'), max(ts) FILTER (WHERE event_type = 'error')) AS last_ts, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds FROM events GROUP BY user_id""")
def last_change(spark: SparkSession, folder: str) -> DataFrame:
    at = lambda k: F.max(F.when(F.col("event_type") == k, F.col("ts")))
    return events(spark, folder).groupBy("user_id").agg(F.greatest(at("view"), at("error")).alias("last_ts"), F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("kinds"))


_MENTIONS = "WITH m AS (SELECT user_id, event_type AS author, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS share, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, author) AS k FROM m)"


@query(f"{_MENTIONS} SELECT user_id, round(sum(share * share), 4)::DOUBLE AS hhi, round(max(share), 4)::DOUBLE AS top1, round(sum(share) FILTER (WHERE k <= 3), 4)::DOUBLE AS top3, string_agg(author, ',' ORDER BY k) FILTER (WHERE k <= 3) AS leading FROM s GROUP BY user_id")
def concentration(spark: SparkSession, folder: str) -> DataFrame:
    """How few authors a container's mentions fall on."""
    from quillspark.operators.profile import concentration as of

    return of(events(spark, folder).select("user_id", F.col("event_type").alias("author")), "user_id", "author")


_RUNS = """WITH p AS (SELECT user_id, event_type AS author, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, author ORDER BY n) AS g FROM p),
r AS (SELECT user_id, author, g, count(*) AS len, min(n) AS first_n FROM g GROUP BY ALL)"""


@query(f"{_RUNS} SELECT user_id, max(len) AS longest, arg_min(author, (-len, first_n)) AS author, arg_min(first_n, (-len, first_n)) AS first_n FROM r GROUP BY user_id")
def longest_run(spark: SparkSession, folder: str) -> DataFrame:
    """The longest run of one dominant author; the earliest of equal ones."""
    from quillspark.operators.profile import author_runs

    best = author_runs(events(spark, folder), "user_id", ["ts", "event_id"], "event_type").groupBy("user_id").agg(F.min(F.struct((-F.col("len")).alias("l"), "first_n", "author")).alias("b"))
    return best.select("user_id", (-F.col("b.l")).alias("longest"), F.col("b.author").alias("author"), F.col("b.first_n").alias("first_n"))


@query(f"{_RUNS} SELECT user_id, author, first_n, first_n + len - 1 AS last_n FROM r WHERE len >= 3")
def author_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of at least three."""
    from quillspark.operators.profile import author_runs

    r = author_runs(events(spark, folder), "user_id", ["ts", "event_id"], "event_type").where("len >= 3")
    return r.select("user_id", "author", "first_n", (F.col("first_n") + F.col("len") - 1).alias("last_n"))


@query(f"""{_RUNS}, u AS (SELECT user_id, unnest(range(first_n, first_n + len)) AS n FROM r WHERE len >= 3),
f AS (SELECT p.user_id, p.n, p.n - row_number() OVER (PARTITION BY p.user_id ORDER BY p.n) AS h FROM p ANTI JOIN u USING (user_id, n))
SELECT user_id, min(n) AS first_n, max(n) AS last_n FROM f GROUP BY user_id, h HAVING count(*) >= 5""")
def standard_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of at least five outside all clusters."""
    from quillspark.operators.profile import author_runs, stretches

    r = author_runs(events(spark, folder), "user_id", ["ts", "event_id"], "event_type")
    return stretches(r, "user_id", used=F.col("len") >= 3, least=5)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY CUBE (hour, event_type)""")
def cube_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder).withColumn("hour", F.date_trunc("hour", "ts"))
    return e.cube("hour", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM i GROUP BY user_id, k""")
def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user that follow each other within six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOURS"), 0).otherwise(1)
    k = F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events(spark, folder).withColumn("s", new).withColumn("k", k).groupBy("user_id", "k").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("k")
