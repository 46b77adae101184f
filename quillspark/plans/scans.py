"""One dictionary looked up in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import privacy
from quillspark.operators import dictionary
from quillspark.registry import query
from quillspark.sources.tables import table


def _patterns(spark: SparkSession, folder: str) -> DataFrame:
    """(seed_id, place, pattern): names of customers, suppliers, nations and
    regions with their parts, and the e-mail addresses of documents."""

    def named(name: str, key: str, *forms: str) -> DataFrame:
        t = table(spark, folder, name)
        return t.select(F.concat_ws(":", F.lit(name), key).alias("seed_id"), F.posexplode(F.array(*[F.expr(f) for f in forms])).alias("place", "pattern"))

    out = named("customer", "c_custkey", "c_name", "replace(c_name, '#', ' ')").unionByName(named("supplier", "s_suppkey", "s_name")).unionByName(named("nation", "n_nationkey", "n_name", "substring(n_name, 1, 3)"))
    out = out.unionByName(named("region", "r_regionkey", "r_name", "substring(r_name, 1, 2)", "substring(r_name, 1, 4)"))
    mails = table(spark, folder, "documents").select(F.explode(privacy.emails("text")).alias("pattern")).distinct()
    return out.unionByName(mails.select(F.concat(F.lit("mail:"), "pattern").alias("seed_id"), F.lit(0).alias("place"), "pattern"))


_MAIL = r"(?:^|[^@.A-Za-z0-9_%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"


@query(rf"""WITH p(seed_id, place, pattern) AS (
  SELECT 'customer:' || c_custkey, unnest([0, 1]), unnest([c_name, replace(c_name, '#', ' ')]) FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 0, s_name FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, unnest([0, 1]), unnest([n_name, substring(n_name, 1, 3)]) FROM nation UNION ALL SELECT 'region:' || r_regionkey, unnest([0, 1, 2]), unnest([r_name, substring(r_name, 1, 2), substring(r_name, 1, 4)]) FROM region
  UNION ALL SELECT 'mail:' || m, 0, m FROM (SELECT DISTINCT regexp_replace(unnest(regexp_extract_all(text, '{_MAIL}', 1)), '^\d+([A-Za-z][^@]*@)', '\1') AS m FROM documents)),
f AS (SELECT doc_id, seed_id, place, pattern, text, CASE WHEN length(pattern) > 3 THEN instr(lower(text), lower(pattern)) - 1 WHEN regexp_matches(lower(text), '(?:^|[^0-9a-z_])' || lower(pattern) || '(?:$|[^0-9a-z_])')
    THEN length(regexp_extract(lower(text), '(?s)^(?:.*?[^0-9a-z_])??' || lower(pattern) || '(?:$|[^0-9a-z_])')) - length(regexp_extract(lower(text), '(?s)^(?:.*?[^0-9a-z_])??(' || lower(pattern) || '(?:$|[^0-9a-z_]))', 1)) ELSE -1 END AS start FROM documents, p),
b AS (SELECT * FROM f WHERE start >= 0 QUALIFY row_number() OVER (PARTITION BY doc_id, seed_id ORDER BY place) = 1)
SELECT doc_id AS document_id, seed_id, pattern AS candidate, start::INTEGER AS start, substring(text, greatest(0, start - 40)::BIGINT + 1, least(length(text), start + length(pattern) + 40)::BIGINT - greatest(0, start - 40)::BIGINT) AS context FROM b""")
def dictionary_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the other tables and e-mail addresses of all documents looked up
    in each document: the first candidate of each seed, and its surroundings."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return dictionary.scan(texts, _patterns(spark, folder))
