"""Work lists of all phases over orders and their parts."""

from __future__ import annotations

from functools import partial, reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import worklist
from quillspark.operators.worklist import Phase
from quillspark.registry import query
from quillspark.sources.tables import table

#: What can be known of an atom.
FACTS = ("argument", "scaffold", "assessed", "forward", "retrograde", "graph_memo", "synthetic_memo", "retrograde_memo", "meta_memo", "failed", "validated")

#: The phases, with what they wait for.  Either of two facts, a fact of one kind of
#: note, a count that has to reach another, a fact of a wider unit, a validation.
PHASES = (
    Phase("graph", "paragraph", "has_argument or has_scaffold", failed="has_failed"),
    Phase("synthetic", "paragraph", "has_forward", failed="has_failed"),
    Phase("validity", "paragraph", "n_assessed >= n_argument", only="has_argument", needs=("graph",)),
    Phase("section", "section", "has_graph_memo", needs=("graph",)),
    Phase("chapter", "chapter", "has_graph_memo", needs=("section",)),
    Phase("work", "work", "has_graph_memo", needs=("chapter",)),
    Phase("section_synthetic", "section", "has_synthetic_memo", needs=("synthetic",)),
    Phase("chapter_synthetic", "chapter", "has_synthetic_memo", needs=("section_synthetic",)),
    Phase("work_synthetic", "work", "has_synthetic_memo", needs=("chapter_synthetic",)),
    Phase("chapter_retrograde", "chapter", "has_retrograde_memo", needs=("work_synthetic",)),
    Phase("section_retrograde", "section", "has_retrograde_memo", needs=("chapter_retrograde",)),
    Phase("paragraph_retrograde", "paragraph", "has_retrograde", failed="has_failed", needs=("section_retrograde",)),
    Phase("meta", "work", "has_meta_memo and has_validated", needs=("work", "work_synthetic")),
)

_ATOMS = """li AS (SELECT l.*, o_custkey, o_orderdate, o_orderpriority, o_orderstatus FROM lineitem l JOIN orders ON o_orderkey = l_orderkey),
atoms AS (
  SELECT o_custkey AS unit, 'paragraph' AS kind, 'p/' || l_orderkey || '/' || l_linenumber AS atom, l_orderkey * 10 + l_linenumber AS "at" FROM li
  UNION ALL SELECT DISTINCT o_custkey, 'section', 's/' || l_orderkey || '/' || l_returnflag, l_orderkey * 10 FROM li
  UNION ALL SELECT o_custkey, 'chapter', 'c/' || o_orderkey, o_orderkey * 10 FROM orders
  UNION ALL SELECT DISTINCT o_custkey, 'work', 'w/' || o_custkey, 0 FROM orders),
facts AS (
  SELECT 'paragraph' AS kind, 'p/' || l_orderkey || '/' || l_linenumber AS atom, unnest(
    CASE WHEN l_quantity > 3 THEN ['argument'] ELSE [] END || CASE WHEN l_quantity > 30 THEN ['argument'] ELSE [] END || CASE WHEN l_discount > 0.02 THEN ['scaffold'] ELSE [] END || CASE WHEN l_tax > 0.01 THEN ['assessed'] ELSE [] END
    || CASE WHEN l_tax > 0.04 THEN ['assessed'] ELSE [] END || CASE WHEN l_linestatus = 'F' THEN ['forward'] ELSE [] END || CASE WHEN l_returnflag <> 'N' THEN ['retrograde'] ELSE [] END || CASE WHEN l_partkey % 50 = 0 THEN ['failed'] ELSE [] END) AS fact FROM lineitem
  UNION ALL SELECT 'section', 's/' || l_orderkey || '/' || l_returnflag, unnest(CASE WHEN l_linenumber <= 4 THEN ['graph_memo'] ELSE [] END || CASE WHEN l_quantity < 40 THEN ['synthetic_memo'] ELSE [] END || CASE WHEN l_tax < 0.07 THEN ['retrograde_memo'] ELSE [] END) FROM lineitem
  UNION ALL SELECT 'chapter', 'c/' || o_orderkey, unnest(CASE WHEN o_orderpriority LIKE '1%' THEN [] ELSE ['graph_memo'] END || CASE WHEN o_orderstatus = 'P' THEN [] ELSE ['synthetic_memo'] END || CASE WHEN o_totalprice > 1000 THEN ['retrograde_memo'] ELSE [] END) FROM orders
  UNION ALL SELECT 'work', 'w/' || o_custkey, unnest(CASE WHEN o_orderkey % 3 = 0 THEN ['graph_memo'] ELSE [] END || CASE WHEN o_orderkey % 5 = 0 THEN ['synthetic_memo'] ELSE [] END || CASE WHEN o_orderkey % 7 = 0 THEN ['meta_memo'] ELSE [] END || CASE WHEN o_orderkey % 2 = 0 THEN ['validated', 'other'] ELSE [] END) FROM orders)"""


def _atoms(spark: SparkSession, folder: str) -> DataFrame:
    """(unit, kind, atom, at): customers are works, orders their chapters, the
    parts of an order of one flag its sections, and items the paragraphs."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("unit"))
    li = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    row = lambda df, kind, atom, at: df.select("unit", F.lit(kind).alias("kind"), F.concat_ws("/", F.lit(kind[0]), *atom).alias("atom"), at.cast("long").alias("at"))
    out = row(li, "paragraph", ["l_orderkey", "l_linenumber"], F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = out.unionByName(row(li, "section", ["l_orderkey", "l_returnflag"], F.col("l_orderkey") * 10).distinct())
    out = out.unionByName(row(orders, "chapter", ["o_orderkey"], F.col("o_orderkey") * 10))
    return out.unionByName(row(orders, "work", ["unit"], F.lit(0)).distinct())


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, atom, n_<fact>…): how often a row says each fact of its atom."""
    li, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")

    def row(df: DataFrame, kind: str, atom: list[str], *facts: tuple[str, str]) -> DataFrame:
        said = {n: [F.coalesce(F.expr(when).cast("int"), F.lit(0)) for when, x in facts if x == n] for _, n in facts}
        return df.select(F.lit(kind).alias("kind"), F.concat_ws("/", F.lit(kind[0]), *atom).alias("atom"), *[reduce(add, x).alias(f"n_{n}") for n, x in said.items()])

    union = partial(DataFrame.unionByName, allowMissingColumns=True)
    rows = (
        row(
            li, "paragraph", ["l_orderkey", "l_linenumber"], ("l_quantity > 3", "argument"), ("l_quantity > 30", "argument"), ("l_discount > 0.02", "scaffold"), ("l_tax > 0.01", "assessed"), ("l_tax > 0.04", "assessed"),
            ("l_linestatus = 'F'", "forward"), ("l_returnflag <> 'N'", "retrograde"), ("l_partkey % 50 = 0", "failed"),
        ),
        row(li, "section", ["l_orderkey", "l_returnflag"], ("l_linenumber <= 4", "graph_memo"), ("l_quantity < 40", "synthetic_memo"), ("l_tax < 0.07", "retrograde_memo")),
        row(orders, "chapter", ["o_orderkey"], ("o_orderpriority not like '1%'", "graph_memo"), ("o_orderstatus <> 'P'", "synthetic_memo"), ("o_totalprice > 1000", "retrograde_memo")),
        row(orders, "work", ["o_custkey"], ("o_orderkey % 3 = 0", "graph_memo"), ("o_orderkey % 5 = 0", "synthetic_memo"), ("o_orderkey % 7 = 0", "meta_memo"), ("o_orderkey % 2 = 0", "validated"), ("o_orderkey % 2 = 0", "other")),
    )
    return reduce(union, rows)


# The same in SQL: each phase's own condition, written out.
_DONE = {
    "graph": ("paragraph", "true", "a + s > 0", "f > 0", []), "synthetic": ("paragraph", "true", "w > 0", "f > 0", []), "validity": ("paragraph", "a > 0", "v >= a", "false", ["graph"]),
    "section": ("section", "true", "g > 0", "false", ["graph"]), "chapter": ("chapter", "true", "g > 0", "false", ["section"]), "work": ("work", "true", "g > 0", "false", ["chapter"]),
    "section_synthetic": ("section", "true", "y > 0", "false", ["synthetic"]), "chapter_synthetic": ("chapter", "true", "y > 0", "false", ["section_synthetic"]), "work_synthetic": ("work", "true", "y > 0", "false", ["chapter_synthetic"]),
    "chapter_retrograde": ("chapter", "true", "r > 0", "false", ["work_synthetic"]), "section_retrograde": ("section", "true", "r > 0", "false", ["chapter_retrograde"]),
    "paragraph_retrograde": ("paragraph", "true", "b > 0", "f > 0", ["section_retrograde"]), "meta": ("work", "true", "m > 0 AND k > 0", "false", ["work", "work_synthetic"]),
}
_N = ", ".join(f"coalesce(count(*) FILTER (WHERE fact = '{f}'), 0) AS {c}" for f, c in zip(FACTS, "a s v w b g y r m f k".split(), strict=True))
_EACH = " UNION ALL ".join(f"SELECT unit, '{n}' AS phase, atom, \"at\", ({d}) AS done, (NOT ({d}) AND ({f})) AS failed FROM j WHERE kind = '{k}' AND ({o})" for n, (k, o, d, f, _) in _DONE.items())
_NEEDS = ", ".join(f"('{n}', '{x}')" for n, v in _DONE.items() for x in v[4])
_LISTS = f"""WITH {_ATOMS}, c AS (SELECT kind, atom, {_N} FROM facts GROUP BY ALL),
j AS (SELECT atoms.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in 'a s v w b g y r m f k'.split())} FROM atoms LEFT JOIN c USING (kind, atom)), x AS ({_EACH}),
p(phase) AS (VALUES {', '.join(f"('{n}')" for n in _DONE)}), needs(phase, needed) AS (VALUES {_NEEDS}), units AS (SELECT DISTINCT unit FROM atoms),
l AS (SELECT units.unit, p.phase, count(x.atom) AS total, count(*) FILTER (WHERE x.done) AS done, count(*) FILTER (WHERE x.failed) AS failed, count(*) FILTER (WHERE NOT x.done AND NOT x.failed) AS pending,
  arg_min(x.atom, (x."at", x.atom)) FILTER (WHERE NOT x.done AND NOT x.failed) AS next_atom FROM units CROSS JOIN p LEFT JOIN x ON x.unit = units.unit AND x.phase = p.phase GROUP BY ALL),
w AS (SELECT l.*, NOT EXISTS (SELECT 1 FROM needs JOIN l n ON n.phase = needs.needed WHERE needs.phase = l.phase AND n.unit = l.unit AND n.pending > 0) AS open FROM l)"""


@query(f"{_LISTS} SELECT unit, phase, total, done, failed, pending, open, next_atom FROM w")
def work_lists(spark: SparkSession, folder: str) -> DataFrame:
    """All phases of every customer in one pass: what is done, failed and waits,
    which phases are open, and the atom that is next."""
    return worklist.work_lists(_atoms(spark, folder), _facts(spark, folder), FACTS, PHASES)


@query(f'{_LISTS} SELECT x.unit, x.phase, x.atom, x."at" FROM x JOIN w ON w.unit = x.unit AND w.phase = x.phase WHERE NOT x.done AND NOT x.failed AND w.open')
def open_work(spark: SparkSession, folder: str) -> DataFrame:
    """The atoms that wait in phases that are open."""
    return worklist.pending(_atoms(spark, folder), _facts(spark, folder), FACTS, PHASES)


@query(f"{_LISTS} SELECT phase, count(*) AS units, sum(total)::BIGINT AS total, sum(done)::BIGINT AS done, sum(failed)::BIGINT AS failed, sum(pending)::BIGINT AS pending, count(*) FILTER (WHERE open) AS open_units FROM w GROUP BY phase")
def pipeline_status(spark: SparkSession, folder: str) -> DataFrame:
    """The status of each phase over all customers."""
    return worklist.totals(work_lists(spark, folder))
