"""Read queries over namings: things that are named, their log of acts, the
perspectives they appear in and the relations they take part in.

Each correlated lookup of a row is one keyed aggregate here, joined to all rows
at once: latest values, flags, first appearances, labels of maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import state

ENTITY_MODES = ("entity", "relation", "silence")
DISCUSSIONS = ("MemoDiscussion:%", "Discussion:%")


def alive(namings: DataFrame) -> DataFrame:
    return namings.where("deleted_at is null")


def history(acts: DataFrame, namings: DataFrame, dimension: str) -> DataFrame:
    """Acts that set ``dimension``, with the inscription of who acted."""
    by = namings.select(F.col("id").alias("by"), F.col("inscription").alias("by_inscription"))
    return acts.where(F.col(dimension).isNotNull()).join(by, "by").select("naming_id", "seq", dimension, "by_inscription")


def participations_of(parts: DataFrame, namings: DataFrame) -> DataFrame:
    """(naming_id, relation_id, partner_id, role, partner_inscription): every
    live relation seen from both of its ends."""
    live = alive(namings)
    both = parts.select(F.col("naming_id"), F.col("id").alias("relation_id"), F.col("participant_id").alias("partner_id"), F.lit("source").alias("role"))
    both = both.unionByName(parts.select(F.col("participant_id").alias("naming_id"), F.col("id").alias("relation_id"), F.col("naming_id").alias("partner_id"), F.lit("target").alias("role")))
    both = both.join(live.select(F.col("id").alias("relation_id"), F.col("created_at").alias("related_at")), "relation_id")
    return both.join(live.select(F.col("id").alias("partner_id"), F.col("inscription").alias("partner_inscription")), "partner_id")


def maps(appearances: DataFrame, namings: DataFrame) -> DataFrame:
    """(map_id, map_label, map_type): live perspectives of themselves that have a type of map."""
    own = appearances.where((F.col("naming_id") == F.col("perspective_id")) & (F.col("mode") == "perspective") & F.get_json_object("properties", "$.mapType").isNotNull())
    label = alive(namings).select(F.col("id").alias("map_id"), F.col("inscription").alias("map_label"))
    return own.select(F.col("naming_id").alias("map_id"), F.get_json_object("properties", "$.mapType").alias("map_type")).join(label, "map_id")


def phases(memberships: DataFrame, appearances: DataFrame, namings: DataFrame) -> DataFrame:
    """(naming_id, perspective_id, phase_id, phase_label): the phase that a
    naming is in on a map: of those it was assigned to and not removed from
    since, the one assigned last."""
    last = memberships.groupBy("phase_id", "naming_id").agg(F.max(F.struct("seq", "action")).alias("l")).where("l.action = 'assign'").select("phase_id", "naming_id", F.col("l.seq").alias("seq"))
    on = last.join(appearances.select(F.col("naming_id").alias("phase_id"), "perspective_id"), "phase_id")
    best = on.groupBy("naming_id", "perspective_id").agg(F.max_by("phase_id", "seq").alias("phase_id"))
    return best.join(namings.select(F.col("id").alias("phase_id"), F.col("inscription").alias("phase_label")), "phase_id")


def aggregated_appearances(appearances: DataFrame, namings: DataFrame, memberships: DataFrame) -> DataFrame:
    """Appearances of namings on maps, with the type of map and the current phase."""
    m = maps(appearances, namings).withColumnRenamed("map_id", "perspective_id")
    a = appearances.where("naming_id <> perspective_id").join(m, "perspective_id")
    return a.join(phases(memberships, appearances, namings), ["naming_id", "perspective_id"], "left").select("naming_id", "perspective_id", "map_label", "map_type", "mode", "valence", "phase_id", "phase_label")


def aggregated_participations(parts: DataFrame, namings: DataFrame, acts: DataFrame, appearances: DataFrame) -> DataFrame:
    """Relations of namings with their partner, its current designation, the
    relation's valence and the maps it is on."""
    p = participations_of(parts, namings)
    now = state.latest(acts, ["naming_id"], ["seq"], "designation").select(F.col("naming_id").alias("partner_id"), F.col("designation").alias("partner_designation"))
    valence = appearances.where("mode = 'relation'").groupBy(F.col("naming_id").alias("relation_id")).agg(F.min("valence").alias("valence"))
    on = appearances.where("naming_id <> perspective_id").join(maps(appearances, namings), F.col("perspective_id") == F.col("map_id"))
    labels = on.groupBy(F.col("naming_id").alias("relation_id")).agg(F.array_join(F.array_sort(F.collect_set("map_label")), ", ").alias("map_labels"))
    return p.join(now, "partner_id", "left").join(valence, "relation_id", "left").join(labels, "relation_id", "left").select("naming_id", "relation_id", "partner_id", "partner_inscription", "partner_designation", "role", "valence", "map_labels")


def project_namings(namings: DataFrame, acts: DataFrame, appearances: DataFrame, parts: DataFrame, memos: DataFrame, researchers: DataFrame) -> DataFrame:
    """All live namings of projects that are entities, relations or silences (but
    not as a code only), or researchers: current designation and inscription,
    grounding, mode, ends of relations, valence, and the maps they are on."""
    live = alive(namings)
    id_ = F.col("id").alias("naming_id")
    now = state.latest(acts, ["naming_id"], ["seq"], "designation", "inscription").withColumnRenamed("inscription", "current_inscription")
    coded = appearances.where("valence = 'codes'").select(F.col("directed_from").alias("naming_id")).distinct().withColumn("has_document_anchor", F.lit(True))
    memo = participations_of(parts, namings).join(memos.select(F.col("naming_id").alias("partner_id")).distinct(), "partner_id", "left_semi").select("naming_id").distinct().withColumn("has_memo_link", F.lit(True))
    shown = appearances.where(F.col("mode").isin(*ENTITY_MODES))
    mode = shown.groupBy("naming_id").agg(F.min("mode").alias("mode"), F.min(F.when(F.col("mode") == "relation", F.col("valence"))).alias("valence"))
    kept = shown.where("valence is null or valence <> 'codes'").select("naming_id").unionByName(researchers.select("naming_id")).distinct()
    label = namings.select("id", "inscription")
    ends = parts.select(id_, F.col("naming_id").alias("directed_from"), F.col("participant_id").alias("directed_to"))
    ends = ends.join(label.select(F.col("id").alias("directed_from"), F.col("inscription").alias("source_inscription")), "directed_from", "left").join(label.select(F.col("id").alias("directed_to"), F.col("inscription").alias("target_inscription")), "directed_to", "left")
    on = appearances.where("naming_id <> perspective_id").join(live.select(F.col("id").alias("perspective_id"), F.col("inscription").alias("label")), "perspective_id")
    maps_ = on.groupBy("naming_id").agg(F.to_json(F.array_sort(F.collect_set(F.struct(F.col("perspective_id").alias("id"), "label")))).alias("appears_on_maps"))
    out = live.select(id_, "project_id", "inscription", "seq").join(kept, "naming_id", "left_semi")
    for part in (now, coded, memo, mode, ends, maps_):
        out = out.join(part, "naming_id", "left")
    false = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select("project_id", "naming_id", "inscription", "seq", "designation", "current_inscription", false("has_document_anchor"), false("has_memo_link"), "mode", "directed_from", "directed_to", "source_inscription", "target_inscription", "valence", "appears_on_maps")


def _talk(label: str | Column) -> Column:
    col = F.col(label) if isinstance(label, str) else label
    return col.like(DISCUSSIONS[0]) | col.like(DISCUSSIONS[1])


def memos_of_projects(namings: DataFrame, memos: DataFrame, parts: DataFrame, appearances: DataFrame, ai: int) -> DataFrame:
    """Live memos with what they are linked to and their discussion, each as an
    array (a nested map by key is one collected array for each key)."""
    live = alive(namings)
    own = live.join(memos, live["id"] == memos["naming_id"]).where(~_talk("inscription")).select("id", "project_id", F.col("inscription").alias("label"), "content", "status", "created_by", "created_at")
    ids = own.select(F.col("id").alias("naming_id"))
    far = participations_of(parts, namings).join(ids, "naming_id", "left_semi").join(ids.select(F.col("naming_id").alias("partner_id")), "partner_id", "left_anti")
    mode = appearances.groupBy(F.col("naming_id").alias("partner_id")).agg(F.min("mode").alias("mode"))
    plain = far.join(memos.select(F.col("naming_id").alias("partner_id")), "partner_id", "left_anti").where(~_talk("partner_inscription")).join(mode, "partner_id", "left")
    links = plain.groupBy(F.col("naming_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct(F.col("partner_id").alias("id"), F.col("partner_inscription").alias("label"), F.coalesce("mode", F.lit("entity")).alias("mode")))).alias("links"))
    said = live.select(F.col("id").alias("partner_id"), "created_at", "created_by").join(memos.select(F.col("naming_id").alias("partner_id"), "content"), "partner_id")
    talk = far.where(F.col("partner_inscription").like(DISCUSSIONS[0])).join(said, "partner_id")
    kind = F.when(F.col("partner_inscription").contains(": researcher"), "researcher").when(F.col("partner_inscription").contains(": revise"), "revise").otherwise("response")
    entry = F.struct("created_at", F.col("partner_id").alias("id"), F.when(F.col("created_by") == ai, "ai").otherwise("researcher").alias("role"), kind.alias("type"), "content")
    talk = talk.groupBy(F.col("naming_id").alias("id")).agg(F.array_sort(F.collect_set(entry)).alias("discussion"))
    out = own.join(links, "id", "left").join(talk, "id", "left")
    return out.select("project_id", "id", "label", "content", F.coalesce("status", F.lit("active")).alias("status"), (F.col("created_by") == ai).alias("is_ai"), "links", "discussion")
