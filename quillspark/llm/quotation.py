"""Conversations linked by quotations.

Each message is parsed into its own passages and its quoted ones (lines that
begin with one or more ``>``, the number being the level; a line that announces
a quotation goes with it).  Adjacent lines of one level are joined, so that it
does not matter where they are wrapped, and split into sentences; a sentence
over several lines also counts by its lines.  Passages are normalised (case,
white space, punctuation) and hashed.  A quoted passage of any length belongs
to the latest earlier message of its conversation that has it as its own, else
to the first message of all conversations that has, if that comes before (by
conversation and turn; so links never close a circle).  As unrelated
conversations share phrases, a passage links to another conversation alone only
if it is long (``ALONE`` words, or letters of scripts without spaces) and at most
``RARE`` conversations have it as their own; shorter or commoner ones, from
``_LEAST`` characters on, link if two of the message agree on the same message.
The message replied to is the one that most passages of the least linked level
belong to, of equal ones that of the latest turn.  Following these links gives
the branch (its first message) and the depth of every message; in the order
(branch_conv, branch_turn, depth, conv_id, turn) a reply stands after what it
replies to.

A conversation is never held by one task: links are joins and windows over
(conversation, passage), ancestors are found by doubling the links, and the
owner of a passage elsewhere is one aggregated row.  A passage or a first
message that very many messages link to is joined in several partitions.

Rows: a null text is an empty body; rows with a null conv_id or turn are left as
they are and linked to nothing; repeated rows get equal results, and rows of one
conv_id and turn with other texts are one message that has all their passages;
further columns are not read, whatever they are called; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import common as c

_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
_ANNOUNCE = re.compile(r"^(on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$", re.I)
_SPLIT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
_PLAIN = re.compile(r"\W+")
_WIDE = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_BETWEEN = re.compile(f"(?<=[{_WIDE}]) (?=[{_WIDE}])")  # a wrapped line adds no space there
_LEAST = 8  # characters of what links across conversations, and of a quoted line that is less than its sentence
_LETTERS = re.compile(f"[{_WIDE}]")
ALONE = 5  # words, or twice as many letters of scripts without spaces, of a passage that links across conversations alone
RARE = 3  # conversations that have such a passage at most


def _plain(part: str) -> str:
    return _BETWEEN.sub("", _PLAIN.sub(" ", part).strip().lower())


def _hash(plain: str) -> int:
    return int.from_bytes(blake2b(plain.encode(), digest_size=8).digest(), "little", signed=True)


def _far(plain: str) -> int:
    """0: links within its conversation only, 1: across with others, 2: also alone."""
    if len(plain) < _LEAST:
        return 0
    return 1 + (len(plain.split()) >= ALONE or len(_LETTERS.findall(plain)) >= 2 * ALONE)


def _sentences(lines: list[str]) -> Iterator[tuple[str, list[str]]]:
    """The normalised sentences of adjacent lines, and the lines of those that
    run over several."""
    for part in _SPLIT.split("\n".join(lines)):
        if plain := _plain(part):
            yield plain, [x for x in map(_plain, part.split("\n")) if x and x != plain] if "\n" in part else []


def parse(text: str | None) -> tuple[str, list[int], list[dict], int]:
    """Body without quotations, hashes of its sentences and their lines; forms
    (level, sentence, h, whole, far) of the quoted sentences, and their number."""
    body, own, quoted, n = [], [], [], 0
    held: list[str] = []
    held_level = 0

    def end() -> None:
        nonlocal n
        for plain, lines in _sentences(held):
            h = _hash(plain)
            if not held_level:
                own.extend((h, *map(_hash, lines)))
                continue
            n += 1
            quoted.append({"level": held_level, "sentence": h, "h": h, "whole": True, "far": _far(plain)})
            quoted.extend({"level": held_level, "sentence": h, "h": _hash(x), "whole": False, "far": _far(x)} for x in lines if len(x) >= _LEAST)
        held.clear()

    lines = (text or "").split("\n")
    for i, line in enumerate(lines):
        level = 0
        if m := _QUOTE.match(line):
            level, line = m[1].count(">"), m[2]
        elif _ANNOUNCE.match(line.strip()) and i + 1 < len(lines) and lines[i + 1].lstrip().startswith(">"):
            end()
            continue
        else:
            body.append(line)
        if level != held_level or not line.strip():
            end()
            held_level = level
        if line.strip():
            held.append(line)
    end()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(body)).strip(), own, quoted, n


_KIND = "conv_id long, turn long, role string, body string, own array<long>, quoted array<struct<level:int,sentence:long,h:long,whole:boolean,far:int>>, n_quoted long"


def parsed(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("level", pa.int32()), ("sentence", pa.int64()), ("h", pa.int64()), ("whole", pa.bool_()), ("far", pa.int32())]))
        for b in batches:
            out = [parse(x) for x in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("conv_id"), b.column("turn"), b.column("role"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], kind), pa.array([x[3] for x in out], pa.int64())], names=["conv_id", "turn", "role", "body", "own", "quoted", "n_quoted"])

    src = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return src.mapInArrow(run, _KIND)


def reply_links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_conv, parent_turn, n_linked) of messages that quote another."""
    rows = rows.where("conv_id is not null and turn is not null")
    asked = rows.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*").distinct()
    owned = rows.select("conv_id", "turn", F.explode("own").alias("h")).distinct()
    wanted = owned.join(asked.select("h").distinct(), "h", "left_semi")
    both = asked.withColumn("owner", F.lit(None).cast("long")).unionByName(wanted.select("conv_id", "turn", "h", F.col("turn").alias("owner")), allowMissingColumns=True)
    before = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("own_turn", F.max("owner").over(before)).where("owner is null")
    each = wanted.groupBy("h", "conv_id").agg(F.min("turn").alias("turn"))
    first = each.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("first"), F.count("*").alias("owners"))
    found = c.salted(near, first, ["h"], "left")
    across = (F.col("far") > 0) & (F.col("first") < F.struct("conv_id", "turn")) & (F.col("first.conv_id") != F.col("conv_id"))
    found = found.where(F.col("own_turn").isNotNull() | across)
    agree = found.where("own_turn is null").groupBy("conv_id", "turn", "first").agg(F.size(F.collect_set("sentence")).alias("n_agree"))  # sentences of one message
    far = found.join(agree, ["conv_id", "turn", "first"], "left").where(F.col("own_turn").isNotNull() | (F.col("far") == 2) & (F.col("owners") <= RARE) | (F.col("n_agree") >= 2))
    linked = far.select("conv_id", "turn", "level", "sentence", "whole", F.when(F.col("own_turn").isNotNull(), F.struct("conv_id", F.col("own_turn").alias("turn"))).otherwise(F.col("first")).alias("to"))
    # a sentence has one vote: as a whole if it is found so, else by a line of it
    linked = linked.groupBy("conv_id", "turn", "level", "sentence").agg(F.max(F.struct("whole", F.col("to.conv_id") == F.col("conv_id"), "to")).alias("m")).select("conv_id", "turn", "level", F.col("m.to").alias("to"))
    votes = linked.groupBy("conv_id", "turn", "level", "to").agg(F.count("*").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "n", F.col("to.turn"), F.col("to.conv_id"))).alias("b"), F.sum("n").alias("n_linked"))
    return best.select("conv_id", "turn", F.col("b.conv_id").alias("parent_conv"), F.col("b.turn").alias("parent_turn"), "n_linked")


def link(messages: DataFrame) -> DataFrame:
    """One row for each message: its body without quotations, the message it
    replies to, and its branch and depth."""
    rows = c.cut(parsed(messages), "messages")
    links = c.cut(reply_links(rows), "links")
    up = links.select("conv_id", "turn", F.col("parent_conv").alias("top_conv"), F.col("parent_turn").alias("top_turn"), F.lit(1).alias("depth"))
    last = None
    while True:  # what is reached from the top of each link is added to it
        up = c.cut(up, "ancestors")
        if last is not None:
            c.drop(last)
        last = up
        more = up.select(F.col("conv_id").alias("top_conv"), F.col("turn").alias("top_turn"), F.col("top_conv").alias("next_conv"), F.col("top_turn").alias("next_turn"), F.col("depth").alias("more"))
        moved = c.salted(up, more, ["top_conv", "top_turn"], "left")
        if moved.where("more is not null").isEmpty():
            break
        up = moved.select("conv_id", "turn", F.coalesce("next_conv", "top_conv").alias("top_conv"), F.coalesce("next_turn", "top_turn").alias("top_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    up = up.join(links, ["conv_id", "turn"])
    out = rows.join(up, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "body", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_conv", "parent_turn",
        F.coalesce("top_conv", "conv_id").alias("branch_conv"), F.coalesce("top_turn", "turn").alias("branch_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
