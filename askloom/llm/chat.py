"""Chat formatting by perspective: every participant of a dialogue is the
assistant once, the others are named users, and masks mark what to learn.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.session import broadcast_if_small, land

#: Turn numbers that one rendered part covers.
TURNS_PER_PART = 64
#: Rows of a part from which on it is cut into pieces, of about this many rows each.
PIECE_ROWS = 4096
# Rows without a turn number are dealt into so many parts by hash.
_LOOSE_PARTS = 1024
# Characters of a text that take part in the choice of ranges, which passes the driver.
_RANGE_CHARS = 128
SYSTEM_ROLES = ("system",)


def rotate_perspectives(
    turns: DataFrame,
    *,
    turns_per_part: int = TURNS_PER_PART,
    system_roles: tuple[str, ...] = SYSTEM_ROLES,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """``conv_id, speaker, part, piece, first_turn, last_turn, n_turns, text, masks``
    from ``conv_id, turn, role, text``.

    One row per conversation, participant, part and piece. A part covers the turn
    numbers ``part * turns_per_part`` and following. Turn numbers may repeat, so a
    part with more than ``piece_rows`` rows is cut into pieces in order of its turns,
    and a conversation of any length and kind is rendered in rows of bounded size
    (about twice ``piece_rows`` turns at most); its text is the texts in order of
    ``part``, then ``piece``. Other parts are piece 0. Runs a job that looks for such
    parts, and one that stores their rows if there are any. A turn is rendered as

        <|assistant|>TEXT<|end|>        said by ``speaker``; TEXT<|end|> is learnt
        <|user|>NAME: TEXT<|end|>       said by another participant
        <|system|>TEXT<|end|>           system roles; these are no participants

    each followed by a line break. ``masks`` lists the ``start, end`` character
    ranges (end excluded) of a part that are learnt.

    Null texts are empty; null roles are users named ``unknown`` and nobody's
    perspective. ``<|`` inside a text or a name gets a blank, so that no text can
    close its own turn. Turns with one number follow each other by role, then
    text; rows that repeat are rendered as often as they occur. Rows without a
    turn number have negative parts. A conversation without participants has no
    rows; rows without ``conv_id`` form one conversation. Other columns are ignored.
    """
    said = turns.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    part = F.when(
        F.col("turn").isNull(), -F.lit(1) - F.pmod(F.xxhash64("role", "text"), F.lit(_LOOSE_PARTS))
    ).otherwise(F.floor(F.col("turn") / turns_per_part))
    parts = (
        _in_pieces(said.withColumn("part", part), piece_rows)
        .groupBy("conv_id", "part", "piece")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    )
    speakers = (
        said.where(F.col("role").isNotNull() & ~F.col("role").isin(*system_roles))
        .select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker"))
        .distinct()
    )
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def render(said: Column) -> Column:
        body = F.concat(_plain(said["text"]), F.lit("<|end|>"))
        mine = said["role"].eqNullSafe(F.col("speaker"))
        name = F.concat(F.lit("<|user|>"), _plain(F.coalesce(said["role"], F.lit("unknown"))), F.lit(": "))
        head = (
            F.when(mine, F.lit("<|assistant|>"))
            .when(F.coalesce(said["role"].isin(*system_roles), F.lit(False)), F.lit("<|system|>"))
            .otherwise(name)
        )
        return F.struct(head.alias("head"), body.alias("body"), mine.alias("mine"))

    lines = seen.withColumn("lines", F.transform("said", render))
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("masks"),
    )

    def step(state: Column, line: Column) -> Column:
        begin = state["at"] + F.length(line["head"])
        end = begin + F.length(line["body"])
        mask = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(
            (end + 1).cast("long").alias("at"),
            F.when(line["mine"], F.concat(state["masks"], F.array(mask)))
            .otherwise(state["masks"])
            .alias("masks"),
        )

    whole = F.concat_ws(
        "", F.transform("lines", lambda x: F.concat(x["head"], x["body"], F.lit("\n")))
    )
    return lines.select(
        "conv_id",
        "speaker",
        "part",
        "piece",
        F.array_min(F.transform("said", lambda x: x["turn"])).alias("first_turn"),
        F.array_max(F.transform("said", lambda x: x["turn"])).alias("last_turn"),
        F.size("said").cast("long").alias("n_turns"),
        whole.alias("text"),
        F.aggregate("lines", start, step)["masks"].alias("masks"),
    )


def _in_pieces(said: DataFrame, piece_rows: int) -> DataFrame:
    """Add ``piece``. Rows of large parts are sorted over all tasks into ranges of
    about ``piece_rows``, equal rows too, and a range's number is the piece."""
    sizes = said.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("_rows"))
    large = land(sizes.where(F.col("_rows") > piece_rows), "large-parts")
    rows = large.select(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    if not rows:
        return said.withColumn("piece", F.lit(0))
    named = large.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    # At most a row per ``piece_rows`` rows of the input, measured before it is sent.
    named = broadcast_if_small(named)
    small = said.join(named, same, "left_anti").withColumn("piece", F.lit(0))
    ranges = said.join(named, same, "left_semi").repartitionByRange(
        -(-rows // piece_rows), "conv_id", "part", "turn", "role", F.left("text", F.lit(_RANGE_CHARS)),
        F.sha2("text", 256), F.monotonically_increasing_id(),
    )
    # Stored, so that a range keeps its number however often it is read.
    return small.unionByName(land(ranges.withColumn("piece", F.spark_partition_id()), "pieces"))


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def with_mask_text(rendered: DataFrame) -> DataFrame:
    """Masks as ``start-end`` ranges joined by commas, for comparison as text."""
    ranges = F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"]))
    return rendered.withColumn("masks", F.concat_ws(",", ranges))


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS body,
         coalesce(text, '') AS raw, CAST(floor(turn / 64) AS BIGINT) AS part
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM conversations
  WHERE role IS NOT NULL AND role <> 'system'
), lines AS (
  SELECT s.conv_id, p.speaker, s.part, s.turn, s.role, s.raw,
         CASE WHEN s.role = p.speaker THEN '<|assistant|>'
              WHEN s.role = 'system' THEN '<|system|>'
              ELSE '<|user|>' || replace(coalesce(s.role, 'unknown'), '<|', '< |') || ': ' END AS head,
         s.body || '<|end|>' AS body, coalesce(s.role = p.speaker, false) AS mine
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS begins
  FROM lines
  WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn, role, raw
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, speaker, part, min(turn) AS first_turn, max(turn) AS last_turn,
       count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY turn, role, raw) AS text,
       coalesce(string_agg(CASE WHEN mine THEN CAST(CAST(begins AS BIGINT) AS VARCHAR) || '-' ||
                CAST(CAST(begins + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn, role, raw), '') AS masks
FROM placed GROUP BY conv_id, speaker, part
"""
