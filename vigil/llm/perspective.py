"""Chat formatting by perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered once with that participant as the assistant and the
others as named users; the mask marks the characters the assistant is to learn. Roles that frame a conversation
(``system``) keep their place in every rendering and are nobody's perspective.

A rendering is cut into chunks of a fixed number of turns by the turn's number, so that a conversation with very many
turns spreads over tasks and is never collected as a whole; chunks follow each other by ``chunk``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns in a chunk; roles that frame the conversation.
TURNS, FRAME = 64, ("system",)
#: Rows without a turn number are spread over so many chunks.
LOOSE = 4096
#: The markers of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
           frame=FRAME, turns_per_chunk: int = TURNS) -> DataFrame:
    """(conv_id, perspective, chunk, n_turns, text, spans, mask) for each participant and chunk.

    ``spans``: array of (start, end) of the trained characters in ``text``, zero-based, end excluded: what the
    perspective says and the marker that ends its turn. ``mask``: the same per turn, '1' or '0'.

    Turns are ordered by turn number, then speaker, then text; repeated rows are repeated turns. A null text is an
    empty turn. A null speaker is rendered as the user ``unknown`` and is no perspective; so a conversation whose
    speakers are all null or framing gives no rows. Markers within texts are broken up by a space, so no text can end
    its turn. Rows without a turn number come in chunks of their own after the others (negative numbers, dealt by
    content). Rows with a null conversation form one conversation, dealt the same way.
    """
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("t"), F.col(speaker).alias("s"),
                        F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"<\|im_", "<| im_").alias("x"))
    loose = F.col("t").isNull() | F.col("c").isNull()
    chunk = F.when(loose, -1 - F.pmod(F.xxhash64("s", "x", "t"), F.lit(LOOSE))).otherwise(
        F.floor(F.col("t") / F.lit(turns_per_chunk)))
    rows = rows.withColumn("chunk", chunk.cast("long"))
    chunks = rows.groupBy("c", "chunk").agg(F.sort_array(F.collect_list(F.struct("t", "s", "x"))).alias("turns"))
    people = rows.filter(F.col("s").isNotNull() & ~F.col("s").isin(*frame)).select("c", "s").distinct().select(
        F.col("c").alias("pc"), F.col("s").alias("perspective"))
    met = chunks.join(people, F.col("c").eqNullSafe(F.col("pc")))

    def head(u):
        name = (F.when(u["s"] == F.col("perspective"), F.lit("assistant")).when(u["s"].isin(*frame), u["s"])
                .otherwise(F.concat(F.lit("user name="), F.coalesce(u["s"], F.lit("unknown")))))
        return F.concat(F.lit(OPEN), name, F.lit("\n"))

    close = CLOSE.rstrip("\n")
    said = F.transform("turns", lambda u: F.struct(
        head(u).alias("head"), u["x"].alias("x"),
        F.coalesce(u["s"] == F.col("perspective"), F.lit(False)).alias("own")))
    met = met.select("c", "perspective", "chunk", said.alias("said"))
    # running positions: one pass over at most a chunk's turns
    spans = F.aggregate(
        "said", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, u: F.struct(
            (acc["at"] + F.length(u["head"]) + F.length(u["x"]) + len(CLOSE)).alias("at"),
            F.when(u["own"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(u["head"])).alias("start"),
                (acc["at"] + F.length(u["head"]) + F.length(u["x"]) + len(close)).alias("end")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return met.select(
        F.col("c").alias("conv_id"), "perspective", "chunk", F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda u: F.concat(u["head"], u["x"], F.lit(CLOSE))), "").alias("text"),
        spans.alias("spans"),
        F.array_join(F.transform("said", lambda u: F.when(u["own"], "1").otherwise("0")), "").alias("mask"))


def op10_chat(conversations: DataFrame) -> DataFrame:
    got = rotate(conversations)
    trained = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return got.select("conv_id", "perspective", "chunk", "n_turns", F.length("text").cast("long").alias("n_chars"),
                      trained.cast("long").alias("trained_chars"), F.md5("text").alias("text_md5"), "mask",
                      F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("spans"))


_HEAD = f"""'{OPEN}' || CASE WHEN s = p THEN 'assistant' WHEN s = 'system' THEN s
          ELSE 'user name=' || coalesce(s, 'unknown') END || chr(10)"""

ORACLE = f"""
WITH r AS (SELECT conv_id AS c, turn AS t, role AS s, replace(coalesce(text, ''), '<|im_', '<| im_') AS x,
                  CAST(floor(turn / {TURNS}) AS BIGINT) AS chunk FROM conversations),
w AS (SELECT DISTINCT c, s AS p FROM r WHERE s IS NOT NULL AND s <> 'system'),
m AS (SELECT r.*, p, {_HEAD} AS head FROM r JOIN w ON r.c IS NOT DISTINCT FROM w.c),
n AS (SELECT *, coalesce(s = p, false) AS own, coalesce(sum(length(head) + length(x) + {len(CLOSE)}) OVER (
             PARTITION BY c, p, chunk ORDER BY t, s, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM m)
SELECT c AS conv_id, p AS perspective, chunk, count(*) AS n_turns,
       CAST(sum(length(head) + length(x) + {len(CLOSE)}) AS BIGINT) AS n_chars,
       CAST(coalesce(sum(length(x) + {len(CLOSE) - 1}) FILTER (own), 0) AS BIGINT) AS trained_chars,
       md5(string_agg(head || x || '{CLOSE[:-1]}' || chr(10), '' ORDER BY t, s, x)) AS text_md5,
       string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY t, s, x) AS mask,
       coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(head) + length(x) + {len(CLOSE) - 1} AS BIGINT),
                           ',' ORDER BY t, s, x) FILTER (own), '') AS spans
FROM n GROUP BY 1, 2, 3
"""
