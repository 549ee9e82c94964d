"""Chat formatting with cumulative-snapshot collapse (operator 10), in DataFrame functions only.

A log often holds a conversation several times, each time with the turns so far. Every turn gets the hash of the conversation up
to it; a conversation whose last hash is the hash of a proper prefix of a longer one is a snapshot of it, and an
anti-join leaves the maximal conversations, which are rendered. Positions and hashes are counted in two levels, within the ranges
that all turns are dealt into in their full order and over the ranges of a conversation, so one conversation with a large part
of all rows is split, whatever its turn numbers are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matforge.llm.common import read, written

#: Turns of one rendered part.
SPAN = 64
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def _before(agg: Column, order: str = "span") -> Column:
    return agg.over(Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def prefix_hashes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (key, conv_id, pos, n, role, text, h1, h2): turns in order, with the 128-bit hash of the conversation up to each.

    Turns are ordered by turn, role, text, nulls first; equal rows are one turn logged twice and count once. Rows of null conversation id
    are one conversation. The turn number orders but is not hashed; a null and an empty text differ.
    """
    own = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
                       F.col(text_col).cast("string").alias("text")).distinct()
    own = own.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")))
    # Ranges of the order itself, numbered and written, so that every later step sees the same ones.
    own = written(own.repartitionByRange("key", "turn", "role", "text").withColumn("span", F.spark_partition_id()), "chat-turns")
    sizes = own.groupBy("key", "span").agg(F.count("*").alias("c"))
    sizes = sizes.select("key", "span", F.coalesce(_before(F.sum("c")), F.lit(0)).alias("base"), F.sum("c").over(Window.partitionBy("key")).alias("n"))
    inside = Window.partitionBy("key", "span").orderBy("turn", "role", "text")
    placed = own.join(sizes, ["key", "span"]).withColumn("pos", F.col("base") + F.row_number().over(inside))
    parts = ("pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    placed = placed.withColumn("x1", F.xxhash64(*parts)).withColumn("x2", F.xxhash64(F.lit("second"), *parts))
    whole = placed.groupBy("key", "span").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    whole = whole.select("key", "span", *(F.coalesce(_before(F.bit_xor(c)), F.lit(0)).alias(f"before_{c}") for c in ("x1", "x2")))
    running = Window.partitionBy("key", "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(whole, ["key", "span"]).select(
        "key", "conv_id", "pos", "n", "role", "text", *(F.bit_xor(f"x{i}").over(running).bitwiseXOR(F.col(f"before_x{i}")).alias(f"h{i}") for i in (1, 2)))


def maximal(hashed: DataFrame) -> DataFrame:
    """Keys of the conversations that are neither a proper prefix of a longer one nor, among equal ones, of larger id."""
    ends = hashed.where("pos = n").groupBy("n", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "key")).alias("first"))
    shorter = hashed.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return ends.join(shorter, ["n", "h1", "h2"], "left_anti").select("first.key")


def render(role: Column, text: Column, opening: str = OPEN, closing: str = CLOSE) -> Column:
    """A turn in the chat template: role in lower case (null: unknown), text as it is (null: empty)."""
    head, tail = opening.split("{role}")
    name = F.lower(F.trim(F.coalesce(role, F.lit("unknown"))))
    return F.concat(F.lit(head), name, F.lit(tail), F.coalesce(text, F.lit("")), F.lit(closing))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 opening: str = OPEN, closing: str = CLOSE, span: int = SPAN) -> DataFrame:
    """Rendered maximal conversations.

    Returns (conv_id, n_turns, part, n_parts, rendered): a conversation of at most ``span`` turns is one row, a longer one several whose
    parts (from 0) follow each other without a gap, so that no task gathers more than ``span`` turns. An empty input gives no rows; other columns are ignored.
    """
    hashed = written(prefix_hashes(turns, conv_col, turn_col, role_col, text_col), "chat-hashes")
    kept = hashed.join(maximal(hashed), "key", "left_semi").withColumn("part", F.floor((F.col("pos") - 1) / span).cast("int"))
    piece = F.struct("pos", render(F.col("role"), F.col("text"), opening, closing).alias("piece"))
    return kept.groupBy("key", "conv_id", "n", "part").agg(F.sort_array(F.collect_list(piece)).alias("pieces")).select(
        "conv_id", F.col("n").alias("n_turns"), "part", F.ceil(F.col("n") / span).cast("int").alias("n_parts"), F.array_join("pieces.piece", "").alias("rendered"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations."""
    return format_chats(read(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
                    count(*) OVER (PARTITION BY conv_id) AS n FROM turns),
chats AS (SELECT conv_id, n, list(struct_pack(r := role, t := text) ORDER BY pos) AS l FROM numbered GROUP BY conv_id, n),
kept AS (SELECT conv_id, n FROM chats a WHERE NOT EXISTS (
    SELECT 1 FROM chats b WHERE (b.n > a.n OR b.n = a.n AND b.conv_id < a.conv_id) AND b.l[1].r IS NOT DISTINCT FROM a.l[1].r
      AND b.l[1].t IS NOT DISTINCT FROM a.l[1].t AND b.l[1:a.n] = a.l))
SELECT k.conv_id, k.n AS n_turns, CAST((m.pos - 1) // 64 AS INTEGER) AS part, CAST((k.n + 63) // 64 AS INTEGER) AS n_parts,
       string_agg('<|' || lower(trim(coalesce(m.role, 'unknown'))) || '|>' || chr(10) || coalesce(m.text, '') || '<|end|>' || chr(10), '' ORDER BY m.pos) AS rendered
FROM kept k JOIN numbered m ON m.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, k.n, (m.pos - 1) // 64
"""
