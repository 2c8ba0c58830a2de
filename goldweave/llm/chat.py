"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered, the rendered text is parsed by a deterministic
parser, and the recovered turns are compared with the source.  Where they
differ, conflicting content is escaped and the text rendered again, until the
turns are identical.

Grammar::

    conversation = { turn }
    turn = "<s>" role NEWLINE body "</s>"
    body = "[INST] " text " [/INST]"      (user)
         | " " text                       (any other role)

A text inside a turn holds no control string.  A backslash sequence stands for
a character of the source: ``\\l`` for ``<``, ``\\o`` for ``[``, ``\\n`` for a
line feed in a role and ``\\b`` for the backslash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm.common import table

#: The template's control strings.
CONTROL = r"</?s>|\[/?INST\]"
OPEN, CLOSE, USER_OPEN, USER_CLOSE = "<s>", "</s>", "[INST] ", " [/INST]"


def escape_conflicts(text: Column) -> Column:
    """Escape what the parser would misread: backslash sequences and control strings."""
    out = F.regexp_replace(text, r"\\(?=[blon])", r"\\b")
    out = F.regexp_replace(out, r"<(?=/?s>)", r"\\l")
    return F.regexp_replace(out, r"\[(?=/?INST\])", r"\\o")


def escape_all(text: Column) -> Column:
    """Escape every character that a control string or an escape could begin with."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\o"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\o"), F.lit("[")), F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def render(turns: Column, escape) -> Column:
    """Segments (text, loss) of all turns; only an assistant's text is under the loss mask."""

    def segments(t: Column) -> Column:
        role = F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n"))
        user = t["role"] == "user"
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(OPEN), role, F.lit("\n"), F.when(user, USER_OPEN).otherwise(" ")), F.lit(False)),
            part(escape(t["text"]), t["role"] == "assistant"),
            part(F.concat(F.when(user, USER_CLOSE).otherwise(""), F.lit(CLOSE)), F.lit(False)),
        )

    return F.flatten(F.transform(turns, segments))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parse(text: Column) -> Column:
    """Turns (role, text) of a rendered text; a null role and text where a turn breaks the grammar."""
    pieces = F.split(text, CLOSE, -1)  # what stands after the last turn is empty

    def turn(piece: Column) -> Column:
        end = F.instr(piece, "\n")
        role, body = F.substring(piece, F.lit(4), end - 4), F.substring(piece, end + 1, F.length(piece))
        user = role == "user"
        inner = F.when(user, F.substring(body, F.lit(8), F.length(body) - 15)).otherwise(F.substring(body, F.lit(2), F.length(body)))
        framed = F.when(user, body.startswith(USER_OPEN) & body.endswith(USER_CLOSE) & (F.length(body) >= 15)).otherwise(body.startswith(" "))
        good = piece.startswith(OPEN) & (end > 0) & framed & ~inner.rlike(CONTROL) & ~role.rlike(CONTROL)
        return F.struct(F.when(good, unescape(role)).alias("role"), F.when(good, unescape(inner)).alias("text"))

    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``turns`` (parsed back), ``segments`` (text, loss) and ``formatted``.

    Turns are ordered by number; equal numbers by role, then text, and repeated
    rows stay.  A null role or text is empty; rows without a conversation id
    form one conversation.  Other columns are not read.  A conversation is one
    string in the end, so its rows meet in one task.  A conversation that the
    last round of escaping doesn't bring back identical is an error.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = df.groupBy(F.col(conv_col).alias("conv_id")).agg(turns.alias("source"))
    out = out.withColumn("segments", render(F.col("source"), lambda t: t)).withColumn("formatted", formatted(F.col("segments"))).withColumn("turns", parse(F.col("formatted")))
    for escape in (escape_conflicts, escape_all):
        same = F.col("turns").eqNullSafe(F.col("source"))
        again = F.when(same, F.col("segments")).otherwise(render(F.col("source"), escape))
        out = out.withColumn("segments", again).withColumn("formatted", formatted(F.col("segments"))).withColumn("turns", F.when(same, F.col("turns")).otherwise(parse(F.col("formatted"))))
    # the last round escapes every character that could conflict; should a text still not come back, say so rather than pass it on
    closed = F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("conversation doesn't come back from its rendered text: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return out.select("conv_id", closed.alias("turns"), "segments", "formatted")


def op6_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, and one that consists of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = format_conversations(rows.unionByName(hard))
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(F.array_join(learned, "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join(learned, ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB SQL for the query: the digests depend on the source only, the formatted length on what had to be escaped.
OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_matches(text || ' ' || role, '</?s>|\[/?INST\]|\\[blon]') AS conflict,
    regexp_replace(text, '\\([blon])', '\\b\1', 'g') AS bs,
    regexp_replace(role, '\\([blon])', '\\b\1', 'g') AS br
  FROM t
), w AS (SELECT conv_id, bool_or(conflict) AS hard FROM e GROUP BY conv_id
), f AS (
  SELECT e.*, CASE WHEN hard THEN length(regexp_replace(regexp_replace(bs, '<(/?s>)', '\\l\1', 'g'), '\[(/?INST\])', '\\o\1', 'g')) ELSE length(text) END
    + CASE WHEN hard THEN length(regexp_replace(regexp_replace(br, '<(/?s>)', '\\l\1', 'g'), '\[(/?INST\])', '\\o\1', 'g')) ELSE length(role) END
    + 8 + CASE WHEN role = 'user' THEN 15 ELSE 1 END AS chars
  FROM e JOIN w ON e.conv_id IS NOT DISTINCT FROM w.conv_id
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
