"""Chat formatting by grammar round trip, in DataFrame functions only.

Template: each turn is ``### ROLE: TEXT</turn>`` and a line feed. Grammar of ROLE and TEXT: any
characters but the control strings ``##`` and ``</``, where a backslash takes the next character
literally. Each turn is first rendered as it is and parsed again; only where the parse isn't valid
or differs from the source is the turn rendered with escapes, and that again is compared. A turn that
still differs ends the job, which the escape rule makes impossible.

Defined cases: null text and null role are empty; turns go by turn, then role, then text, so repeated
rows and ties have one order; null turns come first; a null conv_id is one conversation; an empty
table gives no rows; other columns are ignored. A conversation is one value of the result, hence its
turns meet in one task; nothing larger does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, COLON, END = "### ", ": ", "</turn>\n"
#: A text that holds the template's own control strings.
HARD = "\\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    """No control string is left: a backslash precedes each backslash, the second of two #, the slash of </ and each colon."""
    text = F.regexp_replace(text, r"\\", r"\\\\")
    text = F.regexp_replace(text, "#(?=#)", r"#\\")
    return F.regexp_replace(F.replace(text, F.lit("</"), F.lit("<\\/")), ":", r"\\:")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rendered(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(COLON), body, F.lit(END))


#: One turn: role and body are runs of escapes and other characters.
TURN = r"(?s)^### ((?:[^\\:]++|\\.)*+): (.*)$"


def parsed(turn: Column) -> Column:
    """(role, body, text, valid) of one turn without its end mark; valid if the grammar takes it."""
    role, body = F.regexp_extract(turn, TURN, 1), F.regexp_extract(turn, TURN, 2)
    raw = F.concat(role, F.lit(" "), body)
    return F.struct(
        unescaped(role).alias("role"), body.alias("body"), unescaped(body).alias("text"),
        (F.rlike(turn, F.lit(TURN)) & ~F.contains(raw, F.lit("##")) & ~F.contains(raw, F.lit("</"))).alias("valid"),
    )


def parsed_all(formatted: Column) -> Column:
    """The turns of a whole formatted conversation."""
    parts = F.split(formatted, END)
    return F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), parsed)


def formatted(chats: DataFrame, assistant: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_spans: (start from 1, length) in code points of each assistant text."""
    turns = chats.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    parts = F.split(rendered(F.col("role"), F.col("text")), END)
    back = parsed(parts[0])
    same = (F.size(parts) == 2) & back["valid"] & (back["role"] == F.col("role")) & (back["text"] == F.col("text"))
    turns = turns.withColumn("plain", same)
    turns = turns.withColumns({
        "r": F.when(F.col("plain"), F.col("role")).otherwise(escaped(F.col("role"))),
        "b": F.when(F.col("plain"), F.col("text")).otherwise(escaped(F.col("text"))),
    }).withColumn("line", rendered(F.col("r"), F.col("b")))
    back = parsed(F.split("line", END)[0])
    good = back["valid"] & (back["role"] == F.col("role")) & (back["text"] == F.col("text"))
    turns = turns.withColumn("line", F.when(good, F.col("line")).otherwise(F.raise_error(F.lit("a turn can't be read back"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ended = F.sum(F.length("line").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    turns = turns.withColumns({"n": F.row_number().over(order), "ended": ended})
    span = F.struct((F.col("ended") - len(END) - F.length("b") + 1).cast("int").alias("start"), F.length("b").alias("length"))
    lines = F.array_sort(F.collect_list(F.struct("n", "line", F.when(F.col("role") == assistant, span).alias("span"))))
    return turns.groupBy("conv_id").agg(lines.alias("lines")).select(
        "conv_id",
        F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("formatted"),
        F.filter(F.transform("lines", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from ``formatted`` and ``loss_spans`` alone."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", s["start"], s["length"])))
    return (
        chats.withColumn("turns", parsed_all(F.col("formatted")))
        .withColumn("loss", F.array_join(loss, ""))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def hard_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant both say the control strings."""
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"),
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(formatted(chats.unionByName(hard_conversation(spark))))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, contains(role || ' ' || text, '\') OR contains(role || ' ' || text, '##')
         OR contains(role || ' ' || text, '</') OR contains(role, ':') AS hard FROM t
), r AS (
  SELECT *, length(role) + length(text) + 14 + CASE WHEN hard THEN
      length(role || text) - length(replace(role || text, '\', ''))
    + length(role || text) - length(replace(role || text, ':', ''))
    + (length(role || ' ' || text) - length(replace(role || ' ' || text, '#', '')))
    - (length(regexp_replace(role || ' ' || text, '#+', '#', 'g')) - length(regexp_replace(role || ' ' || text, '#+', '', 'g')))
    + (length(role || ' ' || text) - length(replace(role || ' ' || text, '</', ''))) // 2
    ELSE 0 END AS chars FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
