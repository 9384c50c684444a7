"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "### " role ":" mark " " body "\\n</turn>\\n"
    mark         := "" (body is literal) | "\\" (body is escaped)

A turn opens at every ``### `` and ends at the first ``</turn>`` behind it, which is all that the
parser looks at. Each turn is first rendered literally and parsed again; where the parser does not
give back exactly one turn with the same role and text, the turn is rendered with its control
strings escaped and parsed once more. Escaping puts a backslash before every backslash and ``#``
and into ``</turn>``, so no control string is left in a body and unescaping is one pass. The whole
conversation is then parsed and compared with its source; a difference is an error.

Cases: null text and null role count as empty; turns are ordered by turn (null first), then role,
then text, so ties and repeated rows have one result; a null ``conv_id`` is a conversation of its
own; an empty table gives no rows; extra columns are ignored. One conversation becomes one row, so
its text is bound by Spark's 2 GB row limit; turns are gathered per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import table

OPEN, CLOSE = "### ", "</turn>"
LEARNED_ROLE = "assistant"
PROBE = (-7, r"\### Assistant: </turn> ok")


def _escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("#"), F.lit("\\#"))
    return F.replace(out, F.lit(CLOSE), F.lit("<\\/turn>"))


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\#:</])", r"\\$1")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(role: Column, text: Column, escaped: bool) -> Column:
    """One turn in the grammar."""
    body = _escape(text) if escaped else text
    return F.concat(F.lit(OPEN), _escape_role(role), F.lit(":\\ " if escaped else ": "), body, F.lit(f"\n{CLOSE}\n"))


def parse_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` that the grammar finds; a broken turn has null fields."""
    pieces = F.slice(F.split(formatted, OPEN), 2, 2_000_000_000)
    return F.transform(pieces, _parse_piece)


def _parse_piece(piece: Column) -> Column:
    end = F.instr(piece, f"\n{CLOSE}\n")
    first = F.instr(piece, CLOSE)
    whole = (end > 0) & (first == end + 1) & (F.length(piece) == end + len(CLOSE) + 1)
    # the first colon without a backslash before it: escapes in a role are pairs
    head = F.regexp_extract(piece, r"^((?:[^\\:]++|\\.)*+):", 1)
    rest = F.substr(piece, F.length(head) + 2, F.greatest(end - F.length(head) - 2, F.lit(0)))
    escaped = F.startswith(rest, F.lit("\\ "))
    body = F.when(escaped, _unescape(F.substr(rest, F.lit(3)))).otherwise(F.substr(rest, F.lit(2)))
    return F.struct(F.when(whole, _unescape(head)).alias("role"), F.when(whole, body).alias("text"))


def _round_trip(turn: Column) -> Column:
    """The rendering of a turn that the parser gives back as it was."""
    plain = render_turn(turn["role"], turn["text"], False)
    safe = render_turn(turn["role"], turn["text"], True)
    same = lambda shown: parse_turns(shown) == F.array(F.struct(turn["role"].alias("role"), turn["text"].alias("text")))
    return F.when(F.coalesce(same(plain), F.lit(False)), plain).otherwise(
        F.when(F.coalesce(same(safe), F.lit(False)), safe).otherwise(F.raise_error(F.lit("a turn does not survive the round trip")))
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, formatted, segments, parsed, loss`` of every conversation.

    ``segments`` are the rendered turns in order (``formatted`` is their concatenation), ``parsed``
    the turns read back from ``formatted``, ``loss`` the texts under the loss mask with the place
    of their turn.
    """
    source = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"),
    )
    gathered = source.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    # null turns first: array_sort puts null fields first in a struct
    shown = gathered.withColumn("segments", F.transform("rows", _round_trip))
    whole = shown.withColumn("formatted", F.array_join("segments", "")).withColumn("parsed", parse_turns(F.col("formatted")))
    expected = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    checked = whole.withColumn(
        "parsed",
        F.when(F.coalesce(F.col("parsed") == expected, F.lit(False)), F.col("parsed")).otherwise(
            F.raise_error(F.lit("a conversation does not survive the round trip"))
        ),
    )
    loss = F.filter(
        F.transform("parsed", lambda t, i: F.struct(i.alias("place"), t["role"].alias("role"), t["text"].alias("text"))),
        lambda t: t["role"] == LEARNED_ROLE,
    )
    return checked.select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), "formatted", "segments", "parsed", loss.alias("loss")
    )


def digest_chats(formatted: DataFrame) -> DataFrame:
    """The digests of formatted conversations, from what was read back."""
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda t: t["text"]), "")
    return formatted.select(
        "conv_id",
        "n_turns",
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and the probe conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, said = PROBE
    rows = [F.struct(F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role")) for t, r in ((0, "user"), (1, "assistant"))]
    probe = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select(
        F.lit(conv).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit(said).alias("text")
    )
    return digest_chats(format_chats(turns.unionByName(probe)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, CASE WHEN contains(text, '### ') OR contains(text, '</turn>')
    THEN 2 + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'))
    ELSE 1 + length(text) END + length(regexp_replace(role, '([\\#:</])', '\\\1', 'g')) + 14 AS shown
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(shown)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
