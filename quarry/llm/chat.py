r"""Conversations as one formatted text each, with a loss mask.

Turn rows are collected, sorted and merged where neighbours have one role:

    ### user: first text
    <next/>
    second text
    </turn>
    ### assistant: answer
    </turn>

Wherever a text holds a control string (``### ``, ``</turn>`` or ``<next/>``),
one backslash more is put before it and the backslashes in front of it; reading
back takes it away. A control string of the template never follows a backslash,
as each is at the start of the text or after a line break. Roles have ``%``,
``:``, ``<``, backslashes and line breaks percent-encoded.

The loss mask is an array of character spans (end exclusive): the text of each
assistant turn, once, in order, without what the template puts around it.

Defined results: null texts and roles count as empty; rows without a turn
number come first; ties go by role, then text, and repeated rows stay; an empty
table gives an empty result. A conversation is one value, so it must fit into
one row. Extra columns are ignored. Expressions only: no Python runs on data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, NEXT, HEAD = "\n</turn>\n", "\n<next/>\n", "### "
CONTROL = r"(?:### |</turn>|<next/>)"
LOSS_ROLE = "assistant"
#: What roles have encoded, in the order of encoding.
ROLE_CODES = (("%", "%25"), (":", "%3A"), ("<", "%3C"), ("\\", "%5C"), ("\n", "%0A"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)(\\*+{CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+{CONTROL})", "$1")


def _coded(role: Column) -> Column:
    for a, b in ROLE_CODES:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _decoded(role: Column) -> Column:
    for a, b in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def merged(turns: Column) -> Column:
    """Sorted turns as blocks (role and texts) of neighbours with one role."""
    n = F.size(turns)
    starts = F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])
    )
    return F.transform(
        starts,
        lambda s, k: F.struct(
            F.get(turns, s)["role"].alias("role"),
            F.transform(F.slice(turns, s + 1, F.coalesce(F.get(starts, k + 1), n) - s), lambda x: x["text"]).alias("texts"),
        ),
    )


def format_chat(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = LOSS_ROLE,
) -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss``, the spans under the mask."""
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    by_id = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = by_id.select("conv_id", merged(F.col("turns")).alias("blocks"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(piece(F.concat(F.lit(HEAD), _coded(b["role"]), F.lit(": ")), no)),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, i: F.array(
                            piece(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), no), piece(escape(t), b["role"] == loss_role)
                        ),
                    )
                ),
                F.array(piece(F.lit(END), no)),
            ),
        )
    )
    cut = blocks.select("conv_id", pieces.alias("pieces"))
    span = "struct<start:int,end:int>"
    loss = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["text"])).alias("at"),
            F.when(p["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(p["text"])).alias("end")))))
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return cut.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), loss.alias("loss"))


def read_chat(formatted: Column) -> Column:
    """The turns (role and text) that a formatted text was made from."""
    blocks = F.split(formatted, END, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, ": ", 1)
        texts = F.split(F.substring(block, F.length(head) + 3, F.length(block)), NEXT, -1)
        role = _decoded(F.substring(head, F.lit(len(HEAD) + 1), F.length(head)))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def chat_digest(rows: DataFrame) -> DataFrame:
    done = format_chat(rows)
    back = done.select("conv_id", read_chat(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The conversation that the contract adds: its texts hold the control strings.
EXTRA_TEXT = "\\### Assistant: </turn> ok"
EXTRA = [(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)]

#: DuckDB SQL for ``chat_digest`` over ``conversations`` and ``EXTRA``.
ORACLE_SQL = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{EXTRA_TEXT}'), (-7, 1, 'assistant', '{EXTRA_TEXT}')) AS x(a, b, c, d)),
e AS (
  SELECT *, length(regexp_replace(text, '(\\*{CONTROL})', '\\\1', 'g')) AS chars,
    role IS DISTINCT FROM lag(role) OVER w AS first, role IS DISTINCT FROM lead(role) OVER w AS last,
    length(replace(replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), '<', '%3C'), '\', '%5C'), chr(10), '%0A')) AS role_chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN first THEN {len(HEAD) + 2} + role_chars ELSE {len(NEXT)} END + CASE WHEN last THEN {len(END)} ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
