"""Chat formatting with a grammar round trip, in DataFrame functions only.

The template: `<s>`, then the turns. A user's turn is `[INST]` text `[/INST]`, an assistant's `[ASST]` text `</s>`, a system's
`<<SYS>>` text `<</SYS>>`; any other role is `[ROLE name]` text `[/ROLE]`, with the name in base64.

A control string inside a text would be read as a mark. It is escaped by one backslash after its first character; one that
already has backslashes there gets one more, so that taking one away restores every text. A conversation is first
rendered as it is and read back by the parser; if the turns it recovers differ from the source, its texts are escaped and
it is rendered again; if they still differed, the query would stop with an error.

Scale: turns are gathered by conversation, because a formatted conversation is one value; that is the only shuffle. Its size
is that of its own texts.

Cases: a null text or role is the empty one; turns come in the order of `turn`, nulls first, then role and text where turns tie;
repeated rows are repeated turns; a null conversation id is an id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN = "<s>"
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[ASST]", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE_END = "[/ROLE]"
CLOSING = r"\[/INST\]|</s>|<</SYS>>|\[/ROLE\]"
#: The rest of each control string after its first character.
REST = r"/?INST\]|ASST\]|ROLE |/ROLE\]|/?s>|</?SYS>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])(\\*)({REST})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*)({REST})", "$1$2$3")


def _by_role(role: Column, marks, other: Column) -> Column:
    out = F
    for name, value in marks:
        out = out.when(role == name, value)
    return out.otherwise(other)


def opening(role: Column) -> Column:
    return _by_role(role, [(r, F.lit(m[0])) for r, m in MARKS.items()], F.concat(F.lit("[ROLE "), F.base64(role.cast("binary")), F.lit("]")))


def closing(role: Column) -> Column:
    return _by_role(role, [(r, F.lit(m[1])) for r, m in MARKS.items()], F.lit(ROLE_END))


def rendered(turns: str, change=lambda text: text) -> Column:
    """The turns (array of role and text) in the template, each text as `change` leaves it."""
    one = lambda t: F.concat(opening(t["role"]), change(t["text"]), closing(t["role"]))
    return F.concat(F.lit(BEGIN), F.array_join(F.transform(turns, one), ""))


def parsed(formatted: str) -> Column:
    """The turns that a formatted conversation holds."""
    pieces = F.split(F.substring(F.col(formatted), F.lit(len(BEGIN) + 1), F.length(formatted)), CLOSING)
    # What follows the last closing mark is empty.
    turns = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    starts = lambda p, mark: p.startswith(mark)

    def one(p: Column) -> Column:
        mark = F.regexp_extract(p, r"^\[ROLE ([^\]]*)\]", 1)
        role, size = F, F
        for name, (begin, _) in MARKS.items():
            role, size = role.when(starts(p, begin), F.lit(name)), size.when(starts(p, begin), F.lit(len(begin)))
        role = role.otherwise(F.unbase64(mark).cast("string"))
        size = size.otherwise(F.length(mark) + len("[ROLE ]"))
        return F.struct(role.alias("role"), unescaped(F.substring(p, size + 1, F.length(p))).alias("text"))

    return F.transform(turns, one)


def gathered(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv_id and `turns` in order."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(turn).isNotNull().alias("has"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))))
    return rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.transform(sorted_, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_conversations(rows: DataFrame, **names: str) -> DataFrame:
    """Per conversation: conv_id, formatted, and loss_spans: begin and end, in characters of `formatted`, of each
    assistant's text, from 0, end excluded."""
    own = gathered(rows, **names)
    own = own.withColumn("_plain", rendered("turns"))
    own = own.withColumn("_safe", F.col("turns") == parsed("_plain"))
    own = own.withColumn("_shown", F.when(F.col("_safe"), F.col("turns")).otherwise(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escaped(t["text"]).alias("text")))))
    own = own.withColumn("formatted", rendered("_shown"))
    own = own.withColumn("formatted", F.when(F.col("_safe") | (F.col("turns") == parsed("formatted")), F.col("formatted")).otherwise(F.raise_error("a conversation doesn't survive its round trip")))
    sizes = lambda t: F.struct((t["role"] == "assistant").alias("loss"), F.length(opening(t["role"])).alias("open"), F.length(t["text"]).alias("text"), F.length(closing(t["role"])).alias("close"))
    spot = F.struct(F.lit(len(BEGIN)).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(now: Column, t: Column) -> Column:
        begin = now["at"] + t["open"]
        span = F.array(F.struct(begin.alias("begin"), (begin + t["text"]).alias("end")))
        return F.struct((begin + t["text"] + t["close"]).alias("at"), F.when(t["loss"], F.concat(now["spans"], span)).otherwise(now["spans"]).alias("spans"))

    own = own.withColumn("_sizes", F.transform("_shown", sizes))
    return own.select("conv_id", "formatted", F.aggregate("_sizes", spot, step)["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per formatted conversation: conv_id, formatted, turns, and `loss`: the text under the loss mask, unescaped."""
    own = formatted.withColumn("turns", parsed("formatted"))
    cut = lambda s: unescaped(F.substring(F.col("formatted"), s["begin"] + 1, s["end"] - s["begin"]))
    return own.withColumn("loss", F.array_join(F.transform("loss_spans", cut), ""))


def round_trip_digests(rows: DataFrame) -> DataFrame:
    """Per conversation: what is read back from its formatted text, as counts and digests."""
    own = read_back(format_conversations(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return own.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB SQL for `round_trip_digests` of the table `conversations` and conversation -7.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 10 WHEN 'system' THEN 15 ELSE 14 + 4 * ((strlen(role) + 2) // 3) END AS marks,
    length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|ASST\]|ROLE |/ROLE\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g')) AS escaped
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(marks) + sum(escaped))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
