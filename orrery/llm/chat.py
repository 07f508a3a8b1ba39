"""Chat formatting with prefix-target expansion, by DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are the
context and its text alone is trainable. A conversation that does not end with an
assistant turn gets one more example without a trainable part, so that the output
holds every turn and the conversation can be read back from it.

One shuffle brings the turns of a conversation together; expansion and reading
back keep that partitioning. A conversation is the unit of the output: its context
strings hold all its turns, whatever the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import table

#: Fixed values of the template: what stands before and after a turn's text, by role.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"), "assistant": ("<s> ", " </s>")}
#: For any other role: its name stands between the first two.
OTHER = ("[TURN ", "] ", " [/TURN]")
#: Control strings that a text must not hold as such, each with its escape.
ESCAPE = "\x1a"
CONTROLS = {"[INST]": "1", "[/INST]": "2", "<<SYS>>": "3", "<</SYS>>": "4", "<s>": "5", "</s>": "6", "[TURN ": "7", "[/TURN]": "8"}
SEGMENT = r"(?s)\[INST\] .*? \[/INST\]|<<SYS>> .*? <</SYS>>|<s> .*? </s>|\[TURN [^\]]*\] .*? \[/TURN\]"


def escape(text: Column) -> Column:
    """No control string is left in the result; unescape() gives the text back."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for control, code in CONTROLS.items():
        out = F.replace(out, F.lit(control), F.lit(ESCAPE + code))
    return out


def unescape(text: Column) -> Column:
    out = text
    for control, code in CONTROLS.items():
        out = F.replace(out, F.lit(ESCAPE + code), F.lit(control))
    return F.replace(out, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _role_name(role: Column) -> Column:
    return F.replace(escape(role), F.lit("]"), F.lit(ESCAPE + "9"))


def _segment(turn: Column) -> Column:
    role, body = turn["role"], escape(turn["text"])
    before = F.concat(F.lit(OTHER[0]), _role_name(role), F.lit(OTHER[1]))
    after = F.lit(OTHER[2])
    for name, (a, b) in MARKS.items():
        before, after = F.when(role == name, F.lit(a)).otherwise(before), F.when(role == name, F.lit(b)).otherwise(after)
    return F.struct(role.alias("role"), before.alias("before"), body.alias("body"), after.alias("after"))


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example (1 ..), formatted, loss_start, loss_end: code points, end exclusive.

    Turns stand in the order of turn (null first), then role and text; repeated rows
    stay. Null text and null role count as empty. A null conv_id is a conversation
    of its own. Where loss_start = loss_end no text is trainable. An empty table gives
    no rows; other columns are ignored.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = convs.select("conv_id", F.transform("turns", _segment).alias("segments")).withColumn("n", F.size("segments"))
    at = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("segments", i)["role"] == "assistant")
    open_end = F.element_at("segments", -1)["role"] != "assistant"
    at = F.when(open_end, F.concat(at, F.array(F.col("n") + 1))).otherwise(at)
    rows = convs.select("conv_id", "segments", "n", F.posexplode(at).alias("example", "at"))
    whole = lambda s: F.concat(s["before"], s["body"], s["after"])
    context = F.array_join(F.transform(F.slice("segments", F.lit(1), F.col("at") - 1), whole), "")
    rows = rows.withColumn("context", context).withColumn("reply", F.when(F.col("at") <= F.col("n"), F.get("segments", F.col("at") - 1)))
    start = F.length("context") + F.coalesce(F.length("reply.before"), F.lit(0))
    return rows.select(
        "conv_id",
        (F.col("example") + 1).alias("example"),
        F.concat("context", F.coalesce(whole(F.col("reply")), F.lit(""))).alias("formatted"),
        start.alias("loss_start"),
        (start + F.coalesce(F.length("reply.body"), F.lit(0))).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example, escapes undone."""

    def turn(s: Column) -> Column:
        size = F.length(s)
        name = F.regexp_extract(s, r"^\[TURN ([^\]]*)\] ", 1)
        role = unescape(F.replace(name, F.lit(ESCAPE + "9"), F.lit("]")))
        skip, drop = F.length(name) + len(OTHER[0]) + len(OTHER[1]), F.lit(len(OTHER[2]))
        for known, (a, b) in MARKS.items():
            here = s.startswith(a)
            role, skip, drop = F.when(here, F.lit(known)).otherwise(role), F.when(here, F.lit(len(a))).otherwise(skip), F.when(here, F.lit(len(b))).otherwise(drop)
        return F.struct(role.alias("role"), unescape(F.substring(s, skip + 1, size - skip - drop)).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(SEGMENT), F.lit(0)), turn)


def digest(examples: DataFrame) -> DataFrame:
    """What the examples hold, read back from their text and masks, one row for each conversation."""
    masked = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(F.struct("example", unescape(masked).alias("text")))).alias("masked"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    per = per.withColumn("turns", read_turns(F.col("longest"))).withColumn("loss", F.array_join(F.transform("masked", lambda m: m["text"]), ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The conversation that the query adds: control strings inside both texts.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_formatting(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in PROBE) + " AS t(conv_id, turn, role, text)")
    return digest(expand(own.unionByName(probe)))


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, chr(26), chr(26) || '0')"
    for control, code in CONTROLS.items():
        out = f"replace({out}, '{control}', chr(26) || '{code}')"
    return out


OP8_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {", ".join(map(str, PROBE))}))),
s AS (SELECT *, length({_escaped_sql("text")}) + CASE role {" ".join(f"WHEN '{k}' THEN {len(a) + len(b)}" for k, (a, b) in MARKS.items())}
        ELSE {sum(map(len, OTHER))} + length(replace({_escaped_sql("role")}, ']', chr(26) || '9')) END AS chars,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM s)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    coalesce(sum(upto) FILTER (role = 'assistant' OR i = n), 0)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
