"""Chat formatting by event sourcing: events of a log are folded into final messages, which are rendered and read back.

Events of one message are few and are folded together; a conversation, however long, is only ever sorted and streamed.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: Control strings of this and other templates. Inside texts a backslash follows their first character.
CONTROLS = ["<|", "|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
TRAINED = "assistant"


def escape(c: Column) -> Column:
    """Double every backslash, then break control strings by a single one."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROLS:
        c = F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
    return c


def unescape(s: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", s)


def turns_as_events(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of finished turns as events of their own messages."""
    return turns.select(F.col(conv).alias("conv_id"), F.monotonically_increasing_id().alias("message"), F.col(turn).alias("seq"),
                        F.lit("message").alias("op"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): the final messages of a log (conv_id, message, seq, op, role, text).

    In order of seq, `message`, `edit` and `regenerate` set a message's text, `delta` appends to it and `delete` removes
    it until it is set again; other ops are ignored. A message stands at its first event; its role is the last one named.
    Nulls: text counts as empty, role as the empty string if none is named, seq sorts first, conv_id is a conversation
    of its own. Events of equal seq apply in order of op, role and text, repeated ones repeatedly. Other columns are
    ignored, and an empty log has no messages.
    """
    def step(state: Column, e: Column) -> Column:
        sets, adds, ends = e["op"].isin("message", "edit", "regenerate"), e["op"] == "delta", e["op"] == "delete"
        text = F.coalesce(e["text"], F.lit(""))
        known = F.coalesce(sets | adds | ends, F.lit(False))
        return F.when(~known, state).otherwise(F.struct(
            F.coalesce(e["role"], state["role"]).alias("role"),
            F.when(sets, text).when(adds, F.concat(state["text"], text)).otherwise(F.lit("")).alias("text"),
            F.when(ends, False).otherwise(sets | state["alive"] | adds).alias("alive")))

    start = F.struct(F.lit(None).cast("string").alias("role"), F.lit("").alias("text"), F.lit(False).alias("alive"))
    log = F.sort_array(F.collect_list(F.struct("seq", "op", "role", "text")))
    return (events.groupBy("conv_id", "message").agg(log.alias("log"))
            .select("conv_id", F.get("log", F.lit(0))["seq"].alias("seq"), F.aggregate("log", start, step).alias("m"))
            .where("m.alive").select("conv_id", "seq", F.coalesce("m.role", F.lit("")).alias("role"), "m.text"))


def render(final: DataFrame) -> DataFrame:
    """(conv_id, line, formatted, loss_start, loss_end): one row per message, in order of line within a conversation.

    The loss mask covers the text of assistant messages, as code points of `formatted` from loss_start before loss_end.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    line = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "role", "text")).cast("long")
    body = escape(F.col("text"))
    start = F.length(head).cast("long")
    trained = F.col("role") == TRAINED
    return final.select("conv_id", line.alias("line"), F.concat(head, body, F.lit(END)).alias("formatted"), start.alias("loss_start"),
                        (start + F.when(trained, F.length(body)).otherwise(0)).alias("loss_end"))


MESSAGE = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(CLOSE) + "(.*)" + re.escape(END), re.S)


def read(formatted: str) -> tuple[str, str]:
    """Role and text of one rendered message."""
    found = MESSAGE.fullmatch(formatted)
    if not found:
        raise ValueError("not a rendered message")
    return unescape(found.group(1)), unescape(found.group(2))


def summaries(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from rendered rows: turns, digests of all text and of what the mask covers."""
    kind = rendered.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digested(batches):
        now, state = None, None

        def row() -> list:
            return [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            out = []
            for conv, formatted, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is None or conv != now:
                    if state:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read(formatted)
                loss = unescape(formatted[a:b])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(formatted)
            yield batch_of(out)
        if state:
            yield batch_of([row()])

    types = [rendered.schema["conv_id"].dataType]

    def batch_of(rows: list) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(types[0]), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return (rendered.select("conv_id", "line", "formatted", "loss_start", "loss_end").repartition("conv_id")
            .sortWithinPartitions("conv_id", "line").select("conv_id", "formatted", "loss_start", "loss_end")
            .mapInArrow(digested, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                  "formatted_chars long"))


def _sql_escape(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for s in CONTROLS:
        c = f"replace({c}, '{s}', '{s[0]}\\{s[1:]}')"
    return c


SQL = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(13 + length({_sql_escape('role')}) + length({_sql_escape('text')}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
