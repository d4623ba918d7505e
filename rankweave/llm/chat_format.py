"""Chat formatting by a grammar round trip.

Grammar of the rendered text (no regular expression is needed to parse it)::

    conversation := turn*
    turn         := OPEN role "\\n" text CLOSE          OPEN = "[INST]", CLOSE = "[/INST]"
                  | LOSS_OPEN role "\\n" text LOSS_CLOSE   "<s>", "</s>": the model learns this turn's text

Text never holds a control string: each is broken by a backslash after its first character, and one that already has
backslashes there gets one more, so that the parser can undo it. A turn is rendered plainly first, parsed again, and
escaped only if what comes back is not what went in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.common import NULL_ID, body, table

OPEN, CLOSE, LOSS_OPEN, LOSS_CLOSE = "[INST]", "[/INST]", "<s>", "</s>"
LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"([\[<])(\\*)(/?INST\]|/?s>)")
_BROKEN = re.compile(r"([\[<])\\(\\*)(/?INST\]|/?s>)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _BROKEN.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def parse(rendered: str) -> list[tuple[str, str, bool]]:
    """(role, text, under the loss mask) of every turn; ValueError where the text leaves the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        for start, end, loss in ((OPEN, CLOSE, False), (LOSS_OPEN, LOSS_CLOSE, True)):
            if rendered.startswith(start, at):
                break
        else:
            raise ValueError(f"no turn starts at {at}")
        line = rendered.find("\n", at)
        stop = rendered.find(end, line)
        if line < 0 or stop < 0:
            raise ValueError(f"the turn at {at} does not end")
        inner = rendered[line + 1:stop]
        if any(x in inner for x in (OPEN, CLOSE, LOSS_OPEN, LOSS_CLOSE)):
            raise ValueError(f"a control string inside the turn at {at}")
        turns.append((unescape_role(rendered[at + len(start):line]), unescape(inner), loss))
        at = stop + len(end)
    return turns


def _round_trip(rendered: str, turn: tuple[str, str, bool]) -> bool:
    try:
        return parse(rendered) == [turn]
    except ValueError:
        return False


def render_turn(role: str, text: str) -> str:
    loss = role == LOSS_ROLE
    start, end = (LOSS_OPEN, LOSS_CLOSE) if loss else (OPEN, CLOSE)
    for head, inner in ((role, text), (escape_role(role), text), (escape_role(role), escape(text))):
        if _round_trip(rendered := f"{start}{head}\n{inner}{end}", (role, text, loss)):
            return rendered
    raise AssertionError("the escaped turn does not come back")


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per row of ``turns``: ``conv`` (a null id: the least long), ``turn``, ``rendered``.

    Null roles and texts are empty; a turn renders to a string of the grammar above that parses back to it. The
    rendering needs no other row, so it runs wherever the rows are.
    """
    @F.pandas_udf("string")
    def rendered(role, text):
        return role.combine(text, render_turn)

    conv = F.coalesce(F.col(conv_col).cast("long"), F.lit(NULL_ID))
    own = turns.select(conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"), body(role_col).alias("r"), body(text_col).alias("t"))
    return own.select("conv", "turn", rendered("r", "t").alias("rendered"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of what the parser recovers from the rendered conversations, one row per conversation.

    Turns come in the order of ``turn`` (nulls first; equal turns by their rendered text). The rows of a conversation
    pass through its hash functions as a stream, so that one conversation may be of any length: the memory of the task
    does not grow with it. (A SHA-256 is sequential; parsing, the costly part, is spread over all rows.)
    """
    @F.pandas_udf("struct<role:string,text:string,loss:boolean,chars:long>")
    def parsed(col):
        import pandas as pd

        rows = [(*parse(x)[0], len(x)) for x in col]
        return pd.DataFrame(rows, columns=["role", "text", "loss", "chars"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def close():
            conv, n, turns, chars, loss, size = now
            out.append((None if conv == NULL_ID else conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush():
            cols = list(zip(*out, strict=True))
            names = [x.split()[0] for x in DIGEST.split(", ")]
            types = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            rows = batch.to_pydict()
            for conv, role, text, loss, chars in zip(rows["conv"], rows["role"], rows["text"], rows["loss"], rows["chars"], strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now[5] += chars
                if loss:
                    now[3] += len(text)
                    now[4].update(text.encode("utf-8", "surrogatepass"))
            if len(out) >= 5000:
                yield flush()
                out.clear()
        if now is not None:
            close()
        if out:
            yield flush()

    rows = rendered.withColumn("p", parsed("rendered")).select("conv", "turn", "rendered", "p.*")
    rows = rows.repartition("conv").sortWithinPartitions(F.col("conv"), F.col("turn").asc_nulls_first(), F.col("rendered"))
    return rows.select("conv", "role", "text", "loss", "chars").mapInArrow(digest, DIGEST)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(turns.unionByName(own)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt,
    regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g') AS esc FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(length(learnt))::BIGINT AS loss_chars, sha256(string_agg(learnt, '' ORDER BY turn)) AS loss_sha256,
  sum(length(role) + 1 + length(esc) + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
