"""Chat formatting by prefix-target expansion: an example for every assistant turn.

Each turn becomes a piece of text between marks; the characters that marks begin with are
spelled otherwise inside texts and role names, so that no mark can stand there and every
text can be read back. A conversation's text is its pieces in order. Each assistant turn is an example
of its own: the conversation's text up to the end of that turn, with the reply alone
under the loss mask.

Examples of one conversation are prefixes of one text, so they are stored as spans over
it: the files grow with the turns, not with the square of a conversation's length.
``example_texts`` spells them out.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import shared_dir
from fleetlake.operators.scans import running


@dataclass(frozen=True)
class ChatTemplate:
    """``### role: text</turn>`` and a line end; ``target`` is the role that is trained."""

    opening: str = "### "
    between: str = ": "
    closing: str = "</turn>\n"
    target: str = "assistant"


#: What stands for characters that marks are made of, the backslash first; the colon in role names only.
ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
ROLE_ESCAPES = ESCAPES | {":": "\\c"}
_PLAIN = {e: c for c, e in ROLE_ESCAPES.items()}


def escaped(text: Column, escapes: dict[str, str] = ESCAPES) -> Column:
    for char, told in escapes.items():
        text = F.replace(text, F.lit(char), F.lit(told))
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\[\\hlc]", lambda m: _PLAIN[m[0]], text)


def read_turn(piece: str, template: ChatTemplate = ChatTemplate()) -> tuple[str, str]:
    """(role, text) of a turn's piece; an error if it isn't one."""
    t = template
    if not (piece.startswith(t.opening) and piece.endswith(t.closing)):
        raise ValueError("a piece without its marks")
    role, _, text = piece[len(t.opening) : -len(t.closing)].partition(t.between)
    return unescaped(role), unescaped(text)


def format_conversations(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> tuple[DataFrame, DataFrame]:
    """(turns, examples) of rows (conv_id, turn, role, text).

    turns: conv_id, pos (1, 2, ...), role, piece and its ``start`` and ``stop`` in the
    conversation's text. examples, one for each turn of the target role: conv_id,
    example (1, 2, ...), target_pos, context_turns, ``loss_start`` and ``loss_stop`` of
    the reply and ``stop``, where the example's text ends. All in code points.

    Rows go by turn, those without a turn last, then by role and a hash of the text; repeated
    rows are turns of their own. Null roles and texts are empty, rows without a conv_id
    are one conversation. A conversation without a target turn has turns and no example.
    Empty tables give empty results; very long texts are one piece each; other columns
    are not read.
    """
    t = template
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(t.opening), escaped(role, ROLE_ESCAPES), F.lit(t.between))
    r = rows.select("conv_id", F.col("turn").isNull().alias("no_turn"), "turn", role.alias("role"), F.xxhash64(text).alias("h"), head.alias("head"), escaped(text).alias("body"))
    r = r.select("conv_id", "no_turn", "turn", "role", "h", F.concat("head", "body", F.lit(t.closing)).alias("piece"), F.char_length("head").alias("skip"), F.char_length("body").alias("size"), (F.col("role") == t.target).cast("int").alias("trained"))
    r = r.withColumn("length", F.char_length("piece"))
    r = running(r, ["conv_id"], ["no_turn", "turn", "role", "h"], sums={"stop": "length", "example": "trained"}, rank="pos")
    start = F.col("stop") - F.col("length")
    turns = r.select("conv_id", "pos", "role", "piece", start.alias("start"), "stop")
    loss = start + F.col("skip")
    examples = r.where("trained = 1").select("conv_id", "example", F.col("pos").alias("target_pos"), (F.col("pos") - 1).alias("context_turns"), loss.alias("loss_start"), (loss + F.col("size")).alias("loss_stop"), "stop")
    return turns, examples


def write_examples(rows: DataFrame, path: str, template: ChatTemplate = ChatTemplate()) -> str:
    """Writes the tables ``turns`` and ``examples`` under ``path``; Spark commits the files, so lost tasks are rerun."""
    turns, examples = format_conversations(rows, template)
    turns.write.parquet(f"{path}/turns")
    examples.write.parquet(f"{path}/examples")
    return path


def new_path(spark) -> str:
    import uuid

    return f"{shared_dir(spark)}/fleetlake-chat-{uuid.uuid4().hex}"


def read_examples(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/turns"), spark.read.parquet(f"{path}/examples")


def example_texts(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_stop): examples spelled out, each with all of its context.

    Together they are as long as the square of a conversation's length, so give the
    examples that are wanted now. The mask is text[loss_start:loss_stop].
    """
    context = turns.select(F.col("conv_id").alias("c"), "pos", "piece")
    both = examples.join(context, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") <= F.col("target_pos")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    return both.groupBy("conv_id", "example", "loss_start", "loss_stop").agg(text.alias("text")).select("conv_id", "example", "text", "loss_start", "loss_stop")


def _digest_batches(batches, template: ChatTemplate):
    """Rows come in order of conversation and position, so one state of fixed size is enough however long a conversation is."""
    import pyarrow as pa

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    state = None

    def told(s):
        return (s["id"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["stop"], s["examples"])

    def batch(rows):
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for b in batches:
        out = []
        for conv, piece, start, stop, loss_start, loss_stop in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if state is None or state["id"] != conv:
                if state is not None:
                    out.append(told(state))
                state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "stop": 0, "examples": 0}
            role, text = read_turn(piece, template)
            state["turns"].update(f"{role}\n{text}\n".encode())
            state["n"] += 1
            state["stop"] = stop
            if loss_start is not None:
                reply = unescaped(piece[loss_start - start : loss_stop - start])
                state["chars"] += len(reply)
                state["loss"].update(reply.encode())
                state["examples"] += 1
        yield batch(out)
    yield batch([told(state)] if state is not None else [])


def digests(turns: DataFrame, examples: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples), read from the two tables.

    ``turns_sha256`` is over role, line end, text, line end of every turn, ``loss_*`` over
    the texts under the examples' masks without escapes.
    """
    marks = examples.select(F.col("conv_id").alias("c"), F.col("target_pos").alias("p"), "loss_start", "loss_stop")
    both = turns.join(marks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")), "left")
    rows = both.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select(F.col("conv_id").cast("long"), "piece", "start", "stop", "loss_start", "loss_stop")
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
    return rows.mapInArrow(lambda it: _digest_batches(it, template), kinds)
