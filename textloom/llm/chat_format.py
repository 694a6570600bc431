"""Chat formatting from an event log.

A log row is ``conv_id, message, turn, seq, kind, role, text``. The log is dealt out by conversation and message, sorted by seq, and folded as a stream, so that a conversation
of any length spreads over tasks and a task holds one message: ``start`` (role, empty), ``delta`` (text goes on), ``message`` and ``edit`` (text is replaced), ``regenerate``
(text starts anew, and messages of later turns that began before that moment are dropped), ``delete``. Events of equal seq are folded in the order start, message, regenerate,
edit, delta, delete, then by text. An event without seq comes first, an unknown kind changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, drop_table, new_path, stage_table, text_or_empty

LOG = "conv_id long, message string, turn long, seq long, kind string, role string, text string"
#: Strings that mean something to this or other templates, and what stands for them inside texts; "&" is escaped first and restored last.
NEW_LINE = "&#10;"  # in roles, which end at a line end
CONTROLS = (("<|", "&lt;|"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("<<SYS>>", "&lt;&lt;SYS>>"), ("<</SYS>>", "&lt;&lt;/SYS>>"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]"))
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
LOSS_ROLE = "assistant"
#: Characters of folded messages that are handed on at once, and turns of a conversation that one task looks through for regenerations.
FLUSH_CHARS, CUT_TURNS = 4_000_000, 1024


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for plain, safe in CONTROLS:
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescape(text: str) -> str:
    return text.replace("&lt;", "<").replace("&#91;", "[").replace(NEW_LINE, "\n").replace("&amp;", "&")


def log_of_turns(turns: DataFrame) -> DataFrame:
    """The events by which conversations(conv_id, turn, role, text) could have come about; equal rows stay separate messages.

    Every message starts empty. By turn mod 3 its text then comes in two deltas; or in one delta that is edited, from its first half; or as a draft that is regenerated in two deltas.
    """
    number = F.monotonically_increasing_id().cast("string")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), number.alias("message"), F.col("turn").cast("long").alias("turn"), text_or_empty("role").alias("role"), text_or_empty().alias("t"))
    half = F.floor(F.length("t") / 2).cast("int")
    left, right = F.substring("t", F.lit(1), half), F.substring("t", half + 1, F.length("t"))
    event = lambda k, kind, text=None, role=None: F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), (F.lit("") if role is None else role).alias("role"), (F.lit(None).cast("string") if text is None else text).alias("text"))
    start = event(0, "start", role=F.col("role"))
    streamed = F.array(start, event(1, "delta", left), event(2, "delta", right))
    edited = F.array(start, event(1, "delta", left), event(2, "edit", F.col("t")))
    again = F.array(start, event(1, "delta", F.lit("draft")), event(2, "regenerate"), event(3, "delta", left), event(4, "delta", right))
    way = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3))
    events = rows.select("conv_id", "message", "turn", F.explode(F.when(way == 0, streamed).when(way == 1, edited).otherwise(again)).alias("e"))
    return events.select("conv_id", "message", "turn", (F.col("turn") * 8 + F.col("e.step")).alias("seq"), "e.kind", "e.role", "e.text")


#: Fixed order of events of equal seq.
KINDS = ("start", "message", "regenerate", "edit", "delta", "delete")
FOLDED = "conv_id long, message string, turn long, born long, cut long, role string, text string"


class Message:
    """What is known of one message while its events pass."""

    def __init__(self, conv: int | None, name: str | None):
        self.key, self.turn, self.born, self.cut, self.role, self.parts, self.live = (conv, name), None, None, None, "", [], True

    def take(self, turn: int | None, seq: int | None, kind: str | None, role: str | None, text: str | None) -> None:
        if turn is not None:
            self.turn = turn if self.turn is None else min(self.turn, turn)
        if seq is not None and self.born is None:
            self.born = seq
        if kind not in KINDS:
            return
        self.role, self.live = role or self.role, kind != "delete"
        if kind in ("start", "regenerate", "message", "edit"):
            self.parts = []
        if kind in ("delta", "message", "edit") and text:
            self.parts.append(text)
        if kind == "regenerate" and seq is not None:
            self.cut = seq

    def row(self) -> tuple:
        return (*self.key, self.turn, self.born, self.cut, self.role, "".join(self.parts) if self.live else None)


def fold_messages(log: DataFrame) -> DataFrame:
    """Each message once, ``cut`` the seq of its last regeneration, ``text`` null if it was deleted."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["conv_id", "message", "turn", "born", "cut", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Message | None = None
        done: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
            done.clear()
            return out

        for b in batches:
            for conv, name, *event in zip(*(b.column(c).to_pylist() for c in ("conv_id", "message", "turn", "seq", "kind", "role", "text")), strict=True):
                if now is None or now.key != (conv, name):
                    if now is not None:
                        done.append(now.row())
                        size += len(done[-1][-1] or "")
                        if size >= FLUSH_CHARS or len(done) >= 10_000:
                            yield flush()
                            size = 0
                    now = Message(conv, name)
                now.take(*event)
        if now is not None:
            done.append(now.row())
            yield flush()

    bounded_batches(log.sparkSession)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)).alias("_rank")
    rows = log.select(*names[:3], "seq", "kind", "role", "text", rank)
    return rows.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "_rank", "text").drop("_rank").mapInArrow(run, FOLDED)


def dropped_messages(folded: DataFrame) -> DataFrame:
    """``conv_id, message`` of messages that a regeneration of an earlier turn took away.

    That needs the highest cut of all turns before. It is found over blocks of CUT_TURNS turns and then inside each, so that no task gets all of a conversation.
    """
    ids = folded.where("turn IS NOT NULL").select("conv_id", "message", "turn", "born", "cut", F.floor(F.col("turn") / CUT_TURNS).alias("_block"))
    turns = ids.groupBy("conv_id", "_block", "turn").agg(F.max("cut").alias("_cut"), F.min("born").alias("_born"))
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("_inside", F.max("_cut").over(inside)).alias("t")
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ids.groupBy("conv_id", "_block").agg(F.max("cut").alias("_cut")).withColumn("_before", F.max("_cut").over(earlier)).where("_before IS NOT NULL").alias("b")
    highest = turns.join(blocks, F.col("t.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("t._block") == F.col("b._block")), "left")
    highest = highest.select("t.conv_id", "t.turn", "t._born", F.greatest("t._inside", "b._before").alias("_high")).where("_high > _born").alias("h")
    hit = ids.alias("i").join(highest, F.col("i.conv_id").eqNullSafe(F.col("h.conv_id")) & (F.col("i.turn") == F.col("h.turn"))).where("h._high > i.born")
    return hit.select(F.col("i.conv_id").alias("conv_id"), F.col("i.message").alias("message")).distinct()


def fold_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, turn, role, text`` of the final messages, and the table behind it, to drop after use."""
    folded = stage_table(fold_messages(log), "folded")
    gone = dropped_messages(folded).alias("d")
    kept = folded.alias("f").join(gone, F.col("f.conv_id").eqNullSafe(F.col("d.conv_id")) & F.col("f.message").eqNullSafe(F.col("d.message")), "left_anti")
    return kept.where("text IS NOT NULL").select("conv_id", "turn", "role", "text"), folded


def render(messages: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Adds ``rendered`` (a message's part of the conversation's text), ``loss_begin`` and ``loss_chars`` (code points in rendered under the loss mask)."""
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEW_LINE)), F.lit("\n"))
    body = escape(F.col("text"))
    on = F.col("role") == loss_role
    out = messages.select("conv_id", "turn", "role", head.alias("_head"), body.alias("_body"))
    return out.select("conv_id", "turn", "role", F.concat("_head", "_body", F.lit(CLOSE)).alias("rendered"), F.length("_head").alias("loss_begin"), F.when(on, F.length("_body")).otherwise(0).alias("loss_chars"))


def format_log(log: DataFrame, path: str) -> DataFrame:
    """Fold, render and write a row for each message; returns the table read back. A conversation's text is its ``rendered`` by turn, role and text."""
    messages, folded = fold_log(log)
    out = render(messages)
    out.write.option("compression", "zstd").parquet(path)
    drop_table(folded)
    return log.sparkSession.read.schema(out.schema).parquet(path)


def parse(rendered: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    role, _, body = rendered.removeprefix(OPEN).partition("\n")
    return unescape(role), unescape(body.removesuffix(CLOSE))


def chat_digests(table: DataFrame) -> DataFrame:
    """Per conversation, read from the stored text: its messages stream through one task in order, of which only running hashes are kept.

    A null conv_id is a conversation of its own, null turns come first, ties go by the rendered message, null roles and texts are empty, an empty table gives an empty table.
    """
    rows = table.select("conv_id", "turn", "rendered", "loss_begin", "loss_chars").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        done: list[list] = []

        def flush() -> pa.RecordBatch:
            out = [[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in done]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for conv, rendered, begin, size in zip(*(b.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_begin", "loss_chars")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(rendered)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss = unescape(rendered[begin : begin + size])
                now[3] += len(loss)
                now[4].update(loss.encode("utf-8", "surrogatepass"))
                now[5] += len(rendered)
            if len(done) >= 10_000:
                yield flush()
        if now is not None:
            done.append(now)
            yield flush()

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_turns(turns: DataFrame) -> DataFrame:
    """Digests of all conversations of a table of finished turns, written and read back."""
    return chat_digests(format_log(log_of_turns(turns), new_path(turns.sparkSession, "chats")))
