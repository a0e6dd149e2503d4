"""Operator 8: conversations rebuilt from an event log, and rendered.

An event is (conv_id, seq, kind, target, role, text):

- message: a new message of role with text, numbered by its seq;
- delta: text appended to message target, or to the last one if target is null; the first delta of
  a turn may open the message: a target that never existed is made, of its role; one that came late,
  to a message that has been dropped, is void;
- edit: replaces the text of message target and drops what came after it;
- regenerate: drops message target (null: the last one) and what came after it, then starts an
  empty message of its role in its place, to be streamed by deltas, or given whole in text;
- delete: drops message target alone.

The log is partitioned by conversation, sorted by seq within it, and folded in one pass, in constant
time per event whatever the conversation's length; a conversation larger than a batch is carried
over from batch to batch. Final messages render as
``<|role|>\\ntext<|end|>\\n``; marker strings inside a text are broken by a zero-width space, so that
text cannot forge a turn.

Defined results: conv_id, seq and target are numbers; events with null conv_id or seq are dropped;
exact repetitions of an event count once; events with equal seq (ties) apply messages first, then
in order of kind, target, role, text, nulls first; of messages with one number a target means the latest
that is left; null text is ''; null role is "user"; a target that does not exist (any more)
makes edit, regenerate and delete void; unknown kinds are void; a conversation without a remaining
message renders ''; texts of any length are kept whole; an empty log has no conversations. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["conv_id", "seq", "kind", "target", "role", "text"]


class Fold:
    """The state of one conversation: its messages in order, [number, role, pieces of text], None
    where one was deleted (never at the end), and the places of each number, the latest last."""

    def __init__(self) -> None:
        self.messages: list[list | None] = []
        self.places: dict[int, list[int]] = {}

    def _place(self, target: int | None) -> int | None:
        if target is None:
            return len(self.messages) - 1 if self.messages else None
        own = self.places.get(target)
        return own[-1] if own else None

    def _append(self, number: int, role: str, text: str) -> None:
        self.places.setdefault(number, []).append(len(self.messages))
        self.messages.append([number, role, [text]])

    def _drop_from(self, at: int) -> None:
        """Every message is dropped at most once; its number stays known."""
        while len(self.messages) > at or self.messages and self.messages[-1] is None:
            gone = self.messages.pop()
            if gone is not None:
                self.places[gone[0]].pop()

    def apply(self, seq: int, kind: str | None, target: int | None, role: str | None, text: str | None) -> None:
        role, text = role or "user", text or ""
        at = self._place(target)
        if kind == "message":
            self._append(seq, role, text)
        elif kind == "delta":
            if at is not None:
                self.messages[at][2].append(text)
            elif target is None or target not in self.places:
                self._append(seq if target is None else target, role, text)
        elif at is None:
            return
        elif kind == "edit":
            self.messages[at][2] = [text]
            self._drop_from(at + 1)
        elif kind == "regenerate":
            number = self.messages[at][0]
            self._drop_from(at)
            self._append(number, role, text)
        elif kind == "delete":
            self.places[self.messages[at][0]].pop()
            self.messages[at] = None
            self._drop_from(len(self.messages))

    def final(self) -> list[tuple[str, str]]:
        return [(m[1], "".join(m[2])) for m in self.messages if m is not None]


def render(messages: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role.replace('<|', '<​|')}|>\n{text.replace('<|', '<​|')}<|end|>\n" for role, text in messages)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, last = None, None, None
    for b in batches:
        out = []
        for row in zip(*(b.column(c).to_pylist() for c in COLUMNS)):
            if state is None or row[0] != now:
                if state is not None:
                    out.append((now, state.final()))
                now, state, last = row[0], Fold(), None
            if row != last:
                state.apply(*row[1:])
            last = row
        yield _rendered(out)
    if state is not None:
        yield _rendered([(now, state.final())])


def _rendered(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([render(r[1]) for r in rows], pa.string())], names=["conv_id", "n_messages", "rendered"])


def rebuild(events: DataFrame) -> DataFrame:
    """conv_id, n_messages, rendered of every conversation in the log."""
    kinds = {"conv_id": "long", "seq": "long", "kind": "string", "target": "long", "role": "string", "text": "string"}
    log = events.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items())).where("conv_id is not null and seq is not null")
    order = ["conv_id", "seq", F.coalesce(F.col("kind") != "message", F.lit(True)), *COLUMNS[2:]]
    return log.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_fold, "conv_id long, n_messages long, rendered string")


def from_turns(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as the log that a chat service might have kept of it. A turn's
    number is ten times its own. What the assistant says is streamed in two deltas, every third
    turn then regenerated, to end in " again"; of every other role first a draft stands, an answer to it
    begins, the draft is edited and the answer's last delta comes late. Every fifth turn is
    followed by a slip, which is deleted. Of several different rows with one turn the later ones, by
    role and text, are further deltas."""
    by_turn = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("n", F.row_number().over(by_turn))
    role, text, number = F.coalesce("role", F.lit("user")), F.col("text"), F.col("turn") * 10
    half = F.floor(F.length("text") / 2).cast("int")

    def event(offset: int, kind: str, target, own_role, own_text, when=F.lit(True)):
        fields = F.lit(offset), F.lit(kind), target, own_role, own_text
        return F.when(when, F.struct(*(x.cast(k).alias(c) for x, k, c in zip(fields, ("int", "string", "long", "string", "string"), ("offset", "kind", "target", "role", "text")))))

    null, assistant = F.lit(None), F.lit("assistant")
    streamed = (F.col("n") == 1) & (role == assistant)
    edited = (F.col("n") == 1) & (role != assistant)
    again, slip = streamed & (F.pmod("turn", F.lit(3)) == 1), (F.col("n") == 1) & (F.pmod("turn", F.lit(5)) == 0)
    events = F.array(
        event(0, "delta", number, role, F.substring(text, F.lit(1), half), streamed),
        event(1, "delta", number, null, F.substring(text, half + 1, F.length("text")), streamed),
        event(2, "regenerate", number, role, null, again),
        event(3, "delta", null, null, F.concat(text, F.lit(" again")), again),
        event(0, "message", null, role, F.concat(F.lit("draft of "), text), edited),
        event(1, "delta", number + 1, assistant, F.lit("stale"), edited),
        event(2, "edit", number, null, text, edited),
        event(3, "delta", number + 1, assistant, F.lit("late"), edited),
        event(4, "message", null, role, F.lit("slip"), slip),
        event(5, "delete", number + 4, null, null, slip),
        event(6, "delta", number, role, text, F.col("n") > 1),
    )
    log = turns.select("conv_id", "turn", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
    return log.select("conv_id", (F.col("turn") * 10 + F.col("e.offset")).alias("seq"), "e.kind", "e.target", "e.role", "e.text")


def query(spark, sf_dir: str) -> DataFrame:
    return rebuild(from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


SQL = """
WITH log AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text) AS n
  FROM (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
), messages AS (
  SELECT conv_id, turn, coalesce(max(CASE WHEN n = 1 THEN role END), 'user') AS role,
    string_agg(CASE WHEN n = 1 AND role = 'assistant' AND (turn % 3 + 3) % 3 = 1 THEN text || ' again' ELSE text END, '' ORDER BY n) AS text
  FROM log GROUP BY conv_id, turn
)
SELECT conv_id, count(*) AS n_messages,
  string_agg('<|' || replace(role, '<|', '<' || chr(8203) || '|') || '|>' || chr(10) || replace(text, '<|', '<' || chr(8203) || '|') || '<|end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM messages GROUP BY conv_id
"""
