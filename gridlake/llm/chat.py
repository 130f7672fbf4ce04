"""Reply trees as conversations.

Messages form trees by their parent.  Self-joins that double the distance each round give every message its depth
and the score of the path from its root; a tree's leaves are ranked by that score, the chosen leaves'
paths are walked back with the same doubled steps, and each path is formatted as one conversation.  A tree of
depth n takes log2(n) rounds, whatever the number of trees.

The template writes ``### role: text</turn>`` and a line feed per turn.  Control strings inside roles and texts (``###``,
``</turn>``, the backslash) get a backslash before them, which is undone on reading.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import materialize

OPEN, CLOSE, LEARNED = "###", "</turn>", "assistant"
CONTROL = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
MARK = re.compile(r"\\(?:\\|###|</turn>|:)|</turn>")
ROLE_END = re.compile(r"(?:\\.|[^\\:])*", re.DOTALL)
TEXT_CONTROL = re.compile(r"\\|###|</turn>")


def escape(text: str, control: re.Pattern = TEXT_CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of it (code points) that the loss covers: the assistant's texts.  Nulls are empty."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head = f"{OPEN} {escape(role or '', CONTROL)}: "
        body = escape(text or "")
        if role == LEARNED:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        role = ROLE_END.match(formatted, at + len(OPEN) + 1)
        start = role.end() + 2
        end = next(m.start() for m in MARK.finditer(formatted, start) if m[0] == CLOSE)
        turns.append((unescape(role[0]), unescape(formatted[start:end])))
        at = end + len(CLOSE) + 1
    return turns


def reply_paths(messages: DataFrame, *, branches: int = 1) -> DataFrame:
    """(tree, branch, place, role, text) of the best ``branches`` root-to-leaf paths of each tree.

    ``messages`` has tree, node, parent, role, text, score; nodes are unique in a tree.  A path's score is the sum over its
    messages (null counts 0); ties go to the smaller leaf.  A message whose parent isn't there is a root, and roots of one tree share its branches.
    A message that is its own ancestor has no root and is left out.
    """
    nodes = materialize(messages.select("tree", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    there = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    known = (F.col("tree").eqNullSafe(F.col("t"))) & (F.col("parent") == F.col("p"))
    # (node, ancestor 2^k steps up or null, steps taken, score on the way); a message that has reached its root is done and joins no more
    state = nodes.join(there, known, "left").select("tree", "node", F.col("p").alias("up"), F.lit(1).cast("long").alias("steps"), "score")
    jumps, done, limit = [], [], nodes.count()
    while True:
        state = materialize(state, "jump")
        done.append(state.where("up is null"))
        jumps.append(state.where("up is not null"))
        if jumps[-1].isEmpty() or (1 << len(jumps)) > 2 * limit:
            break
        far = reduce(DataFrame.unionByName, [*done, jumps[-1]]).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("score").alias("score2"))
        on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))
        state = jumps[-1].join(far, on).select("tree", "node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("score") + F.col("score2")).alias("score"))
    whole = reduce(DataFrame.unionByName, done)
    parents = jumps[0].select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = whole.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    walk = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches).select("tree", "branch", "node")
    for jump in reversed(jumps):
        step = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        above = walk.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "branch", F.col("up").alias("node"))
        walk = materialize(walk.unionByName(above), "walk")
    where = whole.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("steps").alias("place"))
    texts = nodes.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "role", "text")
    placed = walk.join(where, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    return placed.join(texts, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2"))).select("tree", "branch", "place", "role", "text")


def conversations(paths: DataFrame) -> DataFrame:
    """One row per path: tree, branch, ``formatted`` and ``loss`` (spans the loss covers).  One conversation's turns meet in one row, as its format asks.

    Null roles and texts are empty; a null tree is one tree.  Very long texts are formatted whole.  An empty table gives an empty result; further columns are ignored.
    """
    turns = F.sort_array(F.collect_list(F.struct("place", "role", "text")))
    grouped = paths.groupBy("tree", "branch").agg(turns.alias("turns"))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    tree_type = paths.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d[0] for d in done], pa.string()), pa.array([[{"first": a, "last": b} for a, b in d[1]] for d in done], kind)], names=["tree", "branch", "formatted", "loss"])

    return grouped.mapInArrow(run, f"tree {tree_type}, branch int, formatted string, loss array<struct<first int, last int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, branch, n_turns, turns, loss_text, formatted_chars) read from the formatted conversations.

    ``turns`` is role, line feed, text, line feed for each turn; ``loss_text`` all text the loss covers, in order, with nothing between.  Repeated rows give
    repeated results, an empty table an empty one.
    """
    tree_type = formatted.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                turns = read_turns(text)
                rows.append((len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), "".join(unescape(text[s["first"] : s["last"]]) for s in loss), len(text)))
            cols = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["tree", "branch", "n_turns", "turns", "loss_text", "formatted_chars"])

    return formatted.select("tree", "branch", "formatted", "loss").mapInArrow(run, f"tree {tree_type}, branch int, n_turns long, turns string, loss_text string, formatted_chars long")


def from_turns(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of linear conversations: each turn replies to the one before it.  Turns that tie go by role, then text; repeated rows are turns of their own.

    Null turns come first, a null id is one conversation, null roles and texts stay null.  An empty table gives an empty result; further columns are ignored.
    """
    c = rows.select(F.col(f"`{id_col}`").alias("tree"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return c.withColumn("node", F.row_number().over(order).cast("long")).select("tree", "node", F.expr("if(node > 1, node - 1, null)").alias("parent"), "role", "text", F.lit(0.0).alias("score"))
