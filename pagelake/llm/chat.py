"""Chat formatting over reply trees.

Messages name their parent. Iterative self-joins double the reach of a jump table (node -> ancestor 2**k above), so the
members of every root-to-leaf path are listed in log2(depth) rounds. Branches are ranked by the summed score of their
messages; each chosen path becomes one conversation. A formatted conversation is `<|im_start|>role\\ntext<|im_end|>\\n` per
turn; control strings inside a role or text are broken by a backslash that the reader takes out again, so they can never
be taken for markers. The loss mask lists the code points of each assistant text. Output is a table in the shared folder,
in chunks of bounded size; the reader streams the chunks of a conversation in order and holds one turn.

Null text, role: empty. Equal turns are ordered by role, then text. A null conv_id is a conversation of its own.
Messages on a cycle, or below a parent that isn't there, have no root; a missing parent makes a message a root, a cycle
has no leaf and yields nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm._common import scratch, ship

START, END = "<|im_start|>", "<|im_end|>"
CHUNK = 1 << 20
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escaped(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(leaf, node, depth, branch): the members of every root-to-leaf path, depth from 0 at the root.

    messages: node (unique string), parent (or null), tree, score (finite; 12 decimals count). branch ranks the leaves of a tree by the sum of the
    scores on their path, best first, ties by leaf; `best` keeps so many branches of each tree.
    """
    # sums of decimals don't depend on their order, so ties stay ties whatever is retried
    score = F.coalesce(F.col("score").cast("decimal(38,12)"), F.lit(0).cast("decimal(38,12)"))
    m = messages.select("node", "parent", "tree", score.alias("score")).checkpoint()
    known = m.select(F.col("node").alias("parent"))
    jump = m.where("parent is not null").join(known, "parent", "left_semi").select("node", F.col("parent").alias("up")).checkpoint()
    parents = jump.select(F.col("up").alias("node")).distinct()
    roots = m.join(jump, "node", "left_anti").select("node")
    member = m.join(parents, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up_by"))
    step, rounds = 1, (m.count() + 1).bit_length() + 1
    for _ in range(rounds):
        if jump.isEmpty():
            break
        more = member.join(jump, "node").select("leaf", F.col("up").alias("node"), (F.col("up_by") + step).alias("up_by"))
        member = member.unionByName(more).checkpoint()
        twice = jump.select(F.col("node").alias("from"), F.col("up").alias("node"))
        jump = twice.join(jump, "node").select(F.col("from").alias("node"), "up").checkpoint()
        step *= 2
    # a leaf whose path reaches no root hangs on a cycle
    top = member.join(roots, "node", "left_semi").select("leaf", F.col("up_by").alias("height"))
    member = member.join(top, "leaf").select("leaf", "node", (F.col("height") - F.col("up_by")).alias("depth"))
    scored = member.join(m.select("node", "tree", "score"), "node")
    total = scored.groupBy("leaf").agg(F.first("tree").alias("tree"), F.sum("score").alias("total"))
    ranked = total.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("branch") <= best)
    return member.join(ranked.select("leaf", "branch"), "leaf")


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations as trees without branches: each turn replies to the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    key = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), n.cast("string"))
    n = F.row_number().over(w)
    df = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n", n)
    parent = F.when(F.col("n") > 1, key(F.col("n") - 1))
    return df.select(key(F.col("n")).alias("node"), parent.alias("parent"), "conv_id", key(F.lit(0)).alias("tree"), "role", "text", F.lit(1.0).alias("score"))


def formatted(turns: DataFrame, conv: str, order: str) -> DataFrame:
    """(conv, chunk, body, mask): conversations in chunks of whole turns; mask lists [start, end) of the assistant texts
    in code points of the chunk's body."""
    ship(turns.sparkSession)
    kind = turns.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, body, size, mask, begun = None, 0, [], 0, [], False

        def flush(of):
            return pa.RecordBatch.from_arrays(
                [pa.array([at], of), pa.array([n], pa.int64()), pa.array(["".join(body)]), pa.array([mask], pa.list_(pa.int64()))], [conv, "chunk", "body", "mask"]
            )

        of = None
        for b in batches:
            of = b.schema.field(0).type
            for c, role, text in zip(*(x.to_pylist() for x in b.columns)):
                if begun and (c != at or size > CHUNK):
                    yield flush(of)
                    n, body, size, mask = (n + 1 if c == at else 0), [], 0, []
                at, begun = c, True
                head, inner = f"{START}{escaped_role(role)}\n", escaped(text)
                if role == "assistant":
                    mask += [size + len(head), size + len(head) + len(inner)]
                turn = f"{head}{inner}{END}\n"
                body.append(turn)
                size += len(turn)
        if begun:
            yield flush(of)

    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = turns.repartition(parts, conv).sortWithinPartitions(conv, order)
    return placed.select(conv, "role", "text").mapInArrow(run, f"{conv} {kind}, chunk long, body string, mask array<long>")


def turns_of(body: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of each turn of a formatted body, unescaped."""
    at = 0
    while at < len(body):
        line = body.index("\n", at)
        end = body.index(END, line)
        yield unescaped_role(body[at + len(START) : line]), unescaped(body[line + 1 : end])
        at = end + len(END) + 1


def digests(chunks: DataFrame, conv: str) -> DataFrame:
    """Per conversation, from its chunks: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ship(chunks.sparkSession)
    kind = chunks.schema[conv].dataType.simpleString()
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            done = []
            for c, body, mask in zip(*(x.to_pylist() for x in b.columns)):
                if state is None or c != at:
                    if state is not None:
                        done.append((at, state))
                    at, state = c, [0, sha256(), 0, sha256(), 0]
                for role, text in turns_of(body):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for s, e in zip(mask[::2], mask[1::2]):
                    text = unescaped(body[s:e])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(body)
            yield rows(done, b.schema.field(0).type)
            of = b.schema.field(0).type
        if state is not None:
            yield rows([(at, state)], of)

    def rows(done, of):
        types = [of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        flat = [(c, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]) for c, s in done]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*flat)) or [[]] * 6, types)], names)

    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = chunks.repartition(parts, conv).sortWithinPartitions(conv, "chunk").select(conv, "body", "mask")
    return placed.mapInArrow(run, f"{conv} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Conversations formatted to the shared folder and read back."""
    spark = conversations.sparkSession
    messages = linear(conversations).checkpoint()
    chosen = paths(messages, best=1)
    turns = chosen.join(messages.select("node", "conv_id", "role", "text"), "node").select("conv_id", "depth", "role", "text")
    to, chunks = scratch(spark, "chat"), formatted(turns, "conv_id", "depth")
    chunks.write.parquet(to)
    return digests(spark.read.schema(chunks.schema).parquet(to), "conv_id")
