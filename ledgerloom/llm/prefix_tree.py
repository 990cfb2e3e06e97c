"""Chat formatting as prefix trees of conversations.

A conversation is a path of turns; conversations with the same first turns share the nodes of these. Conversations are
range-sorted by their paths (a 128-bit hash of all turns so far for each turn), which puts them in depth-first order, so a
node belongs to the first conversation that has it and its tokens are emitted once, in one stream over all trees. A node
carries the position id of its first token (tokens ahead of it on its path) and the intervals of the stream that hold
its ancestors, which with its own earlier tokens are all it may attend to. Intervals that touch are one, so a conversation
without branches has one.

A turn is written as `<|role|>`, a line feed, the text, `<|end|>`, a line feed; header, text and end are encoded apart, and the
loss mask covers the tokens of an assistant's text. Control strings of this and other common templates inside a text get a
backslash after their first character; one that already has backslashes there gets one more, so that the way back is
unique.

A first turn that a third of all conversations share is one node: turns meet their node in a join of many rows to one, never
in a group. Each conversation is read in order by one task, turn by turn, without holding it.

Null roles and texts are empty. Rows are ordered by turn, null first, then by role and text; repeated rows are turns of their
own. Rows without a conversation id form one conversation. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.bpe import decoder, encoder, ids_of
from ledgerloom.llm.frames import arrow_schema, numbered, stage

# What common templates use to mark turns: fixed strings.
_TAIL = r"(?=\||/?s>|/?INST\])"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _TAIL)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _TAIL)
END = "<|end|>\n"
HEADER = re.compile(r"<\|((?:[^|\\]|\\.)*)\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def header(role: str) -> str:
    return "<|" + role.replace("\\", "\\\\").replace("|", "\\p").replace("\n", "\\n") + "|>\n"


def role_of(head: str) -> str:
    inner = HEADER.fullmatch(head).group(1)
    return re.sub(r"\\(.)", lambda m: {"p": "|", "n": "\n"}.get(m[1], m[1]), inner)


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, root, role, text, path): a row for each turn; the last of a conversation has its path."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(
        "depth int, node binary, parent binary, root binary, role string, text string, path binary").fields])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        held = None
        for b in batches:
            out = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                same = held is not None and held[0] == conv
                if held is not None:
                    out.append((*held, None if same else b"".join(state["path"])))
                if not same:
                    state = {"path": [], "last": b""}
                r, t = role.encode(), text.encode()
                node = xxhash.xxh3_128_digest(state["last"] + len(r).to_bytes(8, "little") + r + t)
                state["path"].append(node)
                held = (conv, len(state["path"]) - 1, node, state["last"], state["path"][0], role, text)
                state["last"] = node
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*held, b"".join(state["path"])), target)], schema=target)

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def encoded(nodes: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """`nodes` with role and text written out as token ids (unsigned 32-bit little-endian), and the tokens under the loss."""
    kept = [c for c in nodes.columns if c not in ("role", "text")]
    schema = T.StructType([*(nodes.schema[c] for c in kept), *T.StructType.fromDDL(
        "ids binary, n_tokens long, body_from int, body_to int, loss_from int, loss_to int").fields])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern)
        end = ids_of(END, encode)
        for b in batches:
            out = []
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist()):
                head, body = ids_of(header(role), encode), ids_of(escape(text), encode)
                at = (len(head), len(head) + len(body))
                out.append((np.concatenate([head, body, end]).astype("<u4").tobytes(), at[1] + len(end), *at, *(at if role == "assistant" else (0, 0))))
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(target.field(c).type) for c in kept),
                                              *(pa.array(c, f.type) for c, f in zip(zip(*out), list(target)[len(kept):]))], schema=target)

    return nodes.mapInArrow(run, schema)


def attended(rows: DataFrame) -> DataFrame:
    """(node, position, ancestors) of new nodes; `rows` has every turn's node with its place in the stream."""
    rows = rows.repartition("ordinal").sortWithinPartitions("ordinal", "depth")
    schema = T.StructType.fromDDL("node binary, position long, ancestors array<struct<start: long, stop: long>>")
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, ahead = None, 0, []
        for b in batches:
            out = []
            for ordinal, node, first, start, n in zip(*(b.column(c).to_pylist() for c in ("ordinal", "node", "first", "offset", "n_tokens"))):
                if ordinal != conv:
                    conv, position, ahead = ordinal, 0, []
                if first == ordinal:
                    out.append((node, position, [{"start": a, "stop": z} for a, z in ahead]))
                position += n
                if ahead and ahead[-1][1] == start:
                    ahead[-1] = (ahead[-1][0], start + n)
                else:
                    ahead.append((start, start + n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    return rows.mapInArrow(run, schema)


def build(turns: DataFrame, vocabulary: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The forest and who is in it.

    nodes: node, parent, root, depth, ids, n_tokens, body_from, body_to, loss_from, loss_to (tokens of the node), offset (of
    its first token in the stream), position (of its first token on its path), ancestors (intervals of the stream).
    members: conv_id, depth, node for every turn of every conversation.
    """
    every = stage(paths(turns), "paths")
    ordered = numbered(every.filter(F.col("path").isNotNull()).select(F.col("conv_id").alias("_conv"), "path"),
                       [F.col("path"), F.asc_nulls_first("_conv")], "conversations").drop("path")
    members = stage(every.select("conv_id", "depth", "node").join(ordered, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv"), "members")
    first = members.groupBy("node").agg(F.min("ordinal").alias("first"))
    new = (members.join(first.withColumnRenamed("node", "_n"), (F.col("node") == F.col("_n")) & (F.col("ordinal") == F.col("first")))
           .select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), "first"))
    fresh = every.join(new, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("depth") == F.col("_depth"))).select(
        "node", "parent", "root", "depth", "first", "role", "text")
    nodes = stage(numbered(encoded(fresh, vocabulary, pattern), [F.col("first"), F.col("depth")], "stream", weight="n_tokens")
                  .withColumnRenamed("before", "offset").drop("ordinal"), "nodes")
    seen = attended(members.select("ordinal", "depth", "node").join(nodes.select("node", "first", "offset", "n_tokens"), "node"))
    return nodes.drop("first").join(seen, "node"), members.select("conv_id", "depth", "node")


def read_back(nodes: DataFrame, members: DataFrame, vocabulary: str) -> DataFrame:
    """Every conversation's digests, from token ids only: turns, text under the loss mask, length as written."""
    fed = members.join(nodes.select("node", "ids", "body_from", "body_to", "loss_from", "loss_to", "position",
                                    F.expr("aggregate(ancestors, 0L, (a, x) -> a + x.stop - x.start)").alias("seen")), "node")
    fed = fed.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    schema = T.StructType([members.schema["conv_id"], *T.StructType.fromDDL(
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, attends boolean").fields])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(vocabulary)
        conv, s = None, None

        def row() -> tuple:
            return (conv, s["n"], s["turns"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"], s["tokens"], s["ok"])

        for b in batches:
            out = []
            for r in b.to_pylist():
                if s is None or r["conv_id"] != conv:
                    if s is not None:
                        out.append(row())
                    conv, s = r["conv_id"], {"n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0, "tokens": 0, "ok": True}
                ids = np.frombuffer(r["ids"], "<u4")
                head, body, end = (decode(x) for x in np.split(ids, [r["body_from"], r["body_to"]]))
                s["ok"] &= end == END and r["position"] == s["tokens"] == r["seen"]
                text = unescape(body)
                s["turns"].update(f"{role_of(head)}\n{text}\n".encode())
                if r["loss_to"] > r["loss_from"]:
                    under = unescape(decode(ids[r["loss_from"]:r["loss_to"]]))
                    s["loss_n"] += len(under)
                    s["loss"].update(under.encode())
                s["n"] += 1
                s["chars"] += len(head) + len(body) + len(end)
                s["tokens"] += len(ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row(), target)], schema=target)

    return fed.mapInArrow(run, schema)
