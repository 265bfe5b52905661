"""Chat formatting (operator 10): turns are assembled from separately encoded segments.

The text of each turn is escaped and encoded on its own, so nothing in it can become a control id;
the ids that open and close turns are reserved ones above the vocabulary and are spliced in afterwards.
The loss mask is the running sum of +1 where a trained span begins and -1 where it ends.

    <open role> escaped text <close>        rendered:  ### Role:\\n escaped text </turn>\\n

In content a backslash is doubled, and a backslash is put before each of the strings `### ` and
`</turn>`, so that a control string never occurs bare and dropping those backslashes restores the text.

Turns are sorted by ranges of conversation, turn, role and text, so that a conversation with very many
turns spans several tasks, and are encoded and assembled there as a stream, one turn at a time. Each task
counts from zero; what the tasks before hold of the conversation that it begins with is a sum over one
narrow row per task and conversation, and is added afterwards.

Defined cases: a null text counts as empty, a null role as the role "" (never trained); turns of one
conversation come by turn, then role, then text, nulls first, so ties and repeated rows have one order
and each is a turn; a null conversation id is a conversation of its own; an empty table gives an empty
result. Only the four columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from plotweave.llm.tokens import encoder
from plotweave.session import cut, ship

# The template.
OPEN, BREAK, CLOSE = "### ", ":\n", "</turn>\n"
_CONTROL = re.compile(r"\\|### |</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
ROLES = ("system", "user", "assistant", "tool")
TRAINED = "assistant"

_PLACED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("segment", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("loss_mask", T.ArrayType(T.ByteType())),
        T.StructField("role", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("leads", T.BooleanType()),
    ]
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def role_ids(size: int) -> dict[str, int]:
    """Reserved ids above a vocabulary of `size`: one that opens each known role, one that opens a
    role spelled out in ids, one that ends such a role, and the closing id."""
    return {**{r: size + k for k, r in enumerate(ROLES)}, "": size + len(ROLES), "named": size + len(ROLES) + 1, "close": size + len(ROLES) + 2}


def format_turns(conversations: DataFrame, tokenizer: str, partitions: int | None = None) -> DataFrame:
    """One row per turn, in token positions of its conversation: `(conv_id, segment, start, ids,
    loss_mask, role)`. The rows of a conversation by `segment` are its training sequence."""
    spark = conversations.sparkSession
    ship(spark)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")
    )
    # the last key parts repeated rows; which of them comes first makes no difference
    order = ["conv_id", "turn", "role", "text", "_row"]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(partitions, *order) if partitions else ranged.repartitionByRange(*order)
    placed = cut(ranged.sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(_assembler(tokenizer), _PLACED), "turns")
    return _carried(placed)


def _assembler(tokenizer: str):
    """Turns in order to segments, counted from the first turn that the task holds of a conversation."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, specials_as_text=True)
        reserved = role_ids(coder.size)
        part, current, segment, start, begun, leads = TaskContext.get().partitionId(), None, 0, 0, False, True
        for b in batches:
            out = []
            ids, border = coder.encode([escape(t or "") for t in b.column(2).to_pylist()])
            for k, (conv, role) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if not begun or conv != current:
                    leads = not begun
                    current, segment, start, begun = conv, 0, 0, True
                content = ids[border[k] : border[k + 1]].astype(np.int32)
                known = role or ""
                if known in ROLES or known == "":
                    head = [reserved[known]]
                else:
                    head = [reserved["named"], *coder.encode([escape(known)])[0].tolist(), reserved["named"]]
                whole = np.concatenate([np.array(head, np.int32), content, np.array([reserved["close"]], np.int32)])
                # +1 where the trained content begins, -1 at the closing id behind it
                step = np.zeros(len(whole), np.int8)
                if role == TRAINED:
                    step[len(head)] += 1
                    step[-1] -= 1
                mask = np.cumsum(step, dtype=np.int8)
                out.append((conv, segment, start, whole, mask, role, part, leads))
                segment, start = segment + 1, start + len(whole)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(zip(*out), _PLACED)], _PLACED.names)

    return assemble


def _carried(placed: DataFrame) -> DataFrame:
    """Adds what the tasks before hold of the conversation that a task begins with: a row per task at most."""
    spans = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("size"), F.max("leads").alias("leads"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        spans.select("part", "leads", F.sum("n").over(before).alias("_n"), F.sum("size").over(before).alias("_size"))
        .filter("leads and _n is not null").withColumn("_leads", F.lit(True)).drop("leads")
    )
    moved = placed.join(F.broadcast(carry), (placed["part"] == carry["part"]) & (placed["leads"] == carry["_leads"]), "left")
    add = lambda name, more: (F.col(name) + F.coalesce(F.col(more), F.lit(0))).cast("long").alias(name)
    return moved.select("conv_id", add("segment", "_n"), add("start", "_size"), "ids", "loss_mask", "role")


def said(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """The turns back from ids and masks, decoded where they lie: `(conv_id, segment, role, text, loss,
    loss_chars, formatted_chars)`; `loss` is the text under the mask."""
    ship(formatted.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, specials_as_text=True)
        reserved = role_ids(coder.size)
        names = {v: k for k, v in reserved.items()}
        for b in batches:
            lists, masks = b.column(2), b.column(3)
            contents, roles, trained = [], [], []
            for k in range(b.num_rows):
                ids = lists[k].values.to_numpy(zero_copy_only=False)
                mask = masks[k].values.to_numpy(zero_copy_only=False)
                if names[int(ids[0])] == "named":
                    stop = int(np.flatnonzero(ids[1:] == reserved["named"])[0]) + 1
                    role, body = unescape(coder.decode([ids[1:stop]])[0]), ids[stop + 1 : -1]
                else:
                    role, body = names[int(ids[0])], ids[1:-1]
                roles.append(role)
                contents.append(body)
                trained.append(ids[mask.astype(bool)])
            texts, losses = coder.decode(contents), [unescape(t) for t in coder.decode(trained)]
            sizes = [len(t) for t in losses]
            chars = [len(render(role, text)) for role, text in zip(roles, texts)]
            columns = [roles, [unescape(t) for t in texts], losses, sizes, chars]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds))], _SAID)

    schema = "conv_id long, segment long, role string, text string, loss string, loss_chars long, formatted_chars long"
    return formatted.select("conv_id", "segment", "ids", "loss_mask").mapInArrow(decode, schema)


_SAID = ["conv_id", "segment", "role", "text", "loss", "loss_chars", "formatted_chars"]


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation what its formatted ids and masks hold, read from them alone.

    A digest takes the turns of a conversation in order, so it runs over them as a stream in one task;
    all decoding is done before, where the segments lie.
    """
    rows = said(formatted, tokenizer).repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def batch(done):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*map(close, done)), kinds)], names)

        def close(s):
            return s["conv"], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"]

        for b in batches:
            done = []
            columns = [b.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6)]
            for conv, role, text, loss, lost, chars in zip(*columns):
                if state is None or conv != state["conv"]:
                    if state is not None:
                        done.append(state)
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["loss"].update(loss.encode())
                state["loss_chars"] += lost
                state["chars"] += chars
            if done:
                yield batch(done)
        if state is not None:
            yield batch([state])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(digest, schema)


def render(role: str, escaped: str) -> str:
    """A turn as text."""
    return f"{OPEN}{escape(role)}{BREAK}{escaped}{CLOSE}"


def op10_chat_format(spark, folder: str) -> DataFrame:
    """All conversations and one that quotes the template, formatted and read back."""
    import public_tokenizers

    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.sql(r"SELECT -7L AS conv_id, t AS turn, r AS role, r'\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read_back(format_turns(rows.unionByName(planted), tokenizer), tokenizer)
