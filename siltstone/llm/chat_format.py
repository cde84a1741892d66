"""Chat formatting by columnar byte assembly.

Turns are dealt by range of (conversation, turn), so even one conversation with most of the rows spreads over tasks. A batch's turns
are laid out in numpy: the lengths of all segments give cumulative offsets and, from these, scatter indices, by which headers and
contents are copied into one preallocated buffer. Arrow takes it as it is: the bounds of conversations in it are the offsets of the
column, which leaves as one batch. Only the rows of a batch's last conversation wait for the next batch.

The template is START role NEWLINE text END NEWLINE for each turn. Inside roles and texts a backslash is doubled and every control
string gets a backslash after its first character (a line feed in a role becomes backslash n), which `unescape` undoes exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import small_batches, table, text_parts

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that public chat templates use as control strings.
CONTROL = [START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
PART_BYTES = 4 << 20
LEARNED = "assistant"
#: Characters of a role and a text by which equal turns are dealt out; rows that agree in these stay in one task.
RANGE_CHARS = 256
ORDER = ["conv_id", "turn", "role", "text"]


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    out = pc.replace_substring(column, "\\", "\\\\")
    for c in CONTROL:
        out = pc.replace_substring(out, c, c[0] + "\\" + c[1:])
    return pc.replace_substring(out, "\n", "\\n") if role else out


def unescape(text: str) -> str:
    return re.sub(r"\\([\\n]?)", lambda m: {"\\": "\\", "n": "\n", "": ""}[m[1]], text) if "\\" in text else text


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns in one buffer, where each turn begins (and the last ends), and where each text begins and ends in it."""
    fixed = [np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", END + "\n")]
    role, role_at = text_parts(roles)
    text, text_at = text_parts(texts)
    n = len(roles)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2], lengths[:, 3], lengths[:, 4] = len(fixed[0]), np.diff(role_at), len(fixed[1]), np.diff(text_at), len(fixed[2])
    offsets = np.concatenate([[0], np.cumsum(lengths.ravel())])
    begins = offsets[:-1].reshape(n, 5)
    out = np.empty(offsets[-1], np.uint8)
    for k, part in zip((0, 2, 4), fixed, strict=True):
        out[(begins[:, k, None] + np.arange(len(part))).ravel()] = np.tile(part, n)
    for k, data, at in ((1, role, role_at), (3, text, text_at)):
        out[np.arange(len(data)) + np.repeat(begins[:, k] - at[:-1], np.diff(at))] = data
    return out, np.append(begins[:, 0], offsets[-1]), begins[:, 3:5]


def format_chats(turns: DataFrame, part_bytes: int = PART_BYTES, learned: str = LEARNED) -> DataFrame:
    """Formatted conversations with a loss mask.

    turns: (conv_id, turn, role, text), further columns aren't read. Returns (conv_id, part, n_turns, formatted, loss): the parts of a
    conversation in order of `part`, joined, are the conversation; nearly all have one. loss lists (start, stop) in UTF-8 bytes of
    formatted: the escaped texts of the role `learned`. Turns go by number, equal numbers by role and text; rows that repeat a turn
    stay. Null texts and roles are empty, a null turn comes first, rows with a null conv_id make up one conversation.
    """
    small_batches(turns.sparkSession)

    def parts(rows: pa.Table, last: bool, first: int) -> tuple[pa.RecordBatch | None, pa.Table]:
        """The finished parts of some turns, and the turns of the last one unless it is finished too."""
        roles = rows.column("role").combine_chunks().fill_null("")
        data, at, texts = assemble(escape(roles, True), escape(rows.column("text").combine_chunks().fill_null("")))
        conv = rows.column("conv_id").combine_chunks()
        known, number = conv.is_valid().to_numpy(zero_copy_only=False), conv.fill_null(0).to_numpy()
        new = np.append(True, (number[1:] != number[:-1]) | (known[1:] != known[:-1]))
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        share = (at[:-1] - at[begin]) // part_bytes  # of a long conversation
        new[1:] |= share[1:] != share[:-1]
        cuts = np.append(np.flatnonzero(new), len(new))
        if not last and at[cuts[-1]] - at[cuts[-2]] < part_bytes:
            cuts = cuts[:-1]
        n = len(cuts) - 1
        if not n:
            return None, rows
        mask = pc.equal(roles, learned).to_numpy(zero_copy_only=False)[: cuts[-1]]
        spans = texts[: cuts[-1]][mask] - np.repeat(at[cuts[:-1]], np.diff(cuts))[mask][:, None]
        spans = pa.StructArray.from_arrays([pa.array(spans[:, 0], pa.int64()), pa.array(spans[:, 1], pa.int64())], ["start", "stop"])
        counts = np.append(0, np.cumsum(mask))[cuts].astype(np.int32)
        text = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(at[cuts].astype(np.int32)), pa.py_buffer(data)])
        out = [conv.take(pa.array(cuts[:-1])), pa.array(first + np.arange(n), pa.int64()), pa.array(np.diff(cuts), pa.int64()), text, pa.ListArray.from_arrays(pa.array(counts), spans)]
        return pa.RecordBatch.from_arrays(out, ["conv_id", "part", "n_turns", "formatted", "loss"]), rows.slice(int(cuts[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if rows.num_rows:
                out, held = parts(rows, False, seq)
                if out is not None:
                    yield out
                    seq += len(out)
        if held is not None and held.num_rows:
            yield parts(held, True, seq)[0]

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # ranges by the order itself, so that parts follow it over partitions: the start of a role or text orders like the whole
    role, text = (F.substring(c, 1, RANGE_CHARS) for c in ("role", "text"))
    ties = F.when(F.length(F.coalesce("role", F.lit(""))) <= RANGE_CHARS, F.coalesce(text, F.lit("")))
    ranged = rows.repartitionByRange("conv_id", "turn", role, ties.asc_nulls_last()).sortWithinPartitions(*ORDER)
    return ranged.mapInArrow(run, "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:long,stop:long>>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted conversation or part."""
    found = []
    for turn in formatted.split(START)[1:]:
        role, text = turn[: turn.index(END)].split("\n", 1)
        found.append((unescape(role), unescape(text)))
    return found


def digested(chats: DataFrame) -> DataFrame:
    """What a reader of formatted chats finds, by conversation; parts stream through their task and only digests are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def out() -> pa.RecordBatch:
            conv, turns, whole, chars, loss, size = state
            columns = [[conv], [turns], [whole.hexdigest()], [chars], [loss.hexdigest()], [size]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for row in batch.to_pylist():
                if state is not None and state[0] != row["conv_id"]:
                    yield out()
                    state = None
                if state is None:
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(row["formatted"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                raw = row["formatted"].encode()
                for span in row["loss"]:
                    text = unescape(raw[span["start"] : span["stop"]].decode())
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(row["formatted"])
        if state is not None:
            yield out()

    ordered = chats.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "formatted", "loss")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digested(format_chats(turns))


def oracle() -> str:
    """What the output holds, from the input: turns and learned texts in order, and the length of the template with escaped texts."""
    escaped = "replace(coalesce(text, ''), '\\', '\\\\')"
    role = "replace(coalesce(role, ''), '\\', '\\\\')"
    for c in CONTROL:
        escaped, role = (f"replace({e}, '{c}', '{c[0]}\\{c[1:]}')" for e in (escaped, role))
    return f"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', '{LEARNED}']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(END) + 2} + length(replace({role}, chr(10), 'xx')) + length({escaped})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
