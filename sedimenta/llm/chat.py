"""Chat formatting with loss masks from character offsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, Encoder, compile_lexicon, compile_vocabulary, load_ranks, pack, ship, unpack

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SCHEMA = "conv_id bigint, text string, input_ids array<int>, loss_mask array<int>, n_tokens int, n_target int"


def render(turns: list[tuple[str, str]], target_role: str) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation as one text, and the spans (UTF-8 bytes) to train on:
    content and end mark of each turn of the target role, in order."""
    parts, spans, at = [], [], 0
    for role, content in turns:
        head = f"{OPEN}{role}\n"
        parts += (head, content, CLOSE, "\n")
        start = at + len(head.encode())
        at = start + len(content.encode()) + len(CLOSE) + 1
        if role == target_role:
            spans.append((start, at - 1))
    return "".join(parts), spans


def mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """1 for the tokens that lie wholly in a span; tokens and spans are sorted and each
    apart from each other, so two binary searches per span find its first and last token."""
    lo = np.searchsorted(starts, spans[:, 0], side="left")
    hi = np.maximum(np.searchsorted(ends, spans[:, 1], side="right"), lo)
    step = np.bincount(lo, minlength=len(starts) + 1) - np.bincount(hi, minlength=len(starts) + 1)
    return np.cumsum(step)[:-1].astype(np.int32)


def format_chats(turns: DataFrame, vocabulary: str = VOCABULARY, target_role: str = "assistant") -> DataFrame:
    """One row for each conversation: ``conv_id, text, input_ids, loss_mask, n_tokens, n_target``.

    ``turns`` has ``conv_id, turn, role, text``. The turns of a conversation are put in
    the order of ``turn`` (ties by role, then text; NULL turns last), rendered once, and
    encoded once with offsets; a token is trained on (mask 1) if it lies wholly within
    the content and end mark of a turn of ``target_role``. A token that straddles a
    boundary isn't. Marks that occur inside a content are ordinary text, and the mask
    doesn't depend on them.

    NULL role counts as ``user``, NULL text as empty; a turn without ``conv_id`` belongs
    to no conversation and is left out. Rows that repeat are turns that repeat. Other
    columns are ignored; an empty table gives no rows.
    """
    role = F.lower(F.trim(F.coalesce("role", F.lit("user"))))
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    chats = chats.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    name = ship(turns.sparkSession, pack(compile_vocabulary(load_ranks(vocabulary)) | compile_lexicon([]) | {"ids": np.zeros(0, np.int32), "ids_first": np.zeros(1, np.int64)}))

    def encode(batches):
        tables = unpack(SparkFiles.get(name))
        encoder, sizes = Encoder(tables), np.diff(tables["token_first"])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                drawn = [render(list(zip(r, t)), target_role) for r, t in zip(part["roles"].to_pylist(), part["texts"].to_pylist())]
                texts = pa.array([t for t, _ in drawn], pa.string())
                ids, first, same = encoder.exact(texts)
                if not same.all():
                    raise ValueError("token ids that don't decode to their conversation")
                ends = np.append(0, np.cumsum(sizes[ids]))  # offsets of all tokens of all conversations, one after the other
                base = ends[first[:-1]]
                spans = np.array([(b + s, b + e) for b, (_, own) in zip(base.tolist(), drawn) for s, e in own], dtype=np.int64).reshape(-1, 2)
                marks = mask(ends[:-1], ends[1:], spans)
                target = np.diff(np.append(0, np.cumsum(marks))[first])
                offsets = pa.array(first)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (ids, marks)]
                yield pa.RecordBatch.from_arrays([part["conv_id"], texts, *lists, pa.array(np.diff(first)), pa.array(target.astype(np.int32))], names=["conv_id", "text", "input_ids", "loss_mask", "n_tokens", "n_target"])

    return chats.mapInArrow(encode, SCHEMA)


def op10_chat_format(spark, sf_dir) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
