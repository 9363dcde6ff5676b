"""Vector bin packing of token pieces into sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import slices, text_of
from tessella.llm.tokens import SLICE, byte_encoder, ended

#: Pieces packed together; a task packs one such group after the other.
GROUP = 4096


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold. Gaps under ``least_cut`` tokens aren't filled by cutting a piece."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    least_cut: int = 8


def pack_group(n_tokens: np.ndarray, loss_before: list[np.ndarray], limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (piece, start in it, length).

    ``loss_before[i][j]`` counts the loss-bearing ones of piece i's first j tokens. Into the
    open sequence goes, of the pieces that fit, the one whose share of the three
    limits has the largest dot product with the shares still free (ties: the longer
    piece, then the earlier). If none fits, the longest piece is cut to fill the gap.
    """
    open_: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)  # (tokens, loss) to (piece, start)
    for i in reversed(range(len(n_tokens))):
        open_[int(n_tokens[i]), int(loss_before[i][-1])].append((i, 0))
    shapes = sorted(open_, reverse=True)
    sizes, alive = np.array(shapes, dtype=np.int64).reshape(-1, 2), np.ones(len(shapes), dtype=bool)
    left, out = len(n_tokens), []

    def add(shape: tuple[int, int], piece: tuple[int, int]) -> None:
        nonlocal sizes, alive, shapes
        if shape not in open_:
            shapes.append(shape)
            sizes, alive = np.vstack([sizes, shape]), np.append(alive, True)
        open_[shape].append(piece)
        alive[shapes.index(shape)] = True

    while left:
        free, seq = np.array([limits.tokens, limits.segments, limits.loss]), []
        while left and free[0] and free[1]:
            fits = alive & (sizes[:, 0] <= free[0]) & (sizes[:, 1] <= free[2])
            if fits.any():
                score = sizes[:, 0] * (free[0] / limits.tokens**2) + free[1] / limits.segments**2 + sizes[:, 1] * (free[2] / limits.loss**2)
                k = int(np.argmax(np.where(fits, score, -1.0)))
                piece, start = open_[shapes[k]].pop()
                length, loss = shapes[k]
                left -= 1
            else:
                k = int(np.argmax(np.where(alive, sizes[:, 0], -1)))
                piece, start = open_[shapes[k]][-1]
                ahead = loss_before[piece][start:] - loss_before[piece][start]
                length = int(min(free[0], np.searchsorted(ahead, free[2], side="right") - 1))
                if length < limits.least_cut:
                    break
                open_[shapes[k]].pop()
                loss = int(ahead[length])
                add((shapes[k][0] - length, shapes[k][1] - loss), (piece, start + length))
            alive[k] = bool(open_[shapes[k]])
            seq.append((piece, start, length))
            free -= (length, 1, loss)
        out.append(seq)
    return out


def split_ids(ids: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(n).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def pack_examples(examples: DataFrame, limits: Limits = Limits(), encode=None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_loss.

    ``examples`` has doc_id, ids (binary: little-endian unsigned 32-bit ids, or what
    ``encode()`` turns lists of into arrays of such) and loss (binary: a byte a token, not 0 if it bears loss;
    null: all but a piece's first). Parts of ``limits.tokens`` ids that fill a sequence
    by themselves do so; the rest is packed in groups of ``GROUP``
    within each task, so that no task holds more at once, however large its
    input. sequence_id: task number in the upper bits. An empty example has no piece.
    """
    most, segments_ok = limits.tokens, limits.tokens <= limits.loss
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"

    def run(batches):
        import pyarrow as pa

        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        waiting: list[tuple] = []  # doc_id, start, ids, loss flags, doc_tokens

        def lost(flags, length):
            return flags if flags is not None else np.arange(length) > 0

        def pack():
            nonlocal number
            sums = [np.concatenate([[0], np.cumsum(lost(w[3], len(w[2])))]) for w in waiting]
            for seq in pack_group(np.array([len(w[2]) for w in waiting]), sums, limits):
                offset = 0
                for i, at, length in seq:
                    doc, start, ids, _, total = waiting[i]
                    rows.append((doc, start + at, length, zlib.crc32(ids[at : at + length]), total, number, offset, int(sums[i][at + length] - sums[i][at])))
                    offset += length
                number += 1
            waiting.clear()

        def flush():
            found = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss"])
            rows.clear()
            return found

        make = encode() if encode else lambda blobs: [np.frombuffer(b, dtype="<u4") for b in blobs]
        for batch in batches:
            docs, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, some in slices((b.as_py() or b"" for b in batch.column(1)), SLICE):
                for d, ids in enumerate(make(some), first):
                    loss = np.frombuffer(flags[d], dtype=np.uint8) > 0 if flags[d] is not None else None
                    for start in range(0, len(ids), most):
                        part = ids[start : start + most]
                        some_loss = loss[start : start + most] if loss is not None else None
                        if len(part) == most and segments_ok:
                            rows.append((docs[d], start, most, zlib.crc32(part), len(ids), number, 0, int(lost(some_loss, most).sum())))
                            number += 1
                        else:
                            waiting.append((docs[d], start, part, some_loss, len(ids)))
                    if len(waiting) >= GROUP:
                        pack()
                if len(rows) > 10_000:
                    yield flush()
        if waiting:
            pack()
        if rows:
            yield flush()

    return examples.select(F.col("doc_id").cast("long"), "ids", "loss").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary_path: str, end_id: int = 1, limits: Limits = Limits()) -> DataFrame:
    """The pieces of whole ``docs`` (doc_id, text; null: empty), encoded by a byte-level vocabulary, ``end_id`` after each document."""

    def encoder():
        encode = byte_encoder(vocabulary_path)
        return lambda texts: split_ids(*ended(*encode(texts), end_id))

    return pack_examples(docs.select("doc_id", text_of().cast("binary").alias("ids"), F.lit(None).cast("binary").alias("loss")), limits, encoder).drop("n_loss")


def pack_conversations(turns: DataFrame, vocabulary_path: str, end_id: int = 1, role: str = "assistant", limits: Limits = Limits(loss=1536)) -> DataFrame:
    """Instruction data: each conversation (conv_id, turn, role, text) is one example, the turns of ``role`` bear loss.

    Turns are joined in order, each ended by ``end_id``; pieces as of ``pack_examples``, doc_id being conv_id.
    """
    turn = turns.select("conv_id", F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), text_of().alias("text"), F.coalesce(F.col("role") == role, F.lit(False)).alias("bears")).alias("t"))
    whole = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def run(batches):
        import pyarrow as pa

        encode = byte_encoder(vocabulary_path)
        for batch in batches:
            ids, loss = [], []
            for ts in batch.column(1).to_pylist():
                found, n = ended(*encode([t["text"].encode() for t in ts]), end_id)
                ids.append(found.tobytes())
                loss.append(np.repeat(np.array([t["bears"] for t in ts], dtype=np.uint8), n).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(loss, pa.binary())], ["doc_id", "ids", "loss"])

    return pack_examples(whole.mapInArrow(run, "doc_id long, ids binary, loss binary"), limits)
