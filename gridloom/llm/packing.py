"""Vector best-fit packing of token pieces into fixed-length sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum
of squared piece lengths).  Pieces are placed longest first; among the open
sequences that keep every capacity, the one with the least weighted residual
norm, or the greatest weighted dot product of need and residual, takes the piece.

Pieces are dealt to groups of bounded size, whatever their document, and each
group is packed by one task, so no task grows with the input.  The emptiest
sequences of each group are opened again and packed with those of the other
groups, in as many passes as their number asks for, so that groups cost next to
no sequences.

Defined cases: a null text is empty and holds the end id alone; a very long text
is cut into pieces of a sequence's length, the last one shorter; of equally long
pieces the earlier is placed first, and of equally good sequences the oldest
takes it; repeated rows are packed one by one; rows without an id keep the null;
an empty table gives an empty result.  Only the id and text columns are read, so
other columns can't clash.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrow import map_rows, text_or_empty
from gridloom.llm.bpe import library_rows
from gridloom.plans.durable import materialize

#: A group has at most about so many tokens, in sequences' lengths, and so many pieces.
GROUP_SEQUENCES, GROUP_PIECES = 4096, 200_000
#: Sequences of a group that the next pass opens again.
LOOSE = 16
#: Passes after the first; each opens again at most LOOSE of a group's sequences, so they end long before on groups of full size.
PASSES = 8
#: Weights of tokens, documents and cost in a sequence's score.
WEIGHTS = (1.0, 0.01, 0.01)


def best_fit(lengths: np.ndarray, max_tokens: int = 4096, max_documents: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece.  Unset capacities are those that tokens imply."""
    n = len(lengths)
    capacity = np.array([max_tokens, max_documents or max_tokens, max_cost or max_tokens**2], np.int64)
    if n and (int(lengths.max()) > capacity[0] or int(lengths.max()) ** 2 > capacity[2] or int(lengths.min()) < 1):
        raise ValueError("a piece needs from one token to what an empty sequence holds")
    scale = np.sqrt(np.array(weights)) / capacity
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    # Open sequences, oldest first: residual capacities as columns, and their numbers.
    residual, number, size = np.empty((3, 1024), np.int64), np.empty(1024, np.int64), 0
    made, i = 0, 0
    needs = [np.array([x, 1, x * x], np.int64) for x in range(max_tokens + 1)] if n > max_tokens else None
    for i in order:
        length = int(lengths[i])
        need = needs[length] if needs else np.array([length, 1, length * length], np.int64)
        best = -1
        if size:
            view = residual[:, :size]
            fits = np.flatnonzero((view[0] >= need[0]) & (view[1] >= 1) & (view[2] >= need[2]))
            if len(fits):
                left = view[:, fits]
                if score == "norm":
                    rest = (left - need[:, None]) * scale[:, None]
                    best = int(fits[np.argmin((rest * rest).sum(axis=0))])
                else:
                    best = int(fits[np.argmax(((left * scale[:, None]) * (need * scale)[:, None]).sum(axis=0))])
        if best < 0:
            if size == residual.shape[1]:
                residual, number = np.concatenate([residual, np.empty_like(residual)], axis=1), np.concatenate([number, np.empty_like(number)])
            best, size = size, size + 1
            residual[:, best], number[best] = capacity, made
            made += 1
        bin_of[i], offset[i] = number[best], capacity[0] - residual[0, best]
        residual[:, best] -= need
        if residual[:, best].min() == 0:  # full: closed
            residual[:, best : size - 1], number[best : size - 1] = residual[:, best + 1 : size].copy(), number[best + 1 : size].copy()
            size -= 1
    return bin_of, offset


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32``: documents' ids with the end id, cut only where longer than a sequence.

    With ``with_ids`` also ``row``, a number of the piece's own, and ``ids``, its ids
    as little-endian unsigned 32-bit integers.
    """
    id_type, made = df.schema[id_col].dataType.simpleString(), [0]

    def fn(key, ids):
        from pyspark import TaskContext

        ids += struct.pack("<I", end_id)
        for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
            part = ids[at : at + 4 * max_tokens]
            more = ((TaskContext.get().partitionId() << 36) + made[0], part) if with_ids else ()
            made[0] += 1
            yield key, k, at // 4, len(part) // 4, zlib.crc32(part), *more

    return map_rows(df.select(F.col(id_col), text_or_empty(text_col)), fn, f"`{id_col}` {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", row bigint, ids binary" * with_ids, library_rows(vocabulary))


def pack(
    cut: DataFrame,
    max_tokens: int = 4096,
    max_documents: int | None = None,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    score: str = "norm",
    group_sequences: int = GROUP_SEQUENCES,
    group_pieces: int = GROUP_PIECES,
    _pass: int = 0,
) -> DataFrame:
    """``cut`` (a table in storage, with ``length``) with ``sequence_id`` and ``offset``.

    Groups are dealt by the row's place in the stored table, which is even
    whatever the keys and the same if a task runs again.
    """
    n, tokens = cut.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, -(-tokens // (group_sequences * max_tokens)), -(-n // group_pieces))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    again = groups > 1 and _pass < PASSES

    def run(pdf):
        if len(pdf):
            lengths = pdf["length"].to_numpy()
            bins, offsets = best_fit(lengths, max_tokens, max_documents, max_cost, weights, score)
            pdf["sequence_id"], pdf["offset"] = (_pass << 56) + (pdf["_group"].to_numpy(np.int64) << 24) + bins, offsets
            used = np.bincount(bins, lengths)
            emptiest = np.argsort(used, kind="stable")[: LOOSE if again else 0]
            pdf["_loose"] = np.isin(bins, emptiest[used[emptiest] < max_tokens])
        return pdf.drop(columns="_group")

    columns = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes)
    packed = dealt.groupBy("_group").applyInPandas(run, f"{columns}, sequence_id bigint, offset bigint, _loose boolean")
    if not again:
        return packed.drop("_loose")
    packed = materialize(packed, "packed")
    left = materialize(packed.filter("_loose").select(*cut.columns), "loose")
    rest = pack(left, max_tokens, max_documents, max_cost, weights, score, group_sequences, group_pieces, _pass + 1)
    return packed.filter("not _loose").drop("_loose").union(rest)


def pack_documents(
    df: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 4096,
    max_documents: int | None = None,
    max_cost: int | None = None,
    end_id: int = 1,
    weights: tuple[float, float, float] = WEIGHTS,
    with_ids: bool = False,
    piece_tokens: int | None = None,
) -> DataFrame:
    """Encode, cut and pack: the id, piece, start, length, ids_crc32, sequence_id, offset; with ``with_ids`` the ids too.

    Ids stay in storage while lengths are packed, and meet their places by the
    piece's number.  Documents are cut at ``piece_tokens`` (a sequence's length).
    """
    cut = materialize(pieces(df, vocabulary, id_col, text_col, piece_tokens or max_tokens, end_id, with_ids), "pieces")
    if not with_ids:
        return pack(cut, max_tokens, max_documents, max_cost, weights)
    placed = pack(cut.drop("ids"), max_tokens, max_documents, max_cost, weights)
    return placed.join(cut.select("row", "ids"), "row").drop("row")
