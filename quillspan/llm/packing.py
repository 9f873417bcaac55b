"""Tokenised documents packed into sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import cut, short_batches
from quillspan.llm.vocab import encoded


def sum_of_squares(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given. A piece goes where the sum of the squares of N(g) over gaps 0 < g < room is smallest afterwards, N(g) being the number of open bins with gap g; of equal places to the smallest gap, and to a new bin only if none that is open is as good."""
    count = np.zeros(room + 1, np.int64)
    with_gap: list[list[int]] = [[] for _ in range(room + 1)]
    bins, offsets, filled = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    far = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        here = count[size:room]
        after = 2 * count[: room - size] + 1
        after[:1] = 0  # a bin that is full counts no longer
        change = np.where(here > 0, after - 2 * here + 1, far)
        best = int(change.argmin()) if len(change) else -1
        fresh = 2 * int(count[room - size]) + 1 if size < room else 0
        if best >= 0 and change[best] <= fresh:
            gap = size + best
            b = with_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, b = room, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        if gap > size:
            with_gap[gap - size].append(b)
            count[gap - size] += 1
    return bins, offsets


def packed(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """As sum_of_squares, with the long pieces first."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins[order], offsets[order] = sum_of_squares(lengths[order], room)
    return bins, offsets


def _pieces(batches: Iterator[pa.RecordBatch], file: str, room: int, end_id: int) -> Iterator[pa.RecordBatch]:
    tail = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = memoryview(encoded(text.as_py() or "", file) + tail)
            for piece, at in enumerate(range(0, len(ids), 4 * room)):
                part = ids[at : at + 4 * room]
                out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(documents: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", room: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of at most room tokens of each row: its text's ids and end_id."""
    short_batches(documents.sparkSession)
    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _pieces(it, tokenizer_file, room, end_id), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _dealt(pieces: DataFrame, per_group: int) -> DataFrame:
    """A stored table's rows in groups of some per_group, by their place in the table, so that no key meets in one group. Lost executors repeat the same dealing, as the table's files stay."""
    groups = max(1, -(-pieces.count() // per_group))
    return pieces.withColumn("_row", F.monotonically_increasing_id()).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))


def pack_pieces(pieces: DataFrame, *, room: int = 4096, per_group: int = 2048, most_gap: int = 32) -> DataFrame:
    """sequence_id and offset for each row of a stored table with a column length (from 1 to room).

    Each group of some per_group rows is packed by itself. Pieces of sequences that are left with a gap of more than
    most_gap are dealt and packed once more, with those of the other groups.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def pack(again: bool):
        def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("_row")
            bins, offsets = packed(rows["length"].to_numpy(), room)
            loose = (room - np.bincount(bins, rows["length"].to_numpy()))[bins] > most_gap
            return rows.assign(sequence_id=(int(key[0]) * 2 + again << 32) + bins, offset=offsets, _loose=loose).drop(columns=["_row", "_group"])

        return each

    once = cut(_dealt(pieces, per_group).groupBy("_group").applyInPandas(pack(False), f"{kinds}, sequence_id bigint, offset bigint, _loose boolean"), "packed")
    loose = cut(once.where("_loose").select(pieces.columns), "loose")
    twice = _dealt(loose, per_group).groupBy("_group").applyInPandas(pack(True), f"{kinds}, sequence_id bigint, offset bigint, _loose boolean")
    return once.where("not _loose").drop("_loose").unionByName(twice.drop("_loose"))


def pack_documents(documents: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", room: int = 4096, end_id: int = 1, per_group: int = 2048) -> DataFrame:
    """Packs the tokens of all rows into sequences of at most room tokens.

    One row for each piece: doc_id, piece (from 0), start (the document's tokens before it), length, ids_crc32 (of its ids
    as little-endian unsigned 32-bit numbers), sequence_id and offset there. A document is its ids with end_id after
    them; only one of more than room tokens is cut, into pieces of room tokens and a rest. Sequences have no gaps.

    A null text is an empty one, of end_id alone. Rows that repeat are packed as often. An empty table gives an empty
    table. Other columns are not read. Ids aren't stored, only pieces' lengths; these are dealt into groups of bounded
    size, for which some 50 bytes a piece are shuffled, and those of loosely filled sequences twice.
    """
    return pack_pieces(cut(token_pieces(documents, tokenizer_file, id_col=id_col, text_col=text_col, room=room, end_id=end_id), "pieces"), room=room, per_group=per_group)
