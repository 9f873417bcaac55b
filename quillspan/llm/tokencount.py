"""Token counts of whole texts; huge texts in overlapping chunks that are spliced where both encodings provably agree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import short_batches
from quillspan.llm.vocab import PLAIN, space_first_encoder, special_strings, tokenizer

#: Characters at a chunk's ends where its encoding may differ from the whole text's: more than any special string has, and what a split looks ahead.
MARGIN = 64


def word_starts(encoding, base: int, since: int, until: int) -> dict[int, int]:
    """Where words of the tokenizer's own split begin, from since to before until, and how many tokens come before each."""
    out, words = {}, encoding.word_ids
    for i, (begin, _) in enumerate(encoding.offsets):
        if i and since <= base + begin < until and words[i] is not None and words[i - 1] is not None and words[i] != words[i - 1]:
            out[base + begin] = i
    return out


def spliced_count(text: str, encode, chunk: int, overlap: int) -> int:
    """The number of tokens of a text, of which no more than a chunk and its overlap is encoded at once as long as they agree.

    The split into words reads from left to right and keeps no state: where a word begins, what follows depends only on
    the text from there. So if two chunks both begin a word at a place away from their ends, the first one's tokens up
    to there and the second one's from there are those of the whole text. If no place agrees, the overlap is doubled;
    if it would reach back to the chunk's start, the chunk is.
    """
    total, at, size = 0, 0, chunk
    now, base = encode(text[:size]), 0
    while base + size < len(text):
        end, wide, found = base + size, overlap, None
        while found is None and wide < size // 2:
            begin = end - wide
            mine = word_starts(now, base, max(at + 1, begin + MARGIN), end - MARGIN)
            if mine:
                then = encode(text[begin : begin + chunk])
                both = mine.keys() & word_starts(then, begin, begin + MARGIN, end - MARGIN).keys()
                if both:
                    found = max(both)
            wide *= 2
        if found is None:
            size *= 2
            now = encode(text[base : base + size])
            continue
        total += mine[found] - (_before(now, base, at) if at else 0)
        now, base, size, at = then, begin, chunk, found
    return total + len(now) - (_before(now, base, at) if at else 0)


def _before(encoding, base: int, at: int) -> int:
    return next(i for i, (begin, _) in enumerate(encoding.offsets) if base + begin >= at)


def count_tokens(text: str, file: str, chunk: int, overlap: int) -> int:
    library = tokenizer(file)
    if len(text) > chunk:
        return spliced_count(text, lambda t: library.encode(t, add_special_tokens=False), chunk, overlap)
    if not PLAIN(text):
        return len(library.encode(text, add_special_tokens=False))
    fast = space_first_encoder(file)
    if any(s in text for s in special_strings(file)):
        return len(fast.encode(text, allowed_special="all"))
    return len(fast.encode_ordinary(text))


def _counted(batches: Iterator[pa.RecordBatch], file: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_py() or "" for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([count_tokens(t, file, chunk, overlap) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(documents: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk: int = 1 << 14, overlap: int = 1 << 9) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row's whole text.

    tokenizer_file: a byte-level BPE of the tokenizers library whose ids follow its merges, at the same place on every
    executor. Counts are that library's, without added tokens; special strings in a text are its special tokens. Texts
    of up to chunk characters are encoded at once, plain Latin ones by a faster merger of the same vocabulary; longer
    ones in chunks that overlap.

    A null text is an empty one, with no tokens. Rows that repeat stay apart. An empty table gives an empty table. Other
    columns are not read. No shuffle; a task holds an Arrow batch and the encoding of one chunk.
    """
    short_batches(documents.sparkSession)
    return (
        documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
        .mapInArrow(lambda it: _counted(it, tokenizer_file, chunk, overlap), "doc_id bigint, n_bytes bigint, n_tokens bigint")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
