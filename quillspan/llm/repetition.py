"""Quality rules by suffix arrays over the words of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import over_texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Words whose suffixes are sorted together; one longer text is sorted alone.
CHUNK_WORDS = 150_000


def suffix_ranks(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words. words: ids, text after text; doc: each position's text; ends: where that text ends. A suffix never equals one of another text."""
    n = len(words)
    _, first, size = np.unique(doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[first]
    levels, open_, k = [rank], np.flatnonzero(size[first] > 1), 1
    while len(open_):
        after = open_ + k
        second = np.where(after < ends[open_], rank[np.minimum(after, n - 1)], -1)
        order = np.lexsort((second, rank[open_]))
        open_, second = open_[order], second[order]
        old = rank[open_]
        new_group = np.r_[True, old[1:] != old[:-1]]
        new_part = new_group | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(len(open_))
        head = np.maximum.accumulate(np.where(new_part, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        rank = rank.copy()
        rank[open_] = old + head
        levels.append(rank)
        alone = new_part & np.r_[new_part[1:], True]
        open_, k = np.sort(open_[~alone]), 2 * k
    return levels


def longest_repeats(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the words of the longest substring that begins there and occurs again in its text.

    That is the depth of the deepest interval of common prefixes with its suffix: the larger one of the common prefixes
    with both neighbours in the suffix array. An interval's maximal repeated substring begins at each of its suffixes, so
    these spans are unions of maximal repeats; one that begins later in a repeat lies within the repeat's own span.
    """
    n = len(words)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    levels = suffix_ranks(words, doc, ends)
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    near = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
    a, b = order[near], order[near + 1]
    left, right = a.copy(), b.copy()
    common = np.zeros(len(near), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        inside = (left < ends[a]) & (right < ends[b])
        same = inside & (levels[j][np.minimum(left, n - 1)] == levels[j][np.minimum(right, n - 1)])
        step = same.astype(np.int64) << j
        common, left, right = common + step, left + step, right + step
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def later_copies(words: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Those of the rising positions at whose n words, all of one text, stand at an earlier one of them in that text."""
    most = int(words.max(initial=0)) + 1
    _, same = np.unique(doc[at].astype(np.int64), return_inverse=True)
    for d in range(n):
        _, first, same = np.unique(same * most + words[at + d], return_index=True, return_inverse=True)
    later = np.ones(len(at), bool)
    later[first] = False
    return at[later]


def maximal_spans(text: str, min_words: int) -> list[tuple[int, int]]:
    """The union of the repeated substrings of min_words words or more, as word spans [start, end)."""
    ids: dict[bytes, int] = {}
    words = np.array([ids.setdefault(w, len(ids)) for w in text.encode().split()], np.int64)
    n = len(words)
    longest = longest_repeats(words, np.zeros(n, np.int64), np.full(n, n))
    at = np.flatnonzero(longest >= min_words)
    edge = np.diff(np.r_[0, covered(at, longest[at], n).astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _line_copies(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def _measured(texts: list[str | None], min_words: int) -> dict[str, np.ndarray]:
    """The figures of some texts."""
    texts = [t or "" for t in texts]
    n_words, parts = [], []
    ids: dict[bytes, int] = {}
    for t in texts:
        words = t.encode().split()
        n_words.append(len(words))
        parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
    n_words = np.array(n_words, np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    ends = np.cumsum(n_words)[doc]
    words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    longest = longest_repeats(words, doc, ends)
    third, found = np.flatnonzero(longest >= 3), np.flatnonzero(longest >= min_words)
    in_windows = covered(third, np.full(len(third), 3), len(words))
    in_spans = covered(found, longest[found], len(words))
    later = later_copies(words, doc, found, min_words)
    in_copies = covered(later, np.full(len(later), min_words), len(words))
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, doc, longest)
    return {
        "n_words": n_words,
        "word_chars": np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([_line_copies(t) for t in texts], np.int64),
        "n_repeat_words": np.bincount(doc[in_windows], minlength=len(texts)).astype(np.int64),
        "n_span_words": np.bincount(doc[in_spans], minlength=len(texts)).astype(np.int64),
        "n_copied_words": np.bincount(doc[in_copies], minlength=len(texts)).astype(np.int64),
        "longest_repeat": top,
    }


def _in_chunks(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        begin, room = 0, CHUNK_WORDS * 6
        for i, t in enumerate(texts):
            room -= len(t or "")
            if room <= 0 or i + 1 == len(texts):
                got = _measured(texts[begin : i + 1], min_words)
                yield pa.RecordBatch.from_arrays([ids.slice(begin, i + 1 - begin), *map(pa.array, got.values())], ["doc_id", *got])
                begin, room = i + 1, CHUNK_WORDS * 6


def repetition_rules(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 8,
    max_fraction: float = 0.45,
    max_longest: int = 100,
    max_copied: float = 0.12,
    least_words: int = 50,
    carry: bool = False,
) -> DataFrame:
    """Rules on the quality of whole texts, with repeated substrings from a suffix array of each text's words.

    A word is a run of characters other than ASCII white space. One row for each row, with its id (with carry, document, a
    struct of all its columns, in its place), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, n_span_words (words in the union of repeated substrings of min_words words
    or more), n_copied_words (words in the union of runs of min_words words that stand earlier in the text too, so without
    first copies), longest_repeat (words), base_failed and kept. kept is false if base_failed, if the repeated substrings
    cover more than max_fraction of the words or the later copies more than max_copied, or if the longest repeat has more
    than max_longest words. 0.12 is the limit for duplicate 8-grams of Rae et al. (2021, Gopher, table A1), who count
    characters.

    A null or empty text has zero everywhere and fails. Rows with the same id or text are judged alike, each for itself.
    An empty table gives an empty table. Other columns are not read. No shuffle; a task holds one Arrow batch and the
    suffixes of some 150,000 words, or of one longer text.
    """
    fields = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_span_words bigint, n_copied_words bigint, longest_repeat bigint"
    found = over_texts(documents, lambda it: _in_chunks(it, min_words), fields, id_col=id_col, text_col=text_col, carry=carry)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("n_span_words") <= max_fraction * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    fine = fine & (F.col("n_copied_words") <= max_copied * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
