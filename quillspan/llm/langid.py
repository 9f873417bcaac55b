"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import cut, short_batches

#: Trigrams whose vectors are held at once, and characters whose counts are.
SLAB, CHUNK_CHARS = 8192, 200_000
UNKNOWN = "und"


@functools.cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@functools.lru_cache(1 << 14)
def letter_vector(code: int, size: int, seed: int) -> np.ndarray:
    """The random signs of a letter; of the gap between words for code 0."""
    return (np.random.Generator(np.random.Philox(key=[seed, code])).integers(0, 2, size, np.int8) * 2 - 1).astype(np.int8)


def trigrams(text: str) -> np.ndarray:
    """Keys of the trigrams around each letter of a lower-cased text, where all that lies between words counts as one gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(_is_letter()[codes], codes, 0)
    codes = np.r_[0, codes[(codes > 0) | np.r_[False, codes[:-1] > 0]], 0] if len(codes) else np.zeros(2, np.int64)
    return ((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[codes[1:-1] > 0]


def trigram_vectors(keys: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Each trigram's vector: the product of its letters' vectors, the first rolled by two and the second by one."""
    out = np.ones((len(keys), size), np.int8)
    for shift, roll in ((42, 2), (21, 1), (0, 0)):
        codes, at = np.unique((keys >> shift) & 0x1FFFFF, return_inverse=True)
        out *= np.array([np.roll(letter_vector(int(c), size, seed), roll) for c in codes], np.int8).reshape(-1, size)[at]
    return out


def bundles(texts: list[str], size: int, seed: int) -> np.ndarray:
    """The sum of its trigrams' vectors for each text, at length one; zeros without letters."""
    found = [trigrams(t) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    keys, at = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_inverse=True)
    out = np.zeros((len(texts), size), np.float32)
    order = np.argsort(at, kind="stable") if len(keys) > SLAB else slice(None)
    at, row = at[order], row[order]
    for begin in range(0, len(keys), SLAB):
        part = keys[begin : begin + SLAB]
        a, b = (np.searchsorted(at, [begin, begin + SLAB])) if len(keys) > SLAB else (0, len(at))
        counts = np.bincount(row[a:b] * len(part) + (at[a:b] - begin), minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        out += counts.astype(np.float32) @ trigram_vectors(part, size, seed).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, room = 0, CHUNK_CHARS
    for i, t in enumerate(texts):
        room -= len(t)
        if room <= 0 or i + 1 == len(texts) or i + 1 - begin == 64:
            yield begin, i + 1
            begin, room = i + 1, CHUNK_CHARS


def _summed(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in _chunks(texts):
            # whole numbers, so that sums agree in any order
            for lang, v in zip(langs[a:b], np.rint(bundles(texts[a:b], size, seed) * 1e6).astype(np.int64), strict=True):
                total[lang] = total.get(lang, 0) + v
    if total:
        langs = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(langs, size), pa.string()), pa.array(np.tile(np.arange(size, dtype=np.int32), len(langs))), pa.array(np.concatenate([total[x] for x in langs]))], ["lang", "at", "part"])


def learn_profiles(documents: DataFrame, learn: Column, *, id_col: str, text_col: str, lang_col: str, size: int, seed: int, per_lang: int) -> tuple[list[str], np.ndarray]:
    """The languages and a profile of each: the sum of the bundles of some per_lang rows (all, if there are fewer) drawn by a hash of text and id, less the mean of all profiles (the last row)."""
    rows = documents.where(learn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("lang is not null and text is not null")
    # stored, so that its size is known before texts are read
    shares = cut(rows.groupBy("lang").agg(F.least(F.lit(1.0), per_lang / F.count("*")).alias("share")), "shares")
    drawn = rows.join(shares, "lang").where(F.pmod(F.xxhash64("text", "id", F.lit(seed)), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text")
    sums = drawn.mapInArrow(lambda it: _summed(it, size, seed), "lang string, at int, part bigint").groupBy("lang", "at").agg(F.sum("part").alias("part")).collect()
    langs = sorted({r["lang"] for r in sums})
    if not langs:
        return [], np.zeros((1, size), np.float32)
    row_of = {lang: k for k, lang in enumerate(langs)}
    profile = np.zeros((len(langs), size))
    for r in sums:
        profile[row_of[r["lang"]], r["at"]] = r["part"]
    profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
    centre = profile.mean(0) if len(langs) > 1 else np.zeros(size)
    profile -= centre
    return langs, np.vstack([profile / np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9), centre]).astype(np.float32)


def _predicted(batches: Iterator[pa.RecordBatch], langs: list[str], profile: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        names, scores = [], []
        for a, b in _chunks(texts):
            bundle = bundles(texts[a:b], profile.shape[1], seed)
            some = bundle.any(1)
            away = bundle - profile[-1]
            cosine = away @ profile[:-1].T / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-9) if langs else np.zeros((b - a, 1))
            best = cosine.argmax(1)
            names += [langs[k] if ok and langs else UNKNOWN for k, ok in zip(best, some, strict=True)]
            scores += np.where(some, np.clip(cosine.max(1), 0, 1), 0).astype(float).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def identify_languages(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 512, seed: int = 11, per_lang: int = 5000) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row.

    A letter's vector has random signs; a trigram's is the product of its letters', rolled by their place; a text's is
    the sum of its trigrams'. A language's profile sums the texts of some per_lang rows (drawn by a hash of text and id,
    all where there are fewer) whose id isn't held out: crc32 of the id as text, mod 4, is 2 for those held out. Every
    language has a profile; what is gathered is size numbers for each. Both are compared, less the mean profile, by
    cosine; score is the greatest one, 0 if it is below.

    A null text, or one without letters, gives und and 0; so does every text if nothing can be learned. A null id isn't
    held out, and no language is learned from it. Rows that repeat are judged alike. An empty table gives an empty table.
    Other columns are not read. Shuffled are each task's sums for a language, of size numbers.
    """
    short_batches(documents.sparkSession)
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    langs, profile = learn_profiles(documents, remainder != 2, id_col=id_col, text_col=text_col, lang_col=lang_col, size=size, seed=seed, per_lang=per_lang)
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(remainder == 2, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(lambda it: _predicted(it, langs, profile, seed), "doc_id bigint, held_out boolean, lang_pred string, score double")
