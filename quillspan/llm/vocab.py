"""Vocabulary files of byte-level tokenizers, and the faster merging of the same vocabularies for plain Latin text."""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from array import array

#: Latin text whose character classes, letter case and normal form are the same in every library here; tests go through all these code points.
PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-ɏ]*").fullmatch
#: The split of a byte-level vocabulary whose words begin with their space. A fixed value.
SPACE_FIRST = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The split of a vocabulary of words with ends. A fixed value.
WORD_ENDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def tokenizer(file: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


@functools.cache
def stated(file: str) -> dict:
    with open(file, encoding="utf-8") as f:
        return json.load(f)


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def special_strings(file: str) -> dict[str, int]:
    return {x["content"]: x["id"] for x in stated(file)["added_tokens"]}


def pieces_of(file: str, end: bytes) -> dict[bytes, int]:
    """Each vocabulary entry's bytes, with end for the mark of a word's end, and its id. Single bytes stand first."""
    byte, mark = byte_of_symbol(), stated(file)["model"]["end_of_word_suffix"] or ""
    out = {}
    for entry, i in stated(file)["model"]["vocab"].items():
        if entry in special_strings(file):
            continue
        ended = bool(mark) and entry.endswith(mark)
        out[bytes(byte[c] for c in (entry[: -len(mark)] if ended else entry)) + end * ended] = i
    return out


@functools.cache
def space_first_encoder(file: str):
    """An encoder that gives the ids of the file's tokenizer on plain text: it merges the pair with the lowest id, and ids follow the order of the merges."""
    import tiktoken

    return tiktoken.Encoding("space-first", pat_str=SPACE_FIRST, mergeable_ranks=pieces_of(file, b""), special_tokens=special_strings(file))


class WordIds(dict):
    """The ids of text between white space, as little-endian unsigned 32-bit bytes; filled as it is asked, and emptied when it holds most entries."""

    def __init__(self, file: str, most: int = 500_000):
        import regex
        import tiktoken

        super().__init__()
        ranks = pieces_of(file, b"\xff")
        # Each byte with the mark precedes all other merges, so that the mark is never left over.
        self.merge = tiktoken.Encoding("word-ends", pat_str=SPACE_FIRST, mergeable_ranks=_with_all_bytes(ranks), special_tokens={})._core_bpe.encode_single_piece
        self.split = regex.compile(WORD_ENDS).findall
        self.most = most

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if chunk.isalpha():
            ids = self.merge(chunk.encode() + b"\xff")
        elif chunk[:-1].isalpha() and chunk[-1] in ".,;:!?)":
            ids = self.merge(chunk[:-1].encode() + b"\xff") + self.merge(chunk[-1].encode() + b"\xff")
        else:
            ids = [i for part in self.split(chunk) for i in self.merge(part.encode() + b"\xff")]
        out = self[chunk] = array("I", ids).tobytes()
        return out


def _with_all_bytes(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """The end mark has no id of its own; it gets one that is never given out."""
    return ranks | ({} if b"\xff" in ranks else {b"\xff": max(ranks.values()) + 1000})


@functools.cache
def word_ids(file: str) -> WordIds:
    return WordIds(file)


def encoded(text: str, file: str) -> bytes:
    """The ids of a whole text by the file's tokenizer of words with ends, without added ones, as little-endian unsigned 32-bit bytes."""
    if PLAIN(text) and not any(s in text for s in special_strings(file)):
        ids = word_ids(file)
        return b"".join(map(ids.__getitem__, text.lower().split()))
    return b"".join(array("I", tokenizer(file).encode(part, add_special_tokens=False).ids).tobytes() for part in _at_spaces(text, file))


def _at_spaces(text: str, file: str, size: int = 1 << 20) -> list[str]:
    """A very long text cut before spaces, where neither normal forms nor words reach over; whole if it holds special strings."""
    if len(text) <= size or any(s in text for s in special_strings(file)):
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        cut = text.rfind(" ", at + 1, at + size)
        while cut > at and unicodedata.combining(text[cut + 1]):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            cut = text.find(" ", at + size)
            if cut < 0:
                break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]
