"""Alignment and differences of two versions of a document, pair by pair."""

from __future__ import annotations

import bisect
import difflib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Bits up to which all places of two lists are held at once, and tokens up to which a cut is found by strings of bits.
MOST_BITS, SHORT = 1 << 22, 512

OPS = "pair bigint, seq int, tag string, oi int, rj int, ins_chars bigint, del_chars bigint"


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence's length over both lengths."""
    if not a or not b:
        return 0.0
    # one bit for each character of a; cleared where the common subsequence grows
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = bits = (1 << len(a)) - 1
    for y in b:
        hit = bits & places.get(y, 0)
        bits = (bits + hit | bits - hit) & full
    return 2 * (len(a) - bits.bit_count()) / (len(a) + len(b))


def close_pairs(original: dict[int, str], revised: dict[int, str], least_length: float) -> list[tuple[float, int, int]]:
    """Ratios and numbers of the pairs of texts whose lengths are close enough. Each text of the revision meets all of the original's at once, side by side in one number, with a bit between them that stops carries."""
    order = sorted(original, key=lambda i: len(original[i]))
    places: dict[str, int] = {}
    starts, at = [], 0
    for i in order:
        own: dict[str, int] = {}
        for k, x in enumerate(original[i]):
            own[x] = own.get(x, 0) | 1 << k
        for x, bits in own.items():
            places[x] = places.get(x, 0) | bits << at
        starts.append(at)
        at += len(original[i]) + 1
    out = []
    for j, b in revised.items():
        near = [k for k, i in enumerate(order) if min(len(original[i]), len(b)) >= least_length * max(len(original[i]), len(b))]
        if not near or not b:
            continue
        low = starts[near[0]]
        full = sum((1 << len(original[order[k]])) - 1 << starts[k] - low for k in near)
        own, bits = {x: places[x] >> low & full for x in set(b) if x in places}, full
        for y in b:
            hit = bits & own.get(y, 0)
            bits = (bits + hit | bits - hit) & full
        for k in near:
            i, n = order[k], len(original[order[k]])
            out.append((2 * (n - (bits >> starts[k] - low & (1 << n) - 1).bit_count()) / (n + len(b)), i, j))
    return out


def tokens(text: str) -> list[str]:
    return re.findall(r"[\u4e00-\u9fff\u3400-\u4dbf]|[^\W\u4e00-\u9fff\u3400-\u4dbf]+|\W", text)


class Matcher(difflib.SequenceMatcher):
    """SequenceMatcher without junk, with the same blocks, found by one bit for each place of b."""

    def __init__(self, a: list[str], b: list[str]):
        super().__init__(None, a, b, autojunk=False)
        self.bits = {x: sum(1 << j for j in js) for x, js in self.b2j.items()} if len(a) * len(b) <= MOST_BITS else None

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> difflib.Match:
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        if self.bits is None:
            return super().find_longest_match(alo, ahi, blo, bhi)
        window, get = (1 << bhi) - (1 << blo), self.bits.get
        # where runs of 1, 2, 4, ... equal tokens end in b, by their end in a
        doubled = [[get(x, 0) & window for x in self.a[alo:ahi]]]
        while any(doubled[-1]):
            ends, n = doubled[-1], 1 << len(doubled) - 1
            doubled.append([0] * min(n, len(ends)) + [x and x & y << n for x, y in zip(ends[n:], ends)])
        if len(doubled) == 1:
            return difflib.Match(alo, blo, 0)
        longest, size = doubled[-2], 1 << len(doubled) - 2
        for k in range(len(doubled) - 3, -1, -1):
            more = [0] * min(size, len(longest)) + [x and x & y << size for x, y in zip(longest[size:], doubled[k])]
            if any(more):
                longest, size = more, size + (1 << k)
        i = next(k for k, x in enumerate(longest) if x)
        j = (longest[i] & -longest[i]).bit_length() - 1
        return difflib.Match(alo + i + 1 - size, j + 1 - size, size)


def inline_ops(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """Token ranges that are equal, replaced, deleted or inserted."""
    return Matcher(tokens(a), tokens(b)).get_opcodes()


def volume(a: str, b: str) -> tuple[int, int]:
    """Inserted and deleted characters, without white space."""
    size = lambda t: len(re.sub(r"\s", "", "".join(t)))
    if not a or not b:
        return size(b), size(a)
    x, y = tokens(a), tokens(b)
    ops = [o for o in Matcher(x, y).get_opcodes() if o[0] != "equal"]
    return sum(size(y[j1:j2]) for *_, j1, j2 in ops), sum(size(x[i1:i2]) for _, i1, i2, _, _ in ops)


def align(original: list[str], revised: list[str], least: float = 0.35, least_length: float = 0.4) -> list[tuple[str, int | None, int | None]]:
    """Operations in the order of the revision: equal blocks first come, first matched; then contained ones; then similar ones, best first; the rest deleted or inserted."""
    free_o, match, tag = set(range(len(original))), {}, {}
    by_text: dict[str, list[int]] = {}
    for i, t in enumerate(original):
        by_text.setdefault(t, []).append(i)
    for j, t in enumerate(revised):
        if by_text.get(t):
            match[j], tag[j] = by_text[t].pop(0), "EQ"
            free_o.discard(match[j])
    for j in sorted((j for j in range(len(revised)) if j not in match), key=lambda j: len(revised[j])):
        inside = [i for i in sorted(free_o) if len(revised[j]) >= 2 and revised[j] in original[i]]
        if inside:
            match[j], tag[j] = inside[0], "SUB_EQ"
    used = set(match.values())
    rest_o, rest_r = [i for i in sorted(free_o) if i not in used], [j for j in range(len(revised)) if j not in match]
    close = close_pairs({i: original[i] for i in rest_o}, {j: revised[j] for j in rest_r}, least_length)
    for r, i, j in sorted(close, key=lambda x: (-x[0], x[1], x[2])):
        if r >= least and j not in match and i not in used:
            match[j], tag[j] = i, "REP"
            used.add(i)
    out, gone, at = [], [i for i in range(len(original)) if i not in used and i not in set(match.values())], 0
    for j in range(len(revised)):
        while at < len(gone) and j in match and gone[at] < match[j]:
            out.append(("DEL", gone[at], None))
            at += 1
        out.append((tag.get(j, "INS"), match.get(j), j))
    return out + [("DEL", i, None) for i in gone[at:]]


def rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence, by the smallest end of each length."""
    ends: list[int] = []
    places: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        at = bisect.bisect_left(ends, v)
        before[k] = places[at - 1] if at else -1
        ends[at : at + 1], places[at : at + 1] = [v], [k]
    out, k = [], places[-1] if places else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def in_document_order(ops: list[tuple[str, int | None, int | None]]) -> list[tuple[str, int | None, int | None]]:
    """Operations as a reader of the revision meets them, each deletion just before the match that follows it in the original.

    Of matches that cross, as blocks were moved, as many as can stand in order in both versions are kept, and the others
    left out. Blocks contained in others follow the revision alone.
    """
    matched = sorted((j, i, tag) for tag, i, j in ops if i is not None and j is not None and tag != "SUB_EQ")
    kept = [matched[k] for k in rising([i for _, i, _ in matched])]
    left = [i for _, i, _ in kept]
    placed = [((j, 1, 0), (tag, i, j)) for j, i, tag in kept]
    for tag, i, j in ops:
        if j is None:
            following = bisect.bisect_right(left, i)
            placed.append(((kept[following][0] if following < len(kept) else math.inf, 0, i), (tag, i, j)))
        elif i is None or tag == "SUB_EQ":
            placed.append(((j, 1, 0), (tag, i, j)))
    return [op for _, op in sorted(placed, key=lambda x: x[0])]


def fused_opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Block ranges that are equal, replaced, deleted or inserted; a deletion beside an insertion of as many blocks is a replacement."""
    out: list[tuple[str, int, int, int, int]] = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
        before = out[-1] if out else None
        if before and {before[0], tag} == {"delete", "insert"} and before[2] - before[1] + i2 - i1 == before[4] - before[3] + j2 - j1:
            out[-1] = ("replace", before[1], i2, before[3], j2)
        else:
            out.append((tag, i1, i2, j1, j2))
    return out


def _reached(a: list[str], b: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of each beginning of a with b, with one bit for each token of a."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = bits = (1 << len(a)) - 1
    for y in b:
        hit = bits & places.get(y, 0)
        bits = (bits + hit | bits - hit) & full
    held = np.unpackbits(np.frombuffer(bits.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.r_[0, np.cumsum(1 - held.astype(np.int64))]


def _bits(a: list[str], b: list[str]) -> int:
    """One bit for each token of a, cleared where the common subsequence with b grows."""
    places: dict[str, int] = dict.fromkeys(b, 0)
    for i, x in enumerate(a):
        if x in places:
            places[x] |= 1 << i
    full = bits = (1 << len(a)) - 1
    for y in b:
        at = places[y]
        if at:
            hit = bits & at
            bits = (bits + hit | bits - hit) & full
    return bits


def _cut(a: list[str], b: list[str], c: list[str]) -> int:
    """The first place at which a may be cut so that its parts' common subsequences with b and c are longest together."""
    n = len(a)
    if n > SHORT:
        return int(np.argmax(_reached(a, b) + _reached(a[::-1], c[::-1])[::-1]))
    # passing a token, the first part's grows where its bit is cleared, the second's shrinks where that bit is
    grows, shrinks = f"{_bits(a, b):0{n}b}"[::-1], f"{_bits(a[::-1], c[::-1]):0{n}b}"
    best = now = cut = 0
    for k, (x, y) in enumerate(zip(grows, shrinks), 1):
        if x != y:
            now += 1 if x == "0" else -1
            if now > best:
                best, cut = now, k
    return cut


def common_places(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places in both lists of a longest common subsequence.

    Equal ends are matched; what lies between is cut at the middle of b and where a may be cut without loss, and each
    half done by itself. So memory grows with the lists alone, and the result is exact for any size.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i == p or j == q:
            continue
        if q - j == 1:
            out += [(k, j) for k in range(i, p) if a[k] == b[j]][:1]
            continue
        if set(a[i:p]).isdisjoint(b[j:q]):
            continue
        half = (j + q) // 2
        cut = i + _cut(a[i:p], b[j:half], b[half:q])
        todo += [(i, cut, j, half), (cut, p, half, q)]
    return sorted(out)


def common_runs(a: list[str], b: list[str]) -> list[tuple[bool, str, str]]:
    """Whether equal, and both sides, of each stretch of two lists by a longest common subsequence."""
    out: list[tuple[bool, str, str]] = []
    i = j = 0
    for x, y in [*common_places(a, b), (len(a), len(b))]:
        if x > i or y > j:
            out.append((False, "".join(a[i:x]), "".join(b[j:y])))
        if x < len(a):
            if out and out[-1][0]:
                out[-1] = (True, out[-1][1] + a[x], out[-1][2] + b[y])
            else:
                out.append((True, a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def diff_runs(a: str, b: str) -> list[tuple[bool, str, str]]:
    """Stretches of two texts by a longest common subsequence of their tokens."""
    return common_runs(tokens(a), tokens(b))


def row_runs(a: list[str], b: list[str]) -> list[tuple[int, bool, str, str]]:
    """Stretches of the cells of two table rows, cell by cell; a row's further cells are deleted or inserted whole."""
    width = max(len(a), len(b))
    a, b = a + [""] * (width - len(a)), b + [""] * (width - len(b))
    return [(k, *run) for k, (x, y) in enumerate(zip(a, b, strict=True)) for run in diff_runs(x, y)]


def escaped(text: str) -> str:
    """Text for XML 1.0: characters that it forbids are left out, others escaped."""
    text = re.sub("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]", "", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def tracked_paragraph(runs: list[tuple[bool, str, str]], author: str, date: str, first_id: int) -> str:
    """A paragraph of WordprocessingML with its insertions and deletions tracked."""
    by, out, number = f'w:author="{escaped(author)}" w:date="{escaped(date)}"', [], first_id
    for same, old, new in runs:
        if same:
            out.append(f'<w:r><w:t xml:space="preserve">{escaped(new)}</w:t></w:r>')
            continue
        for kind, leaf, text in (("del", "delText", old), ("ins", "t", new)):
            if text:
                out.append(f'<w:{kind} w:id="{number}" {by}><w:r><w:{leaf} xml:space="preserve">{escaped(text)}</w:{leaf}></w:r></w:{kind}>')
                number += 1
    return f"<w:p>{''.join(out)}</w:p>"


def tracked_body(original: list[str], revised: list[str], author: str, date: str) -> str:
    """All paragraphs of both versions in the order of the alignment, with tracked changes."""
    out, number = [], 1
    for tag, i, j in align(original, revised):
        old, new = "" if i is None else original[i], "" if j is None else revised[j]
        runs = [(True, new, new)] if tag in ("EQ", "SUB_EQ") else diff_runs(old, new)
        out.append(tracked_paragraph(runs, author, date, number))
        number += 2 * len(runs)
    return "".join(out)


def align_pairs(original: DataFrame, revised: DataFrame) -> DataFrame:
    """Operations and their volume for each pair of two tables of pair, pos and text."""

    def each(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("pos"), b.sort_values("pos")
        pair = int((a if len(a) else b)["pair"].iloc[0])
        left, right = a["text"].tolist(), b["text"].tolist()
        rows = []
        for k, (tag, i, j) in enumerate(align(left, right)):
            ins, gone = volume("" if i is None else left[i], "" if j is None else right[j]) if tag in ("REP", "INS", "DEL") else (0, 0)
            rows.append((pair, k, tag, i, j, ins, gone))
        out = pd.DataFrame(rows, columns=["pair", "seq", "tag", "oi", "rj", "ins_chars", "del_chars"])
        return out.astype({"oi": "Int32", "rj": "Int32"})

    return original.groupBy("pair").cogroup(revised.groupBy("pair")).applyInPandas(each, OPS)
