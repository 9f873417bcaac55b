"""Paragraphs of text layers: mojibake, and stray East-Asian characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T

BAD = r"[\x{00}\x{08}\x{0B}\x{0C}\x{0E}\x{0F}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
EXOTIC = r"[\x{80}-\x{24F}\x{2B0}-\x{36F}\x{2150}-\x{23FF}]"


def is_poisoned(c):
    """Whether a paragraph of a text layer is mojibake: empty, three glyph references or more, or many private-use, control or exotic characters."""
    def judged(s):
        n, bad, exotic = F.length(s), T.count_of(s, BAD), T.count_of(s, EXOTIC)
        much = (T.count_of(s, r"\((?:cid|CID):") >= 3) | (bad >= F.greatest(F.lit(8.0), n * 0.05)) | (exotic >= F.greatest(F.lit(20.0), n * 0.30))
        return F.when(n < 10, False).otherwise(much)

    # a list of one binds the text, which would else be made and stripped again for each use
    bound = F.transform(F.array(c), lambda x: F.struct((x == "").alias("empty"), T.stripped(x).alias("s")))
    return F.transform(bound, lambda x: F.when(x["empty"], True).otherwise(judged(x["s"])))[0]


LEADERS = r"[\x{30FB}\x{FF65}\x{2026}]{2,}"
CJK_CONTENT = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
CJK_PUNCT = r"[\x{3000}-\x{303F}\x{FF00}-\x{FF0F}\x{FF1A}-\x{FF20}]"


def sanitize_paragraph(c, least=0.15):
    """A paragraph without leader dots and, where few characters are Chinese or Japanese, without those and their punctuation."""

    def kept(plain):
        few = F.regexp_replace(F.regexp_replace(plain, CJK_CONTENT, ""), CJK_PUNCT, "")
        counted = F.transform(F.array(plain), lambda p: F.struct(p.alias("p"), T.chars(p).alias("solid"), T.count_of(p, CJK_CONTENT).alias("content")))
        return F.transform(counted, lambda x: F.when(x["solid"] == 0, "").otherwise(T.stripped(F.when(x["content"] < least * x["solid"], few).otherwise(x["p"]))))[0]

    # a list of one binds the text, which would else be made again for each use
    return F.transform(F.array(F.regexp_replace(c, LEADERS, "")), kept)[0]
