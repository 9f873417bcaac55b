"""Character classes and the metrics of text units, as columns and as DuckDB's SQL from the same patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of the metric contract and of the filters, without brackets. They differ from one another on purpose.
FAR = r"\x{1100}-\x{11FF}\x{3000}-\x{303F}\x{3130}-\x{318F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A960}-\x{A97C}\x{AC00}-\x{D7A3}\x{D7B0}-\x{D7FF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}"
WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
DRAWING_CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
IDEOGRAPH = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{2E80}-\x{2EFF}\x{F900}-\x{FAFF}"
OCR_CJK = r"\x{3000}-\x{303F}" + IDEOGRAPH + r"\x{FF00}-\x{FFEF}"
HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"
LATIN = r"A-Za-z\x{C0}-\x{24F}"

# What an empty slide shows, in lower case.
PLACEHOLDERS = [
    "click to add title", "click to add subtitle", "click to add text",
    "click to add slide title", "click to add slide subtitle", "click to add notes",
    "点击此处添加标题", "点击此处添加副标题", "点击此处添加文本",
    "点击此处添加幻灯片标题", "点击此处添加幻灯片副标题", "点击此处添加备注",
    "date", "footer", "slide number", "页脚", "页码", "presenter name", "company name", "作者", "单位",
]

RUN = f"[^{WS}{FAR}]+"
#: The characters of WS.
WS_CHARS = "".join(filter(re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WS) + "]").match, map(chr, range(0x3001))))


def stripped(c: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.btrim(c, F.lit(WS_CHARS))


def stripped_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def count_sql(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS BIGINT)"


#: The same classes for Java's patterns, which ask one range first that settles most characters.
FAR_FIRST, RUN_FIRST = f"[\\x{{1100}}-\\x{{FFEF}}&&[{FAR}]]+", f"[\\x{{21}}-\\x{{7E}}[^{WS}{FAR}]]++"


def fe(c: Column) -> Column:
    """East-Asian characters."""
    return (F.length(c) - F.length(F.regexp_replace(c, FAR_FIRST, ""))).cast("bigint")


def nc(c: Column) -> Column:
    """Runs of other characters that aren't white space."""
    return count_of(c, RUN_FIRST)


def chars(c: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.translate(c, WS_CHARS, "")).cast("bigint")


def chars_sql(x: str) -> str:
    return f"CAST(length(regexp_replace({x}, '[{WS}]', '', 'g')) AS BIGINT)"


def metrics(c: Column) -> list[Column]:
    """fe, nc, chars and words of a unit."""
    return [fe(c).alias("fe"), nc(c).alias("nc"), chars(c).alias("chars"), (fe(c) + nc(c)).alias("words")]


def metrics_sql(x: str) -> str:
    a, b = count_sql(x, f"[{FAR}]"), count_sql(x, RUN)
    return f"{a} AS fe, {b} AS nc, {chars_sql(x)} AS chars, {a} + {b} AS words"


TOTALS = ["fe", "nc", "chars", "words"]


def totals() -> list[Column]:
    return [F.sum(m).cast("bigint").alias(m) for m in TOTALS]


TOTALS_SQL = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in TOTALS)


def with_han(c: Column) -> Column:
    """Latin vowels as Han characters, to exercise the East-Asian counts on Latin text."""
    return F.translate(c, "aeiou", "中文字数统")


HAN_SQL = "translate(text, 'aeiou', '中文字数统')"


def pages_of(n_chars: Column) -> Column:
    """Estimated pages of 750 characters each, at least one."""
    return F.greatest(F.lit(1), F.floor((n_chars + 749) / 750)).cast("bigint")


def pages_sql(x: str) -> str:
    return f"CAST(greatest(1, ({x} + 749) // 750) AS BIGINT)"
