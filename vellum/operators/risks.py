"""Lines that need a reviewer's eye: injection phrases, active markup, hidden characters."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each rule is called, in the order of report.
INJECTION = "possible prompt injection text"
MARKUP = "HTML script or iframe"
DATA_URI = "active data URI"
HIDDEN = "hidden Unicode format character"
PHRASES = ("ignore previous instructions", "system prompt")
_MARKUP = r"<\s*(script|iframe)(?![A-Za-z0-9_])"
_URI = r"data:text/html|data:application/javascript"


def line_reasons(line: Column) -> Column:
    """Reasons for which a line is risky; a line may have several."""
    low = F.lower(line)
    rules = [
        (F.contains(low, F.lit(PHRASES[0])) | F.contains(low, F.lit(PHRASES[1])), INJECTION),
        (line.rlike(f"(?i){_MARKUP}"), MARKUP),
        (line.rlike(f"(?i){_URI}"), DATA_URI),
        (line.rlike(r"\p{Cf}"), HIDDEN),
    ]
    return F.array_compact(F.array(*(F.when(rule, F.lit(reason)) for rule, reason in rules)))


def risk_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line (from 1), reason of every risky line."""
    lines = texts.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\r?\n")).alias("pos", "line_text"))
    return lines.select(F.col(id_col), (F.col("pos") + 1).alias("line"), F.explode(line_reasons(F.col("line_text"))).alias("reason"))


def risks_of(text: str) -> list[tuple[int, str]]:
    """risk_lines() of one text on the driver."""
    out = []
    for n, line in enumerate(re.split(r"\r?\n", text), 1):
        low = line.lower()
        if any(p in low for p in PHRASES):
            out.append((n, INJECTION))
        if re.search(_MARKUP, line, re.IGNORECASE):
            out.append((n, MARKUP))
        if re.search(_URI, line, re.IGNORECASE):
            out.append((n, DATA_URI))
        if any(unicodedata.category(c) == "Cf" for c in line):
            out.append((n, HIDDEN))
    return out
