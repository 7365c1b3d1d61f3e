"""Text and hashing expressions. Lengths that feed scores are UTF-16 units, as ids and budgets count them."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"\s   -     　﻿"
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
_OPERATORS = ("and", "or", "not", "near")


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, rf"^[{_SPACE}]+|[{_SPACE}]+\z", "")


def stable_id(kind: str, value: Column) -> Column:
    """kind and the first 20 hex digits of sha1 of kind and value."""
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha1(F.concat(F.lit(f"{kind}:"), value)), 1, 20))


def content_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def normalize_path(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\\", "/"), r"^\./", "")


def normalize_entity(value: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(value), r"^`|`\z", ""))


def cleanup_name(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trimmed(value), r"^`|`\z", ""), r"[.,;:]\z", "")


def slugify(heading: Column) -> Column:
    bare = F.regexp_replace(F.lower(trimmed(heading)), r"[^a-z0-9\x{4e00}-\x{9fff}\s-]", "")
    dashed = F.regexp_replace(F.regexp_replace(bare, r"\s+", "-"), "-+", "-")
    slug = F.regexp_replace(dashed, r"^-|-\z", "")
    return F.when(slug == "", F.lit("section")).otherwise(slug)


def utf16_length(value: Column) -> Column:
    return F.length(value) + F.length(F.regexp_replace(value, r"[^\x{10000}-\x{10FFFF}]", ""))


def token_estimate(value: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(utf16_length(value) / 4).cast("int"))


@cache
def _folding() -> tuple[str, str]:
    """Characters that decompose into one base character and marks, and those bases; made from Unicode's own data."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            pairs.append((chr(code), parts[0].lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(value: Column) -> Column:
    """Lower case without diacritics, as the full-text index stores terms."""
    return F.regexp_replace(F.translate(F.lower(value), *_folding()), r"\p{Mn}+", "")


def fold_text(value: str) -> str:
    """fold() of one string on the driver."""
    table = str.maketrans(*_folding())
    return "".join(c for c in value.lower().translate(table) if unicodedata.category(c) != "Mn")


def index_terms(value: Column) -> Column:
    """Terms of a text in order, repeats included."""
    return F.regexp_extract_all(fold(value), F.lit(r"[\p{L}\p{N}\p{Co}]+"), 0)


def exploded_terms(texts: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The kept columns of texts with a row for each of index_terms(text), column term.

    Words are cut out first, marks included, and only those beyond ASCII are folded.
    """
    words = texts.select(*keep, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{Mn}*+[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*"), 0)).alias("term"))
    return words.select(*keep, F.when(F.octet_length("term") > F.length("term"), fold(F.col("term"))).otherwise(F.col("term")).alias("term"))


def _ngrams(run: Column, size: int) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.length(run) - size + 1), lambda i: F.substring(run, i, size))
    return F.when(F.length(run) >= size, grams).otherwise(F.array().cast("array<string>"))


def cjk_ngrams(value: Column) -> Column:
    """Bigrams, then trigrams, of each run of CJK characters."""
    runs = F.regexp_extract_all(value, F.lit(f"[{CJK}]+"), 0)
    return F.flatten(F.transform(runs, lambda r: F.concat(_ngrams(r, 2), _ngrams(r, 3))))


def index_content(value: Column) -> Column:
    """What the full-text index sees: the text, and its CJK n-grams on a line of their own."""
    grams = cjk_ngrams(value)
    return F.when(F.size(grams) > 0, F.concat_ws("\n", value, F.concat_ws(" ", grams))).otherwise(value)


def query_tokens(value: Column) -> Column:
    """Tokens as queries and embeddings see them: a token without CJK comes twice."""
    return F.filter(F.flatten(F.transform(query_words(value), word_tokens)), is_token)


def query_words(value: Column) -> Column:
    """Runs of letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{N}_]+"), 0)


def word_tokens(word: Column) -> Column:
    """Tokens of one word, before short ones and operators go; most words are plain and need one test only."""
    grams = cjk_ngrams(word)
    rest = F.regexp_extract_all(F.regexp_replace(word, f"[{CJK}]+", " "), F.lit(r"[\p{L}\p{N}_]+"), 0)
    parts = F.flatten(F.transform(rest, lambda p: F.split(p, "_")))
    again = F.when(F.size(grams) == 0, F.split(word, "_")).otherwise(F.array().cast("array<string>"))
    return F.when(word.rlike(f"[_{CJK}]"), F.concat(grams, parts, again)).otherwise(F.array(word, word))


def is_token(token: Column) -> Column:
    return (F.length(token) > 1) & ~token.isin(*_OPERATORS)


def token_counts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, token, n: query_tokens() of each text, counted. Words are counted first, so that each distinct one is read once."""
    words = rows.select(F.col(id_col), F.explode(query_words(F.col(text_col))).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))
    tokens = words.select(id_col, F.explode(word_tokens(F.col("word"))).alias("token"), "n").where(is_token(F.col("token")))
    return tokens.groupBy(id_col, "token").agg(F.sum("n").alias("n"))


def _regex_runs(text: str, cjk: bool) -> list[str]:
    import regex

    script = r"\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Hangul}"
    return regex.findall(f"[{script}]+", text) if cjk else regex.findall(r"[\p{L}\p{N}_]+", regex.sub(f"[{script}]+", " ", text))


def query_tokens_of(query: str) -> list[str]:
    """query_tokens() of one string on the driver."""
    import regex

    out: list[str] = []
    for word in regex.findall(r"[\p{L}\p{N}_]+", query.lower()):
        grams = [run[i : i + n] for run in _regex_runs(word, True) for n in (2, 3) for i in range(len(run) - n + 1)]
        out += grams
        out += [p for part in _regex_runs(word, False) for p in part.split("_")]
        if not grams:
            out += word.split("_")
    return [t for t in out if len(t) > 1 and t not in _OPERATORS]


def prefix_terms(query: str, most: int = 24) -> list[str]:
    """Distinct prefixes that a query looks for; the cut comes before repeats are removed."""
    return list(dict.fromkeys(query_tokens_of(query)[:most]))


def fnv1a(value: Column) -> Column:
    """FNV-1a, 32 bits, over UTF-16 units."""
    prime, mask = F.lit(16777619).cast("long"), F.lit(0xFFFFFFFF).cast("long")

    def step(h: Column, unit: Column) -> Column:
        return (h.bitwiseXOR(unit) * prime).bitwiseAND(mask)

    def one(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        high = (F.lit(0xD800) + F.floor((code - 0x10000) / 1024)).cast("long")
        low = (F.lit(0xDC00) + (code - 0x10000) % 1024).cast("long")
        return F.when(code < 0x10000, step(h, code)).otherwise(step(step(h, high), low))

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), one)


def fnv1a_of(value: str) -> int:
    h = 2166136261
    raw = value.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
    return h


def like_prefix(term: Column, prefixes: list[str]) -> Column:
    """Whether a term starts with any prefix; each test reaches the Parquet scan."""
    test = F.lit(False)
    for p in prefixes:
        test = test | term.startswith(p)
    return test


def camel_words(text: str) -> list[str]:
    return re.findall(r"[A-Za-z0-9]+", text)
