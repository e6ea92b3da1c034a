"""Text columns: clean-up, sentences, hashes, grams, language."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that count as white space beside ASCII's.
SPACES = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#x2F;", "/"), ("&nbsp;", " "), ("&apos;", "'")]


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACES}+|{SPACES}+\z", "")


def collapsed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, rf"{SPACES}+", " "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often use names it: an expression that named it would be copied each time."""
    return F.get(F.transform(F.array(value), use), 0)


def decoded(text: Column) -> Column:
    """Named entities in order, '&amp;' first, then decimal and then hexadecimal ones; what names no character stays."""
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    for pattern, base in ((r"&#([0-9]+);", 10), (r"&#x([0-9a-fA-F]+);", 16)):
        text = bound(text, characters_of(pattern, base))
    return text


def characters_of(pattern: str, base: int) -> Callable[[Column], Column]:
    """A column function that puts characters for numbers that a pattern finds."""
    def told(text: Column) -> Column:
        between, codes = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        both = F.zip_with(between, F.transform(codes, lambda c: character(c, base)), lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
        return F.when(text.contains("&#"), F.array_join(both, "")).otherwise(text)

    return told


def character(code: Column, base: int) -> Column:
    """The character of a code point in digits; the entity again if there is none."""
    number = F.when(F.length(code) <= 9, F.conv(code, base, 10).cast("long"))
    known = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    whole = F.concat(F.lit("&#x" if base == 16 else "&#"), code, F.lit(";"))
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(whole)


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """NFKC without zero-width characters. Spark has no such function; only texts beyond ASCII go to Python's, in batches."""
    foreign = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.regexp_replace(F.coalesce(F.pandas_udf(_nfkc, T.StringType())(foreign), text), r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")


def normalized_title(title: Column) -> Column:
    """A title as it is compared and hashed: entities decoded, NFKC, no zero-width characters, single spaces; '' for null."""
    return collapsed(composed(decoded(F.coalesce(title, F.lit("")))))


def without(text: Column, opening: str, closing: str, mark: str) -> Column:
    """text with a space for each part from an opening to the next closing (patterns). Only what stands before the last closing is
    searched, so that openings that nothing closes cost nothing. mark: what every closing begins with; texts without it stay as they are."""
    def cut(t: Column) -> Column:
        head = F.regexp_extract(t, f"(?is)^(.*{closing})", 1)
        return F.concat(F.regexp_replace(head, f"(?is){opening}.*?{closing}", " "), F.substring(t, F.length(head) + 1, F.length(t)))

    return bound(text, lambda t: F.when(t.rlike(f"(?i){mark}"), cut(t)).otherwise(t))


def html_to_text(html: Column) -> Column:
    """Comments, scripts, styles and templates go, tags go, entities are decoded, all white space collapses to single spaces."""
    text = without(html, "<!--", "-->", "-->")
    for tag in ("script", "style", "template"):
        text = without(text, rf"<{tag}\b[^>]*>", rf"</{tag}\s*>", f"</{tag}")
    return collapsed(decoded(F.regexp_replace(text, r"(?s)<[^>]*>", " ")))


def page_title(html: Column) -> Column:
    return collapsed(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def content_hash(title: Column, url: Column) -> Column:
    """Identity of a normalised title with a dedup URL."""
    return F.md5(F.concat(title, F.lit("\n"), url))


def sentences(text: Column, marks: str = r"[。！？!?\n]+") -> Column:
    """Trimmed, non-empty parts between sentence marks (an ASCII full stop is none)."""
    return F.filter(F.transform(F.split(text, marks), trimmed), lambda s: s != "")


def first_sentence(text: Column) -> Column:
    """The first of sentences(), null if there is none; the others are not cut."""
    found = trimmed(F.regexp_extract(text, rf"^(?:{SPACES}|[。！？!?])*+([^。！？!?\n]*+)", 1))
    return F.when(found != "", found)


def caseless(pattern: str) -> str:
    """A pattern for Arrow's matcher that holds as (?i) does in Spark's, where only ASCII letters lose their case: each as a class of its own, white space likewise."""
    def told(m: re.Match) -> str:
        part = m.group()
        if part == r"\s":
            return r"[\t\n\x0B\f\r ]"
        if part.startswith("["):
            return part[:-1] + "".join(x.swapcase() for x in re.findall("[a-z]-[a-z]|[A-Z]-[A-Z]|[A-Za-z]", part)) + "]"
        return f"[{part.lower()}{part.upper()}]" if len(part) == 1 else part

    return re.sub(r"\\.|\[[^\]]*\]|[A-Za-z]", told, pattern)


def holding(text: Column, patterns: dict[str, str]) -> Column:
    """struct of booleans: which patterns of Arrow's matcher, that reads a text once for each, a text holds; null for null."""
    def found(batch: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pc.match_substring_regex(batch, p) for p in patterns.values()], list(patterns))

    return F.arrow_udf(found, T.StructType([T.StructField(n, T.BooleanType()) for n in patterns]))(text)


def first_holding(parts: Column, patterns: dict[str, str]) -> Column:
    """struct of numbers from 0: the first of a list of texts that holds each pattern of Arrow's matcher; null if none does."""
    def found(batch: pa.Array) -> pa.Array:
        flat, row = batch.flatten(), pc.list_parent_indices(batch).to_numpy()
        start = batch.offsets.to_numpy()[:-1] - batch.offsets[0].as_py()
        columns = []
        for p in patterns.values():
            at = pc.match_substring_regex(flat, p).fill_null(False).to_numpy(zero_copy_only=False).nonzero()[0]
            rows, first = np.unique(row[at], return_index=True)
            numbers, none = np.zeros(len(batch), dtype=np.int32), np.ones(len(batch), dtype=bool)
            numbers[rows], none[rows] = at[first] - start[rows], False
            columns.append(pa.array(numbers, mask=none))
        return pa.StructArray.from_arrays(columns, list(patterns))

    return F.arrow_udf(found, T.StructType([T.StructField(n, T.IntegerType()) for n in patterns]))(parts)


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule (name, pattern of Arrow's matcher) that a text holds; null if none or the text is null."""
    def found(batch: pa.Array) -> pa.Array:
        name = pa.nulls(len(batch), pa.string())
        for n, p in rules:
            name = pc.coalesce(name, pc.if_else(pc.match_substring_regex(batch, p), n, pa.scalar(None, pa.string())))
        return name

    return F.arrow_udf(found, T.StringType())(text)


def rule_summary(title: Column, text: Column) -> Column:
    """The first two sentences of more than ten characters, 200 characters at most; else the title."""
    long = F.filter(sentences(text, r"[。！？.!?]+"), lambda s: F.length(s) > 10)
    both = F.array_join(F.slice(long, 1, 2), "。")
    return F.when(F.size(long) == 0, title).when(F.length(both) > 200, F.concat(F.substring(both, 1, 200), F.lit("..."))).otherwise(both)


def paragraphs(text: Column, most: int = 80) -> Column:
    """Parts between blank lines, or after a sentence's end (an ASCII full stop is none) and white space before a letter or Han sign."""
    return F.slice(F.filter(F.transform(F.split(text, rf"\n{{2,}}|(?<=[。！？!?]){SPACES}+(?=[\x{{3400}}-\x{{9FFF}}A-Za-z])"), trimmed), lambda p: p != ""), 1, most)


def language_tag(text: Column) -> Column:
    """mixed if Han signs and Latin letters both occur, zh if only Han ones do, else non_zh."""
    han, latin = text.rlike(r"[\x{3400}-\x{9FFF}]"), text.rlike("[A-Za-z]")
    return F.when(han & latin, "mixed").when(han, "zh").otherwise("non_zh")


#: Signs of scripts that are cut in grams: Han, kana, hangul.
CJK = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"


def grams(text: Column, n: int) -> Column:
    """Distinct runs of n signs of CJK scripts."""
    runs = F.regexp_extract_all(text, F.lit(f"({CJK}{{2,}})"), F.lit(1))
    cut = F.transform(F.filter(runs, lambda r: F.length(r) >= n), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n))))
    return F.array_distinct(F.flatten(cut))


def latin_tokens(text: Column, stop: list[str] = ()) -> Column:
    """Distinct ASCII tokens of two or more characters in lower case, without stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9_+#.\-]*[a-z0-9])"), F.lit(1)), lambda t: ~t.isin(list(stop)) if stop else F.lit(True)))


def title_key(title: Column) -> Column:
    """For equality of titles: lower case, single spaces, no punctuation at the ends."""
    return F.regexp_replace(F.lower(collapsed(title)), r"^[\p{P}\p{S}\s]+|[\p{P}\p{S}\s]+\z", "")


def plain(text: Column) -> Column:
    """Lower case without white space, punctuation and signs, for containment tests."""
    return F.regexp_replace(F.lower(text), r"[\s\p{P}\p{S}]", "")


def grounded(quote: Column, text: Column) -> Column:
    """Whether a non-empty quote stands literally in a text."""
    return (trimmed(quote) != "") & text.contains(trimmed(quote))
