"""Scalar text functions, as column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of paths, words that mark a failed result, keywords of retryable errors.
PATH_EXTENSIONS = ("ts", "tsx", "js", "jsx", "json", "md", "mdx", "sql", "yml", "yaml", "toml", "env", "sh", "py")
FAILURE_WORDS = ("error", "失败", "不存在", "denied", "refused", "timeout")
RETRY_WORDS = ("ECONNRESET", "EPIPE", "ETIMEDOUT", "timeout", "fetch failed", "network", "No output generated")
SPACE = r"[\s 　﻿]"


def trim_all(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def slugify(text: Column) -> Column:
    """Lower case; other characters than ASCII letters, digits and CJK become one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9一-鿿]+", "-"), "^-|-$", "")


def truncate_middle(text: Column, limit: int) -> Column:
    """Texts beyond ``limit`` characters keep 60 % of it at the head and the rest at the tail."""
    head = int(limit * 0.6)
    tail = limit - head
    kept = F.concat(F.substring(text, 1, head), F.lit("\n\n... ["), (F.length(text) - limit).cast("string"), F.lit(" characters omitted] ...\n\n"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= limit, text).otherwise(kept)


def extract_paths(text: Column) -> Column:
    """Distinct paths with a known extension that don't continue a word or path."""
    pattern = rf"(?<![\w/])([\w./-]+\.(?:{'|'.join(PATH_EXTENSIONS)}))"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))


def glob_pattern(glob: str) -> str:
    """Anchored regular expression: ``**`` crosses folders, ``*`` doesn't, dots are plain."""
    return "^" + re.sub(r"\*\*|\*|\.", lambda m: {"**": ".*", "*": "[^/]*", ".": r"\."}[m[0]], glob) + "$"


def replace_once(text: Column, old: Column, new: Column) -> Column:
    """(outcome, text): replaced only where ``old`` occurs exactly once, taken literally."""
    times = F.when(F.length(old) > 0, ((F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)).cast("long")).otherwise(0)
    outcome = F.when(times == 0, "missing").when(times > 1, "ambiguous").otherwise("replaced")
    return F.struct(outcome.alias("outcome"), F.when(times == 1, F.replace(text, old, new)).otherwise(text).alias("text"))


def is_failure(text: Column) -> Column:
    """Does a result speak of a failure?"""
    return text.rlike("(?i)" + "|".join(FAILURE_WORDS))


def is_retryable(message: Column) -> Column:
    """The first three digits decide if they are a status of 400 or more; else network keywords do."""
    status = F.try_to_number(F.nullif(F.regexp_extract(message, r"(\d{3})", 1), F.lit("")), F.lit("999"))
    words = F.lit(False)
    for w in RETRY_WORDS:
        words = words | message.contains(w)
    return F.when(status.isin(408, 429, 529) | status.between(500, 599), True).when(status.between(400, 499), False).otherwise(words)


def backoff_ms(attempt: Column, base: int = 500, limit: int = 30_000) -> Column:
    """Waiting time before an attempt, without its random part."""
    return F.least(F.lit(base) * F.pow(F.lit(2), attempt - 1), F.lit(limit)).cast("long")


def short_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.left(F.sha2(F.encode(text, "UTF-8"), 256), F.lit(16))


def stable_json(entries: Column) -> Column:
    """JSON of a map, keys in order; nulls stay."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))), {"ignoreNullFields": "false"})


def stable_json_text(json: Column) -> Column:
    """A JSON text as it would be with the keys of all its objects in order and no white space (malformed: null)."""
    return F.to_json(F.try_parse_json(json))


def short_number(n: Column) -> Column:
    """1234 as 1.2k, 2500000 as 2.5M."""
    return F.when(n >= 1_000_000, F.concat(F.format_number(n / 1_000_000, 1), F.lit("M"))).when(n >= 1000, F.concat(F.format_number(n / 1000, 1), F.lit("k"))).otherwise(n.cast("string"))


def markdown_steps() -> list[tuple[str, str]]:
    """(pattern, replacement) in order; ``$1`` is the first group.  No look-around and no back references."""
    dropped = ("script", "style", "nav", "footer", "header", "iframe", "head")
    return [
        (r"(?is)<!--.*?-->", ""),
        *((rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", "") for tag in dropped),
        *((rf"(?is)<h{k}(?:\s[^>]*)?>(.*?)</h{k}\s*>", "\n\n" + "#" * k + " $1\n\n") for k in range(1, 7)),
        (r"(?is)<pre(?:\s[^>]*)?>\s*(?:<code(?:\s[^>]*)?>)?", "\n\n```\n"),
        (r"(?is)(?:</code\s*>)?\s*</pre\s*>", "\n```\n\n"),
        (r"(?is)<li(?:\s[^>]*)?>(.*?)</li\s*>", "\n- $1"),
        (r"(?is)<a\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a\s*>", "[$2]($1)"),
        *((rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", to) for tag, to in (("b", "**$1**"), ("strong", "**$1**"), ("i", "_$1_"), ("em", "_$1_"))),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(?:p|div|tr|ul|ol|table|article|section|blockquote)\s*>", "\n\n"),
        (r"(?s)<[^>]*>", ""),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;", "'"),
        ("&nbsp;", " "),
        ("&amp;", "&"),
        (r"[ \t]+\n", "\n"),
        (r"\n{3,}", "\n\n"),
    ]


def html_to_markdown(html: Column) -> Column:
    """Headings, fenced code, list items, links, emphasis and paragraphs; script, style and page furniture go."""
    for pattern, to in markdown_steps():
        html = F.regexp_replace(html, pattern, to)
    return F.regexp_replace(html, r"^\s+|\s+$", "")


def percent(share: Column, places: int = 1) -> Column:
    """0.256 as 25.6%; null (infinite) as ∞."""
    return F.coalesce(F.concat(F.format_number(share * 100, places), F.lit("%")), F.lit("∞"))


def overwrite(base: Column, over: Column) -> Column:
    """Two maps as one; keys of ``over`` win."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def first_field(json: Column, *paths: str) -> Column:
    """The first of several JSON paths that isn't null, as a number; else 0."""
    return F.coalesce(*(F.get_json_object(json, p).cast("double") for p in paths), F.lit(0.0))


def json_array(text: Column, element: str = "string") -> Column:
    """The outermost [...] of a text, parsed; an empty array if there is none or it is malformed."""
    body = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.from_json(F.nullif(body, F.lit("")), f"array<{element}>"), F.array().cast(f"array<{element}>"))


def rolling_hash(text: Column) -> Column:
    """h = 31 h + code over the characters, kept in 32 bits with sign; its absolute value to base 36."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(0xFFFFFFFF))
    signed = F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)
    return F.lower(F.conv(F.abs(signed).cast("string"), 10, 36))
