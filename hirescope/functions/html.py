"""Markup to text. Tags go by regular expression in the JVM; only the entity
table needs Python, as one Arrow batch call per column."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import col

# --- fixed values: what starts an item, ends a block, makes a heading -------------
ITEM = r"(?i)<li\b[^>]*>"
BLOCK = (
    r"(?i)<(?:br|/?(?:p|div|ul|ol|li|tr|h[1-6]|section|article|table|blockquote))\b[^>]*>"
)
INNER = r"((?:(?!</?(?:p|div|h[1-6])\b).)*?)"
HEADING_TAG = r"(?is)<(h[1-6])\b[^>]*>" + INNER + r"</\1\s*>"
BOLD_PARAGRAPH = (
    r"(?is)<(p|div)\b[^>]*>\s*<(strong|b)\b[^>]*>" + INNER + r"</\2\s*>\s*:?\s*</\1\s*>"
)
TAG = r"<[^>]+>"
LINE_SPACE = r"[\t\x0B\f\r\x1c-\x1f\x85\p{Z}]"
# Windows-1252 bytes read as Latin-1, and what they were. The five undefined
# bytes become a space.
CP1252 = {
    b: bytes([b]).decode("cp1252", errors="replace").replace("�", " ")
    for b in range(0x80, 0xA0)
}


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities, named and numeric, by the full standard table."""
    return text.map(lambda s: html.unescape(s) if s and "&" in s else s)


def _headings(text: Column) -> Column:
    """Heading tags and all-bold paragraphs become 'Title:' lines."""
    for pattern, group in ((HEADING_TAG, 2), (BOLD_PARAGRAPH, 3)):
        text = F.regexp_replace(text, pattern, f"\n\u0001${group}\u0002\n")
    # Tags inside a title become spaces; an empty title is just a break.
    text = F.regexp_replace(text, "<[^>\u0001\u0002]+>(?=[^\u0001\u0002]{0,2000}\u0002)", " ")
    text = F.regexp_replace(text, "\u0001\\s*\u0002", "")
    text = F.regexp_replace(text, "\u0001\\s*([^\u0001\u0002]*:)\\s*\u0002", "$1")
    text = F.regexp_replace(text, "\u0001\\s*([^\u0001\u0002]*?)\\s*\u0002", "$1:")
    return F.regexp_replace(text, "[\u0001\u0002]", "")


def clean_text(raw: Column | str) -> Column:
    """Markup off; lines, bullets and headings kept; entities decoded
    after the tags; stray cp1252 bytes repaired. Running it twice changes
    nothing."""
    text = _headings(F.coalesce(col(raw), F.lit("")))
    text = F.regexp_replace(text, ITEM, "\n• ")
    text = F.regexp_replace(text, BLOCK, "\n")
    text = unescape(F.regexp_replace(text, TAG, " "))
    bytes_in = "".join(chr(b) for b in CP1252)
    text = F.translate(text, bytes_in, "".join(CP1252.values()))
    text = F.regexp_replace(text, LINE_SPACE + "+", " ")
    text = F.regexp_replace(text, r" *\n[ \n]*", "\n")
    text = F.regexp_replace(text, "• *\n", "• ")
    return F.regexp_replace(text, r"^[\s]+|[\s]+$", "")


# --- fixed values: the few entities the page reader decodes -------------------------
PAGE_ENTITIES = {
    "&amp;": "&", "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'",
    "&rsquo;": "'", "&lsquo;": "'", "&ldquo;": '"', "&rdquo;": '"', "&mdash;": "-",
    "&ndash;": "-", "&bull;": "\n- ", "&#x27;": "'", "&#x2F;": "/",
}


def html_to_text(raw: Column | str) -> Column:
    """A fetched page as text with '- ' bullets; blank runs folded."""
    text = F.regexp_replace(
        F.coalesce(col(raw), F.lit("")), r"(?is)<(script|style|noscript|svg)\b.*?</\1>", " "
    )
    text = F.regexp_replace(text, r"(?i)<(br|/p|/div|/li|/h[1-6])\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)<li\b[^>]*>", "\n- ")
    text = F.regexp_replace(text, TAG, " ")
    for entity, char in PAGE_ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.replace(F.replace(text, F.lit("•"), F.lit("\n- ")), F.lit("\r"), F.lit(""))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
