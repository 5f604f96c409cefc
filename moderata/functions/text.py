"""Text expressions: tokens, sentences, HTML, chat messages and number rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moderata.functions.references import decode_references

# The retrieval prompt and the chat markers.
CONTEXT_PREFIX = "You are given the following context: "
QUESTION = "Is the following hate speech: "
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>\n"

TOKEN = r"[\p{L}\p{N}]+"
WORD_RUN = r"[^ \t\r\n]+[ \t\r\n]*"
SENTENCE = r"[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+"
BLANKS = " \t\r\n"

# Attributes of a tag; a quoted value may hold ">". No part gives back what it took, so a tag takes linear time.
ATTRIBUTES = r"""(?:[^>=]++|= *+"[^"]*+"|= *+'[^']*+'|=)*+>"""


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null text gives an empty array."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Runs of non-blank characters with the blanks behind them."""
    return F.regexp_extract_all(text, F.lit(WORD_RUN), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences with their terminators and trailing blanks; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def html_to_text(html: Column) -> Column:
    """Page source to readable text.

    Comments and the contents of head, script and style go; block tags and line
    breaks become newlines; other tags go, quoted attributes whole; references are
    decoded once; blanks are squeezed.
    """
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for block in ("script", "style", "head"):
        out = F.regexp_replace(out, rf"(?is)<{block}\b{ATTRIBUTES}.*?</{block}\s*>", "")
    out = F.regexp_replace(out, r"[ \t\r\n]+", " ")
    out = F.regexp_replace(
        out,
        r"(?i)</?(?:p|div|br|hr|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|"
        r"blockquote|pre|title|body|html|main|aside|form|dl|dt|dd)\b" + ATTRIBUTES,
        "\n",
    )
    out = F.regexp_replace(out, r"(?i)<[!/]?[a-z]" + ATTRIBUTES, "")
    out = decode_references(out)
    out = F.regexp_replace(out, r" *\n[ \n]*", "\n")
    return strip(F.regexp_replace(out, r" +", " "))


def chat_message(
    role: Column | str,
    content: Column,
    add_generation_prompt: bool = False,
    start: str = TURN_START,
    end: str = TURN_END,
) -> Column:
    """One rendered chat message; the markers are arguments, ChatML by default."""
    role = F.lit(role) if isinstance(role, str) else role
    rendered = F.concat(F.lit(start), role, F.lit("\n"), content, F.lit(end))
    if add_generation_prompt:
        rendered = F.concat(rendered, F.lit(f"{start}assistant\n"))
    return rendered


def system_prefix(system: Column) -> Column:
    """The rendered system message, or an empty string where none is given."""
    given = F.length(F.coalesce(system, F.lit(""))) > 0
    return F.when(given, chat_message("system", system)).otherwise(F.lit(""))


def retrieval_prompt(
    query: Column, context: Column, prefix: str = CONTEXT_PREFIX, question: str = QUESTION
) -> Column:
    """Prefix, context, newline, question, query; a null query gives null."""
    context = F.coalesce(context, F.lit(""))
    return F.concat(F.lit(prefix), context, F.lit("\n"), F.lit(question), query)


def duration(seconds: Column) -> Column:
    """Seconds as ``h:mm:ss``, rounded half to even, with a day part from 24 h on."""
    total = F.bround(seconds.cast("double"), 0).cast("bigint")
    days = F.floor(total / F.lit(86400))
    rest = total - days * F.lit(86400)
    clock = F.concat_ws(
        ":",
        F.floor(rest / 3600).cast("string"),
        F.lpad(F.floor(F.pmod(rest, F.lit(3600)) / 60).cast("string"), 2, "0"),
        F.lpad(F.pmod(rest, F.lit(60)).cast("string"), 2, "0"),
    )
    unit = F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, "))
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), unit, clock))


def thousands(value: Column, width: int = 5) -> Column:
    """Whole number with thousands separators, right-aligned to ``width``, never cut."""
    shown = F.format_number(value, 0)
    return F.when(F.length(shown) < width, F.lpad(shown, width, " ")).otherwise(shown)


def two_decimals(value: Column) -> Column:
    """Number with two decimals and no separators."""
    return F.format_string("%.2f", value.cast("double"))
