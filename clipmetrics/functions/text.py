"""Text expressions: cleaning, tokens, channel names, script counts, subtitle times."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clipmetrics import rules

SPACE = r"[\s\p{Z}\x{85}]+"
PUNCT_OR_SPACE = r"[\s\p{Z}\x{85}\p{P}]+"
ZERO_WIDTH = r"[\x{200b}-\x{200f}\x{feff}]"

# everything Unicode counts as white space; Spark's own trim removes blanks only
WHITESPACE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# how the last three bytes of a text that ends in one of them look in hexadecimal digits
WHITE_END = f"(?:{'|'.join(c.encode().hex().upper() for c in WHITESPACE)})$"


def strip(col: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    # Only strings with an ampersand can change; the rest are passed through untouched.
    return values.map(lambda v: html.unescape(v) if v is not None and "&" in v else v)


COMMON_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                   ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def unescape(col: Column, full: bool = True) -> Column:
    """HTML entities to text. full covers the whole HTML5 set, otherwise the common ones.

    Common entities are replaced in the JVM. Only strings that hold other ones go through Python, in Arrow batches;
    for all others a null is sent.
    """
    if full:
        whole = col
        for entity, _ in COMMON_ENTITIES:
            whole = F.replace(whole, F.lit(entity), F.lit(html.unescape(entity)))
        names = "|".join(entity[1:-1] for entity, _ in COMMON_ENTITIES)
        other = F.contains(col, F.lit("&")) & F.rlike(F.regexp_replace(col, f"&(?:{names});", ""), F.lit("&[#a-zA-Z]"))
        return F.coalesce(_unescape(F.when(other, col)), F.when(F.contains(col, F.lit("&")), whole).otherwise(col))
    plain = col
    for entity, char in COMMON_ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(F.contains(col, F.lit("&")), plain).otherwise(col)


def collapse(col: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return strip(F.regexp_replace(col, SPACE, " "))


def clean_index_text(col: Column, full: bool = True) -> Column:
    """Entities first, then tags to blanks (index results)."""
    return collapse(F.regexp_replace(unescape(col, full), rules.TAG, " "))


def clean_page_text(col: Column, full: bool = True) -> Column:
    """Tags first, then entities (rendered pages)."""
    return collapse(unescape(F.regexp_replace(col, rules.TAG, " "), full))


def unescape_slashes(col: Column) -> Column:
    """Script-escaped separators back to plain characters."""
    plain = col
    for escaped, char in (("\\u002F", "/"), ("\\u002f", "/"), ("\\u003A", ":"), ("\\u003a", ":"), ("\\u0026", "&"),
                          ("\\u003D", "="), ("\\u003d", "="), ("\\/", "/")):
        plain = F.replace(plain, F.lit(escaped), F.lit(char))
    return F.when(F.contains(col, F.lit("\\")), plain).otherwise(col)


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def strip_site_suffixes(col: Column) -> Column:
    """Site name endings removed one after the other."""
    col = strip(col)
    for suffix in rules.SITE_SUFFIXES:
        col = strip(F.regexp_replace(col, re.escape(suffix) + "$", ""))
    return col


def is_generic_title(col: Column) -> Column:
    low = F.lower(strip(col))
    found = F.lit(False)
    for marker in rules.GENERIC_TITLES:
        found = found | F.contains(low, F.lit(marker))
    return found


def tokens(col: Column) -> Column:
    """Lower-cased words of at least two characters, split on spaces and Unicode punctuation."""
    return F.filter(F.split(F.lower(col), PUNCT_OR_SPACE), lambda t: F.length(t) >= 2)


def channel_name(col: Column) -> Column:
    """Creator name without a leading @, separators as one blank."""
    bare = strip(F.regexp_replace(strip(F.regexp_replace(col, f"^{SPACE}", "")), "^@", ""))
    return strip(F.regexp_replace(F.lower(bare), r"[\s\p{Z}\x{85}_\-·•]+", " "))


def squeeze(col: Column) -> Column:
    """Observation text without any white space or zero-width characters."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), SPACE, ""), ZERO_WIDTH, "")


def comparable(col: Column) -> Column:
    """What similarity looks at: letters, marks, digits, underscore and Han of the squeezed text."""
    return F.regexp_replace(squeeze(col), r"[^\p{L}\p{N}_\x{3400}-\x{9fff}]", "")


def script_count(col: Column, script: str = rules.HAN) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(script))


def compact(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), SPACE, "")


def looks_untranslated(source: Column, target: Column, script: str = rules.HAN) -> Column:
    """Target still is the source script: a compact copy, or mostly that script in a sentence."""
    src, dst = strip(F.coalesce(source, F.lit(""))), strip(F.coalesce(target, F.lit("")))
    in_src, in_dst = script_count(src, script), script_count(dst, script)
    share = in_dst / F.greatest(F.lit(1), F.regexp_count(dst, F.lit(r"\p{L}"))).cast("double")
    dominant = (in_src >= 4) & (in_dst >= 4) & (share >= 0.55)
    return (in_src >= 3) & (dst != "") & ((compact(src) == compact(dst)) | dominant)


def speech_text(col: Column) -> Column:
    """Text for speech: control and zero-width characters to blanks, collapsed."""
    plain = F.regexp_replace(F.coalesce(col, F.lit("")), r"[\x00-\x1F\x{200b}\x{feff}]", " ")
    return collapse(plain)


def title_from_stem(col: Column) -> Column:
    """File stem to title: trailing [id] dropped, underscores to blanks, 240 characters kept."""
    bare = F.regexp_replace(strip(F.coalesce(col, F.lit(""))), r"(?i)\s*\[(?:BV[0-9A-Za-z]+|av\d+|\d{8,})\]\s*$", "")
    return F.left(strip(F.replace(bare, F.lit("_"), F.lit(" "))), F.lit(240))


def platform_from_file(col: Column) -> Column:
    low = F.lower(col)
    return F.when(F.rlike(low, F.lit(r"\[bv[0-9a-z]+\]")) | F.contains(low, F.lit("bilibili")), "bilibili").otherwise("")


def srt_time(seconds: Column) -> Column:
    """Seconds to HH:MM:SS,mmm; half a millisecond rounds to even."""
    ms = F.greatest(F.lit(0), F.bround(seconds * 1000.0)).cast("long")
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000,
    )


def srt_seconds(col: Column) -> Column:
    """HH:MM:SS,mmm or HH:MM:SS.mmm to seconds."""
    part = lambda i: F.regexp_extract(col, r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})", i).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000.0


def lenient_json(col: Column) -> Column:
    """Variant from loose JSON text: code fences dropped, else the outermost braces."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(col), r"^```[^\n]*\n?", ""), r"\n?```[^\n]*$", ""))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))
