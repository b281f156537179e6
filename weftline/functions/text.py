"""Text expressions. All are built-in Catalyst functions; nulls give nulls unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters without width; a run of two or more, or any lone U+FEFF, is noise.
INVISIBLE = r"[\u200B-\u200D\u2060-\u2064\uFEFF]{2,}|\uFEFF"
XML_INVALID = r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def clean_text(c: Column) -> Column:
    """Without invisible runs, Unicode white space squeezed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(strip_invisible(c), r"(?U)\s+", " "))


def excerpt(c: Column, n: int) -> Column:
    """At most ``n`` characters, cut behind a word when that keeps over half of them, with an ellipsis if cut."""
    head = F.left(c, F.lit(n))
    kept = F.length(head) - F.locate(" ", F.reverse(head))
    word = F.rtrim(F.left(head, kept), F.lit(" ,;:.-"))
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (kept > n // 2), word).otherwise(head)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(cut, F.lit("…")))


def xml_clean(c: Column) -> Column:
    """Without the characters that XML 1.0 forbids."""
    return F.regexp_replace(c, XML_INVALID, "")


def escape_text(c: Column) -> Column:
    """``& < >`` as references, for text that is HTML inside another document."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_xml(c: Column) -> Column:
    """XML character data and attribute values: markup, quotes and line controls as references."""
    out = escape_text(c)
    for a, b in (('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cdata(c: Column) -> Column:
    """A CDATA section; an inner end mark is split over two."""
    return F.concat(F.lit("<![CDATA["), F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def shorten(c: Column, n: int) -> Column:
    """For display: n - 1 characters and an ellipsis where longer than n."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("…"))).otherwise(c)


def or_default(c: Column, default: Column | str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def first_non_blank(*cols: Column) -> Column:
    """The first value that is not blank, itself untrimmed."""
    return F.coalesce(*[F.when(F.regexp_replace(c, r"(?U)\s+", "") != "", c) for c in cols])


def entry_title(title: Column, description: Column, link: Column) -> Column:
    """Title, else the start of the description, else the link."""
    return F.coalesce(F.nullif(F.trim(xml_clean(title)), F.lit("")), excerpt(F.nullif(clean_text(xml_clean(description)), F.lit("")), 80), link)


# The same rules for values inside Python code that walks trees.
_INVISIBLE = re.compile("[\u200b-\u200d\u2060-\u2064\ufeff]{2,}|\ufeff")
_SPACE = re.compile(r"\s+")


def py_strip_invisible(s: str) -> str:
    return _INVISIBLE.sub("", s)


def py_clean_text(s: str) -> str:
    return _SPACE.sub(" ", _INVISIBLE.sub("", s)).strip()
