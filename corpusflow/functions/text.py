"""Text Column expressions (all JVM-side, whole-stage-codegen friendly).

Python's ``str.split()``/``strip()``/``splitlines()`` treat more code points as
whitespace / line breaks than Java's ``\\s``; the character classes below reproduce
Python's sets exactly so results match the reference byte for byte.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.config import TRUNCATION_MARKER

# ---------------------------------------------------------------------------
# Fixed values (Python whitespace and line-break sets, written as Java regex):
#   whitespace: \t \n \x0b \x0c \r, \x1c-\x1f, space, \x85, \u00a0, \u1680,
#               \u2000-\u200a, \u2028, \u2029, \u202f, \u205f, \u3000
#   line breaks: \r\n, \n \r \x0b \x0c \x1c \x1d \x1e \x85 \u2028 \u2029
# ---------------------------------------------------------------------------
WS_CLASS = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
WS_RUN = WS_CLASS + "+"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
# Separator used to split HTML into text nodes; a control character that survives
# entity decoding and never appears in markup text.
NODE_SENTINEL = "\u0001"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


# The same whitespace set as characters, for trim(): it only looks at the ends of
# the string, where an end-anchored regex is tried at every position.
WS_CHARS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def ws_strip(c) -> Column:
    """Python ``str.strip()`` (all Unicode whitespace)."""
    return F.trim(_col(c), F.lit(WS_CHARS))


def ws_rstrip(c) -> Column:
    """Python ``str.rstrip()``."""
    return F.rtrim(_col(c), F.lit(WS_CHARS))


def words(c) -> Column:
    """Python ``str.split()``: whitespace runs, no empty tokens.

    Stripping first leaves no leading/trailing empty token, so no per-word filter
    lambda (interpreted, not code-generated) runs over every word; only an
    all-whitespace text needs the explicit empty result."""
    stripped = ws_strip(_col(c))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, WS_RUN, -1))


def compact(c) -> Column:
    """Collapse whitespace runs to one space and strip; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), WS_RUN, " "))


def truncate(c, limit, keep_tail: bool = False) -> Column:
    """Compact, then cut to ``limit`` characters with a ``...`` marker.

    ``limit`` may be a Python int or a Column (per-row budgets, see context packing).
    After compaction the only whitespace left is U+0020, so plain ``rtrim`` is exact.
    """
    text = compact(c)
    lim = _lit(limit)
    marker = F.lit(TRUNCATION_MARKER)
    n_marker = len(TRUNCATION_MARKER)
    short_cut = F.right(text, lim) if keep_tail else F.left(text, lim)
    avail = lim - F.lit(n_marker)
    if keep_tail:
        long_cut = F.concat(marker, F.right(text, avail))
    else:
        long_cut = F.concat(F.rtrim(F.left(text, avail)), marker)
    return (
        F.when(lim <= 0, F.lit(""))
        .when(F.length(text) <= lim, text)
        .when(lim <= F.lit(n_marker), short_cut)
        .otherwise(long_cut)
    )


def clean_text(c) -> Column:
    """Mail body cleaning: drop CR, collapse 3+ newlines, right-strip lines, strip.

    Order matters (lines holding only spaces are not collapsed by the newline rule).
    """
    s = F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\r"), F.lit(""))
    s = F.regexp_replace(s, "\\n{3,}", "\n\n")
    lines = F.transform(F.split(s, LINE_BREAK, -1), lambda line: ws_rstrip(line))
    return ws_strip(F.array_join(lines, "\n"))


# ---------------------------------------------------------------------------
# Named HTML entities decoded on the JVM path (all others are decoded
# by ``functions.udfs.html_unescape_nodes``).
#   &quot; -> "   &apos; -> '   &#39; -> '   &lt; -> <   &gt; -> >
#   &nbsp; -> U+00A0   &copy; -> U+00A9   &reg; -> U+00AE   &middot; -> U+00B7
#   &ndash; -> U+2013  &mdash; -> U+2014  &hellip; -> U+2026
#   &amp; -> &   (decoded last so "&amp;lt;" stays "&lt;")
# ---------------------------------------------------------------------------
_ENTITIES = [
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&middot;", "·"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&hellip;", "…"),
    ("&amp;", "&"),
]


def unescape_basic(c) -> Column:
    out = _col(c)
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


# A tag ends at the first ">" outside quotes; one whose quotes never close ends at the first ">" of all.
_TAG = ("(?s)<[/!?]?[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
        "|<[/!?]?[A-Za-z][^>]*+>")
# An ampersand that does not begin one of the entities above.
_OTHER_ENTITY = "&(?!(?:" + "|".join(e[1:-1] for e, _ in _ENTITIES) + ");)"


def html_nodes(c) -> Column:
    """Markup → array of raw text nodes (comments, doctype, script/style/template removed)."""
    h = F.coalesce(_col(c), F.lit(""))
    h = F.regexp_replace(h, "(?s)<!--.*?-->", NODE_SENTINEL)
    h = F.regexp_replace(h, "(?is)<(script|style|template)\\b[^>]*>.*?</\\1\\s*>", NODE_SENTINEL)
    h = F.regexp_replace(h, _TAG, NODE_SENTINEL)
    return F.split(h, NODE_SENTINEL, -1)


def html_to_text(c, full_entities: bool = True) -> Column:
    """Visible text nodes, each stripped, empties dropped, joined by newline.

    The common entities are decoded on the JVM. Only the nodes of a page that holds another one (or a bare ampersand)
    pass an Arrow UDF that knows all of them; ``full_entities=False`` leaves those as they are."""
    nodes = html_nodes(c)
    known = F.transform(nodes, unescape_basic)
    if full_entities:
        from corpusflow.functions.udfs import html_unescape_nodes

        known = F.coalesce(html_unescape_nodes(F.when(F.rlike(_col(c), F.lit(_OTHER_ENTITY)), nodes)), known)
    stripped = F.transform(known, ws_strip)
    return F.array_join(F.filter(stripped, lambda n: n != F.lit("")), "\n")


def basename(path_col) -> Column:
    return F.regexp_extract(_col(path_col), "[^/]+$", 0)


def first_non_empty(c, default) -> Column:
    """Python ``x or default`` for strings."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), _lit(default))
