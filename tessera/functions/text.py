"""I: scalar text expressions (Column -> Column), all JVM-side and codegen'd.

Whitespace and word characters are spelled out as explicit ASCII classes so
the expressions mean the same thing in Java regex, RE2 and the browser's
regex (whose ``\\s``, ``\\b`` without the ``u`` flag are ASCII).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "[\\t\\n\\x0B\\f\\r ]"          # whitespace class
NOT_WORD = "[^A-Za-z0-9_]"           # complement of an ASCII word character
# The words and characters that the tests below look for, in the order in which layouts break lines.
SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE", "JOIN")
LAYOUT_KEYWORDS = ("SELECT", "FROM", "WHERE", "GROUP BY", "ORDER BY", "HAVING")
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Trim all ASCII whitespace (Spark's ``trim`` only removes spaces)."""
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+$", "")


def is_blank(c) -> Column:
    """Null or only whitespace."""
    return F.coalesce(strip_ws(c), F.lit("")) == ""


def over_max_length(c, n: int) -> Column:
    """I2."""
    return F.length(_c(c)) > n


def has_control_chars(c) -> Column:
    """Any of 00-08, 0B-0C, 0E-1F."""
    return _c(c).rlike(CONTROL)


def looks_like_sql(c) -> Column:
    """I4: a whole-word SQL keyword, any case."""
    return _c(c).rlike(f"(?i)(^|{NOT_WORD})({'|'.join(SQL_WORDS)})({NOT_WORD}|$)")


def normalize_spaces(c) -> Column:
    """Whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(_c(c), f"{WS}+", " "))


def capitalize_sentences(c) -> Column:
    """Upper-case a-z at the start of the text or after '.' + whitespace.

    One pass: split at the full stops, upper-case the letter that follows each piece's leading whitespace (the first
    piece: its first letter), rejoin. The whitespace may be of any length.
    """
    def fixed(p: Column, i: Column) -> Column:
        lead = F.length(F.regexp_extract(p, f"^({WS}*)[a-z]", 1))
        raised = F.concat(F.substr(p, F.lit(1), lead), F.upper(F.substr(p, lead + 1, F.lit(1))), F.substr(p, lead + 2))
        return F.when(F.when(i == 0, p.rlike("^[a-z]")).otherwise(p.rlike(f"^{WS}+[a-z]")), raised).otherwise(p)
    return F.array_join(F.transform(F.split(_c(c), "\\."), fixed), ".")


def format_as_sql(c) -> Column:
    """Collapse whitespace, one space after commas, spaces around '='."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_spaces(c), " ?, ?", ", "), " ?= ?", " = "))


def word_count(c) -> Column:
    """Words after trimming, split on whitespace runs; empty text counts 1 (split quirk)."""
    return F.size(F.split(strip_ws(c), f"{WS}+"))


def text_stats(c) -> dict[str, Column]:
    """I8: characters, words, lines, spaces, characters without whitespace."""
    c = _c(c)
    return {
        "characters": F.length(c),
        "words": word_count(c),
        "lines": F.size(F.split(c, "\n")),
        "spaces": F.size(F.split(c, " ")) - 1,
        "characters_no_ws": F.length(F.regexp_replace(c, WS, "")),
    }


def header_title(c) -> Column:
    """Split on '_', first letter upper, rest lower, join with spaces."""
    words = F.split(_c(c), "_")
    return F.array_join(F.transform(words, lambda w: F.concat(
        F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def display_value(c, is_object: bool = False, limit: int = 100) -> Column:
    """Null -> NULL; structured -> JSON; text over `limit` chars -> prefix + '...'."""
    c = _c(c)
    s = F.to_json(c) if is_object else c.cast("string")
    return (F.when(c.isNull(), F.lit("NULL"))
            .when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("...")))
            .otherwise(s))


def sql_layout(c) -> Column:
    """Collapse whitespace, newline before main keywords, indent later lines by 4."""
    x = F.regexp_replace(strip_ws(c), f"{WS}+", " ")
    for kw in LAYOUT_KEYWORDS:
        x = F.regexp_replace(x, f"(?i)(^|{NOT_WORD}){kw}({NOT_WORD}|$)", f"$1\n{kw}$2")
    lines = F.split(x, "\n")
    return F.array_join(F.transform(lines, lambda ln, i: F.when(i == 0, F.trim(ln))
                                    .otherwise(F.concat(F.lit("    "), F.trim(ln)))), "\n")


def iso_timestamp(c) -> Column:
    """ISO-8601 text; the 6-digit fraction only when it is non-zero."""
    c = _c(c)
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(c, "SSSSSS")
    return F.when(c.isNull(), F.lit(None)).when(frac == "000000", base) \
        .otherwise(F.concat(base, F.lit("."), frac))


def table_scoped_question(table, question) -> Column:
    """Prefix a question with its table."""
    return F.concat(F.lit("About table "), _c(table), F.lit(": "), _c(question))
