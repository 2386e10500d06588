"""SQL texts: the stored normal form (I1), the repeated-query pattern (I2), infrastructure tables (I4), IN lists (I16)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of comments, literals and lists.
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
_PLAIN = r"[^'\\]*+(?:\\.[^'\\]*+)*+"
#: A literal to its end, a doubled quote being none; where a cut text has no such end, to the first quote of the last doubled one.
#: Nothing is given back within either form, so that a long literal takes no stack.
STRING_LITERAL = rf"'(?:{_PLAIN}'')*+{_PLAIN}'|'(?:{_PLAIN}''(?={_PLAIN}''))*+{_PLAIN}'(?=')"
NUMBER = r"(?<![A-Za-z_\d])-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
IN_PLACEHOLDERS = r"(?i)\bIN\s*\(\s*\?(?:\s*,\s*\?)+\s*\)"
UUID = r"\b(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\b"
IN_LIST = r"(?i:\b(IN)\s*(\()[^)]+\))"
IPV4 = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
URL = r"https?://\S+"
QUOTED = r"'[^']*'"
BOOLEAN = r"\b(?i:TRUE|FALSE)\b"
#: Tables of the framework, the queue, the cache and the database's own catalog.
INFRASTRUCTURE = (
    r"(?i)\b(?:solid_cache_entries|solid_queue_\w+|solid_cable_messages|schema_migrations|ar_internal_metadata"
    r"|sqlite_(?:master|sequence|stat\d*)|dbstat|pg_catalog|information_schema"
    r"|pg_(?:attribute|attrdef|class|index(?:es)?|type|namespace|constraint|depend|enum|range|proc|am|opclass|collation|description|database|settings|sequences?|tables|matviews|get_\w+))\b"
)
#: All of them as one: what begins with a word asks for its boundary once, and nothing looks back but where a number may begin.
#: No two of the last four begin with the same character, so that their order is free.
VALUES = r"\b(?:" + "|".join(x.removeprefix(r"\b") for x in (UUID, IN_LIST.replace(r"\b", ""), IPV4, EMAIL, BOOLEAN)) + rf")|{URL}|{QUOTED}|(?=[-\d]){NUMBER}"
STORED_BYTES, PATTERN_CHARS, REPEAT_THRESHOLD = 4000, 1000, 3


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """A function of a value that it names several times: an expression within a lambda is evaluated wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sql_normalize(sql: Column) -> Column:
    """Literals to ``?``, lists of them to ``IN (?)``, comments as they were, at most 4000 bytes on a whole character.

    One scan tells comments, literals and numbers apart, so that neither what looks like a comment within a literal nor what
    looks like a literal within a comment counts. Blanks and lists are then taken together between the comments.
    """
    lexer = f"(?s){BLOCK_COMMENT}|{STRING_LITERAL}|{NUMBER}"
    marked = _between(sql, lexer, lambda t: F.when(t.startswith("/*"), t).otherwise(F.lit("?")), lambda x: x)
    squeezed = lambda x: F.regexp_replace(F.regexp_replace(x, IN_PLACEHOLDERS, "IN (?)"), r"\s+", " ")
    joined = once(marked, lambda t: F.when(t.contains("/*"), _between(t, BLOCK_COMMENT, lambda c: c, squeezed)).otherwise(squeezed(t)))
    return once(F.regexp_replace(joined, r"^\s+|\s+$", ""), lambda t: F.when(F.octet_length(t) <= STORED_BYTES, t).otherwise(_whole_characters(t)))


def _between(text: Column, pattern: str, matched: Callable[[Column], Column], rest: Callable[[Column], Column]) -> Column:
    """The text with its matches and what stands between them each replaced by a function of it."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda r, m: F.concat(rest(r), F.when(m.isNull(), F.lit("")).otherwise(matched(m))))
    return F.array_join(pairs, "")


def _whole_characters(text: Column) -> Column:
    """The longest prefix of whole characters within the byte limit."""
    cut = F.substring(text.cast("binary"), 1, STORED_BYTES)
    over = F.substring(text.cast("binary"), STORED_BYTES + 1, 1)
    inside = (F.conv(F.hex(over), 16, 10).cast("int") >= 128) & (F.conv(F.hex(over), 16, 10).cast("int") < 192)
    tail = F.regexp_extract(F.hex(cut), "((?:[C-F][0-9A-F])(?:[89AB][0-9A-F]){0,2})$", 1)
    return F.when(inside, F.substring(cut, F.lit(1), F.lit(STORED_BYTES) - F.floor(F.length(tail) / 2).cast("int"))).otherwise(cut).cast("string")


def sql_pattern(sql: Column) -> Column:
    """The query's shape: every value to ``?`` in one pass, so that no rule eats what another left."""
    bare = once(sql, lambda t: F.when(t.contains("/*"), F.regexp_replace(t, BLOCK_COMMENT, "")).otherwise(t))
    # The groups are empty but for lists, whose replacement keeps their head.
    marked = F.regexp_replace(bare, VALUES, "$1$2?")
    listed = once(marked, lambda t: F.when(t.contains("(?"), F.regexp_replace(t, r"(?i)\bIN\(\?", "IN (?)")).otherwise(t))
    # A blank that stands alone is as it should be.
    return once(F.trim(F.regexp_replace(listed, r"\s{2,}|[^\S ]", " ")), truncate_sql)


def truncate_sql(sql: Column) -> Column:
    return F.when(F.length(sql) > PATTERN_CHARS, F.concat(F.substring(sql, 1, PATTERN_CHARS), F.lit("…"))).otherwise(sql)


def is_infrastructure(sql: Column) -> Column:
    return F.coalesce(sql.rlike(INFRASTRUCTURE), F.lit(False))


def collapse_in_lists(sql: Column, threshold: int = 8, keep: int = 3) -> Column:
    """Lists of more than ``threshold`` flat items as their first ``keep`` and a count (I16)."""
    pattern = r"(?i)\bIN\s*\(\s*([^()]*?)\s*\)"
    lists = F.transform(F.regexp_extract_all(sql, F.lit(pattern), F.lit(1)), lambda x: F.split(x, ","))
    whole = F.regexp_extract_all(sql, F.lit(pattern), F.lit(0))
    short = F.zip_with(lists, whole, lambda i, w: F.when(F.size(i) > threshold, F.concat(F.lit("IN ("), F.array_join(F.transform(F.slice(i, 1, keep), lambda x: F.trim(x)), ", "), F.lit(", … "), F.size(i).cast("string"), F.lit(" values …)"))).otherwise(w))
    return F.array_join(F.zip_with(F.split(sql, pattern, -1), short, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
