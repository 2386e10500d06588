"""Log texts: levels (I11), ids (I12, I13), UUIDs (I9), attribute text (I8), full-text terms (I10), body structure."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level names by number, and other spellings.
LEVELS = {"trace": 0, "debug": 1, "info": 2, "warn": 3, "error": 4, "fatal": 5}
ALIASES = {"warning": "warn", "err": "error", "critical": "fatal", "crit": "fatal", "panic": "fatal"}
UUID_PARTS = r"(?i)\b([0-9a-f]{8})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{12})\b"
TRACEPARENT = r"(?i)traceparent='?00-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-f]{2}'?"
FLOAT = r"^-?\d+\.\d+$"


def _lookup(pairs: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def level_from_name(name: Column) -> Column:
    """The level's number, null for unknown or blank names."""
    low = F.lower(name)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), low), low, F.lit("")))


def level_from_number(number: Column) -> Column:
    """Severity 1 to 24, in fours; null outside."""
    n = number.cast("int")
    return F.when(n.between(1, 24), F.floor((n - 1) / 4).cast("int"))


def level_name(level: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in LEVELS.items() for x in (v, k)]), level)


def collapse_uuids(text: Column) -> Column:
    return F.regexp_replace(text, UUID_PARTS, "$1$2$3$4$5")


def normalize_id(value: Column, width: int) -> Column:
    """Hex of exactly ``width`` digits in lower case, else what base64 decodes to if that has this width, else null."""
    decoded = F.lower(F.hex(F.try_to_binary(value, F.lit("base64"))))
    return F.when(value.rlike(f"^[0-9A-Fa-f]{{{width}}}$"), F.lower(value)).when(F.length(decoded) == width, decoded)


def traceparent(body: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(body, TRACEPARENT, group), F.lit(""))


def attrs_text(attributes: Column) -> Column:
    """``key value`` pairs of a string map in its order: values that look like floats stay out, UUIDs become one token."""
    pairs = F.transform(
        F.filter(F.map_entries(attributes), lambda e: F.trim(e["key"]) != ""),
        lambda e: F.when(e["value"].isNull() | (e["value"] == "") | e["value"].rlike(FLOAT), e["key"]).otherwise(F.concat_ws(" ", e["key"], collapse_uuids(e["value"]))),
    )
    return F.nullif(F.array_join(pairs, " "), F.lit(""))


def _folding() -> tuple[str, str]:
    """Letters of the Latin ranges that carry marks, and what they are without: from Unicode's decompositions."""
    with_marks = [c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isalpha()]
    return "".join(with_marks), "".join(unicodedata.normalize("NFD", c)[0] for c in with_marks)


def fts_text(text: Column) -> Column:
    """Tokens of a text between single spaces: lower case, no marks, everything but letters and digits a separator."""
    plain = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{M}", ""), *_folding())
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}\p{Co}]+", " ")), F.lit(" "))


def fts_phrases(query: str | None) -> list[str]:
    """Phrases of a search: the tokens of ``key:value`` as one, those of a bare word each for itself; none if none is usable."""
    found: list[str] = []
    collapsed = re.sub(UUID_PARTS, r"\1\2\3\4\5", query or "")
    for term in collapsed.split():
        plain = "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c)).lower()
        words = re.findall(r"[^\W_]+", plain)
        if ":" in term:
            found += [" ".join(words)] if words else []
        else:
            # A token with underscores is one phrase of what they separate.
            found += [" ".join(re.findall(r"[^\W_]+", t)) for t in re.findall(r"\w+", plain) if re.findall(r"[^\W_]+", t)]
    return found


def fts_match(columns: list[Column], query: str | None) -> Column:
    """Every phrase within one of the columns; a query without usable terms matches everything."""
    match = F.lit(True)
    for phrase in fts_phrases(query):
        match = match & F.greatest(*[F.contains(fts_text(c), F.lit(f" {phrase} ")) for c in columns], F.lit(False))
    return match


def body_structure(body: Column) -> Column:
    """``duration_ms, statement, tags, message`` of a log body with a database's duration line or trailing comment tags."""
    # Fixed values of the log format: the trailing comment, its pairs, the duration's line, and the words before a statement.
    text = F.coalesce(body, F.lit(""))
    comment = F.regexp_extract(text, r"(?s)\s*/\*\s*(.+?)\s*\*/\s*$", 1)
    keys, values = (F.regexp_extract_all(comment, F.lit(r"(\w+)='([^']*)'"), F.lit(g)) for g in (1, 2))
    tagged = F.size(keys) > 0
    bare = F.when(tagged, F.rtrim(F.regexp_replace(text, r"(?s)\s*/\*\s*(.+?)\s*\*/\s*$", ""))).otherwise(text)
    line = r"(?s)^duration:\s*([\d.]+)\s*ms\b\s*(.*)$"
    rest = F.trim(F.regexp_extract(bare, line, 2))
    said = F.regexp_extract(rest, r"(?s)^(?:statement|execute[^:]*|bind[^:]*|parse[^:]*):\s*(.+)$", 1)
    statement = F.when(bare.rlike(line), F.nullif(F.trim(F.coalesce(F.nullif(said, F.lit("")), rest)), F.lit("")))
    return F.struct(F.nullif(F.regexp_extract(bare, line, 1), F.lit("")).try_cast("double").alias("duration_ms"), statement.alias("statement"),
                    F.when(tagged, F.map_from_arrays(keys, values)).otherwise(F.create_map().cast("map<string,string>")).alias("tags"), F.trim(F.coalesce(statement, bare)).alias("message"))
