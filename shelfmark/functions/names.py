"""Name functions as columns: normal form, relevance, edit distance, paths' drives, extensions and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of plain text files.
TEXT_EXTENSIONS = "txt md rs py js ts tsx jsx c cc cpp h hpp cs java json toml yaml yml xml ini cfg conf log ps1 bat cmd sh html css sql".split()
RICH_EXTENSIONS = "pdf doc docx xls xlsx ppt pptx rtf eml mht mhtml".split()


def normalized(text: Column) -> Column:
    """Lower case letter by letter, so that a final sigma stays a sigma."""
    each = F.array_join(F.transform(F.split(text, ""), F.lower), "")
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(each)


def stem(name: Column) -> Column:
    """What stands before the last dot; all of a name without one."""
    return F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(name)


def extension(name: Column) -> Column:
    """What stands after the last dot in lower case; null without a dot."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1)))


def relevance(query: str | Column, name: Column, flags: Column) -> Column:
    """How well a normal name fits a normal query: the best of exact name, exact stem, prefix, stem's prefix and substring,
    changed by flags and by how much longer the name is in bytes."""
    q = F.lit(query) if isinstance(query, str) else query
    part = stem(name)
    tier = F.when(name == q, 10_000).when(part == q, 9_000).when(F.startswith(name, q), 7_000).when(F.startswith(part, q), 6_500).when(F.contains(name, q), 4_000).otherwise(0)
    bonus = F.when(flags.bitwiseAND(1) != 0, 120).otherwise(0) - F.when(flags.bitwiseAND(2) != 0, 300).otherwise(0) - F.when(flags.bitwiseAND(4) != 0, 500).otherwise(0)
    longer = F.least(F.lit(500), F.greatest(F.lit(0), F.octet_length(name) - F.octet_length(q)))
    return F.when(tier > 0, tier + bonus - longer).otherwise(0)


def byte_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance over UTF-8 bytes; null beyond ``most``."""
    latin = lambda x: F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
    d = F.levenshtein(latin(a), latin(b), most)
    return F.when(d >= 0, d)


def fuzzy_distance(query: str, name: Column, most: int) -> Column:
    """The lesser distance to the name or its stem; null beyond ``most``."""
    return F.least(byte_distance(F.lit(query), name, most), byte_distance(F.lit(query), stem(name), most))


def absolute(volume: Column, path: Column) -> Column:
    """``qualified`` for a path that may come with either slash in front."""
    return F.when(path.rlike("^[A-Za-z]:"), path).otherwise(F.concat(volume, F.lit(":\\"), F.ltrim(path, F.lit("\\/"))))


def flags_of(bits: Column) -> Column:
    """A catalog's flags of a file system's attribute bits: directory, hidden, system, reparse point."""
    flag = lambda bit, value: F.when(bits.bitwiseAND(bit) != 0, value).otherwise(0)
    return flag(0x10, 1) + flag(0x02, 2) + flag(0x04, 4) + flag(0x400, 8)


def qualified(volume: Column, path: Column) -> Column:
    """A path with its drive in front, unless it has one."""
    return F.when(path.rlike("^[A-Za-z]:"), path).otherwise(F.concat(volume, F.lit(":\\"), F.ltrim(path, F.lit("\\"))))


def ends_with_any(text: Column, extensions: list[str]) -> Column:
    return F.lower(text).rlike(r"\.(" + "|".join(extensions) + ")$")


def is_text_candidate(name: Column) -> Column:
    return ends_with_any(name, TEXT_EXTENSIONS)


def is_rich_candidate(name: Column) -> Column:
    return ends_with_any(name, TEXT_EXTENSIONS + RICH_EXTENSIONS)


def tokens(text: Column) -> Column:
    """Runs of letters, digits, _ and - in lower case, of two bytes at least. A run beyond 96 bytes is cleared each time that
    it passes 96 and goes on, so that its last part alone is a token."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_\-]+"), F.lit(0))
    # Over bytes as characters: 97 bytes and what is left of the character that the last one stands in.
    cleared = lambda t: F.regexp_replace(F.decode(F.encode(t, "UTF-8"), "ISO-8859-1"), r"(?s).{97}[\x80-\xbf]*+", "")
    tail = lambda t: F.when(F.octet_length(t) <= 96, t).otherwise(F.decode(F.encode(cleared(t), "ISO-8859-1"), "UTF-8"))
    return F.filter(F.transform(runs, tail), lambda t: F.octet_length(t) >= 2)


def visible_text(html: Column, most: int | None = None) -> Column:
    """Text outside tags: trimmed pieces with five entities decoded (&amp; last), joined by a space; cut at ``most`` if asked."""
    pieces = F.transform(F.split(F.regexp_replace(html, r"<[^>]*(>|$)", "\0"), "\0"), lambda s: F.regexp_replace(s, r"^[\s  - ]+|[\s  - ]+$", ""))
    kept = F.filter(pieces, lambda s: s != "")

    def decoded(s: Column) -> Column:
        for entity, char in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            s = F.replace(s, F.lit(entity), F.lit(char))
        return s

    whole = F.array_join(F.transform(kept, decoded), " ")
    return whole if most is None else F.substring(whole, 1, most)


def lookup_name(path: Column) -> Column:
    """A path's last part, trimmed and cut at 260 characters, for a web lookup that shows no folders."""
    return F.substring(F.trim(F.regexp_extract(path, r"[^\\/]*$", 0)), 1, 260)


def within_scope(path: Column, scope: str) -> Column:
    """Whether a path is the scope or lies below it; both slashes are one, and case counts not."""
    p = F.lower(F.replace(path, F.lit("/"), F.lit("\\")))
    s = scope.replace("/", "\\").lower()
    return (p == s) | F.startswith(p, F.lit(s if s.endswith("\\") else s + "\\"))
