"""Globs, names, coordinates and keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Breaks between the words of an identifier; look-around over the categories of both neighbours.
WORD_BREAK = r"_+|(?<=\p{Nd})(?!\p{Nd}|_|$)|(?<!\p{Nd}|_|^)(?=\p{Nd})|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
LINE_BREAK = "\r\n|[\r\n\u0085  ]"


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a path glob: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` in one part."""
    pattern = pattern.replace("\\", "/")
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:[^\\n]*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append("[^\\n]*")
            i += 2
        else:
            c = pattern[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.sub(r"([^\w/])", r"\\\1", c))
            i += 1
    return "\\A" + "".join(out) + "\\z"


def matches_glob(path: Column, pattern: str) -> Column:
    """Case-sensitive whole match; a backslash parts folders on both sides."""
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(glob_regex(pattern))


def in_folder(path: Column, folder: str) -> Column:
    """Whether a project-relative path lies below a folder of that name, at any depth."""
    return matches_glob(path, f"**/{folder.strip('/')}/**")


def in_namespace(name: Column, pattern: str) -> Column:
    """``A.**`` matches A itself and all below it; the global namespace is the empty name."""
    parts = F.when(F.coalesce(name, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.replace(name, F.lit("."), F.lit("/")), F.lit("/")))
    glob = pattern.replace(".", "/")
    return parts.rlike(glob_regex(glob if glob.endswith("**") or not glob else f"{glob}/"))


def identifier_words(name: Column) -> Column:
    """Words of an identifier: parted at underscores, case changes, acronym ends and digits."""
    return F.filter(F.split(F.regexp_replace(name, "^@+", ""), WORD_BREAK), lambda w: w != "")


def contains_word(name: Column, word: str, fold: bool = False) -> Column:
    words = identifier_words(name)
    return F.exists(words, lambda w: F.lower(w) == word.lower()) if fold else F.array_contains(words, word)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_order(text: Column) -> Column:
    """A key that sorts by UTF-16 code units."""
    return F.encode(text, "UTF-16BE")


def line_and_column(text: Column, offset: Column) -> Column:
    """(line, column) from 1 of a UTF-16 offset from 0; a carriage return with its newline is one break."""
    before = F.decode(F.substring(F.encode(text, "UTF-16BE"), F.lit(1), (offset * 2).cast("int")), "UTF-16BE")
    lines = F.split(before, LINE_BREAK, -1)
    return F.struct(F.size(lines).alias("line"), (utf16_length(F.element_at(lines, -1)) + 1).alias("column"))


def constant_key(type_key: Column, has_value: Column, value: Column) -> Column:
    """Key of a typed constant; a present null differs from an absent value and from any text."""
    return F.struct(type_key.alias("type_key"), has_value.alias("has_value"), value.cast("string").alias("value"))


def float_key(value: Column) -> Column:
    """Key of a double: its text, in which zeros differ by sign and a NaN equals a NaN."""
    return value.cast("string")


def length_prefixed(*parts: Column) -> Column:
    """Parts joined so that no two lists of parts give one text."""
    return F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def fingerprint(text: Column) -> Column:
    """Upper-case SHA-256."""
    return F.upper(F.sha2(text, 256))


def template_key(text: Column, hole: str = "[0-9]+") -> Column:
    """A text with its one hole marked; null unless it has exactly one."""
    return F.when(F.regexp_count(text, F.lit(hole)) == 1, F.regexp_replace(text, hole, "{}"))


def member_path(path: Column) -> Column:
    """Segments of a key such as ``Items[0].Name``; null if it doesn't parse."""
    whole = path.rlike(r"\A[A-Za-z_]\w*(\[[^\[\]]+\])*(\.[A-Za-z_]\w*(\[[^\[\]]+\])*)*\z")
    return F.when(whole, F.regexp_extract_all(path, F.lit(r"([A-Za-z_]\w*|\[[^\[\]]+\])"), F.lit(1)))


def compare_paths(left: Column, right: Column, same_project: Column) -> Column:
    """Match, Different or Unknown for two lists of segments."""
    unknown = ~F.coalesce(same_project, F.lit(False)) | left.isNull() | right.isNull()
    return F.when(unknown, "Unknown").when(left == right, "Match").otherwise("Different")


def starts_with_text(segments: Column, prefix: str) -> Column:
    """Whether a built string, as (kind, text) segments, begins with a literal."""
    merged = F.aggregate(segments, F.struct(F.lit("").alias("text"), F.lit(True).alias("open")), lambda a, s: F.when(a["open"] & (s["kind"] == "text"), F.struct(F.concat(a["text"], s["text"]).alias("text"), F.lit(True).alias("open"))).otherwise(F.struct(a["text"].alias("text"), F.lit(False).alias("open"))))
    return merged["text"].startswith(prefix)
