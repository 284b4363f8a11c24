"""Lexical facts of C-like source texts: tokens and comments, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Alternatives in order: what begins a comment or a text wins over punctuation.
TOKEN = re.compile(
    r"""(?P<doc>///[^\n]*|/\*\*(?!/).*?\*/)|(?P<comment>//[^\n]*|/\*.*?\*/)"""
    r'''|(?P<text>\$*"{3,}.*?"{3,}|[$@]*@[$@]*"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*")'''
    r"""|(?P<char>'(?:\\.[^'\n]*|[^'\\\n])')|(?P<directive>^[ \t]*\#[^\n]*)"""
    r"""|(?P<number>\d[\w.]*)|(?P<name>@?[^\W\d]\w*)|(?P<mark>[^\w\s])""",
    re.S | re.M,
)
TOKENS = "context_id string, document_id string, ordinal int, kind string, start int, length int, text string"
SCHEMA = pa.schema([(n, pa.string() if t == "string" else pa.int32()) for n, t in (c.split() for c in TOKENS.split(", "))])


def utf16(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def lex(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, length, text) of each token; offsets in UTF-16 units."""
    plain = text.isascii()
    at = unit = 0
    for m in TOKEN.finditer(text):
        if plain:
            start, length = m.start(), m.end() - m.start()
        else:
            unit += utf16(text[at : m.start()])
            start, length = unit, utf16(m[0])
            unit += length
            at = m.end()
        yield m.lastgroup, start, length, m[0]


#: Tokens of one Arrow batch, about.
BATCH = 50_000


def tokens(documents: DataFrame) -> DataFrame:
    """Tokens of each document (context_id, document_id, text), comments and directives among them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in SCHEMA]
        for batch in batches:
            for context, document, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(zip(*lex(text or ""), strict=True))
                if found:
                    n = len(found[0])
                    for column, values in zip(columns, ([context] * n, [document] * n, range(n), *found), strict=True):
                        column.extend(values)
                if len(columns[0]) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)
                    columns = [[] for _ in SCHEMA]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    return documents.select(*[F.col(c).cast("string").alias(c) for c in ("context_id", "document_id", "text")]).mapInArrow(each, TOKENS)


def comments(documents: DataFrame) -> DataFrame:
    """Ordinary and documentation comments; not what looks like one inside a text."""
    return tokens(documents).where(F.col("kind").isin("comment", "doc"))


def token_shapes(documents: DataFrame) -> DataFrame:
    """(context_id, document_id, n_tokens, shape): every token's kind, length and text; trivia is left out."""
    part = F.concat_ws(":", "kind", "length", "text")
    solid = tokens(documents).where(~F.col("kind").isin("comment", "doc", "directive"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", part.alias("part")))), lambda t: t["part"])
    return solid.groupBy("context_id", "document_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.sha2(F.array_join(ordered, "\n"), 256).alias("shape"))
