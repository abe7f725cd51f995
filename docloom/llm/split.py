"""Oversized texts cut into overlapping pieces at natural boundaries.

Recursive separator hierarchy: a text is cut into sections, those that are too long into paragraphs, lines, sentences,
words and at last characters, until each unit fits; then units are packed greedily, each piece beginning with the last
``overlap`` characters of the piece before. Pieces are slices of the text, so nothing is lost or changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.common import WHITE_SPACE, strip

#: Ends of units, from the coarsest to the finest level; the last level is single characters.
LEVELS = (
    re.compile(r"\n(?=#{1,6}\s)|\f"),
    re.compile(r"\n[^\S\n]*\n+"),
    re.compile(r"\n"),
    re.compile(r"[。！？!?।؟…]+[”’»」』）)\"]*\s*|\.[”’»」』）)\"]*\s+"),
    re.compile(r"[\s　]+|[，、；：,;]"),
)


def units(text: str, start: int, end: int, limit: int, level: int = 0) -> Iterator[tuple[int, int, int]]:
    """(from, to, level of the separator it ends at), in order and without gaps, none longer than ``limit``."""
    if end - start <= limit:
        yield start, end, level
        return
    if level == len(LEVELS):
        for at in range(start, end, limit):
            yield at, min(at + limit, end), level
        return
    at = start
    for m in LEVELS[level].finditer(text, start, end):
        if m.end() > at:
            yield from units(text, at, m.end(), limit, level + 1)
            at = m.end()
    if at < end:
        yield from units(text, at, end, limit, level + 1)


def pieces(text: str, limit: int = 1500, overlap: int = 150) -> list[tuple[int, int]]:
    """(from, to) of the pieces of a text, white space around it left out; one piece if it is within the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    start = len(text) - len(text.lstrip(WHITE_SPACE))
    end = len(text.rstrip(WHITE_SPACE))
    if end <= start:
        return []
    if end - start <= limit:
        return [(start, end)]
    out, begin, at = [], start, start
    for _, b, _ in units(text, start, end, limit - overlap):
        if b - begin > limit:
            out.append((begin, at))
            begin = max(begin, at - overlap)
        at = b
    out.append((begin, end))
    return out


def split_oversized(df: DataFrame, keys: Sequence[str], text: str, carry: Sequence[str] = (), *, limit: int = 1500, overlap: int = 150) -> DataFrame:
    """``keys, carry, piece_no, n_pieces, char_start, char_end, piece`` of the texts of more than ``limit`` characters.

    ``piece`` is ``text[char_start:char_end]`` (code points, from 0), at most ``limit`` long, and shares its first
    ``overlap`` characters with the piece before. Length counts without white space at both ends. Texts within the
    limit, null and blank texts give no rows and never leave the JVM; other columns of ``df`` are not read, so they may
    have any name. Repeated rows are cut each time. No shuffle.
    """
    names = [*keys, *carry]
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(names)]
    schema = T.StructType(
        [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(names)]
        + [T.StructField(c, T.IntegerType()) for c in ("piece_no", "n_pieces", "char_start", "char_end")]
        + [T.StructField("piece", T.StringType())]
    )
    width = len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [pdf[f"k{i}"].astype(object).where(pdf[f"k{i}"].notna(), None) for i in range(width)]
            rows = []
            for *k, t in zip(*values, pdf["text"]):
                cut = pieces(t, limit, overlap)
                rows += [(*k, i, len(cut), a, b, t[a:b]) for i, (a, b) in enumerate(cut)]
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    long = df.select(*kept, F.col(text).alias("text")).filter(F.length(strip("text")) > limit)
    out = long.mapInPandas(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "piece_no", "n_pieces", "char_start", "char_end", "piece")
