"""Chunks: windows of fixed size in SQL, and windows that end at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.stages import short_batches


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk_index, total_chunks, content: a window of `size` characters every size - overlap."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under size")
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length(text_col) - overlap) / F.lit(step)))
    rows = docs.filter(F.length(text_col) > 0).withColumn("total_chunks", count.cast("int"))
    rows = rows.select(id_col, text_col, "total_chunks", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)).alias("chunk_index"))
    return rows.select(id_col, "chunk_index", "total_chunks", F.substr(F.col(text_col), F.col("chunk_index") * step + 1, F.lit(size)).alias("content"))


def split_at_boundaries(text: str, size: int, overlap: int) -> list[str]:
    """Windows of at most size characters that end after a paragraph, sentence or word if one ends in their second half."""
    out, start = [], 0
    while start < len(text):
        end, skip = start + size, 0
        if end < len(text):
            part, half = text[start:end], size * 0.5
            for mark, keep, jump in (("\n\n", 0, 2), (". ", 1, 1), (" ", 0, 1)):
                at = part.rfind(mark)
                if at > half:
                    end, skip = start + at + keep, jump
                    break
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        start = max(start + 1, end + skip - overlap)
    return out


def boundary_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk_index, total_chunks, content with split_at_boundaries; each text is cut by itself, many per batch."""
    if not 0 <= overlap < size / 2:
        raise ValueError("overlap must be at least 0 and under half of size")

    short_batches(docs.sparkSession)  # texts and their pieces are in a worker's memory a batch at a time

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([split_at_boundaries(t or "", size, overlap) for t in series], dtype=object)

    rows = docs.select(id_col, cut(F.col(text_col)).alias("parts"))
    return rows.select(id_col, F.size("parts").alias("total_chunks"), F.posexplode("parts").alias("chunk_index", "content"))


def part_titles(title: Column, index: Column, total: Column) -> Column:
    """A section's title for its chunk: with the part's number if the section was split."""
    return F.when(total > 1, F.concat(title, F.lit(" (parte "), (index + 1).cast("string"), F.lit(")"))).otherwise(title)


def embedding_text(title, content, context, related, note_type):
    """Context, links of the note, its class, title and content, each once, a blank line between them."""
    links = F.when(F.size(related) > 0, F.concat(F.lit("[Relacionado con: "), F.array_join(F.slice(related, 1, 5), ", "), F.lit("]")))
    mark = F.when(note_type == "hub", F.lit("[Concepto central]")).when(note_type == "index", F.lit("[Nota índice]"))
    return F.concat_ws("\n\n", context, links, mark, title, content)
