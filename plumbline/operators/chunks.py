"""Chunks of documents: recursive splitting with overlap, and where each chunk stands."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ")
DEFAULT_SEPARATORS = ("\n\n", "\n", " ", "")


def _pack(pieces: list[str], glue: str, size: int, overlap: int) -> Iterator[str]:
    """Pieces joined to chunks of up to ``size``, each opening with the last pieces of the one before, up to ``overlap``."""
    held: deque[str] = deque()
    width = 0
    for piece in pieces:
        need = len(piece) + (len(glue) if held else 0)
        if held and width + need > size:
            yield glue.join(held).strip()
            while held and (width > overlap or width + len(piece) + len(glue) > size):
                width -= len(held.popleft()) + (len(glue) if held else 0)
        width += len(piece) + (len(glue) if held else 0)
        held.append(piece)
    if held:
        yield glue.join(held).strip()


def split_text(text: str, size: int = 300, overlap: int = 20, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Chunks of a text, cut at the first separator that it has; pieces still too long are cut at the next ones.

    A piece that no separator cuts stays whole, however long. Separators are not kept at the ends of chunks.
    """
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    glue, finer = separators[at], separators[at + 1 :]
    short: list[str] = []
    for piece in text.split(glue) if glue else text:
        if not piece:
            continue
        if len(piece) < size:
            short.append(piece)
            continue
        yield from filter(None, _pack(short, glue, size, overlap))
        short = []
        if finer:
            yield from split_text(piece, size, overlap, finer)
        else:
            yield piece
    yield from filter(None, _pack(short, glue, size, overlap))


def chunk_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 300, overlap: int = 20, separators: tuple[str, ...] = SEPARATORS
) -> DataFrame:
    """(id, chunk_no, chunk): each document's chunks in order; null and empty texts have none. Nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, chunks = [], [], []
            for k, text in enumerate(batch.column("_text").to_pylist()):
                for n, chunk in enumerate(split_text(text or "", size, overlap, separators)):
                    rows.append(k)
                    numbers.append(n)
                    chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())], ["_id", "chunk_no", "chunk"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return texts.mapInArrow(run, f"_id {kind}, chunk_no int, chunk string").withColumnRenamed("_id", id_col)


def chunk_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, chunk_no, chunk, start, end): the first occurrence of each chunk, end inclusive; null if the text hasn't it.

    Offsets are found beside the chunk itself, so no text is joined back.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    size, overlap, separators = options.get("size", 300), options.get("overlap", 20), options.get("separators", SEPARATORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for k, text in enumerate(batch.column("_text").to_pylist()):
                for n, chunk in enumerate(split_text(text or "", size, overlap, separators)):
                    at = text.find(chunk)
                    rows.append(k)
                    out.append((n, chunk, at, at + len(chunk) - 1) if at >= 0 else (n, chunk, None, None))
            columns = list(zip(*out)) or [[], [], [], []]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(rows, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], ["_id", "chunk_no", "chunk", "start", "end"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return texts.mapInArrow(run, f"_id {kind}, chunk_no int, chunk string, start int, end int").withColumnRenamed("_id", id_col)
