"""Responses that are sent chunk by chunk, in order, with little of them in the driver at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from targetry.operators import chunks
from targetry.sources.tables import counted, forget

TARGETS, METADATA = "targets", "metadata"
#: Bytes of rows, as their size column says, that the driver holds at a time, but for one larger chunk.
HELD_BYTES = 8 << 20


@dataclass(frozen=True)
class Chunk:
    """kind: targets or metadata. number: from 0, through both kinds."""

    number: int
    kind: str
    rows: list[Row] = field(default_factory=list)


def _chunks(rows: DataFrame, by: str, n_bytes: int, order: tuple[str, ...]) -> Iterator[list[Row]]:
    """Rows of each value of by, in order. Ranges of whole chunks are sorted by the executors and fetched one at a time."""
    parts = max(1, -(-n_bytes // HELD_BYTES))
    held: list[Row] = []
    for row in rows.repartitionByRange(parts, by).sortWithinPartitions(by, *order).toLocalIterator():
        if held and held[0][by] != row[by]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def send(rows: DataFrame, size: str, most: int, *order: str, metadata: DataFrame | None = None) -> Iterator[Chunk]:
    """Chunks of rows in order, of at most most bytes by their size column (a larger row is alone), then those of metadata
    (message, dictionary, id, ... as responses.metadata_chunks() gives it). Without rows there is one empty chunk.

    All is computed and stored before the first chunk goes out: what can't be read or computed fails before anything is sent.
    """
    cut, facts = counted(chunks.numbered(rows, size, most, *order), bytes=F.sum(size))
    words, sizes = (None, {}) if metadata is None else counted(metadata, bytes=F.sum(16 + F.octet_length("name")))

    def run() -> Iterator[Chunk]:
        number = 0
        if not facts["n"]:
            yield Chunk(0, TARGETS)
            number = 1
        try:
            for found in _chunks(cut, "chunk_no", facts["bytes"] or 0, order) if facts["n"] else ():
                yield Chunk(number, TARGETS, found)
                number += 1
            for found in _chunks(words, "message", sizes["bytes"] or 0, ("dictionary", "id")) if sizes.get("n") else ():
                yield Chunk(number, METADATA, found)
                number += 1
        finally:
            forget(cut, *([words] if words is not None else []))

    return run()
