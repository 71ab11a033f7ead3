"""Packing documents into token sequences, by harmonic classes.

A document's ids are cut into full sequences, then into halves, quarters and so on of a
sequence down to ``finest``, and a rest of fewer ids. A piece of length n belongs to the class
k = capacity // n: k such pieces fit whatever their exact lengths, so every bin of class k takes
k pieces and no worker needs to know of another. What a worker has left over when its rows end, less
than a bin of each class, it packs by decreasing length, and cuts a last piece where that fills a bin.

Ids are those of the vocabulary's tokenizer with its special strings taken as ordinary text (``encode_special_tokens``), as the vocabulary's own notes set it: no text can
forge the end of a document.

Defined results: a null text is empty and has the closing id only; repeated rows are packed once each;
a table without rows gives none; other columns are ignored. Sequence ids name the task and the bin in it.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgauge.llm.common import ship

SCHEMA = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


class Encoder:
    """Ids of a byte-level vocabulary as little-endian bytes."""

    def __init__(self, vocabulary: str, pattern: str):
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        return np.array(self._encode(text), dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(vocabulary: str, pattern: str) -> Encoder:
    """One per Python worker, kept for its next task."""
    return Encoder(vocabulary, pattern)


def cuts(n: int, capacity: int, finest: int) -> list[int]:
    """Lengths into which ``n`` ids are cut."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while rest and size >= finest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    if rest:
        out.append(rest)
    return out


class HarmonicBins:
    """Open bins of one worker: one per class. ``add`` gives the finished bins, ``rest`` what is left, packed tightly."""

    def __init__(self, capacity: int):
        self.capacity, self._open = capacity, {}

    def add(self, piece: tuple) -> list[tuple] | None:
        k = self.capacity // piece[2]
        bin_ = self._open.setdefault(k, [])
        bin_.append(piece)
        return self._open.pop(k) if len(bin_) == k else None

    def rest(self):
        """The leftovers, longest first, each put on until a bin is full; the piece that crosses the border is cut there."""
        pieces = sorted((p for bin_ in self._open.values() for p in bin_), key=lambda p: (-p[2], p[:2]))
        self._open, now, room = {}, [], self.capacity
        for doc, start, length, ids, total in pieces:
            while length > room:
                now.append((doc, start, room, ids[:4 * room], total))
                start, length, ids = start + room, length - room, ids[4 * room:]
                yield now
                now, room = [], self.capacity
            now.append((doc, start, length, ids, total))
            room -= length
            if not room:
                yield now
                now, room = [], self.capacity
        if now:
            yield now


def pack(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 1024, finest: int = 64, end_id: int = 0) -> DataFrame:
    """One row per piece: where it starts in its document's ids, its length and checksum, its sequence and place there."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = SCHEMA.format(id=kind)
    closing = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        task, bins, encode, number = TaskContext.get().partitionId(), HarmonicBins(capacity), encoder(vocabulary, pattern), 0
        rows: list[tuple] = []

        def place(pieces):
            nonlocal number
            at = 0
            for doc, start, length, ids, total in pieces:
                rows.append((doc, start, length, zlib.crc32(ids), total, (task << 40) + number, at))
                at += length
            number += 1

        def taken():
            columns = list(zip(*rows)) or [()] * 7
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        id_type = None
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + closing
                total, start = len(ids) // 4, 0
                for length in cuts(total, capacity, finest):
                    full = bins.add((doc, start, length, ids[4 * start:4 * (start + length)], total))
                    if full:
                        place(full)
                    start += length
                if len(rows) >= 10_000:
                    yield taken()
        for pieces in bins.rest():
            place(pieces)
        if id_type is not None:
            yield taken()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
