"""Byte-level BPE over whole texts by overlapping chunks, and its exact inverse.

A text longer than a chunk is cut near every multiple of the chunk's length. Around the place two
overlapping views, one begun before it and one at it, are pre-tokenised; where their boundaries
meet again, between a visible character and ASCII white space, no pre-token of the whole text can
cross, so the pieces on both sides encode alone. Pieces go to tasks of their own and are joined in
order; decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 16  #: characters of a chunk
OVERLAP = 1 << 10  #: characters of a view at first; doubled until the views meet
CONTRACTION = 4  #: at a view's end, boundaries this near may come from the cut
BATCH_BYTES = 1 << 23  #: output batches are closed at this size


@lru_cache(4)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(4)
def _bytes_of_ids(ranks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(all tokens' bytes by id, offsets)."""
    table = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    tokens = [table.get(i, b"") for i in range(max(table) + 1)]
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def load_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The rank file, about a megabyte whatever the corpus, for all executors."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_text(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    return encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@lru_cache(4)
def _splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def meeting_point(text: str, at: int, pattern: str, overlap: int = OVERLAP) -> int | None:
    """The first boundary after ``at`` that views begun before it and at it share, with white space on its right only; None if there is none."""
    split = _splitter(pattern)
    while True:
        low, high = max(0, at - overlap), min(len(text), at + overlap)
        trusted = high if high == len(text) else high - CONTRACTION
        ends = [{m.end() for m in split.finditer(text, a, high)} for a in (low, at)]
        for x in sorted(ends[0] & ends[1]):
            if at < x < trusted and text[x] in " \t\n\r\x0b\x0c" and not text[x - 1].isspace():
                return x
        if high == len(text):
            return None
        overlap *= 2


def pieces(text: str, pattern: str, chunk: int = CHUNK) -> Iterator[str]:
    """Pieces of about ``chunk`` characters that encode alone; together they are the text."""
    start = 0
    while len(text) - start > chunk:
        cut = meeting_point(text, start + chunk, pattern)
        if cut is None:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def _encode_rows(ranks: Broadcast, pattern: str, names: list[str], decoded: bool):
    """(..., text) to (..., ids) and, if asked for, what they decode to; a null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            first, size, out = 0, 0, []
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                ids = encode_text(encoding, text.as_py() or "")
                out.append((ids.tobytes(), decode_ids(ranks.value, ids.astype(np.int64))[0].tobytes()) if decoded else (ids.tobytes(),))
                size += sum(map(len, out[-1]))
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    kept = [c.slice(first, len(out)) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.binary()) for x in zip(*out))], names)
                    first, size, out = k + 1, 0, []

    return run


def _cut_rows(pattern: str, chunk: int):
    """(id, digest, text) to (id, digest, part, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for part, piece in enumerate(pieces(batch.column(2)[k].as_py(), pattern, chunk)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([part], pa.int64()), pa.array([piece])], ["id", "digest", "part", "piece"])

    return run


def _join_parts(names: list[str]):
    """(id, parts) to (id, *names): the parts' bytes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts = batch.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *(pa.array([b"".join(p[n] for p in parts)], pa.binary()) for n in names)], ["id", *names])

    return run


def encode(docs: DataFrame, ranks: Broadcast, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, decoded: bool = False) -> DataFrame:
    """Encode whole texts: ``id_col``, ``n_tokens`` (long), ``ids`` (binary, little-endian unsigned 32-bit) and, if asked for, ``decoded``, as ``decode`` would add it.

    Special tokens are ordinary text. One row per input row, repeated rows and null ids included;
    a null text is empty, an empty one has no ids. Other columns are ignored, so names can't clash.
    Only a text's own ids are ever brought together.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    out = ["ids", "decoded"] if decoded else ["ids"]
    tail = "".join(f", {n} binary" for n in out)
    is_long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    whole = docs.where(~is_long).mapInArrow(_encode_rows(ranks, pattern, ["id", *out], decoded), f"id {kind}{tail}")
    cut = docs.where(is_long).select("id", F.sha2("text", 256).alias("digest"), "text").mapInArrow(_cut_rows(pattern, chunk), f"id {kind}, digest string, part long, piece string")
    dealt = cut.repartition("digest", "part").mapInArrow(_encode_rows(ranks, pattern, ["id", "digest", "part", *out], decoded), f"id {kind}, digest string, part long{tail}")
    # equal rows have equal parts: the set holds them once, and the first part tells how many rows there are
    parts = dealt.groupBy("id", "digest").agg(F.array_sort(F.collect_set(F.struct("part", *out))).alias("parts"), F.count_if(F.col("part") == 0).alias("rows"))
    joined = parts.select("id", F.explode(F.array_repeat("parts", F.col("rows").cast("int"))).alias("parts")).mapInArrow(_join_parts(out), f"id {kind}{tail}")
    return whole.unionByName(joined).select(F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *out)


def decode_ids(ranks: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all ids, bytes of each)."""
    flat, offsets = _bytes_of_ids(ranks)
    if len(ids) and int(ids.max()) >= len(offsets) - 1:
        raise ValueError(f"id {int(ids.max())} is not in the vocabulary")
    lengths = offsets[ids + 1] - offsets[ids]
    places = np.arange(lengths.sum()) + np.repeat(offsets[ids] - np.cumsum(lengths) + lengths, lengths)
    return flat[places], lengths


def decode(encoded: DataFrame, ranks: Broadcast, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded`` (binary): the concatenated bytes of ``ids_col``, null where that is null.

    An id outside the vocabulary is an error. A column named ``decoded`` is replaced.
    """
    encoded = encoded.drop("decoded")
    place, names = encoded.columns.index(ids_col), [*encoded.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = [x.as_py() for x in part.column(place)]
                ids = np.frombuffer(b"".join(x or b"" for x in rows), "<u4").astype(np.int64)
                data, lengths = decode_ids(ranks.value, ids)
                ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([len(x or b"") // 4 for x in rows])]
                raw, start, out = data.tobytes(), 0, []
                for x, end in zip(rows, ends.tolist()):
                    out.append(None if x is None else raw[start:end])
                    start = end
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")
