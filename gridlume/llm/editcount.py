"""Token counts that follow edits: a segment tree over each document's pre-token runs.

A leaf is a run of whole pre-tokens of about LEAF characters that starts at ASCII white space
after a visible character, where no pre-token can cross, so leaves encode alone. The tree holds
sums of characters and tokens. An edit finds its leaves by descent, re-encodes only those plus
the neighbour whose border it touches, and renews the sums above them. Where an insertion needs
more leaves than the edit's slots, the smallest subtree around them with room deals its leaves out
anew, their counts kept; the tree doubles when none has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BATCH_BYTES, _encoding

LEAF = 256  #: characters of a leaf, about
FILL = 0.75  #: share of a subtree's slots that leaves dealt out anew may take
RESERVED = ("id", "text", "n_tokens", "n_chars", "tree_chars", "tree_tokens", "n_tokens_before", "encoded_chars")
_BLANK = " \t\n\r\x0b\x0c"


def leaf_texts(text: str, size: int = LEAF) -> list[str]:
    """The leaves of a text; together they are the text."""
    out, start = [], 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and not (text[cut] in _BLANK and not text[cut - 1].isspace()):
            cut += 1
        out.append(text[start:cut])
        start = cut
    if start < len(text) or not out:
        out.append(text[start:])
    return out


class TokenTree:
    """Sums by heap order: node i has children 2i and 2i + 1; leaves start at ``width``."""

    def __init__(self, leaves: list[str], chars: list[int], tokens: list[int]) -> None:
        self.leaves, self.chars, self.tokens = leaves, chars, tokens
        self.width = len(chars) // 2
        self.encoded = 0  #: characters encoded since

    @classmethod
    def build(cls, text: str, encoding: tiktoken.Encoding, size: int = LEAF) -> TokenTree:
        leaves = leaf_texts(text, size)
        width = 1 << (len(leaves) - 1).bit_length()
        tree = cls(leaves + [""] * (width - len(leaves)), [0] * (2 * width), [0] * (2 * width))
        for k, leaf in enumerate(tree.leaves):
            tree._set(k, leaf, encoding)
        for k in range(width - 1, 0, -1):
            tree._sum(k)
        return tree

    @classmethod
    def restore(cls, text: str, chars: list[int], tokens: list[int]) -> TokenTree:
        leaves, start = [], 0
        for n in chars[len(chars) // 2 :]:
            leaves.append(text[start : start + n])
            start += n
        return cls(leaves, list(chars), list(tokens))

    def _set(self, k: int, leaf: str, encoding: tiktoken.Encoding) -> None:
        self.leaves[k] = leaf
        self.chars[self.width + k] = len(leaf)
        self.tokens[self.width + k] = len(encoding.encode_ordinary(leaf)) if leaf else 0
        self.encoded += len(leaf)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, its start) of the character at ``place``; of the last one for the text's end."""
        place, k, start = min(place, max(0, self.chars[1] - 1)), 1, 0
        while k < self.width:
            k *= 2
            if place - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.width, start

    def edit(self, place: int, removed: int, inserted: str, encoding: tiktoken.Encoding, size: int = LEAF) -> None:
        place = min(max(place, 0), self.chars[1])
        end = min(place + max(removed, 0), self.chars[1])
        low, start = self.find(place)
        if place == start and start:  # the border before the leaf may go
            low, start = self.find(start - 1)
        high, stop = self.find(end)
        stop += len(self.leaves[high])
        if end == stop < self.chars[1]:
            high, stop = self.find(stop)
            stop += len(self.leaves[high])
        region = "".join(self.leaves[low : high + 1])
        region = region[: place - start] + inserted + region[end - start :]
        new = leaf_texts(region, size)
        if len(new) > high - low + 1:
            self._make_room(low, high, new, encoding)
            return
        for k, leaf in enumerate(new + [""] * (high - low + 1 - len(new))):
            self._set(low + k, leaf, encoding)
        self._renew(low, high)

    def _renew(self, low: int, high: int) -> None:
        """The sums above the leaves low to high."""
        first, last = (self.width + low) // 2, (self.width + high) // 2
        while first:
            for k in range(first, last + 1):
                self._sum(k)
            first, last = first // 2, last // 2

    def _make_room(self, low: int, high: int, new: list[str], encoding: tiktoken.Encoding) -> None:
        """Put the ``new`` leaves in place of low to high, which are too few; only they are encoded."""
        span = 1
        while True:
            start = low // span * span
            if start + span > high:
                ahead = [k for k in range(start, low) if self.leaves[k]]
                behind = [k for k in range(high + 1, min(start + span, self.width)) if self.leaves[k]]
                needed = len(ahead) + len(new) + len(behind)
                if needed <= FILL * span:
                    break
            span *= 2
        kept = lambda places: [(self.leaves[k], self.tokens[self.width + k]) for k in places]
        items = kept(ahead) + [(leaf, None) for leaf in new] + kept(behind)
        if span > self.width:  # the tree's other leaves are all in ``items``
            self.width = span
            self.leaves, self.chars, self.tokens = [""] * span, [0] * (2 * span), [0] * (2 * span)
        for k in range(start, start + span):
            self.leaves[k], self.chars[self.width + k], self.tokens[self.width + k] = "", 0, 0
        for n, (leaf, tokens) in enumerate(items):
            k = start + n * span // needed
            if tokens is None:
                self._set(k, leaf, encoding)
            else:
                self.leaves[k], self.chars[self.width + k], self.tokens[self.width + k] = leaf, len(leaf), tokens
        self._renew(start, start + span - 1)


_FIELDS = "n_tokens long, n_chars long, tree_chars array<int>, tree_tokens array<int>"


def _as_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 4 * len(row[1]) + 64
        if size >= BATCH_BYTES:
            yield batch(out)
            out, size = [], 0
    if out:
        yield batch(out)


def _ints(column: pa.Array, k: int) -> list[int]:
    return column[k].values.to_numpy(zero_copy_only=False).tolist()


def _schema(kind: pa.DataType, *more: tuple[str, pa.DataType]) -> pa.Schema:
    ints = pa.list_(pa.int32())
    return pa.schema([("id", kind), ("text", pa.string()), ("n_tokens", pa.int64()), ("n_chars", pa.int64()), ("tree_chars", ints), ("tree_tokens", ints), *more])


def count_tokens(docs: DataFrame, ranks: Broadcast, pattern: str, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Trees of whole texts: ``id``, ``text``, ``n_tokens``, ``n_chars``, ``tree_chars``, ``tree_tokens`` and the columns named in ``extra``.

    One row per input row; the id comes back as ``id``. A null text is empty; an empty one has a
    tree of one empty leaf and no tokens; null and repeated ids stay as they are. An extra column
    with a name of the tree's own, or of what ``apply_edits`` adds, comes back as ``extra_`` and
    that name; columns not named there are ignored.
    """
    named = {c: f"extra_{c}" if c in RESERVED else c for c in extra}
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in named.items()))
    extra = tuple(named.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            more = [(n, batch.schema.field(n).type) for n in extra]

            def rows(batch=batch):
                for k in range(batch.num_rows):
                    text = batch.column(1)[k].as_py()
                    tree = TokenTree.build(text, encoding)
                    yield (batch.column(0)[k].as_py(), text, tree.tokens[1], tree.chars[1], np.array(tree.chars, np.int32), np.array(tree.tokens, np.int32), *(batch.column(2 + e)[k].as_py() for e in range(len(extra))))

            yield from _as_batches(rows(), _schema(batch.schema.field(0).type, *more))

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    tail = "".join(f", `{c}` {kinds[c]}" for c in extra)
    return kept.mapInArrow(run, f"id {kinds['id']}, text string, {_FIELDS}{tail}")


def apply_edits(trees: DataFrame, ranks: Broadcast, pattern: str, edits_col: str = "edits") -> DataFrame:
    """The trees after each row's ``edits_col``, an array of (place, removed, inserted), applied in order.

    Places count characters of the text as the earlier edits left it and are clipped to it; a null
    array, edit, place or removal does nothing or counts 0, a null insertion is empty. Adds
    ``n_tokens_before`` and ``encoded_chars``, what the edits made it encode again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:

            def rows(batch=batch):
                ids, texts, chars, tokens, edits = (batch.column(c) for c in ("id", "text", "tree_chars", "tree_tokens", edits_col))
                for k in range(batch.num_rows):
                    tree = TokenTree.restore(texts[k].as_py(), _ints(chars, k), _ints(tokens, k))
                    before = tree.tokens[1]
                    for e in edits[k].as_py() or ():
                        if e is not None:
                            tree.edit(e["place"] or 0, e["removed"] or 0, e["inserted"] or "", encoding)
                    yield ids[k].as_py(), "".join(tree.leaves), tree.tokens[1], tree.chars[1], np.array(tree.chars, np.int32), np.array(tree.tokens, np.int32), before, tree.encoded

            yield from _as_batches(rows(), _schema(batch.schema.field("id").type, ("n_tokens_before", pa.int64()), ("encoded_chars", pa.int64())))

    kind = trees.schema["id"].dataType.simpleString()
    return trees.mapInArrow(run, f"id {kind}, text string, {_FIELDS}, n_tokens_before long, encoded_chars long")
