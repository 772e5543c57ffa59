"""Evaluation texts inside a corpus, by Wu-Manber multi-pattern search.

Texts are brought to their letters and digits (width and case folded).  A document holds an item if some run of
at least ceil(share * n) of the item's n letters stands in it unbroken.  As share > 1/2, every such run contains
the item's middle part, letters n - need to need: that *core* is what is searched for.  Of each core the window
of m letters (m a power of two) that the fewest other items have is its anchor.  Per window length the shift
table over blocks of three letters says which text positions can end an anchor at all; those that can are looked
up in the buckets of anchor hashes, and the items of a bucket are confirmed by direct comparison, extending the
match to both sides.

Items are taken in blocks of bounded size (*block_chars* letters); each block is broadcast and the corpus, read
whole, streams past it without a shuffle.  With more than one block the corpus is folded to its letters once and
written, and every block reads the folded texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialize, spread

_REST = re.compile(r"[\W_]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_BLOCK = 3
_BITS = 22
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def letters(s: str) -> str:
    """The letters and digits of a text, width and case folded."""
    return _REST.sub("", s if s.isascii() else unicodedata.normalize("NFKC", s)).lower()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Patterns:
    """The shift tables and anchor buckets of one block of items."""

    def __init__(self, items: list[str], tenths: int = 7):
        self.items = items
        self.need = [-(-tenths * len(s) // 10) for s in items]
        self.classes: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        by_class: dict[int, list[int]] = {}
        for i, s in enumerate(items):
            core = 2 * self.need[i] - len(s)
            by_class.setdefault(1 << min(4, core.bit_length() - 1), []).append(i)
        for m, ids in sorted(by_class.items()):
            self.classes.append(self._tables(m, ids))

    def _tables(self, m: int, ids: list[int]) -> tuple:
        cores = [self.items[i][len(self.items[i]) - self.need[i] : self.need[i]] for i in ids]
        codes = np.frombuffer("".join(cores).encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = np.array([len(c) for c in cores])
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        windows = n - m + 1
        owner = np.repeat(np.arange(len(ids)), windows)
        at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(first, windows) + at
        h = window_hashes(codes, start, m)
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        order = np.lexsort((at, count[inverse], owner))
        pick = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
        by_hash = np.argsort(h[pick], kind="stable")
        pick = pick[by_hash]
        offset = at[pick] + (np.array([len(self.items[ids[o]]) - self.need[ids[o]] for o in owner[pick]], np.int64))
        last = start[pick] + m
        block = min(m, _BLOCK)
        shift = np.full(1 << _BITS, min(255, m - block + 1), np.uint8)
        for back in range(m - block, -1, -1):
            shift[block_index(codes, last - back - block, block)] = back
        return m, shift, h[pick], np.array(ids)[owner[pick]], offset

    def find(self, docs: list[str]) -> list[tuple[int, int]]:
        """Distinct (document, item) numbers of all documents, each text in letters()."""
        text = "\x00".join(docs) + "\x00"
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.array([len(d) + 1 for d in docs])
        begin = np.cumsum(lengths) - lengths
        sums, inv = None, None
        blocks: dict[int, np.ndarray] = {}
        found: set[tuple[int, int]] = set()
        for m, shift, hashes, owner, offset in self.classes:
            if len(codes) < m:
                continue
            block = min(m, _BLOCK)
            if block not in blocks:
                blocks[block] = block_index(codes, None, block)
            possible = np.flatnonzero(shift[blocks[block][m - block :]] == 0)  # starts of windows whose last block ends an anchor
            if not len(possible):
                continue
            if sums is None:
                sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * _powers(_BASE, len(codes)))])
                inv = _powers(_BASE_INV, len(codes))
            h = (sums[possible + m] - sums[possible]) * inv[possible]
            left = np.searchsorted(hashes, h, "left")
            hit = (left < len(hashes)) & (hashes[np.minimum(left, len(hashes) - 1)] == h)
            possible, left, h = possible[hit], left[hit], h[hit]
            right = np.searchsorted(hashes, h, "right")
            in_doc = np.searchsorted(begin, possible, "right") - 1
            for p, a, b, d in zip(possible.tolist(), left.tolist(), right.tolist(), in_doc.tolist(), strict=True):
                for k in range(a, b):
                    item = int(owner[k])
                    if (d, item) not in found and self._confirm(text, p, item, int(offset[k]), m):
                        found.add((d, item))
        return sorted(found)

    def _confirm(self, text: str, p: int, item: int, off: int, m: int) -> bool:
        s, need = self.items[item], self.need[item]
        if text[p : p + m] != s[off : off + m]:
            return False
        a, b = p, p + m
        i, j = off, off + m
        while i > 0 and a > 0 and b - a < need and text[a - 1] == s[i - 1]:
            a -= 1
            i -= 1
        while j < len(s) and b - a < need and text[b] == s[j]:
            b += 1
            j += 1
        return b - a >= need


def window_hashes(codes: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * _powers(_BASE, max(1, len(codes))))])
    return (sums[start + m] - sums[start]) * _powers(_BASE_INV, max(1, len(codes)))[start]


def block_index(codes: np.ndarray, start: np.ndarray | None, block: int) -> np.ndarray:
    """The place in the shift table of the blocks that begin at start, or of all."""
    n = len(codes) - block + 1
    h = np.zeros(n if start is None else len(start), np.uint64)
    for k in range(block):
        h += (codes[k : k + n] if start is None else codes[start + k]) * _MIX[k]
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


def _normalize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        norm = pa.array([letters(s) if s is not None else None for s in b.column(2).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), norm], names=["item_table", "item_id", "norm"])


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, tenths: int = 7, block_chars: int = 12_000_000, batch_chars: int = 1_500_000) -> DataFrame:
    """(doc_id, item_table, item_id), distinct: documents that hold at least tenths/10 of an item's letters unbroken.

    An item of a single letter is held by every document with that letter: the definition knows no least length.
    items has item_table, item_id, item_text.  Null texts, and items without a letter or digit, are held by none;
    repeated rows change nothing; equal item texts are searched once and reported under every id.
    """
    if not 5 < tenths <= 10:
        raise ValueError("tenths must be over 5: else a run need not contain the item's middle")
    spark = docs.sparkSession
    normal = items.select(F.col("item_table").cast("string"), F.col("item_id").cast("string"), F.col("item_text").cast("string")).filter("item_text is not null").distinct()
    normal = materialize(normal.mapInArrow(_normalize, "item_table string, item_id string, norm string").filter("norm <> ''").distinct(), "items")
    texts = materialize(normal.select("norm").distinct(), "item-texts")
    total = texts.agg(F.sum(F.length("norm"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    corpus = docs.select(F.col(doc_id), F.col(text).cast("string").alias("__text")).filter("__text is not null")
    corpus = spread(corpus)
    if blocks > 1:
        corpus = materialize(corpus.mapInArrow(_fold_texts, corpus.schema), "letters")
    schema = T.StructType([corpus.schema[doc_id], T.StructField("norm", T.StringType())])
    found = None
    for b in range(blocks):
        block = texts.filter(F.pmod(F.xxhash64("norm"), F.lit(blocks)) == b)
        tables = spark.sparkContext.broadcast(Patterns(block.toArrow()["norm"].to_pylist(), tenths))
        hits = corpus.mapInArrow(_scan(tables, batch_chars, doc_id, schema, blocks > 1), schema)
        if blocks > 1:
            hits = materialize(hits, "hits")
            tables.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found.join(normal, "norm").select(doc_id, "item_table", "item_id").distinct()


def _fold_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([letters(t) for t in b.column(1).to_pylist()], pa.string())], names=b.schema.names)


def _scan(tables, batch_chars: int, doc_id: str, schema: T.StructType, folded: bool):
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(schema[doc_id].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: Patterns = tables.value

        def flush(keys: list, texts: list[str]) -> pa.RecordBatch:
            pairs = patterns.find(texts) if texts else []
            return pa.RecordBatch.from_arrays([pa.array([keys[d] for d, _ in pairs], key_type), pa.array([patterns.items[i] for _, i in pairs], pa.string())], names=[doc_id, "norm"])

        keys: list = []
        texts: list[str] = []
        size = 0
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = t if folded else letters(t)
                keys.append(k)
                texts.append(t)
                size += len(t)
                if size >= batch_chars:
                    yield flush(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield flush(keys, texts)

    return run
