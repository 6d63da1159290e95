"""Suffix-array dedup of bytes by merging Burrows-Wheeler transforms.

Which bytes repeat is decided per part (see ``passages``) on one copy of each
piece of text around a shared anchor, for all such pieces. The pieces of a part
are taken in cells, never parting the pieces of one anchor, and a cell in
shards. Each shard's suffixes are sorted by themselves, which gives its
transform. The shards are then merged by refining an interleave: a list that
says, for each rank of the merged order, from which shard its suffix comes.
Each round sorts it stably by the two symbols before the suffixes, read from the
transforms, and so extends the prefixes it is sorted by by two symbols; no
suffix is compared or sorted again. Borders between ranks with different
prefixes are carried along. A rank that stands alone between two borders stays
alone, as do the ranks that come from it, and is left out from there on. After
half as many rounds as the window has bytes, the ranks between two borders are
the suffixes with a common prefix of a whole window: the repeated intervals.

Defined cases: a null text is an empty one; texts shorter than the window keep
all bytes, as do the documents of a null id's equals: a null id is smaller than
none. Rows of equal id don't remove from each other. An empty table gives an
empty result. Very long texts are worked on whole, one at a time. Columns beside
id and text are not read, whatever their names. Windows may have any length up
to 65,000 bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from curbside.llm.passages import Passages, removed, sha256_hex

#: Symbols of a cell, unless one anchor has more, and of a shard.
CELL, SHARD = 1 << 16, 1 << 14
#: Length of the anchors of a window.
ANCHOR = 17


def shard_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a shard in the order of their first ``depth`` symbols at least; zeros end the pieces.

    Doubling: the ranks of suffixes by h symbols give those by 2h.
    """
    n = len(text)
    bits = np.uint64(max(1, int(n).bit_length()))
    x = np.concatenate([text, np.zeros(4, text.dtype)]).astype(np.uint64)
    key = (x[:n] << np.uint64(24)) | (x[1 : n + 1] << np.uint64(16)) | (x[2 : n + 2] << np.uint64(8)) | x[3 : n + 3]
    mask = (np.uint64(1) << bits) - np.uint64(1)
    h = 4
    while True:
        both = np.sort((key << bits) | np.arange(n, dtype=np.uint64))
        order = (both & mask).astype(np.int64)
        if h >= depth:
            return order
        both >>= bits
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(True, both[1:] != both[:-1]))
        key = rank << bits
        key[: max(0, n - h)] |= rank[h:]
        h *= 2


def merged_classes(shards: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """For each shard and each place in it, the class of the suffix there by its first ``depth`` symbols.

    Shards are texts of symbols 1 to 255, each piece ended by a zero. Classes of
    several suffixes are numbered in the order of the merged suffix array; a
    suffix that is alone in its class has a negative number of its own.
    """
    orders = [shard_order(s, depth) for s in shards]
    edges = np.concatenate([[0], np.cumsum([len(o) for o in orders])])
    codes, steps, first_steps = [], [], []
    for text, order, base in zip(shards, orders, edges, strict=False):
        ends = np.flatnonzero(text == 0)
        before = np.arange(-1, len(text) - 1)
        before[np.append(0, ends[:-1] + 1)] = ends  # a piece is read as a ring
        one = text[before]
        code = ((one[before].astype(np.uint16) << np.uint16(8)) | one)[order]
        codes.append(code)
        steps.append(_backward(code, base))
        if depth % 2:
            first_steps.append(_backward(code & 0xFF, base))
    code, step = np.concatenate(codes), np.concatenate(steps)
    n = len(code)
    at = np.arange(n, dtype=np.int32)  # rank in the merged order -> place in the shards' orders, one after the other
    block = np.zeros(n, np.int32)
    for k in range(-(-depth // 2)):
        odd = depth % 2 and not k  # an odd depth begins with one symbol
        symbol = code[at] & 0xFF if odd else code[at]
        to = np.argsort(symbol, kind="stable")
        symbol, old = symbol[to], block[to]
        border = np.ones(len(to) + 1, bool)
        border[1:-1] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        several = ~(border[:-1] & border[1:])
        block = np.cumsum(border[:-1], dtype=np.int32)[several]
        at = (np.concatenate(first_steps) if odd else step)[at[to[several]]]
    out = -1 - np.arange(n)
    out[at] = block
    found = []
    for order, base in zip(orders, edges, strict=False):
        classes = np.empty(len(order), np.int64)
        classes[order] = out[base : base + len(order)]
        found.append(classes)
    return found


def _backward(symbol: np.ndarray, base: int) -> np.ndarray:
    """For each place of a shard's order that of the suffix which begins with the symbols before it: a stable sort by these, inverted."""
    out = np.empty(len(symbol), np.int32)
    out[np.argsort(symbol, kind="stable")] = np.arange(base, base + len(symbol))
    return out


def find(group: np.ndarray, tokens: Callable[[int, int], np.ndarray], size: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Least id of the pieces that have each window; ``tokens(a, b)`` are those of the pieces from a to b."""
    out = np.empty(int((size - window + 1).sum()), np.int64)
    outs = np.concatenate([[0], np.cumsum(size - window + 1)])
    for a, b in _cells(group, size + 1, CELL):
        shards, places, who = [], [], []
        for i, j in _cells(np.arange(a, b), size[a:b] + 1, SHARD):
            i, j = i + a, j + a
            own = tokens(i, j)
            start = np.cumsum(size[i:j]) - size[i:j] + np.arange(j - i)
            text = np.zeros(len(own) + j - i, np.uint8)
            text[np.arange(len(own)) + np.repeat(np.arange(j - i), size[i:j])] = own + 1
            n = size[i:j] - window + 1
            first = np.cumsum(n) - n
            places.append(np.repeat(start - first, n) + np.arange(n.sum()))
            who.append(np.repeat(ids[i:j], n))
            shards.append(text)
        classes = np.concatenate([c[p] for c, p in zip(merged_classes(shards, window), places, strict=True)])
        holders = np.concatenate(who)
        shared = classes >= 0
        least = np.full(int(classes.max(initial=0)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, classes[shared], holders[shared])
        holders[shared] = least[classes[shared]]
        out[outs[a] : outs[b]] = holders
    return out


def _cells(group: np.ndarray, size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of pieces of ``most`` symbols or so that part no group."""
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    total = np.cumsum(size)[ends - 1]
    out, start, done = [], 0, 0
    while start < len(group):
        k = max(int(np.searchsorted(total, done + most, "right")) - 1, int(np.searchsorted(ends, start, "right")))
        out.append((start, int(ends[k])))
        start, done = int(ends[k]), int(total[k])
    return out


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes as ``kept``.

    A byte goes if a window of ``window`` bytes covers it that also starts in a
    document with a smaller id.
    """

    def report(ids: pa.Array, data: np.ndarray, bounds: np.ndarray, of: np.ndarray, gone: np.ndarray) -> list:
        n, spans = removed(of, gone)
        kept, size = data[~gone].tobytes(), np.diff(bounds)
        ends = np.cumsum(size - n)
        texts = [kept[a:b] for a, b in zip((ends - (size - n)).tolist(), ends.tolist(), strict=True)]
        return [ids, size, n, spans, sha256_hex(texts), *([texts] if with_text else [])]

    job = Passages("bytes", window, min(ANCHOR, window), lambda *a: find(*a, window))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return job.run(docs, report, schema, id_col, text_col)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50)


# Windows are compared as hexadecimal digits, two for each byte. Of a text's hits those that overlap or touch are one run.
OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM win JOIN least USING (g) WHERE m < doc_id OR (doc_id IS NULL AND m IS NOT NULL)),
run AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i - p > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM hit),
span AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY r, k),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS f FROM span),
kept AS (
  SELECT r, sum(b - a)::BIGINT AS n, count(*) AS k, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest
  FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
