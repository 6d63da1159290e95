"""Anchors of repeated passages.

A window of tokens picks the least of its k-gram hashes as its anchor, the
leftmost of equals. Windows that are equal pick equal anchors at equal places,
wherever they stand, so a passage's windows are dealt to its anchors: a piece is
a run of windows with one anchor, with the tokens they cover. Equal windows in
different documents always lie in pieces with equal anchors.

Grams of frequent kinds come late in the order of hashes: a window takes such an
anchor only where it has no other, so a common phrase does not gather the many
different surroundings it stands in.
"""

from __future__ import annotations

import numpy as np

from curbside.llm.chunk_ids import piece_hashes, prefix_hashes
from curbside.llm.word_hashes import WordHashes

#: h: hash of the anchor; first: the piece's first token, n: its windows.
PIECE = np.dtype([("h", "<u8"), ("doc", "<u4"), ("first", "<i8"), ("n", "<u2")])
_PLACE = np.uint64((1 << 24) - 1)
#: Kinds of grams that are told apart as frequent or not.
KINDS = 1 << 20
#: Window starts that are worked on at one time.
SEGMENT = 1 << 19


def kinds_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(40)).astype(np.int64) & (KINDS - 1)


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    at = np.arange(max(0, len(tokens) - k + 1))
    return piece_hashes(prefix_hashes(tokens), at, at + k)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def pieces(tokens: np.ndarray, bounds: np.ndarray, window: int, k: int, late: np.ndarray | None = None) -> np.ndarray:
    """The pieces of texts that lie one after the other, in their order; ``late`` marks the frequent kinds of grams.

    Window starts are taken ``SEGMENT`` at a time, and a piece ends with its segment.
    """
    found = [np.zeros(0, PIECE)]
    for at in range(0, len(tokens) - window + 1, SEGMENT):
        to = min(len(tokens), at + SEGMENT + window - 1)
        own = _pieces(tokens[at:to], np.clip(bounds, at, to) - at, window, k, late)
        own["first"] += at
        found.append(own)
    return np.concatenate(found)


def _pieces(tokens: np.ndarray, bounds: np.ndarray, window: int, k: int, late: np.ndarray | None) -> np.ndarray:
    n = len(tokens)
    grams = gram_hashes(tokens, k)
    at = np.arange(len(grams), dtype=np.uint64)
    keyed = ((grams >> np.uint64(1)) & ~_PLACE) | (at & _PLACE)
    if late is not None:
        keyed |= late[kinds_of(grams)].astype(np.uint64) << np.uint64(63)
    least = least_of(keyed, window - k + 1)  # one for each window start
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(size), dtype=np.int64), size)
    inside = doc[: n - window + 1] == doc[window - 1 :]
    new = np.empty(len(inside), bool)
    new[0], new[1:] = True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (doc[1 : n - window + 1] != doc[: n - window])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    anchor = (least[first] & _PLACE).astype(np.int64)
    anchor += (first - anchor + (1 << 23)) >> 24 << 24  # texts of more than 2**24 tokens
    out = np.empty(len(first), PIECE)
    out["h"], out["doc"], out["first"], out["n"] = grams[anchor], doc[first], first, last - first + 1
    return out


def word_places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end of each word ``[^\\x20\\x09-\\x0D]+``, bounds of the texts' words)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros_like(bounds)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    edge = bounds[:-1][np.diff(bounds) > 0]
    begins[edge] = ~space[edge]
    start = np.flatnonzero(begins)
    stop = space
    stop[edge] = True
    # The next space or text start behind each word start ends the word.
    ends = np.append(np.flatnonzero(stop), len(data))
    return start, ends[np.searchsorted(ends, start, "right")], np.searchsorted(start, bounds)


def word_tokens(data: np.ndarray, bounds: np.ndarray, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds of the texts' words)."""
    raw, sizes, found = data.tobytes(), [0], [np.zeros(0, np.uint64)]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        words = raw[a:b].split()
        sizes.append(len(words))
        found.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(found), np.cumsum(sizes)
