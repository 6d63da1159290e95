"""Substring dedup of words by suffix automata of reference shards.

The references are the corpus itself: what other documents hold around each
shared anchor (see ``passages``), one copy of each piece. They have no size
bound, so they are not broadcast as a whole: they are cut into shards of bounded
size, and a shard's automaton is built in the task to which all pieces that
could match it are dealt. All pieces, those with no rival too, stream through
the automaton of every shard of their own anchor. The state after a word is the longest match that ends
there, kept at the length of a window, and tells the least document that has
that window.

Defined cases: a null or blank text has no words. Texts shorter than the window
keep all words. A null id is smaller than none; rows of equal id don't remove
from each other. An empty table gives an empty result. Very long texts are worked
on whole, one at a time. Columns beside id and text are not read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from curbside.llm.bwt_dedup import _cells
from curbside.llm.passages import Passages, removed, sha256_hex
from curbside.llm.winnow import word_places

#: Words of a shard's automaton.
SHARD = 1 << 15
#: Words of a window's anchor.
ANCHOR = 5


class SuffixAutomaton:
    """Automaton of all substrings of some sequences; each state knows the least id that has it."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [np.iinfo(np.int64).max]

    def _state(self, length: int, follow: dict[int, int], link: int, least: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.least.append(least)
        return len(self.length) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.least[0])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], owner: int) -> None:
        nexts, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for word in words:
            q = nexts[last].get(word)
            if q is not None:  # the sequence so far was in an earlier one
                last = q if length[q] == length[last] + 1 else self._clone(last, word, q)
            else:
                new = self._state(length[last] + 1, {}, 0, least[0])
                p = last
                while p >= 0 and word not in nexts[p]:
                    nexts[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nexts[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
                last = new
            if owner < least[last]:
                least[last] = owner

    def settle(self) -> None:
        """Hands each state's least id on to its suffixes."""
        link, least = self.link, self.least
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            u = link[v]
            if u > 0 and least[v] < least[u]:
                least[u] = least[v]

    def windows(self, words: list[int], window: int) -> list[int]:
        """For each window of a sequence the least id that has it, or the largest number."""
        nexts, link, length, least = self.next, self.link, self.length, self.least
        state, matched, none, out = 0, 0, np.iinfo(np.int64).max, []
        for i, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            follow = nexts[state].get(word)
            if follow is None:
                matched = 0
            else:
                state, matched = follow, matched + 1
                if matched > window:
                    matched = window
                while length[link[state]] >= matched > 0 and link[state] > 0:
                    state = link[state]
            if i >= window - 1:
                out.append(least[state] if matched >= window else none)
        return out


def find(group: np.ndarray, tokens: Callable[[int, int], np.ndarray], size: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Least id of the pieces that have each window; ``tokens(a, b)`` are those of the pieces from a to b."""
    outs = np.concatenate([[0], np.cumsum(size - window + 1)])
    out = np.full(outs[-1], np.iinfo(np.int64).max, np.int64)
    own = ids.tolist()
    for a, b in _cells(group, size, SHARD):
        flat, ends = tokens(a, b).tolist(), np.cumsum(size[a:b]).tolist()
        words = {a + k: flat[end - n : end] for k, (end, n) in enumerate(zip(ends, size[a:b].tolist(), strict=True))}
        # One anchor's pieces may be more than a shard: each shard is then met by all of them.
        for i, j in _cells(np.arange(a, b), size[a:b], SHARD):
            automaton = SuffixAutomaton()
            for k in range(i + a, j + a):
                automaton.add(words[k], own[k])
            automaton.settle()
            for k in range(a, b):
                at = slice(outs[k], outs[k + 1])
                out[at] = np.minimum(out[at], automaton.windows(words[k], window))
    return out


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words as ``kept``, joined by spaces.

    A word goes if a window of ``window`` words covers it that also starts in a
    document with a smaller id.
    """

    def report(ids: pa.Array, data: np.ndarray, bounds: np.ndarray, of: np.ndarray, gone: np.ndarray) -> list:
        start, end, _ = word_places(data, bounds)
        n, _ = removed(of, gone)
        size, raw, texts = np.diff(of), data.tobytes(), []
        stay = ~gone
        for k in range(len(size)):
            if n[k]:
                own = np.flatnonzero(stay[of[k] : of[k + 1]]) + of[k]
                spans = zip(start[own].tolist(), end[own].tolist(), strict=True)
                texts.append(b" ".join([raw[x:y] for x, y in spans]))
            else:
                texts.append(b" ".join(raw[bounds[k] : bounds[k + 1]].split()))
        return [ids, size, n, sha256_hex(texts), *([texts] if with_text else [])]

    job = Passages("words", window, min(ANCHOR, window), lambda *a: find(*a, window))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * with_text
    return job.run(docs, report, schema, id_col, text_col)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 13)


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT win.doc_id, i FROM win JOIN least USING (g) WHERE m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(13) t(k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
