"""Hashes of words that tell different words apart."""

from __future__ import annotations

import hashlib


class WordHashes(dict):
    """64-bit BLAKE2b of each word; begins anew when it has grown large.

    Some two of n distinct words share a hash with a probability of about
    n**2 / 2**65, 3e-2 for a thousand million of them; it shows only where they
    stand in otherwise equal surroundings.
    """

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value
