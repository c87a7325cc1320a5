"""Token counters for the chunker: byte-pair encodings of public vocabulary files."""

from __future__ import annotations

import base64
from functools import lru_cache

#: Splits text before bytes are merged: contractions, words, numbers, other signs, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class BpeCounter:
    """Counts and slices by the tokens of a rank file; each worker loads the file at ``path``, which all of them must have.

    Counts don't add up over joins, so the chunker measures joined text with it.
    """

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        self.path, self.pattern = path, pattern

    def ids(self, text: str) -> list[int]:
        return _encoding(self.path, self.pattern).encode_ordinary(text)

    def __call__(self, text: str) -> int:
        return len(self.ids(text))

    def slices(self, text: str, size: int) -> list[str]:
        """A text cut after every ``size`` tokens; a cut inside a character gives U+FFFD there."""
        ids = self.ids(text)
        return [_encoding(self.path, self.pattern).decode(ids[i : i + size]) for i in range(0, len(ids), size)]
