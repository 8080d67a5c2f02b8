"""Token ids of byte-level BPE vocabularies, in Arrow batches."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Fixed value: how this family of vocabularies splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of a vocabulary file of the tokenizers library, without special tokens added.

    The same merges run in the tiktoken library, which is several times as fast. Texts
    that contain the string of a special token, or that its pattern engine rejects, go
    to the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._path, self._exact = path, None
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        symbols = _byte_symbols()
        ranks = {bytes(symbols[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in self._special}
        #: Smallest type that holds every id.
        self.dtype = np.dtype("<u2" if max(spec["model"]["vocab"].values()) < 1 << 16 else "<u4")
        self._fast = tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Ids of one text as 32-bit numbers."""
        if not any(s in text for s in self._special):
            try:
                return np.array(self._fast.encode_ordinary(text), np.uint32)
            except ValueError:  # a pattern step limit, on odd and very long texts
                pass
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self._path)
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)
