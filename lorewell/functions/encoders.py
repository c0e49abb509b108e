"""The default encoder and pair scorer: deterministic, from hashed tokens. Real models are passed in as callables of the same form."""

from __future__ import annotations

import re
import zlib

import numpy as np

TOKEN = re.compile(r"\w+")


class HashedTokens:
    """Texts -> (dense vectors of length 1, sparse token weights). A token's place and sign in the dense vector come from its CRC. Both modes are alike."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str], mode: str = "document") -> tuple[np.ndarray, list[dict[int, float]]]:
        dense = np.zeros((len(texts), self.dim))
        sparse: list[dict[int, float]] = []
        for row, text in enumerate(texts):
            weights: dict[int, float] = {}
            for token in TOKEN.findall(text.lower()):
                h = zlib.crc32(token.encode())
                weights[h] = weights.get(h, 0.0) + 1.0
                dense[row, h % self.dim] += 1.0 if (h >> 20) & 1 else -1.0
            sparse.append(weights)
        length = np.linalg.norm(dense, axis=1, keepdims=True)
        return (dense / np.where(length > 0, length, 1)).astype(np.float32), sparse
