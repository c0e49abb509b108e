"""Token ids of the public byte-level BPE vocabulary inside tasks. Files are read from a path that is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str, special_as_text: bool = False) -> list[int]:
    """Ids of a whole text; null counts as empty. The string of the special token becomes its id, as the tokenizer's JSON file asks for, unless it
    is to be ordinary text."""
    enc = _encoding(path)
    if not text:
        return []
    if special_as_text or SPECIAL not in text:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for i, part in enumerate(text.split(SPECIAL)):
        ids += ([SPECIAL_ID] if i else []) + enc.encode_ordinary(part)
    return ids
