"""The public byte-level BPE vocabulary, by its rank file.

The rank file holds the vocabulary of ``byte_bpe_50k.json`` (same merges, same
ids); tiktoken encodes it several times faster than tokenizers does, and tests
hold the ids of both against each other. Strings of special tokens inside a text
are ordinary text. Encoders are kept per Python worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters encoded at a time.
PIECE = 1 << 20

_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(path: str | None = None) -> tiktoken.Encoding:
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN,
                                            mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts before the first blank after a word: no token of the pattern spans one,
    so the pieces' tokens are the text's. A stretch without one stays whole."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut].isspace() and not text[cut - 1].isspace()):
            cut += 1
        if cut >= len(text):
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def encode(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a whole text (uint32)."""
    # Lone surrogates cannot come out of a table's UTF-8 strings.
    got = [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text) if p]
    if not got:
        return np.zeros(0, np.uint32)
    return (got[0] if len(got) == 1 else np.concatenate(got)).astype(np.uint32, copy=False)
