"""A public byte-level BPE tokenizer, read from a vocabulary file whose path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def load(path: str = DEFAULT) -> tiktoken.Encoding:
    """The tokenizer of a file of base64 tokens and ranks; kept per process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def sizes(path: str = DEFAULT) -> np.ndarray:
    """Bytes of each token id."""
    enc = load(path)
    out = np.zeros(enc.n_vocab, dtype=np.int64)
    for k in range(enc.n_vocab):
        try:
            out[k] = len(enc.decode_single_token_bytes(k))
        except KeyError:  # an id without a token
            pass
    return out
