"""Token counts by a public tokenizer, one encoder per Python worker."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's authors split text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level encoder of a rank file; special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


# Fixed value: the characters that the split pattern takes for white space.
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 100_000


def count_tokens(text: str | None, path: str = DEFAULT_VOCABULARY, long_run: int = LONG_RUN) -> int:
    """Tokens of a text; very long runs of white space are merged apart from the split.

    The split looks ahead at the end of a run and gives up on runs of a million
    characters. A run is one piece but for its last character, if text follows,
    so taking it out changes nothing.
    """
    if not text:
        return 0
    e = encoder(path)
    if len(text) < long_run:
        return len(e.encode_ordinary(text))
    total, at = 0, 0
    for m in re.finditer(f"{_WHITE}{{{long_run},}}", text):
        end = m.end() - (m.end() < len(text))
        total += len(e.encode_ordinary(text[at : m.start()])) + len(e._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(e.encode_ordinary(text[at:]))


def token_count(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of the whole text; a null or empty text has 0."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([count_tokens(t, path) for t in s], dtype="int32")

    return count(text)
