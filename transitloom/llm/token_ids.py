"""Exact ids of a byte-level BPE vocabulary, in bulk.

`BpeIds` gives the ids of `tokenizers` for `byte_bpe_50k.json`.  The rank file of the same vocabulary is several times
as fast through `tiktoken`; it is used for texts without a special token's string whose characters all lie below
U+0250, where both libraries' character classes are the same (tests compare them), and `tokenizers` for the rest.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np

_BEYOND = re.compile("[^\x00-ɏ]|<\\|endoftext\\|>")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class BpeIds:
    def __init__(self, json_path: str | None = None, rank_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path or default_path("byte_bpe_50k.json"))
        self.fast = None
        if json_path is None or rank_path is not None:
            import public_tokenizers
            import tiktoken

            with open(rank_path or default_path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.fast is None or _BEYOND.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def array(self, text: str | None, end_id: int | None = 0) -> np.ndarray:
        ids = self.encode(text)
        if end_id is not None:
            ids.append(end_id)
        return np.array(ids, dtype="<u4")


@functools.lru_cache(maxsize=2)
def bpe(json_path: str | None = None, rank_path: str | None = None) -> BpeIds:
    """One encoder for each worker process."""
    return BpeIds(json_path, rank_path)
