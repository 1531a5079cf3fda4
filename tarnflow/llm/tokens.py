"""Token ids of a public byte-level BPE vocabulary, the same as those of the tokenizers library."""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np


class Encoder:
    """ids of texts under a tokenizer file of the tokenizers library.

    Where the same vocabulary lies beside it as ranks (same name, .tiktoken), tiktoken makes the same ids several times faster. Texts that hold
    the string of a special token always go through the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self._special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self._fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str, special: bool = True) -> np.ndarray:
        """special: strings of special tokens become their ids (as the library has it by default); else they are ordinary text."""
        if self._fast is not None and not (special and any(s in text for s in self._special)):
            return self._fast.encode_to_numpy(text, disallowed_special=())
        self._slow.encode_special_tokens = not special
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)
