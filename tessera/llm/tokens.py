"""Byte-level BPE inside tasks, from public files of one vocabulary.

The ids are those of the tokenizers library with the JSON file and add_special_tokens=False: a special token's own string in a text, such as <|endoftext|>, gives that token's id. The library takes about 660 CPU seconds a GB of these texts, tiktoken with the same vocabulary's rank file about 250, so tiktoken encodes; tests hold the two together. Only its merges take n squared steps in a run without white space, so texts with such a run of over LONG_RUN characters go to the library itself. Either way the ids are the same.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np

LONG_RUN = 2000


class Encoder:
    """ids(text) of the vocabulary as uint32. width[id] is a token's length in bytes."""

    def __init__(self, ranks_path: str, json_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        with open(json_path, encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.width = np.zeros(max(*ranks.values(), *special.values()) + 1, np.int64)
        for token, rank in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.width[rank] = len(token)
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._json_path, self._slow = json_path, None

    def ids(self, text: str) -> np.ndarray:
        if len(text) > LONG_RUN and max(map(len, text.split()), default=0) > LONG_RUN:
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self._json_path)
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self._fast.encode_to_numpy(text, allowed_special="all"), np.uint32)


@lru_cache(2)
def encoder(ranks_path: str | None = None, json_path: str | None = None) -> Encoder:
    """One encoder a worker process. The default paths are looked up where the task runs."""
    import public_tokenizers

    return Encoder(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), json_path or public_tokenizers.path("byte_bpe_50k.json"))
