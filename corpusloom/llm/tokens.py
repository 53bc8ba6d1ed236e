"""Token ids of a public byte-level tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

DEFAULT = "byte_bpe_50k.json"


@functools.cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by the tokenizer file, special tokens not added.

    Where the same vocabulary lies beside it as ranks, these give the same ids in a third of the time. Texts in which a
    special token is spelt out, and any that the faster form refuses, go through the tokenizer itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = Tokenizer.from_file(path)
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    slow = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, "<u4")
    ranks_path = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks_path):
        return slow
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return slow(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except (ValueError, RuntimeError):
            return slow(text)

    return encode
