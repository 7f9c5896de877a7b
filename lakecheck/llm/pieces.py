"""Token ids of texts, by public vocabulary files."""

from __future__ import annotations

import base64
import os
import re
from functools import cache

import numpy as np

#: Both libraries cut texts of ASCII characters and these alike.
_OTHER = re.compile(r"[^\x00-\x7f¡-ɏ]")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine; each worker asks for its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _ranked(path: str):
    import public_tokenizers
    import tiktoken

    with open(path) as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(str.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_bpe_ids(text: str, path: str, ranks: str) -> np.ndarray:
    """Ids as the library of ``path`` gives them, without added special tokens.

    ``ranks`` holds the same vocabulary for a library that is four times as fast; it takes
    the texts on which both agree by construction.
    """
    if "<|" in text or not text.isascii() and _OTHER.search(text):  # the first may start a special token
        return np.asarray(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4")
    return np.asarray(_ranked(ranks).encode_ordinary(text), "<u4")
