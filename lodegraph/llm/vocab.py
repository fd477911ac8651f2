"""Public tokenizer vocabularies as tiktoken encodings."""

from __future__ import annotations

import base64
import json
import os
from functools import cache


def path_of(name: str) -> str:
    """The place of a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoding(path: str):
    """The encoding of a file of ranks, loaded once per worker.

    Special tokens are those that the tokenizers file of the same name adds, if there is one.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    other = path.removesuffix(".tiktoken") + ".json"
    special = {}
    if other != path and os.path.exists(other):
        with open(other, encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
