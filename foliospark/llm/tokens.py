"""Token ids of a public byte-level vocabulary, given by its path.

The ids are those of the ``.json`` vocabulary. Its ``.tiktoken`` sibling holds the same vocabulary as ranks, and that
library gives the same ids about four times as fast; where there is no sibling, the ``.json`` file is used itself.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def added_tokens(path: str) -> dict[str, int]:
    """Strings that the vocabulary file gives an id of their own, outside its merges."""
    with open(path, encoding="utf-8") as file:
        return {x["content"]: x["id"] for x in json.load(file).get("added_tokens", [])}


@functools.cache
def encoder(path: str):
    """A function from a text to its list of ids, those that the library ``tokenizers`` gives by default without special tokens around the text: an added token inside the text has its own id."""
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        plain = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        added = added_tokens(path)
        if not added:
            return plain
        cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

        def encode(text: str) -> list[int]:
            if not any(x in text for x in added):
                return plain(text)
            ids: list[int] = []
            for i, part in enumerate(cut.split(text)):
                ids += [added[part]] if i % 2 else plain(part)
            return ids

        return encode
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
