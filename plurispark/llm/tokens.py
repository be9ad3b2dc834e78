"""Token ids of whole texts under a public byte-level vocabulary."""

from __future__ import annotations

import numpy as np

#: Ids of the vocabularies used here stay below 65 536.
DTYPE = "<u2"


def encoder(name: str):
    """A function from text to the packed ids of the whole text (null or empty: none).

    *name* is the vocabulary's file stem: ``<name>.json`` and ``<name>.tiktoken`` are
    one vocabulary for two libraries with equal ids. The second is several times
    faster; a text with ``<|`` in it may name a special token and goes to the first.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full: list[Tokenizer] = []

    def encode(text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, DTYPE)
        if "<|" in text:
            if not full:
                full.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
            return np.asarray(full[0].encode(text, add_special_tokens=False).ids, DTYPE)
        return np.asarray(fast.encode_ordinary(text), DTYPE)

    return encode
