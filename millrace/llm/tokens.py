"""Token ids of whole texts by a public byte-level vocabulary."""

from __future__ import annotations

import base64

from millrace.plans.shipping import worker_cache

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Id of a document's end in the default vocabulary's numbering (free there).
END = 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str = VOCABULARY):
    """The encoder of a rank file, built once in a worker."""
    cache = worker_cache().setdefault("encodings", {})
    if path not in cache:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        cache[path] = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache[path]


def size(path: str = VOCABULARY) -> int:
    """One more than the greatest id."""
    return encoding(path).max_token_value + 1
