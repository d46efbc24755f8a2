"""Token ids from the vocabulary files of public tokenizers."""

from __future__ import annotations

import base64
import os

import tiktoken

#: Folder of the vocabulary files on every machine; an argument of each operator that tokenizes.
TOKENIZERS = os.environ.get("PROVLAKE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, tiktoken.Encoding] = {}


def byte_bpe(folder: str = TOKENIZERS, file: str = BYTE_BPE) -> tiktoken.Encoding:
    """The byte-level BPE of a ranks file, loaded once a process."""
    path = os.path.join(folder, file)
    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(file, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]
