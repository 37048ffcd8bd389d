"""Tokenizer files inside tasks: loaded once per Python worker, never trained.

A path is a parameter and must exist on every executor (a vocabulary file of
an installed package); the default names the public vocabulary.
"""

from __future__ import annotations

import functools
import json

import numpy as np


def default_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@functools.cache
def load(path: str):
    """The tokenizer of a .json file, single-threaded, without padding or truncation."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable bytes stand for themselves, the others follow U+00FF in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Texts made of bytes below this one (code points below U+0240) are split
#: alike by both libraries; others go to the slower one.
ALIKE = 0xC9


@functools.cache
def _ranked(path: str):
    """The same byte-level vocabulary in the faster library."""
    import tiktoken
    spec = json.load(open(path, encoding="utf-8"))
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    import public_tokenizers
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def byte_level_ids(path: str, text: bytes) -> np.ndarray:
    """The ids of one UTF-8 text without added special tokens, as uint32."""
    if not text:
        return np.empty(0, np.uint32)
    if np.frombuffer(text, np.uint8).max() < ALIKE:
        return _ranked(path).encode_to_numpy(text.decode(), allowed_special="all").astype("<u4")
    return np.array(load(path).encode(text.decode(), add_special_tokens=False).ids, "<u4")
