"""Token ids of whole texts, from a public vocabulary file that is a parameter and never copied."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

END = 0  # the id that closes every document
#: The splitting pattern of byte-level vocabularies, with the branch that words take first and without going back. Only
#: an apostrophe begins a contraction and nothing follows a branch, so the pieces are those of the pattern as published.
PIECES = r""" ?\p{L}++|'(?:[sdmt]|ll|ve|re)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies print a byte as itself where it is visible, and else as the next letter from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """An encoder of the byte-level BPE in a tokenizers JSON file.

    The merges of such a file are in the order of the ids they make, so its vocabulary is a table of ranks and the
    faster of the two installed libraries gives the same ids (tests compare them).
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
    letters = _byte_of_letter()
    ranks = {
        bytes(letters[c] for c in piece): rank for piece, rank in spec["model"]["vocab"].items() if piece not in special
    }
    return tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A single space between visible characters: no piece of the splitting pattern reaches over its left side.
CUT = re.compile(r"(?<=\S) (?=\S)")


def token_ids(text: str | None, path: str, part: int = 1 << 20) -> np.ndarray:
    """All ids of a text and the closing id; a null text is empty.

    Very long texts are encoded part by part, cut only where the encoder itself would cut, so memory is bounded by
    the parts and the ids are the same.
    """
    text, encode, rows, start = text or "", encoder(path).encode_to_numpy, [], 0
    while len(text) - start > part:
        cut = CUT.search(text, start + part)
        if cut is None:
            break
        rows.append(encode(text[start:cut.start()], allowed_special="all"))
        start = cut.start()
    return np.concatenate([*rows, encode(text[start:], allowed_special="all"), np.array([END], dtype=np.uint32)])


def width(path: str) -> str:
    """The narrowest unsigned type for the ids of a vocabulary."""
    return "<u2" if encoder(path).n_vocab <= 1 << 16 else "<u4"
