"""Pieces of a text before byte-pair merging, with a fast path for common characters.

Only texts made of the characters listed here take the fast path; any other text,
and any text with a special token's string, goes through the tokenizers library
as a whole.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A character for which regex engines and Unicode versions might disagree.
UNCOMMON = re.compile("[^\t\n\r\x20-\x7e¡«»¿À-įı-ňŊ-ž–—‘’“”…]")
#: Patterns of the two public tokenizers (fixed values).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces whose encoding a worker remembers; beyond it starts anew.
CACHE_ENTRIES = 400_000
#: Characters beyond which a piece is not remembered.
LONG_PIECE = 64

#: The character that stands for each byte in byte-level vocabularies: its own if printable, else from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SYMBOL_OF = dict(zip([*_PRINTABLE, *sorted({*range(256)} - {*_PRINTABLE})], map(chr, [*_PRINTABLE, *range(256, 324)])))


def common(text: str, specials: tuple[str, ...]) -> bool:
    """Whether the fast path may be taken."""
    if any(s in text for s in specials):
        return False
    return UNCOMMON.search(text) is None


def load(path: str):
    """The tokenizer of a file, and its special tokens' strings."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    specials = tuple(t.content for t in tok.get_added_tokens_decoder().values())
    return tok, specials
