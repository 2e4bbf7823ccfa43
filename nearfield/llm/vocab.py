"""A byte-level BPE tokenizer as a table of pre-tokens, shared by counting and packing.

The library splits a text by a fixed pattern and merges bytes inside each
pre-token alone, so a text's ids are its pre-tokens' ids joined. That holds
where the pattern's character classes are those the library was built with:
texts with other characters, or with a special token's string, go to the
library whole.
"""

from __future__ import annotations

import json
import re
import struct

import regex
from tokenizers import Tokenizer, pre_tokenizers

#: The split of byte-level BPE vocabularies of this family, letters first (no other alternative starts where they match).
PATTERN = r""" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same where all characters are below U+0250, and where all are ASCII, by the faster module.
LETTERS, NUMBERS, SPACES = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \x85\xa0"
LATIN = re.compile(rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+").findall
PLAIN = re.compile(r" ?[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A).findall
BEYOND = re.compile("[^\x00-\u024f]").search
#: Outside these ranges letters and numbers may be of another Unicode version than the library's.
UNSURE = re.compile("[^\u0000-\u0557\u0590-\u085f\u1e00-\u206f\u20a0-\u2bff\u3000-\u9fff\uac00-\ud7a3]")
#: Pre-tokens remembered by one worker beyond the vocabulary.
CACHE = 1_000_000


class Pretokens:
    """Splits texts for the table; `plain` is false where the file isn't of the kind that can be tabled."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.load(open(path))
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.plain = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not spec.get("normalizer")
            and spec["model"].get("type") == "BPE"
            and not spec["model"].get("dropout")
        )
        self.find = regex.compile(PATTERN).findall
        self.merge, self.chars = self.tok.model.tokenize, _byte_chars()

    def split(self, text: str) -> list[str] | None:
        """The pre-tokens, or None if the library must see the whole text."""
        if not self.plain or any(s in text for s in self.special):
            return None
        if text.isascii():
            return PLAIN(text)
        if not BEYOND(text):
            return LATIN(text)
        return None if UNSURE.search(text) else self.find(text)

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def merged(self, piece: str) -> list[int]:
        """The ids of one pre-token of split(), by the library's merges alone."""
        return [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.chars))]


def _byte_chars() -> dict[int, str]:
    """Each byte of UTF-8 to the character that stands for it in the vocabulary, as the library writes them."""
    spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    every = [*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x10000, 0x400), *range(0x10000, 0x110000, 0x10000)]
    return {b: c for x in map(chr, every) for b, c in zip(x.encode(), spell(x)[0][0])}


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings proven to encode alone as one token and to be one pre-token."""
    pre = Pretokens(path)
    if not pre.plain:
        return frozenset()
    from tokenizers import decoders

    decode = decoders.ByteLevel().decode
    strings = {decode([t]) for t in pre.tok.get_vocab(with_added_tokens=False)}
    strings = [s for s in strings if s and "�" not in s and pre.split(s) == [s]]
    return frozenset(s for s, e in zip(strings, pre.tok.encode_batch(strings, add_special_tokens=False)) if len(e.ids) == 1)


class Counts(dict):
    """Pre-token to number of tokens; starts from the proven strings, the rest is merged once and remembered."""

    def __init__(self, pre: Pretokens, proven: frozenset[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.pre, self.proven = pre, proven

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE + len(self.proven):
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        n = len(self.pre.merged(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n


class Ids(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, pre: Pretokens):
        super().__init__()
        self.pre = pre

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self.pre.merged(piece)
        b = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = b
        return b
