"""Vocabulary files of public tokenizers and their byte alphabet."""

from __future__ import annotations

import json
from functools import cache


@cache
def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the characters from
    256 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(other) for b in range(256)]


@cache
def load(path: str) -> dict:
    """A tokenizer's JSON file; kept once per process."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)


@cache
def fast_encoder(path: str):
    """The tokenizer of a byte-level file without normaliser, with its ids.

    Ids of such a file follow the order of its merges, so that they serve as
    ranks; strings of special tokens in a text become their ids, as in the
    tokenizers library.
    """
    import tiktoken

    file = load(path)
    back = {c: b for b, c in enumerate(byte_characters())}
    ranks = {bytes(back[c] for c in token): i for token, i in file["model"]["vocab"].items()}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


@cache
def library(path: str):
    """The tokenizers library's own tokenizer of a file, without truncation and padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encoded(path: str, text: str) -> list[int]:
    """Ids of a text by the fast encoder; by the library where that gives up, as on a million blanks in a row."""
    try:
        return fast_encoder(path).encode(text, allowed_special="all")
    except ValueError:
        return library(path).encode(text, add_special_tokens=False).ids
