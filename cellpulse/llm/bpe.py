"""Byte-level BPE ids from a tokenizer file, with byte lengths for offsets.

The file is the JSON form of the ``tokenizers`` library. Where its merges are numbered in order, as in
byte-level vocabularies of that kind, its ids are exactly ranks, and ``tiktoken`` gives the same ids several times
faster; any other file, and any text that the faster encoder refuses, goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
"""How byte-level pre-tokenization cuts a text (fixed value)."""


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it is printable, else the next free code point from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """``added`` says what becomes of the strings of added tokens in a text: by default they are plain text, with ``added`` they get their own
    ids, as the ``tokenizers`` library does unless told otherwise."""

    def __init__(self, path: str, added: bool = False) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = not added
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = _ranked(spec)
        alphabet = byte_alphabet()
        size = 1 + max(self.slow.get_vocab(with_added_tokens=True).values())
        self.token_bytes = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        own = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        for token, i in own.items():
            self.token_bytes[i] = token.encode()
        self.byte_lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.marks = tuple(own) if added else ()

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(m in text for m in self.marks):
            try:
                return np.array(self.fast.encode_ordinary(text), dtype="<u4")
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # noqa: BLE001, S110  the native encoder panics on some very long runs, and its panic is no Exception
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def _ranked(spec: dict):  # noqa: ANN202
    """The rank form of a byte-level BPE file, or None if the file is of another kind."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    if model.get("type") != "BPE" or not plain or model.get("ignore_merges") or model.get("dropout"):
        return None
    vocab, alphabet = model["vocab"], byte_alphabet()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    in_order = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
    if not in_order or any(vocab.get(c, 256) > 255 for c in alphabet):
        return None
    import tiktoken

    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> Encoder:
    return Encoder(path, added)
