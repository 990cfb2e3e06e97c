"""Token ids of a byte-level BPE vocabulary file, on executors."""

from __future__ import annotations

import functools
import json

import numpy as np


def vocabulary(path: str) -> tuple[dict[bytes, int], list[int]]:
    """Bytes of every token by id, and the ids that merges make, in order of the merges.

    In a byte-level vocabulary every byte is written as one printable character: printable bytes as themselves, the
    others as the characters from 256 on, in order.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    tokens = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
    return tokens, [model["vocab"][a + b] for a, b in merged]


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """encode(text) -> ids, for the vocabulary in the JSON file at `path`; loaded once in each Python worker.

    The file's own library gives the same ids (tested), at about a fifth of the speed, for it also tracks offsets.
    """
    import tiktoken

    tokens, made = vocabulary(path)
    # A merge's rank is the id of what it makes, if ids grow with the merges. Other tokens than these and single bytes never
    # come out of the file's own library.
    if any(x >= y for x, y in zip(made, made[1:])):
        raise ValueError(f"{path}: ids do not follow the order of merges")
    known = set(made)
    ranks = {k: v for k, v in tokens.items() if len(k) == 1 or v in known}
    if set(ranks.values()) != set(range(len(ranks))):
        raise ValueError(f"{path}: ids have gaps")
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


@functools.lru_cache(maxsize=2)
def decoder(path: str):
    """decode(ids) -> text."""
    parts = {i: raw for raw, i in vocabulary(path)[0].items()}
    return lambda ids: b"".join(map(parts.__getitem__, ids.tolist())).decode()


def ids_of(text: str, encode) -> np.ndarray:
    # Long texts go through in parts cut before a space that follows a letter or digit: no token spans such a place.
    if len(text) < 1 << 20:
        return np.array(encode(text), "<u4")
    parts, start = [], 0
    while start < len(text):
        end = start + (1 << 20)
        while end < len(text) and not (text[end] == " " and text[end - 1].isalnum() and text[end + 1:end + 2].isalnum()):
            end += 1
        parts.append(np.array(encode(text[start:end]), "<u4"))
        start = end
    return np.concatenate(parts)
