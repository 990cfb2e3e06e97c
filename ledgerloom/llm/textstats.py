"""Counts over one text, on its UTF-8 bytes. Words are runs of bytes other than ASCII white space."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"

# One row per class of bytes, over all 256 values.
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58),
    "symbol": SYMBOLS, "mark": b"!?", "stop": b".,;:", "other": b"\"'()-/@[]\\^_`{}~+=",
    "space": [9, 10, 11, 12, 13, 32], "newline": [10], "tail": range(128, 192), "lead": range(192, 256),
    "control": [*range(9), *range(14, 32), 127],
}
CLASS_NAMES = list(_CLASSES)
_TABLE = np.zeros((256, len(_CLASSES)), np.int64)
for _i, _members in enumerate(_CLASSES.values()):
    _TABLE[list(_members), _i] = 1


def byte_classes(raw: bytes) -> dict[str, int]:
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return dict(zip(CLASS_NAMES, (counts @ _TABLE).tolist()))


def dup_lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    seen: set[bytes] = set()
    lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            seen.add(line)
    return lines, lines - len(seen)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of `width` words that are found twice or more in the list."""
    n = len(words)
    if n <= width:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    key = ids[:n - width + 1]
    for j in range(1, width):
        # Keys are numbered anew before each step, so the product is at most windows x distinct words.
        key = np.unique(key, return_inverse=True)[1] * len(names) + ids[j:n - width + 1 + j]
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[at] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def profile(raw: bytes) -> dict[str, float]:
    """Everything the quality operators look at, as plain counts."""
    c = byte_classes(raw)
    words = raw.split()
    lines, dups = dup_lines(raw)
    return {
        "n_bytes": len(raw), "n_chars": len(raw) - c["tail"], "n_words": len(words),
        "word_chars": len(raw) - c["tail"] - c["space"], "n_symbols": c["symbol"],
        "n_lines": lines, "n_dup_lines": dups, "n_repeat_words": repeated_words(words),
        "n_distinct": len(set(words)), "longest": max(map(len, words), default=0), "words": words, **c,
    }


def rates(p: dict[str, float]) -> list[float]:
    """Rates of a profile, in the order of RATES."""
    words, chars, solid = max(p["n_words"], 1), max(p["n_chars"], 1), max(p["word_chars"], 1)
    return [
        np.log1p(p["n_words"]), p["word_chars"] / words, p["upper"] / solid, p["digit"] / solid, p["symbol"] / words,
        p["mark"] / words, p["stop"] / words, p["other"] / words, p["lead"] / solid, p["control"] / chars,
        np.log1p(p["n_lines"]), p["n_words"] / max(p["n_lines"], 1), p["n_dup_lines"] / max(p["n_lines"], 1),
        p["n_repeat_words"] / words, p["n_distinct"] / words, np.log1p(p["longest"]), p["space"] / chars,
    ]


RATES = ["log_words", "word_length", "upper", "digit", "symbol", "mark", "stop", "other", "lead", "control",
         "log_lines", "line_words", "dup_lines", "repeat_words", "distinct", "log_longest", "space"]
