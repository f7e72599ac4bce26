"""Byte-level BPE ids and counts of whole texts, equal to those of the tokenizers library."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from .common import per_process

#: The pre-token pattern of byte-level BPE. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges whose letters, digits and spaces are classed alike by all the libraries used (a test tries each code point).
#: A text with any other character goes through the tokenizers library as a whole.
OTHER = re.compile("[^\u0000-\u0557\u0600-\u085f\u0900-\u0bff\u2000-\u2060\u20a0-\u20bf\u2100-\u214f\u2190-\u2bff\u3000-\u30ff\u4e00-\u9fef\uac00-\ud7a3\U0001f300-\U0001f5ff]")
KEEP = 300_000


def once(make):
    """Make it once for a path and process."""
    name = make.__name__

    @functools.wraps(make)
    def kept(path: str):
        return per_process((name, path), lambda: make(path))

    return kept


@once
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@once
def parts(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """The vocabulary as byte strings with ids, and the special strings that a text may hold.

    Raises if the file is not a plain byte-level BPE, whose ids follow the order of its merges.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model, added = spec["pre_tokenizer"], spec["model"], spec.get("added_tokens") or []
    plain = pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if model["type"] != "BPE" or not plain or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}
    special = {a["content"]: a["id"] for a in added}
    ranks = {bytes(char[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
    made = [ranks[bytes(char[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError(f"the ids in {path} do not follow its merges")
    return ranks, special


@once
def fast(path: str) -> tiktoken.Encoding:
    ranks, special = parts(path)
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def ids(path: str, text: str | None) -> np.ndarray:
    """Ids of a whole text, as unsigned 32-bit numbers."""
    if not text:
        return np.zeros(0, np.uint32)
    if OTHER.search(text):
        return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.frombuffer(fast(path).encode_to_numpy(text, allowed_special="all"), np.uint32)


@once
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proven to encode alone as one token: each is a pre-token by itself, and merging it gives one id."""
    ranks, special = parts(path)
    cut = regex.compile(PATTERN)
    texts = []
    for raw in ranks:
        try:
            s = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if s not in special and not OTHER.search(s) and cut.findall(s) == [s]:
            texts.append(s)
    t = tokenizer(path)
    return frozenset(s for s in texts if len(t.encode(s, add_special_tokens=False).ids) == 1)


class Counts(dict):
    """Tokens of each pre-token: one for the proven strings, merged for the rest when first met."""

    def __init__(self, path: str):
        super().__init__(dict.fromkeys(whole_tokens(path), 1))
        self.proven, self.merge = len(self), tokenizer(path)

    def __missing__(self, pre: str) -> int:
        n = len(self.merge.encode(pre, add_special_tokens=False).ids)
        if len(self) < self.proven + KEEP:
            self[pre] = n
        return n


@once
def counter(path: str):
    """A function that counts the tokens of a whole text."""
    table, cut = Counts(path), regex.compile(PATTERN)
    special = regex.compile("|".join(map(regex.escape, parts(path)[1])) or r"(?!)")
    signs = [s[:2] for s in parts(path)[1]]

    def count(text: str | None) -> int:
        if not text:
            return 0
        if OTHER.search(text):
            return len(table.merge.encode(text, add_special_tokens=False).ids)
        if not any(s in text for s in signs):
            return sum(map(table.__getitem__, cut.findall(text)))
        pieces = special.split(text)
        return len(pieces) - 1 + sum(sum(map(table.__getitem__, cut.findall(p))) for p in pieces)

    return count
