"""Byte-level BPE ids, as the ``tokenizers`` library gives them, by a faster encoder of the same vocabulary.

A byte-level vocabulary whose merges stand in the order of their ids says the same as the ranks of their bytes: of two
neighbours the pair of least id is joined first. ``tiktoken`` encodes by ranks, about three times as fast as the
library and without remembering words, so memory does not grow with the texts. The file decides whether that holds (``ranks_of``);
where it does not, and for texts that hold the string of an added token, which the library cuts out first, or a run of white
space too long for the encoder's pattern, the library itself encodes.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

#: The pattern of byte-level pre-tokens (a fixed value), without giving back where nothing can follow: white space is cut before its last
#: blank, unless the text ends there.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: A run of white space that is left to the library.
_WIDE, _BLANKS = 10_000, re.compile(r"\s{10000}")
#: Entries of each of the two generations of a memory.
MEMORY = 400_000
_NONE: set[str] = set()


def _letters() -> dict[str, int]:
    """The letter of a byte-level vocabulary → its byte: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def ranks_of(model: dict) -> dict[bytes, int] | None:
    """Bytes → id of a tokenizer file whose ids are ranks; ``None`` for any other."""
    bpe, split = model["model"], model.get("pre_tokenizer") or {}
    if bpe.get("type") != "BPE" or model.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    if bpe.get("dropout") or bpe.get("continuing_subword_prefix") or bpe.get("end_of_word_suffix") or bpe.get("ignore_merges") or bpe.get("byte_fallback"):
        return None
    letters, added = _letters(), {t["content"] for t in model.get("added_tokens", ())}
    vocabulary = {k: i for k, i in bpe["vocab"].items() if k not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
    if any(vocabulary.get("".join(m)) != len(letters) + n for n, m in enumerate(merges)) or len(vocabulary) != len(letters) + len(merges):
        return None
    if any(c not in letters for k in vocabulary for c in k):
        return None
    return {bytes(letters[c] for c in k): i for k, i in vocabulary.items()}


class _Memory(dict):
    """``memory[key]`` computes and keeps what is missing; the older half is forgotten when both halves are full."""

    def __init__(self, compute):
        self.compute, self.old = compute, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Bpe:
    """``ids(text)``: the ids as little-endian unsigned 32-bit integers in one ``bytes``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            ranks = ranks_of(json.load(f))
        self.fast = None
        if ranks:
            import tiktoken

            # added tokens are never allowed in the call, so they change no ids; with none to look for, the encoder would stop at every place
            marks = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()} or {"\0" * 64: len(ranks)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=marks)

    def whole(self, text: str) -> bytes:
        """By the library itself."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if self.fast is None or any(token in text for token in self.added) or (len(text) >= _WIDE and _BLANKS.search(text)):
            return self.whole(text)
        try:
            return bytes(self.fast._core_bpe.encode_to_tiktoken_buffer(text, _NONE))  # without a list of Python integers
        except UnicodeEncodeError:
            return array("I", self.fast.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One encoder for each worker process and vocabulary file."""
    return Bpe(path)
