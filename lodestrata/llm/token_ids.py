"""Token ids of whole texts, by a public vocabulary file and the tokenizers library."""

from __future__ import annotations

import functools
import json
import re
import struct

import numpy as np

from lodestrata.llm.common import kept

#: Words of these characters alone take the short way: nothing in them is changed by NFC, and lower-casing is per character.
PLAIN = re.compile(rb"(?:[!-~]|\xc2[\xa1-\xbf]|\xc3[\x80-\xbf])+\Z")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# fixed values: the split pattern, and the steps of a vocabulary file that the short way follows
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def by_words(file: dict) -> bool:
    """Whether a vocabulary file's ids of a text are those of its words in order, and its special tokens begin with `<|`."""
    same = all(file.get(k) == v for k, v in STEPS.items())
    return same and file["model"]["type"] == "BPE" and not file["model"].get("dropout") and all(t["content"].startswith("<|") for t in file["added_tokens"])


class WordTokens(dict):
    """White-space separated word (bytes) to its ids as little-endian 32-bit bytes.

    The normalizer and pre-tokenizer of files of the STEPS never join what white space separates, so a text's
    ids are those of its words in order. Words of plain characters are cut by the file's own pattern
    and each part goes straight to the library's BPE model; any other word, or one that may hold a
    special token, goes through the whole tokenizer. Up to `limit` words and parts are remembered. With any other
    file each text goes through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = 300_000):
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.limit, self.parts = self.tokenizer.model, limit, {}
        self.short = by_words(json.loads(self.tokenizer.to_str()))
        self.pattern = regex.compile(PATTERN)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def clear(self) -> None:
        super().clear()
        self.parts.clear()

    def part(self, text: str) -> bytes:
        if text.isascii() and text.isalpha():
            return self[text.encode()]
        ids = self.parts.get(text)
        if ids is None:
            if len(self.parts) >= self.limit:
                self.parts.clear()
            shown = text if text.isascii() else "".join(map(self.shown.__getitem__, text.encode()))
            ids = self.parts[text] = self.of(shown)
        return ids

    def of(self, shown: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            super().clear()
        if word.isalpha():  # ASCII letters alone are one part
            ids = self.of(word.decode().lower())
        elif PLAIN.match(word) and b"<|" not in word:
            ids = b"".join(map(self.part, self.pattern.findall(word.decode().lower())))
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit bytes."""
        return b"".join(map(self.__getitem__, text.split())) if self.short else self.whole(text)


@functools.lru_cache(maxsize=1)
def _word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def word_tokens(path: str) -> WordTokens:
    """The worker's own: Spark keeps Python workers between tasks, and with them what words they remember."""
    return kept(_word_tokens(path))
