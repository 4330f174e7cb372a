"""Token ids of whole texts, equal to the tokenizers library's, from cached word ids.

The vocabulary's pre-tokens are independent of each other, so a text's ids are its
pre-tokens' ids in a row. For texts made only of characters for which lower-casing,
composition and character classes are the same everywhere (Basic Latin, Latin-1 and
Latin Extended-A, without control characters and without İ), Python splits the text,
the library's model encodes each pre-token that is new, and a bounded cache holds its ids. Every other text, every text with
one of the special strings inside, and every text for a vocabulary file that normalises or splits in another way, goes to the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
import struct

#: Distinct pre-tokens kept in a worker before the cache starts anew.
CACHE_WORDS = 200_000

_SIMPLE = re.compile("[\t\n\r -~¡-¬®-įı-ſ]*")
_LETTERS = "a-zªµºß-öø-ÿĀ-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")

# The normaliser and the splitting of the vocabulary files that the pattern above is equal to.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: How byte-level vocabularies write bytes that are no printable characters: by code points from 256 on, in order.
_BYTE_NAMES = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}

_open: dict[str, WordIds] = {}


class _Words(dict):
    """Pre-tokens and their ids; what is missing comes from the library's model."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize

    def __missing__(self, word: str) -> bytes:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_NAMES)
        found = [x.id for x in self.tokenize(spelt)]
        out = self[word] = struct.pack(f"<{len(found)}I", *found)
        return out


class WordIds:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.known = told.get("normalizer") == _NORMALISER and told.get("pre_tokenizer") == _SPLITTER and told.get("post_processor") is None and all(not x["normalized"] for x in told.get("added_tokens", []))
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words(self.tokenizer.model)

    def whole(self, texts: list[str]) -> list[bytes]:
        """By the library alone."""
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        rest = []
        ids = self.words.__getitem__
        for i, text in enumerate(texts):
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            if self.known and _SIMPLE.fullmatch(text) and not any(s in text for s in self.special):
                out[i] = b"".join(map(ids, _SPLIT.findall(text.lower())))
            else:
                rest.append(i)
        if rest:
            for i, got in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
                out[i] = got
        return out


def word_ids(path: str) -> WordIds:
    """The worker's own, loaded once."""
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]
