"""Token ids of whole texts, with a memory for stretches that come again.

Both kinds of tokenizer used here never join what stands before a run of white
space with what follows it, nor a word with the punctuation after it, so a text
can be cut there and each stretch encoded by itself: with the white space before
it where that counts, without where it is dropped. The tokenizers library
encodes every stretch; one that is a plain word goes straight to its model.
"""

from __future__ import annotations

import os
import re
import struct
from functools import cache

#: Stretches of one generation of a worker's memory, of which it has two, and their longest.
STRETCHES, LONGEST = 400_000, 48

# Unicode's white space, as the tokenizers' patterns know it, and Latin letters but the dotted I, which becomes two in lower case.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
# A word ends before white space, ASCII punctuation or the end of the text.
_ENDS = rf"(?=[{_SPACE}!-/:-@\[-`{{-~]|\Z)"
_WITH_SPACE = re.compile(rf"[{_SPACE}]*+[{_LETTERS}]++{_ENDS}|[{_SPACE}]*+[^{_SPACE}]++|[{_SPACE}]++")
_WITHOUT_SPACE = re.compile(rf"[{_LETTERS}]++{_ENDS}|[^{_SPACE}]++")
# Where lower case goes character by character and texts are composed already.
_BEYOND_LATIN = re.compile("[\u0130\u0250-\U0010ffff]")
_PLAIN = re.compile(rf" ?[{_LETTERS}]+")
# Python parts words at these, too; the tokenizers' patterns do not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


@cache
def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for 256 and on, in order.
    """
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_encoders: dict[tuple[str, bool], TextEncoder] = {}


def worker_encoder(path: str, drops_space: bool) -> TextEncoder:
    """The encoder of this Python worker, which later tasks find again with what it remembers."""
    key = path, drops_space
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TextEncoder(path, drops_space)
    return _encoders[key]


class TextEncoder(dict):
    """Encodes texts to little-endian unsigned 32-bit ids.

    As a dictionary it holds the ids of the stretches met of late.
    """

    def __init__(self, path: str, drops_space: bool) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._drops_space = drops_space
        self._pattern = _WITHOUT_SPACE if drops_space else _WITH_SPACE
        self._older: dict[str, bytes] = {}

    def _ids(self, stretch: str) -> list[int]:
        if not _PLAIN.fullmatch(stretch):
            return self._tokenizer.encode(stretch, add_special_tokens=False).ids
        if self._drops_space:
            stretch = stretch.lower()
        letters = stretch.encode().decode("latin-1").translate(_byte_letters())
        return [token.id for token in self._model.tokenize(letters)]

    def __missing__(self, stretch: str) -> bytes:
        found = self._older.get(stretch)
        if found is None:
            # What stands between white space may be words and punctuation, each known before.
            parts = self._pattern.findall(stretch) if self._drops_space else (stretch,)
            if len(parts) > 1:
                found = b"".join(map(self.__getitem__, parts))
            else:
                ids = self._ids(stretch)
                found = struct.pack(f"<{len(ids)}I", *ids)
        if len(stretch) <= LONGEST:
            if len(self) >= STRETCHES:
                # What is still in use comes back from the older generation.
                self._older = dict(self)
                self.clear()
            self[stretch] = found
        return found

    def encode(self, text: bytes) -> bytes:
        line = text.decode("utf-8", "replace")
        # The kind that drops white space works in lower case; done for the whole
        # text, capitals need no room in the memory. Special tokens keep theirs.
        if self._drops_space and "<|" not in line and not _BEYOND_LATIN.search(line):
            line = line.lower()
            if not _SEPARATORS.search(line):
                return b"".join(map(self.__getitem__, line.split()))
        return b"".join(map(self.__getitem__, self._pattern.findall(line)))
