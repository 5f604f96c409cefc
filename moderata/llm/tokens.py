"""Token ids of texts by a public tokenizer file, with word parts remembered in the worker."""

from __future__ import annotations

import os
import re
from array import array

from moderata.llm.common import Remembered, kept

# str.split() also splits at these four, which are no white space for the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile(r"[^\S\x1c-\x1f]+")
# Fixed value: how the tokenizer file cuts a lower-case text below code point 256 into parts.
_PARTS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|(?:[\x1c-\x1f]|[^\s0-9a-zªµºß-öø-ÿ²³¹¼-¾])+"
)


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: printable bytes for themselves, the others from 256 up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: 256 + k for k, b in enumerate(others)}


class TextTokens:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer composes and lower-cases a text, drops white space and encodes
    part by part. In the Latin-1 range composing changes nothing and lower case is
    one letter for one, so words of such a text are cut into parts here and only parts
    not met before are encoded. Words of other texts go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.parts = Remembered(self._part)
        self.latin = Remembered(self._latin_word)
        self.words = Remembered(self._word)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text; none for null."""
        if not text:
            return b""
        if _latin(text):
            return b"".join(map(self.latin.__getitem__, _split(text.lower())))
        return b"".join(map(self.words.__getitem__, _split(text)))

    def _latin_word(self, word: str) -> bytes:
        return b"".join([self.parts[p] for p in _PARTS.findall(word)])

    def _part(self, part: str) -> bytes:
        if not (part.isascii() and part.isalnum()):
            part = part.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.model.tokenize(part)]).tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


def _latin(text: str) -> bool:
    """Whether all characters are below 256 and none can begin a special token's name."""
    if "<|" in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _split(text: str) -> list[str]:
    return [w for w in _BLANKS.split(text) if w] if _ODD.search(text) else text.split()


def tokens_of(path: str) -> TextTokens:
    """The worker's :class:`TextTokens` of a tokenizer file."""
    return kept("tokens", path, lambda: TextTokens(path))
