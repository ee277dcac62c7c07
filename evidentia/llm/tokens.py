"""Token ids of many texts with a public tokenizer file, inside Spark tasks.

``WordEncoder`` gives exactly the ids of ``tokenizers.Tokenizer.encode(text, add_special_tokens=False)`` for the
lower-casing word-level BPE file.  Words repeat far more often than texts do, and in such a vocabulary a word's ids
depend on that word alone, so each distinct word is encoded once per worker and looked up afterwards.  Texts with
characters for which Python's case or class rules might differ from the tokenizer's, or with the literal of an added
token (which gives that token's id), go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Latin text whose lower case, normal form and classes are alike in Python and in the tokenizer.
_PLAIN = re.compile(r"[\t-\r -~\xa0-įı-ɏ]*\Z")
_LETTERS = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The file's own split rule, for plain lower-case text.
_WORDS = re.compile(
    rf"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_NUMBERS}]+")


class _Words(dict):
    """Word to the bytes of its ids.  A new word is looked up among the ``older`` ones first, then encoded."""

    def __init__(self, encode: Callable[[str], bytes], older: dict[str, bytes]) -> None:
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class WordEncoder:
    """Ids of texts, in arrays.  About ``most_words`` words are remembered, in two generations: when the younger is full,
    it becomes the older and the words not used since are forgotten, so that common words stay."""

    def __init__(self, path: str, most_words: int = 250_000) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        #: Literals of the file's own tokens, such as the end of a text, which the tokenizer finds in texts first.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        plain = [chr(c) for c in range(0x250) if _PLAIN.match(chr(c)) and not chr(c).isspace()]
        #: How the file's byte-level step spells each plain character.
        self.spelling = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in plain}
        self.most_words = most_words
        self.words = _Words(self._word, {})

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.translate(self.spelling))]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _bytes(self, text: str) -> bytes:
        if not _PLAIN.match(text):
            return self._whole(text)
        lower = text.lower()
        if any(t in lower for t in self.added):
            return self._whole(text)
        if 2 * len(self.words) > self.most_words:
            self.words = _Words(self._word, dict(self.words))
        return b"".join(map(self.words.__getitem__, _WORDS.findall(lower)))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text as unsigned 32-bit numbers; none for null."""
        return np.frombuffer(self._bytes(text or ""), np.uint32)

    def length(self, text: str | None) -> int:
        """The number of ids of one text."""
        return len(self._bytes(text or "")) // 4


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker."""
    return WordEncoder(path)


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
