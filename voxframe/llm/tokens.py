"""Fast exact use of a byte-level BPE of the ``tokenizers`` library.

Pre-tokens never cross a single space or newline that stands between two
non-space characters, so a text is cut there and each distinct piece is encoded
once by the library and kept in a bounded two-generation cache.  Texts with
other white space, or with runs of it, go to the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

from .common import claim

#: White space other than a space and a newline.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: Letters and digits below U+0250, where Unicode's versions agree.
_LETTER = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "L")
_DIGIT = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "N")
#: How the pre-tokenizer cuts such text without white space inside.
_CUT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+")
_LATIN = re.compile(r"[ !-~\u00a1-\u024f]+").fullmatch


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_BYTES = str.maketrans({b: c for b, c in enumerate(_byte_letters())})


#: Bytes of a codec's caches in a worker process.
CACHE_BYTES = 176 << 20


class _Pieces(dict):
    """Piece -> what ``encode`` gives for it.  Two generations, of about ``most`` bytes together."""

    def __init__(self, encode, most: int):
        self.encode, self.most, self.old, self.held = encode, most // 2, {}, 0

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.encode(piece)
        size = 200 + 2 * len(piece)  # two small objects and a slot of the dictionary
        if self.held + size > self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0
        if size <= self.most:
            self[piece] = value
            self.held += size
        return value


class Codec:
    """``encode(text)`` gives the library's ids as little-endian bytes of ``width`` bytes each."""

    def __init__(self, path: str, most: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.code, self.dtype = ("H", "<u2") if self.tok.get_vocab_size() <= 1 << 16 else ("I", "<u4")
        self.width = array(self.code).itemsize
        self.model = self.tok.model
        self.words = _Pieces(lambda w: self._piece(" " + w), most * 3 // 4)
        self.firsts = _Pieces(self._piece, most // 8)
        self.pre = _Pieces(self._pre, most // 8)
        self.newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _pre(self, pre: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(pre.encode().decode("latin-1").translate(_BYTES))]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not _LATIN(piece):
            return self._whole(piece)
        cut = _CUT.findall(piece)
        if len(cut) == 1:  # held as a word or as a first one, and not once more
            return self._pre(piece)
        return b"".join([self.words[x[1:]] if x[0] == " " and len(x) > 1 else self.pre[x] for x in cut])

    def encode(self, text: str) -> bytes:
        return self.encode_from(text)[0]

    def encode_from(self, text: str) -> tuple[bytes, int]:
        """The ids of a text, and how many its first line and line end take; 0 if no other line follows."""
        if not text:
            return b"", 0
        out: list[bytes] = []
        if not any(c in text for c in _OTHER_SPACE):
            words = self.words.__getitem__
            for line in text.split("\n"):
                parts = line.split(" ")
                if "" in parts:  # an empty line, or spaces side by side or at an end
                    break
                out.append(self.firsts[parts[0]] + b"".join(map(words, parts[1:])))
            else:
                return self.newline.join(out), (len(out[0] + self.newline) // self.width if len(out) > 1 else 0)
        ids, cut = self._whole(text), text.find("\n")
        if cut < 0:
            return ids, 0
        first = len(out[0]) if out else len(self.encode(text[:cut]))
        return ids, min((first + len(self.newline)) // self.width, len(ids) // self.width)


class WordCodec:
    """Ids of a tokenizer that drops white space and marks word ends; ``encode`` as in ``Codec``.

    No token crosses a space or a newline, so what stands between them is encoded once
    and kept.  Words of Latin letters, digits and signs go to the model without the
    library's normalizer, whose work on them is lower case alone.
    """

    #: U+0130 is two characters in lower case.
    _PLAIN = re.compile(r"[!-~\u00a1-\u012f\u0131-\u024f]+").fullmatch
    _PARTS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")

    def __init__(self, path: str, most: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.code, self.dtype = ("H", "<u2") if self.tok.get_vocab_size() <= 1 << 16 else ("I", "<u4")
        self.width = array(self.code).itemsize
        self.model = self.tok.model
        self.words = _Pieces(self._word, most)

    def _letters(self, word: str) -> bytes:
        """A word of letters below U+0100, in lower case."""
        own = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return array(self.code, [t.id for t in self.model.tokenize(own)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return self._letters(word.lower())
            core = word[:-1]
            if core.isalpha() and word[-1] in ".,;:!?":  # most other words
                known = self.words.get(core)
                return (self._letters(core.lower()) if known is None else known) + self.words[word[-1]]
        if not word:
            return b""
        if not self._PLAIN(word):
            return array(self.code, self.tok.encode(word, add_special_tokens=False).ids).tobytes()
        parts = self._PARTS.findall(word.lower())
        if len(parts) > 1:  # a word and signs beside it
            return b"".join([self.words[p] for p in parts])
        return array(self.code, [t.id for part in parts for t in self.model.tokenize(part.encode().decode("latin-1").translate(_BYTES))]).tobytes()

    def encode(self, text: str) -> bytes:
        try:  # letters below U+0100 have one lower case, so that fewer words are different
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


_open: dict[str, Codec | WordCodec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker process; its cache serves all tasks of that worker."""
    claim("codec", _open.clear)
    if path not in _open:
        _open[path] = Codec(path)
    return _open[path]


def word_codec(path: str) -> WordCodec:
    """As ``codec``, for a tokenizer of words."""
    claim("codec", _open.clear)
    if path not in _open:
        _open[path] = WordCodec(path)
    return _open[path]
