"""Token ids of whole texts with a tokenizer of the tokenizers library, by way of a word cache.

Both tokenizers cut a text into pre-tokens that never reach over the start of a run of white
space, so a text's ids are those of its words one after another. Each Python worker keeps the ids
of words it has met, up to a multiple of CACHE_WORDS of them, and asks the library only for new ones.
"""

from __future__ import annotations

import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable
from itertools import islice

from tokenizers import Tokenizer

#: Words whose ids a worker keeps; of a full cache, the half that came first stays, which has the frequent words.
CACHE_WORDS = 400_000

#: Unicode's White_Space, which is what \s means to the tokenizers.
_WHITE = "\t-\r \x85\xa0  -     　"
_UNIT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+$")
#: Beginnings of the UTF-8 forms of white space beyond ASCII.
_FAR_WHITE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _byte_letters() -> list[str]:
    """The letter by which byte-level BPE writes each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    far = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(far)) for b in range(256)]


_LETTERS = "".join(_byte_letters())


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Cache(dict):
    """cache[key] is make(key), kept for up to `most` keys."""

    def __init__(self, make: Callable[[bytes], bytes], most: int) -> None:
        super().__init__()
        self.make = make
        self.most = most

    def __missing__(self, key: bytes) -> bytes:
        found = self[key] = self.make(key)
        if len(self) >= self.most:
            first = dict(islice(self.items(), self.most // 2))
            self.clear()
            self.update(first)
        return found


class Encoder:
    """ids(text in UTF-8) as little-endian unsigned 32-bit integers, without special tokens."""

    cache_words = CACHE_WORDS

    def __init__(self, path: str, library: Tokenizer | None = None) -> None:
        self.path = path
        self.library = library or Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.words = _Cache(self._new, self.cache_words)
        self.parts = _Cache(self._part, self.cache_words)

    def _whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids)

    def _part(self, part: bytes) -> bytes:
        """Ids of one pre-token."""
        return _packed([t.id for t in self.model.tokenize(charmap_decode(part, "strict", _LETTERS)[0])])

    def _plain(self, word: bytes) -> tuple[bytes, bytes] | None:
        """Letters and punctuation of a word made of Latin-1 letters and ASCII punctuation after them."""
        letters = word.rstrip(_PUNCTUATION)
        if letters.isalpha() or not letters.isascii() and (text := letters.decode()).isalpha() and max(text) < "Ā":
            return letters, word[len(letters) :]
        return None

    def _looked_up(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.words.__getitem__, words))

    def _new(self, word: bytes) -> bytes:
        raise NotImplementedError


class WordEncoder(Encoder):
    """For a tokenizer that lower-cases, drops white space and ends words with a mark."""

    def ids(self, data: bytes) -> bytes:
        return self._looked_up(data.split())

    def _new(self, word: bytes) -> bytes:
        plain = self._plain(word)
        if not plain:
            return self._whole(word.decode())
        letters, rest = plain
        head = self.parts[letters.lower() if letters.isascii() else letters.decode().lower().encode()]
        return head + self.parts[rest] if rest else head


class ByteEncoder(Encoder):
    """For byte-level BPE, in which a word takes one space before it along. Upper case makes more words."""

    cache_words = 2 * CACHE_WORDS

    def __init__(self, path: str, library: Tokenizer | None = None) -> None:
        super().__init__(path, library)
        self.units: dict[str, bytes] = {}

    def ids(self, data: bytes) -> bytes:
        n = len(data.split())
        spaces, lines = data.count(b" "), data.count(b"\n")
        even = n > 0 and spaces + lines == n - 1 and not (data[:1].isspace() or data[-1:].isspace())
        if even and (data.isascii() or not any(x in data for x in _FAR_WHITE)) and not any(x in data for x in (b"\t", b"\r", b"\x0b", b"\x0c")):
            words = data.replace(b"\n", b" \n").split(b" ")
            return self._first(words[0]) + self._looked_up(words[1:])
        return b"".join([self._unit(u) for u in _UNIT.findall(data.decode())])

    def _first(self, word: bytes) -> bytes:
        plain = self._plain(word)
        return b"".join(self.parts[x] for x in plain if x) if plain else self._whole(word.decode())

    def _unit(self, unit: str) -> bytes:
        ids = self.units.get(unit)
        if ids is None:
            if len(self.units) >= CACHE_WORDS:
                self.units.clear()
            ids = self.units[unit] = self._whole(unit)
        return ids

    def _new(self, word: bytes) -> bytes:
        """A word after one space, or after one line break if it begins with that."""
        line = word[:1] == b"\n"
        plain = self._plain(word[1:] if line else word)
        if not plain:
            return self._whole(word.decode() if line else f" {word.decode()}")
        letters, rest = plain
        head = self.parts[b"\n"] + self.parts[letters] if line else self.parts[b" " + letters]
        return head + self.parts[rest] if rest else head


#: What a short cut must encode as the library does before it is used.
_PROBES = ["", " ", "a b", "a  b\n\nc ", "Don't STOP, it's 12,345.6!", "\tÉtée naïve\u3000東京 x\x0by", "e\u0301 \U0001f600\u00a0z", "(<|endoftext|>)"]

_encoders: dict[str, Encoder] = {}


class WholeEncoder(Encoder):
    """For any other tokenizer: the library's encoding of the whole text."""

    def ids(self, data: bytes) -> bytes:
        return self._whole(data.decode())


def new_encoder(path: str) -> Encoder:
    """An encoder for a tokenizer file: a short cut that agrees with the library on _PROBES, or the library."""
    whole = WholeEncoder(path)
    for short in (ByteEncoder, WordEncoder):
        some = short(path, whole.library)
        if all(some.ids(p.encode()) == whole.ids(p.encode()) for p in _PROBES):
            return some
    return whole


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file, kept as long as the process is."""
    if path not in _encoders:
        _encoders[path] = new_encoder(path)
    return _encoders[path]


class Sent:
    """A tokenizer file's encoder as the value of a broadcast variable, which brings the path alone.

    A Python worker makes the encoder in the first task that uses the variable and keeps it for the
    tasks that follow; with the first task that does not use the variable, Spark takes it from the
    worker. So the caches of one job take no memory in the stages of others.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self._encoder: Encoder | None = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_encoder": None}

    def encoder(self) -> Encoder:
        if self._encoder is None:
            self._encoder = new_encoder(self.path)
        return self._encoder
