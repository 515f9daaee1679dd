"""Word BPE through the tokenizers library, with one library call per distinct piece.

The public word BPE drops white space and never merges across its pre-tokens, so the ids
of a text are the ids of its pre-tokens one after another.  Texts made of plain Latin
characters are cut here by the vocabulary file's own pattern and each distinct pre-token is
handed to the library's model once per worker; any other word goes through the library whole.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers

DEFAULT_VOCABULARY = "word_bpe_49k.json"
END_ID = 1

# The pre-token pattern of the vocabulary file, for lower-cased Latin text.
_LETTER = "a-zªµºß-öø-įı-ſ"
_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9²³¹¼-¾]|"
    f"[^\\s{_LETTER}0-9²³¹¼-¾]+"
)
# Characters whose lower case, class and normal form are settled; all others take the library's path.
_PLAIN = re.compile("[\t-\r\x20-\u012f\u0131-\u017f]*")
_WORD = re.compile("[^\t-\r\x20]+")
# Characters that the byte alphabet spells as themselves.
_OWN = re.compile("[!-~]*")


_PROBES = ("Don't stop, it's 3rd-rate: x=2;  y!?", "A b\n\tc d's 42 (see é ü ſ)", "we'll've I'M 3½ a\x7fb «q»")


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    seen, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            seen.append(chr(b))
        else:
            seen.append(chr(spare))
            spare += 1
    return seen


class WordBpe:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most_cached: int = 1_000_000):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        model, byte = self._whole.model, _byte_alphabet()

        class Cache(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= most_cached:
                    self.clear()
                spelled = piece if _OWN.fullmatch(piece) else "".join([byte[b] for b in piece.encode()])
                ids = [t.id for t in model.tokenize(spelled)]
                self[piece] = out = np.array(ids, "<u4").tobytes()
                return out

        self._ids = Cache().__getitem__
        # the shortcut holds for vocabularies with this pattern and case rule only
        for probe in _PROBES:
            if self.encode(probe) != np.array(self._whole.encode(probe, add_special_tokens=False).ids, "<u4").tobytes():
                raise ValueError(f"{path} does not cut words as this encoder does: {probe!r}")

    def encode(self, text: str) -> bytes:
        if "<|" not in text and _PLAIN.fullmatch(text):
            return b"".join(map(self._ids, _PIECES.findall(text.lower())))
        out = []
        for word in _WORD.findall(text):
            if "<|" not in word and _PLAIN.fullmatch(word):
                out += map(self._ids, _PIECES.findall(word.lower()))
            else:
                out.append(np.array(self._whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes())
        return b"".join(out)


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str | None = None) -> WordBpe:
    """The encoder of this worker process; path: a tokenizers file, by default the public one."""
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
