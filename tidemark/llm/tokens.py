"""Token ids of whole texts by a public tokenizers file whose tokens end at word ends.

Words repeat, so each worker remembers the ids of the pieces that the vocabulary's own pattern cuts a
text into. That is exact, as no token crosses pieces. It is done for texts of ASCII and Latin letters,
where lower case and composed forms leave no choice; other texts are encoded as a whole.
"""

from __future__ import annotations

import json
import re

import numpy as np

REMEMBERED = 400_000  # pieces a worker remembers at a time; bounds its memory only

# Latin letters whose lower case is one letter: up to U+017E without the dotted capital I.
_LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
_OTHER = re.compile(f"[^\t-\r -~{_LETTERS}]")
# The pattern of the vocabulary file, for such texts.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())
        first = (spec["pre_tokenizer"].get("pretokenizers") or [{}])[0]
        self.by_piece = (
            spec["model"].get("end_of_word_suffix") == "</w>" and first.get("pattern", {}).get("Regex") == _PATTERN
            and [n["type"] for n in spec["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"])
        self.ends = np.zeros(self.model.get_vocab_size() + 1, bool)
        for token, i in self.model.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        # A special token in a text is found before it is cut into pieces.
        if not self.by_piece or "<|" in text or _OTHER.search(text):
            return self.whole(text)
        pieces, known = _PIECES.findall(text.lower()), self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        new = self._learn([p for p in set(pieces) if p not in known])
        ids = b"".join([known[p] if p in known else new[p] for p in pieces])
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        if len(new) <= REMEMBERED:
            known.update(new)
        return ids

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces, encoded many at a time with spaces between them."""
        found: dict[str, bytes] = {}
        for start in range(0, len(pieces), 2000):
            some = pieces[start:start + 2000]
            ids = np.array(self.model.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(some):
                found.update((x, self.whole(x)) for x in some)
                continue
            at = 0
            for x, end in zip(some, cuts, strict=True):
                found[x] = ids[at:end].tobytes()
                at = end
        return found


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
