"""Token ids of whole texts, by the ``tokenizers`` library.

``WordTokenizer`` serves the lower-casing BPE with word ends, which drops white
space: the ids of a text are those of its pre-tokens in order. Texts of the plain
characters below are cut into pre-tokens here, by the tokenizer's own pattern; a
pre-token is encoded once per worker, a hundred to a call (every last piece of one
carries the ``</w>`` suffix, which marks where it ends), and looked up afterwards.
Other texts are cut at white space, and chunks with other characters or special
strings are encoded by the library as they stand. A look-up table that is full
drops its older half: a bound on memory, not on results.
"""

from __future__ import annotations

import re

import numpy as np

ENTRIES = 350_000
LONGEST_KEPT = 64
TEXTS = 100

_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
#: White space to Python, not to the tokenizer.
_NOT_SPACE_HERE = re.compile("[\x1c-\x1f]")
_LOADED: dict[str, "WordTokenizer"] = {}


def _bytes(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def _cut(text: str) -> list[str] | None:
    """Pre-tokens, and chunks to be encoded whole; None if the text must be."""
    if "<|" not in text and _PLAIN.fullmatch(text):
        return _PIECES.findall(text.lower())
    if _NOT_SPACE_HERE.search(text):
        return None
    return [p for c in text.split() for p in (_PIECES.findall(c.lower()) if "<|" not in c and _PLAIN.fullmatch(c) else [c])]


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> "WordTokenizer":
        """One per worker process, kept between tasks."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def plain(self, texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        for at in range(0, len(texts), TEXTS):
            cut = [_cut(x) for x in texts[at:at + TEXTS]]
            missing = set().union(*(c for c in cut if c)).difference(self.known)
            learnt = self._learn(list(missing)) if missing else {}
            for i, c in enumerate(cut):
                if c is None:
                    out.append(self.plain([texts[at + i]])[0])
                    continue
                try:
                    out.append(b"".join(map(self.known.__getitem__, c)))
                except KeyError:  # a piece too long to keep, or one just dropped
                    gone = {p for p in c if p not in self.known and p not in learnt}
                    learnt.update(self._learn(list(gone)) if gone else {})
                    out.append(b"".join([self.known[p] if p in self.known else learnt[p] for p in c]))
        return out

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces that are not known; those of moderate length are kept."""
        learnt: dict[str, bytes] = {}
        # a chunk with special strings or other characters may hold several pre-tokens
        whole = [p for p in new if "<|" in p or not _PLAIN.fullmatch(p)]
        learnt.update(zip(whole, self.plain(whole) if whole else []))
        simple = [p for p in new if p not in learnt]
        for at in range(0, len(simple), 100):
            some = simple[at:at + 100]
            ids = np.asarray(self.library.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                learnt.update(zip(some, self.plain(some)))
                continue
            raw, begin = ids.tobytes(), 0
            for piece, end in zip(some, (4 * ends).tolist()):
                learnt[piece] = raw[begin:end]
                begin = end
        if len(self.known) + len(learnt) > ENTRIES:
            for key in list(self.known)[:len(self.known) // 2]:
                del self.known[key]
        self.known.update((p, ids) for p, ids in learnt.items() if len(p) <= LONGEST_KEPT)
        return learnt
