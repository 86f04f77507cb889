"""Token ids of whole texts with a public vocabulary file, a word at a time.

The vocabularies split text at white space before anything else, so the ids of a text are those of its words one after
another, and a word that is remembered is not encoded again.  Memory is bounded in bytes: the words that were met last are
kept, and texts are to be given in slices of TEXT_BYTES (``_common.slices``).  Where the vocabulary knows no capitals, words are lower-cased
first; a full stop or comma after a letter is a token of its own.  All of that is tried out on probes before it is relied on; a
tokenizer that fails them encodes whole texts.
"""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

#: Bytes of remembered words, in two generations of half of that each; what a word costs with its letters and ids; words that are
#: encoded in one call.
MEMORY_BYTES, WORD_BYTES, CALL_WORDS = 64 << 20, 180, 4096
#: Bytes of text that are split into words at once: the larger, the fewer words are looked up twice.
TEXT_BYTES = 4 << 20
_PROBES = ("one two", "a1 b2", "it's  we'll\n\tgo", "x , y . z !?", "é è é", "<|end of text|> <|endoftext|>", "End, the end. A1. é,")
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


class WordEncoder:
    """Ids of texts as arrays."""

    def __init__(self, path: str, ordinary_special: bool = False, memory_bytes: int = MEMORY_BYTES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary_special
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # what comes again is remembered here
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.used, self.memory_bytes = 0, memory_bytes
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        vocabulary = self.tokenizer.get_vocab()
        self.ends_unit = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends_unit[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        whole = [self._whole(t) for t in _PROBES]
        self.lower = whole == [self._whole(t.lower()) for t in _PROBES]
        self.by_word = whole == self._words([t.encode() for t in _PROBES])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of words that are not known.

        A word of letters is one unit to the tokenizer, and a unit's last token shows that it ends one; so such words go
        through in one text.
        """
        texts = [w.decode() for w in words]
        letters = [t.isalpha() for t in texts]
        self._learn_some([w for w, a in zip(words, letters) if a], [t for t, a in zip(texts, letters) if a], True)
        self._learn_some([w for w, a in zip(words, letters) if not a], [t for t, a in zip(texts, letters) if not a], False)

    def _learn_some(self, words: list[bytes], texts: list[str], units: bool) -> None:
        for k in range(0, len(words), CALL_WORDS):
            some = texts[k : k + CALL_WORDS]
            if units:
                found = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
                ids = np.array(found.ids, "<u4")
                ends = np.flatnonzero(self.ends_unit[ids]) + 1
                if len(ends) != len(some):  # letters that normalisation takes apart
                    self._learn_some(words[k : k + CALL_WORDS], some, False)
                    continue
            else:
                found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
                ids = np.array(found.ids, "<u4")
                ends = np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))
            data, start = ids.tobytes(), 0
            for w, end in zip(words[k : k + CALL_WORDS], (4 * ends).tolist()):
                self.known[w] = data[start:end]
                start = end

    def _words(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        split = [(t.lower() if self.lower else t).split() for t in texts]
        distinct: set[bytes] = set().union(*split)
        if self.used > self.memory_bytes // 2:  # the generation before goes, but for the words that come again
            self.known, self.before, self.used = {}, self.known, 0
        known = self.known
        new = distinct.difference(known)
        if self.before:
            again = new.intersection(self.before)
            known.update(zip(again, map(self.before.__getitem__, again)))
            new -= again
            self.used += WORD_BYTES * len(again)
        if new:
            marked = {w for w in new if w[-1] in b".," and len(w) > 1 and w[-2] in _LETTERS} if self.lower else set()
            plain = (new - marked) | {w[:-1] for w in marked} | ({b".", b","} if marked else set())
            plain.difference_update(known)
            self._learn(list(plain))
            known.update({w: known[w[:-1]] + known[w[-1:]] for w in marked})
            self.used += WORD_BYTES * (len(plain) + len(marked)) + sum(len(w) for w in plain if len(w) > 40)
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids (unsigned 32-bit, little-endian) of texts in UTF-8."""
        if not self.by_word:
            return [np.frombuffer(self._whole(t.decode()), "<u4") for t in texts]
        return [np.frombuffer(ids, "<u4") for ids in self._words(texts)]
