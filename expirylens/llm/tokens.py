"""Token ids of whole texts by the tokenizers library, with a word cache."""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import unicodedata
from operator import add
from types import ModuleType

import numpy as np

# Words whose ids a worker keeps, in two generations: the older one goes when the younger is full.
CACHE_WORDS = 1_000_000
_AFTER_WORD = re.compile(r"(?<=\w) ")
# Letters, digits and signs between whose runs a byte-level vocabulary cuts anyway, and a line's end inside a word.
_RUNS = r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[-.,;:!?()\"=/_%&*+<>@#$\[\]{}|~^]+"
_SIMPLE = re.compile(rf"(?:{_RUNS})(?:{_RUNS}|\n(?=\S))*")
_PIECES = re.compile(rf"{_RUNS}|\n")
_LETTERS, _SIGNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+"), ".,;:!?()"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _visible_end(word: str) -> bool:
    return bool(word) and unicodedata.category(word[-1])[0] in "LNPSM"


class Encoder:
    """Ids of texts, as little-endian unsigned 16- or 32-bit arrays.

    A byte-level vocabulary without normalisation cuts texts into words before it merges, and always
    between a visible character and a blank. There the text is split, and each different word goes through
    the tokenizer once. Any other vocabulary gets whole texts. Strings that look like special tokens are
    ordinary text.
    """

    def __init__(self, path: str, kept_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core already
        self.kept_words = kept_words
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.by_word = (spec.get("normalizer") is None and before.get("type") == "ByteLevel"
                        and before.get("use_regex", True) and not before.get("add_prefix_space", False))
        self.words: dict[str, bytes] = {}  # what follows a blank and ends in a visible character: ids with the blank
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}  # pieces that follow another one
        if self.by_word:
            vocabulary = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a blank
            self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Keep the ids of pieces that a blank precedes and after which a text can be cut. They are tokenized side by side: in
        between two of them, and nowhere else, an id begins with a blank."""
        for at in range(0, len(new), 64 * 100):
            lines = [new[k:k + 64] for k in range(at, min(len(new), at + 64 * 100), 64)]
            for line, e in zip(lines, self.tokenizer.encode_batch_fast([" " + " ".join(line) for line in lines], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.dtype)
                cuts = (np.append(np.flatnonzero(self.opens[ids]), len(ids)) * self.dtype.itemsize).tolist()
                data = ids.tobytes()
                self.words.update(zip(line, [data[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))

    @classmethod
    def kept(cls, path: str, kept_words: int = CACHE_WORDS) -> Encoder:
        """The worker's own encoder of that vocabulary: its words serve the tasks that follow, too."""
        state = sys.modules.setdefault("expirylens_worker_state", ModuleType("expirylens_worker_state")).__dict__
        if path not in state:
            state[path] = cls(path)
        state[path].kept_words = kept_words
        return state[path]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_word:
            return [np.frombuffer(x, self.dtype) for x in self._ids(texts)]
        gc.disable()  # lists of words are many here, and never cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _add(self, words: set[str]) -> None:
        """Keep the ids of those words, each behind a blank, after which a text can be cut: those of their runs, one after the other."""
        known, older = self.words, self.older
        new, cut = [], []
        for word in words:
            if word in older:
                known[word] = older[word]
            elif word.isalpha():  # letters are never cut
                new.append(word)
            else:
                cut.append(word)
        ended, stems, ends = [], [], []  # words that are letters with signs behind them
        runs = []  # words of several runs
        for word in cut:
            stem = word.rstrip(_SIGNS)
            if stem and len(stem) < len(word) and (stem.isalpha() if stem.isascii() else _LETTERS.fullmatch(stem)):
                ended.append(word)
                stems.append(stem)
                ends.append(word[len(stem):])
            elif _SIMPLE.fullmatch(word):
                runs.append((word, *_PIECES.findall(word)))
            elif _visible_end(word):
                new.append(word)
        firsts = set(stems).union([r[1] for r in runs]).difference(new)
        for stem in firsts:
            if stem not in known:
                if stem in older:
                    known[stem] = older[stem]
                else:
                    new.append(stem)
        self._learn(new)
        tails = [p for p in set(ends).union(*[r[2:] for r in runs]) if p not in self.tails]
        self.tails.update(zip(tails, self._ids(tails), strict=True))
        known.update(zip(ended, map(add, map(known.__getitem__, stems), map(self.tails.__getitem__, ends)), strict=True))
        for word, stem, *rest in runs:
            known[word] = known[stem] + b"".join([self.tails[p] for p in rest])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > self.kept_words // 2:
            self.older, self.words = self.words, {}
        if len(self.tails) > self.kept_words // 4:
            self.tails = {}
        get = self.words.get
        split = [t.split(" ") for t in texts]
        bodies = [list(map(get, words)) for words in split]
        gaps = {i: [k for k, ids in enumerate(body) if ids is None] for i, body in enumerate(bodies) if None in body}
        missing: set[str] = set()
        for i, places in gaps.items():
            words = split[i]
            missing.update([words[k] for k in places if k])
        if missing:
            self._add(missing)
        odd = [i for i, words in enumerate(split) if len(words) > 1 and not _visible_end(words[0])]
        for i, places in gaps.items():
            words, body = split[i], bodies[i]
            for k in places:
                if (ids := get(words[k])) is not None:
                    body[k] = ids
                elif k and k == len(body) - 1:
                    body[k] = self._ids([" " + words[k]])[0]  # nothing follows it
                elif k:
                    odd.append(i)
        heads = [words[0] for words in split]
        for i in set(odd):  # blanks beside white space: cut only after letters and digits
            heads[i], *rest = _AFTER_WORD.split(texts[i])
            bodies[i] = [b"", *self._ids([" " + w for w in rest])]
        for body, head in zip(bodies, self._ids(heads), strict=True):
            body[0] = head
        return [np.frombuffer(b"".join(body), self.dtype) for body in bodies]
