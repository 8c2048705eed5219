"""Ids of whole texts by a word-end vocabulary of the tokenizers library, each distinct word encoded once.

The vocabulary's rules make words independent of each other: the text is composed (NFC) and
lower-cased, cut into words, white space dropped, and each word merged on its own. So a worker
splits texts at white space, cuts the chunks that it has not met yet into words with the same
pattern, lets the library encode the words that are new, many in one call, and joins the stored
ids of the chunks. Texts that hold a special token's string, and
vocabularies with other rules, go to the library whole. A worker keeps ``MOST_CHUNKS`` chunks
and words, then starts afresh, so memory does not grow with the corpus; it drops them when it is idle.
"""

from __future__ import annotations

import json
import re
import threading
import time
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from .worker_memory import give_back

MOST_CHUNKS = 800_000
#: Characters of the texts that are cut into chunks together.
AT_ONCE = 1_000_000
#: Seconds without a text after which a worker's chunks and words go.
IDLE = 5
#: Fixed pattern of the vocabulary's words, after lower-casing, for texts without a character in ``ODD``.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
#: Any character outside those that the standard module is known to class as the library does;
#: chunks with one are encoded by the library.
ODD = "[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]"
#: The rules for which words are independent, as the vocabulary file states them.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_END = "</w>"


class WordIds:
    """Whole texts to the bytes of their ids, little-endian unsigned 32-bit."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.special = [x["content"] for x in made["added_tokens"]]
        self.size = max([*made["model"]["vocab"].values(), *(x["id"] for x in made["added_tokens"])]) + 1
        self.ends = np.zeros(self.size, bool)
        for token, at in made["model"]["vocab"].items():
            self.ends[at] = token.endswith(WORD_END)
        rules = made.get("normalizer") or {}
        self.independent = [x["type"] for x in rules.get("normalizers", [])] == NORMALIZERS and made["model"].get("end_of_word_suffix") == WORD_END
        self.find, self.odd = re.compile(WORDS).findall, re.compile(ODD).search
        self.blank, self.separator = re.compile(r"[^\S\x1c-\x1f]+").split, re.compile("[\x1c-\x1f]").search
        self.known: dict[str, bytes] = {}
        self.lock, self.watched, self.used = threading.Lock(), False, 0.0

    def chunks(self, text: str) -> list[str]:
        """What stands between white space; no word reaches across it."""
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if text.isascii() else text.replace("Σ", "σ").lower()
        return self.blank(text) if self.separator(text) else text.split()

    def learn(self, chunks: set[str]) -> None:
        new = chunks.difference(self.known)
        if len(self.known) + len(new) > MOST_CHUNKS:
            self.known.clear()
            new = chunks
        if self.odd(" ".join(new)):
            odd = [c for c in new if self.odd(c)]
            self.known.update([(c, np.array(self.library.encode(c, add_special_tokens=False).ids, "<u4").tobytes()) for c in odd])
            new = new.difference(odd)
        mixed = [(c, self.find(c)) for c in new if not c.isalpha()]
        words = set(filter(str.isalpha, new))
        words.update(*[w for _, w in mixed])
        self.learn_words(words.difference(self.known))
        known = self.known.__getitem__
        self.known.update([(c, b"".join(map(known, w))) for c, w in mixed])

    def learn_words(self, new: set[str]) -> None:
        listed = list(new)
        for at in range(0, len(listed), 20_000):
            some = listed[at : at + 20_000]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):  # some word has no end of its own: one by one
                self.known |= {w: np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in some}
                continue
            whole, ends = ids.tobytes(), (4 * ends).tolist()
            self.known.update(zip(some, [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def run(self, texts: list[str]) -> list[bytes]:
        with self.lock:
            out = self._ids(texts)
            self.used = time.monotonic()
            if not self.watched:
                self.watched = True
                threading.Thread(target=self._forget, daemon=True).start()
        return out

    def _forget(self) -> None:
        """Drops what is known once no text has come for ``IDLE`` seconds: other stages need the memory of idle workers."""
        while self.watched:
            time.sleep(IDLE)
            with self.lock:
                if time.monotonic() - self.used >= IDLE:
                    self.known.clear()
                    self.watched = False
        give_back()

    def _ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        at = 0
        while at < len(texts):
            some, size, distinct = [], 0, set()
            while at < len(texts) and (not some or size + len(texts[at]) < AT_ONCE):
                text = texts[at]
                if not self.independent or any(s in text for s in self.special):
                    out[at] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    some.append((at, self.chunks(text)))
                    distinct.update(some[-1][1])
                size += len(text)
                at += 1
            self.learn(distinct)
            for i, chunks in some:
                out[i] = b"".join(map(self.known.__getitem__, chunks))
        return out


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]
