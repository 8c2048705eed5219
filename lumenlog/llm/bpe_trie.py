"""Byte-pair encoding and decoding over a trie of distinct words.

The words of a batch that are not known yet are taken in sorted order, which is the depth-first
order of their trie: a stack holds one state for each node on the path from the root, and a word
keeps the states of the prefix that it shares with the word before. The state of a node is the
last token of the encoding of its prefix. A prefix's encoding is the encoding of what stands
before its last token, followed by that token, and the last token is the longest vocabulary
entry ending there that can follow the token before it; walking back from a word's node gives
its encoding, and shared prefixes are worked out once.

Two tokens can stand side by side if no merge between the right edge of the first and the left
edge of the second comes before the merges that swallow those edges (see ``Bpe.follows``).

Encoding needs no shuffle: Spark deals out the documents and each task handles its batches in
turn. A worker keeps the encodings of words that it has seen, up to ``MOST_WORDS`` of them, then
starts afresh, so memory does not grow with the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .worker_memory import tidy

#: Words whose encodings a worker keeps.
MOST_WORDS = 500_000
#: Pairs of tokens whose verdict a worker keeps.
MOST_PAIRS = 1_000_000
#: Fixed pattern of the words of byte-level vocabularies, for texts without a character in ``ODD``.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Any character outside those that the standard module is known to class as the library does:
#: Latin letters, common marks and quotes, without the separators 1C-1F and the numbers that are no
#: decimal digits. Texts with one are cut into words by the library.
ODD = "[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u20ac]"
NEVER = 1 << 60



def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files, as letter: byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level vocabulary: encodes words, decodes ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        letters = byte_letters()
        as_bytes = lambda text: bytes(letters[c] for c in text)
        self.special = {x["content"]: x["id"] for x in made["added_tokens"]}
        vocabulary = {k: v for k, v in made["model"]["vocab"].items() if k not in self.special}
        self.bytes_of = {v: as_bytes(k) for k, v in vocabulary.items()} | {v: k.encode() for k, v in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(made["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, whole = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.merges.setdefault((a, b), (rank, whole))
            parts.setdefault(whole, (rank, a, b))
        self.right_edge = {t: self._edge(t, parts, 2) for t in vocabulary.values()}
        self.left_edge = {t: self._edge(t, parts, 1) for t in vocabulary.values()}
        # A token that merging its own bytes doesn't give can't be in any encoding.
        self.ids = {b: t for t, b in self.bytes_of.items() if t in self.right_edge and self._merged(b, vocabulary, made) == [t]}
        self.longest = max(map(len, self.ids), default=1)
        self.pairs: dict[int, bool] = {}

    @staticmethod
    def _edge(token: int, parts: dict[int, tuple[int, int, int]], side: int) -> list[tuple[int, int]]:
        """The tokens along one edge of a token's merge tree, each with the rank of the merge that swallows it."""
        edge, swallowed = [(token, NEVER)], NEVER
        while token in parts:
            swallowed, token = parts[token][0], parts[token][side]
            edge.append((token, swallowed))
        return edge

    def _merged(self, word: bytes, vocabulary: dict[str, int], made: dict) -> list[int]:
        """Plain merging, lowest rank first; for checking single tokens."""
        if not hasattr(self, "_single"):
            self._single = {b: t for t, b in self.bytes_of.items() if len(b) == 1}
        ids = [self._single[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            rank, at = min((self.merges.get(pair, (NEVER, 0))[0], i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == NEVER:
                break
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        return ids

    def follows(self, first: int, second: int) -> bool:
        """Whether the two tokens stay apart.

        A merge of an edge token of the first with one of the second happens if it comes before
        both are swallowed. With equal ranks the leftmost goes first: the first token's own merge
        before the one across, the one across before the second token's own.
        """
        apart = True
        for a, swallowed_a in self.right_edge[first]:
            for b, swallowed_b in self.left_edge[second]:
                merge = self.merges.get((a, b))
                if merge and merge[0] < swallowed_a and merge[0] <= swallowed_b:
                    apart = False
                    break
            if not apart:
                break
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[first << 32 | second] = apart
        return apart

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Encodings of distinct words, in sorted order: the walk over their trie."""
        find, follows, known, longest, bytes_of = self.ids.get, self.follows, self.pairs.get, self.longest, self.bytes_of
        states, before = [-1], b""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    token = find(word[start:end])
                    if token is None:
                        continue
                    if start:
                        apart = known(states[start] << 32 | token)
                        if not (follows(states[start], token) if apart is None else apart):
                            continue
                    states.append(token)
                    break
            found, end = [], len(word)
            while end:
                found.append(states[end])
                end -= len(bytes_of[states[end]])
            found.reverse()
            before = word
            yield word, found

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


class TextCoder:
    """Whole texts through a :class:`Bpe`, with the worker's store of known words."""

    def __init__(self, path: str):
        self.bpe = Bpe(path)
        self.find, self.odd = re.compile(WORDS).findall, re.compile(ODD).search
        self.spans = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.decimals: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.bpe.special)) + ")").split

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.decimals)
        if len(self.decimals) + len(new) > MOST_WORDS:
            self.decimals.clear()
            self.decoded.clear()
            new = words
        for word, ids in self.bpe.encode_words([w.encode() for w in new if w not in self.bpe.special]):
            self.decimals[text := word.decode()] = ",".join(map(str, ids))
            self.decoded[text] = self.bpe.decode(ids)
        for special, token in self.bpe.special.items():
            self.decimals[special], self.decoded[special] = str(token), self.bpe.bytes_of[token]

    def words(self, text: str) -> list[str]:
        """Words and special tokens, in order."""
        if any(s in text for s in self.bpe.special):
            return [w for i, part in enumerate(self.cut(text)) for w in ([part] if i % 2 else self.plain_words(part))]
        return self.plain_words(text)

    def plain_words(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.spans(text)] if self.odd(text) else self.find(text)

    def run(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids, as decimals joined by commas, and the bytes that they decode to."""
        at = 0
        while at < len(texts):
            some, size, distinct = [], 0, set()
            while at < len(texts) and (not some or size + len(texts[at]) < 4_000_000):
                some.append(self.words(texts[at]))
                distinct.update(some[-1])
                size += len(texts[at])
                at += 1
            self.learn(distinct)
            for words in some:
                yield ",".join(map(self.decimals.__getitem__, words)), b"".join(map(self.decoded.__getitem__, words))


_coders: dict[str, TextCoder] = {}


def coder(path: str) -> TextCoder:
    """The worker's coder for a vocabulary file."""
    if path not in _coders:
        _coders[path] = TextCoder(path)
    return _coders[path]


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id``, ``ids`` (array of int) and ``decoded`` (string) for every row of ``docs``.

    Null text counts as empty and gives no ids; repeated rows give repeated results; other
    columns of ``docs`` are not read.
    """

    def run(batches):
        own = coder(vocabulary)
        for batch in batches:
            out = list(own.run(batch.column(1).to_pylist()))
            ids = [list(map(int, x.split(","))) if x else [] for x, _ in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([d.decode("utf-8", "replace") for _, d in out], pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id)


def digests(docs: DataFrame, vocabulary: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """As :func:`encode_decode`, but ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` instead of the ids and text.

    The digests are taken where the ids are made, so neither ids nor decoded texts leave the worker.
    """

    def run(batches):
        own = coder(vocabulary)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids, decoded in own.run(batch.column(1).to_pylist()):
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id)
