"""Token counts by a unigram model: forward scores in a trie of distinct pre-tokens.

A pre-token is a run of anything but ASCII white space with the word mark before
it. Its best segmentation into pieces of a public vocabulary has the highest sum
of scores. The distinct pre-tokens of a pass are put into a trie; the forward
score of a node (the best of all segmentations of its path) is computed once
for all pre-tokens that share the prefix, and the count of pieces is stored
where a pre-token ends.

The public vocabulary is a merge list without probabilities, and tokenizers are
not trained here: a piece's score is minus the logarithm of its place, as in
Zipf's law, so an early piece is preferred. The counts are those of this
unigram segmentation. They are near, but not equal to, those of the library's
merges of the same vocabulary. Bytes of characters in no piece count as one
token each.
"""

from __future__ import annotations

import functools
import math
from collections import ChainMap
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, passes, prepare, tidy

MARK = "▁"
#: Bytes, about, of the pre-tokens whose counts a worker keeps; the store starts anew beyond it.
KEEP_BYTES = 48 << 20
#: A longer pre-token is scored by itself, with the last few scores only in memory.
LONG = 1024
_OUT = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("n_byte_tokens", pa.int64())])

#: The score, the tokens and the byte tokens among them of a node's best segmentation.
Best = tuple[float, int, int]


class Vocabulary:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0  # of a byte
        self.known: dict[bytes, tuple[int, int]] = {}
        self.held = 0

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        pieces = [(i, p.id_to_piece(i)) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        return cls({x: -math.log(2 + k) for k, (_, x) in enumerate(pieces)})

    def counts(self, pretokens: set[bytes]) -> Mapping[bytes, tuple[int, int]]:
        """(tokens, byte tokens among them) of each pre-token at least; new ones go through a trie."""
        if self.held > KEEP_BYTES:
            self.known, self.held = {}, 0
        long = {w: self.alone(MARK + w.decode("utf-8", "replace")) for w in pretokens if len(w) > LONG}
        out = ChainMap(self.known, long) if long else self.known
        # The sorted pre-tokens are the trie in depth-first order; the stack holds the
        # path to the last one.
        path, stack = MARK, [(0.0, 0, 0)]
        stack.append(self.node(MARK, 1, stack))
        for word in sorted(w for w in pretokens if w not in out):
            text = MARK + word.decode("utf-8", "replace")
            shared = 0
            for a, b in zip(path, text):  # noqa: B905
                if a != b:
                    break
                shared += 1
            del stack[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                stack.append(self.node(text, end, stack))
            path = text
            self.known[word] = stack[-1][1:]
            self.held += len(word) + 160
        return out

    def alone(self, text: str) -> tuple[int, int]:
        """The same for one text of any length, in memory that does not grow with it."""
        last: list[Best] = [(0.0, 0, 0)]
        for end in range(1, len(text) + 1):
            last.append(self.node(text, end, last))
            if len(last) > 4 * self.longest + 64:
                del last[: -self.longest]
        return last[-1][1:]

    def node(self, text: str, end: int, before: list[Best]) -> Best:
        """The best of all segmentations of text[:end], from those of its prefixes (the last ones are enough); between equal scores the longer last piece."""
        best = None
        for size in range(min(self.longest, end), 0, -1):
            if (score := self.scores.get(text[end - size : end])) is not None:
                was = before[-size]
                if best is None or was[0] + score > best[0]:
                    best = (was[0] + score, was[1] + 1, was[2])
        last = text[end - 1]
        if best is None or last not in self.scores:
            # A character in no piece of its own: its bytes.
            size, was = len(last.encode()), before[-1]
            if best is None or was[0] + size * self.unknown > best[0]:
                best = (was[0] + size * self.unknown, was[1] + size, was[2] + size)
        return best


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def counter(path: str):
    @tidy
    def count(batches):
        v = vocabulary(path)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in passes(batch):
                split = [t.split() for t in texts]
                known = v.counts({w for ws in split for w in ws})
                out = []
                for i, ws in enumerate(split):
                    got = [known[w] for w in ws]
                    out.append((ids[first + i], len(ws), sum(a for a, _ in got), sum(b for _, b in got)))
                yield batch_of(_OUT, zip(*out, strict=True))

    return count


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens and n_byte_tokens (in n_tokens) of each row; ``path`` names the vocabulary on every executor.

    A null or blank text has none. Repeated and null doc_ids keep a row each. An
    empty table gives an empty one. Time grows in proportion to a text's length,
    whatever the length of its words.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(counter(path), "doc_id bigint, n_pretokens bigint, n_tokens bigint, n_byte_tokens bigint")
