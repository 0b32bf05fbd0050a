"""Token counts of texts under a unigram piece model, by dynamic programming shared in a trie.

A text is cut into pre-tokens (a word with the space before it, or a run of white space). The distinct new pre-tokens
of a chunk of texts form one trie, which is walked level by level: a node's best log-probability and number of pieces
are computed once for all words that share the prefix, and where a word ends its node's number is stored. A level is a
few array operations over all of its nodes; where few words are left, as in a long run without spaces, they are walked
byte by byte, what they share once.

Pieces come from a public vocabulary file, and no tokenizer is trained: a piece's probability follows Zipf's law by its
merge rank in that file. These are not probabilities that a unigram tokenizer has learned from text.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import pick, utf8

PRE_TOKEN = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+?(?= ?[^\x20\x09-\x0D]|\Z)")
ZIPF_SHIFT = 2.7
#: Pre-tokens that a worker remembers, then it starts anew; bytes of the texts whose new pre-tokens share a trie.
KNOWN, CHUNK_BYTES = 400_000, 1 << 22
#: With so few words left a level is a few bytes, and steps one by one are faster than array operations.
NARROW = 16


def piece_scores(path: str) -> dict[bytes, float]:
    """Piece -> log-probability, up to a constant, from a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): -math.log(int(b) + ZIPF_SHIFT) for a, b in (x.split() for x in lines if x.strip())}


class Vocabulary:
    """Pieces as an automaton over bytes: sorted keys (state, byte) with the state each leads to; for each state the score
    of the piece that ends there, or nan, and whether longer pieces go on from it."""

    def __init__(self, scores: dict[bytes, float]):
        total = math.log(sum(map(math.exp, scores.values()))) if scores else 0.0
        steps: dict[tuple[int, int], int] = {}
        ends: dict[int, float] = {}
        for piece, score in [*scores.items(), *((bytes([b]), total - 30.0) for b in range(256) if bytes([b]) not in scores)]:  # so that every text can be cut
            state = 0
            for b in piece:
                state = steps.setdefault((state, b), len(steps) + 1)
            ends[state] = score - total
        order = sorted(steps)
        self.keys = np.array([state << 8 | b for state, b in order], np.int64)
        self.states = np.array([steps[k] for k in order], np.int64)
        self.score = np.full(len(steps) + 1, np.nan)
        self.score[list(ends)] = list(ends.values())
        self.goes_on = np.zeros(len(steps) + 1, bool)
        self.goes_on[self.keys >> 8] = True

    @cached_property
    def plain(self) -> tuple[dict[int, int], list[float], list[bool]]:
        """The automaton as plain values, for steps one by one."""
        return dict(zip(self.keys.tolist(), self.states.tolist(), strict=True)), self.score.tolist(), self.goes_on.tolist()

    def step(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these states have a way on with their byte, and where those lead."""
        key = states << 8 | data
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        alive = np.flatnonzero(self.keys[at] == key)
        return alive, self.states[at[alive]]


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(piece_scores(path))


def narrow_counts(words: list[bytes], depth: int, pieces: list[tuple[float, int, int]], n_pieces: int, vocabulary: Vocabulary) -> list[int]:
    """trie_counts() below a node at ``depth``, byte by byte: for few words, such as one run of letters without spaces.

    pieces: score and count where each begins, and state. Words are sorted; what they share is walked once.
    """
    step, scores, goes_on = vocabulary.plain
    counts, left = [0] * len(words), [(0, len(words), depth, pieces, n_pieces)]
    while left:
        low, high, depth, pieces, n_pieces = left.pop()
        while True:
            while low < high and len(words[low]) == depth:
                counts[low] = n_pieces
                low += 1
            if low == high:
                break
            byte = words[low][depth]
            if words[high - 1][depth] != byte:
                parting = next(k for k in range(low, high) if words[k][depth] != byte)
                left.append((parting, high, depth, pieces, n_pieces))
                high = parting
            going, best, least = [], -np.inf, 0
            for value, n, state in pieces:
                after = step.get(state << 8 | byte)
                if after is None:
                    continue
                own = value + scores[after]
                if own > best or own == best and n + 1 < least:  # a state that ends no piece has no score: never larger
                    best, least = own, n + 1
                if goes_on[after]:
                    going.append((value, n, after))
            pieces, n_pieces, depth = [*going, (best, least, 0)], least, depth + 1
    return counts


def trie_counts(words: list[bytes], vocabulary: Vocabulary) -> dict[bytes, int]:
    """The number of pieces in the likeliest cut of each distinct word; of equally likely cuts the one with the fewest."""
    words = sorted(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    counts = np.zeros(len(words), np.int64)
    live, node = np.arange(len(words)), np.zeros(len(words), np.int64)  # words not ended, and their node on this level
    n_pieces = np.zeros(1, np.int64)  # of each node
    # pieces begun but not ended, in order of their node: score and count where they begin, state
    owner, score, begun, state = np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64)
    depth = 0
    while len(live):
        done = sizes[live] == depth
        counts[live[done]] = n_pieces[node[done]]
        live, node = live[~done], node[~done]
        if not len(live):
            break
        if len(live) <= NARROW:
            for own in np.unique(node):
                among, here = live[node == own], slice(*np.searchsorted(owner, [own, own + 1]))
                pieces = list(zip(score[here].tolist(), begun[here].tolist(), state[here].tolist(), strict=True))
                counts[among] = narrow_counts([words[k] for k in among], depth, pieces, int(n_pieces[own]), vocabulary)
            break
        byte = data[starts[live] + depth]
        fresh = np.append(True, (node[1:] != node[:-1]) | (byte[1:] != byte[:-1]))  # words are sorted: a node's stand together
        parent, n = node[fresh], int(fresh.sum())
        first, last = np.searchsorted(owner, parent, "left"), np.searchsorted(owner, parent, "right")
        many = last - first
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        child = np.repeat(np.arange(n), many)
        alive, after = vocabulary.step(state[at], byte[fresh][child])
        at, child = at[alive], child[alive]
        ended = np.flatnonzero(~np.isnan(vocabulary.score[after]))
        own, value, pieces = child[ended], score[at[ended]] + vocabulary.score[after[ended]], begun[at[ended]] + 1
        edge = np.searchsorted(own, np.arange(n))  # single bytes are pieces, so each node has some
        best = np.maximum.reduceat(value, edge)
        n_pieces = np.minimum.reduceat(np.where(value == best[own], pieces, np.iinfo(np.int64).max), edge)
        going = vocabulary.goes_on[after]
        owner = np.concatenate([child[going], np.arange(n)])
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        score = np.concatenate([score[at[going]], best])[order]
        begun = np.concatenate([begun[at[going]], n_pieces])[order]
        state = np.concatenate([after[going], np.zeros(n, np.int64)])[order]
        node, depth = np.cumsum(fresh) - 1, depth + 1
    return dict(zip(words, counts.tolist(), strict=True))


class Counter:
    """Token counts of chunks of texts; remembers what pre-tokens have."""

    def __init__(self, vocabulary: Vocabulary, known: int = KNOWN):
        self.vocabulary, self.most, self.known = vocabulary, known, {}

    def __call__(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """Tokens, pre-tokens and bytes of each text."""
        found = [PRE_TOKEN.findall(x) for x in texts]
        distinct = set().union(*found)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = distinct
        if new:
            self.known.update(trie_counts(list(new), self.vocabulary))
        return [(sum(map(self.known.__getitem__, x)), len(x), len(text)) for x, text in zip(found, texts, strict=True)]


def count_tokens(docs: DataFrame, vocabulary_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_pre_tokens, n_bytes: one row per document, also for repeated rows and null ids.

    Null and empty texts have 0 of each. Long texts, and pre-tokens of any length, are read whole; a text over
    ``chunk_bytes`` is a chunk of its own. An empty table gives no rows.
    """
    names = ("n_tokens", "n_pre_tokens", "n_bytes")

    @F.arrow_udf("struct<n_tokens: bigint, n_pre_tokens: bigint, n_bytes: bigint>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = Counter(vocabulary_of(vocabulary_path))
        for batch in batches:
            rows, held, size = [], [], 0
            for text in batch:
                held.append(utf8(text.as_py()))
                size += len(held[-1])
                if size >= chunk_bytes:
                    rows += count(held)
                    held, size = [], 0
            rows += count(held)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], names)

    return pick(docs, "doc_id", "text").select("doc_id", of("text").alias("n")).select("doc_id", "n.*")
