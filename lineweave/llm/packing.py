"""Sum-of-squares online packing of token ids into fixed windows.

Every document is tokenised whole and closed by an end id. What fills whole windows becomes whole windows; the rest
goes, in the order documents come, to the fill level that keeps the sum over levels of the squared number of
partially filled windows smallest. Those numbers stand in an array by level. Each task packs its own partition, so
nothing is gathered; at its end the few windows that are still open are filled up from the emptiest of them.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lineweave.llm.common import pick

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pre-tokenised units remembered by a worker; then it starts anew.
UNITS = 400_000
MARKS = ".,;:!?"
# Fixed value: where the tokenizer's pattern sets borders.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, as the tokenizer of this file gives them.

    A byte-level BPE never merges over the borders that its pattern sets. A single white-space character between two
    others is such a border, so a text where white space never stands in runs is the sum of its units: the first
    word, and each later word with the space or line end before it. Units are looked up, new ones tokenised from the
    same vocabulary as ranks. Texts with runs of white space, or with a special token's string, go to the tokenizer whole.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ordinary = Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.units: dict[str, bytes] = {}
        self.marks = {c: self.ids(c) for c in MARKS}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def unit(self, word: str) -> bytes | None:
        """Ids of a word that follows a space, or begins with a line end; None if it isn't a unit."""
        at = word[:1] == "\n"
        if not word or word[at : at + 1].isspace() or word[-1].isspace():
            return None
        core, sign = word[:-1], word[-1]
        if sign in self.marks and core[at:].isalpha():  # a run of letters ends before a mark
            ids = self.units.get(core)
            if ids is None:
                self.units[core] = ids = self.ids(core if at else " " + core)
            return ids + self.marks[sign]
        return self.ids(word if at else " " + word)

    def ids(self, text: str) -> bytes:
        return array("I", self.ordinary(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        if not first or first[0].isspace() or first[-1].isspace():
            return self.whole(text)
        known = self.units
        if len(known) > UNITS:
            known.clear()
        ids = list(map(known.get, rest))
        if None in ids:
            for k, got in enumerate(ids):
                if got is None:
                    word = rest[k]
                    got = known.get(word) or self.unit(word)
                    if got is None:
                        return self.whole(text)
                    known[word] = ids[k] = got
        return self.ids(first) + b"".join(ids)


@lru_cache(maxsize=1)
def encoder(tokenizer_path: str, ranks_path: str) -> Encoder:
    """One for each worker process, kept from task to task."""
    return Encoder(tokenizer_path, ranks_path)


class Packer:
    """Windows of one task. A piece is (doc_id, start, bytes of ids, doc_tokens)."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.done: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        full = len(ids) - len(ids) % step
        for at in range(0, full, step):
            self.close([(doc_id, at // 4, ids[at : at + step], total)])
        if rest := ids[full:]:
            self.place((doc_id, full // 4, rest, total))

    def place(self, piece: tuple) -> None:
        n, levels, window = len(piece[2]) // 4, self.levels, self.window
        last = window - n
        change = 2 * (levels[n:] - levels[: last + 1]) + 2  # from level h to h + n, for each h
        change[last] = 1 - 2 * levels[last]  # full windows aren't counted
        change[levels[: last + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * levels[n] + 1  # a new window
        h = last - int(change[::-1].argmin())  # of equals the fullest
        pieces = [piece]
        if h:
            levels[h] -= 1
            pieces = self.open[h].pop() + pieces
        if h + n == window:
            self.close(pieces)
        else:
            levels[h + n] += 1
            self.open.setdefault(h + n, []).append(pieces)

    def finish(self) -> None:
        """The emptiest open windows are cut to fill up the fullest, so one window at most stays unfilled."""
        still = [(h, pieces) for h in sorted(self.open, reverse=True) for pieces in self.open[h]]
        self.open, i, j = {}, 0, len(still) - 1
        source = list(still[j][1]) if still else []
        while i < j:
            level, pieces = still[i]
            pieces = list(pieces)
            while level < self.window and i < j:
                doc_id, start, ids, total = source.pop()
                room = 4 * (self.window - level)
                if len(ids) > room:
                    source.append((doc_id, start, ids[:-room], total))
                    start, ids = start + (len(ids) - room) // 4, ids[-room:]
                pieces.append((doc_id, start, ids, total))
                level += len(ids) // 4
                if not source:
                    j -= 1
                    source = list(still[j][1]) if j > i else []
            if level == self.window or i >= j:
                self.close(pieces)
                i += 1
        if i == j and source:
            self.close(source)


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of a document.

    Null and empty texts give the end id alone. Every id lies in exactly one piece; repeated rows are packed as often
    as they occur and a null doc_id stays null. A very long text is cut at windows. sequence_id holds the task's
    partition in its upper bits. An empty table gives no rows.
    """
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer_path, ranks_path), Packer(window, TaskContext.get().partitionId() << 36)

        def out() -> pa.RecordBatch:
            rows, packer.done = packer.done, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, encode(text.as_py() or "") + end)
            yield out()
        packer.finish()
        yield out()

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
