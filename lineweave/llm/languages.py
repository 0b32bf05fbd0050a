"""Language of words in code-switched text by a linear-chain conditional random field.

A line of a text is a sequence of words. A word's score for a language sums learned weights of its affixes, character
n-grams and, if it is in the lexicon of frequent training words, of the word itself; transitions between the languages
of neighbouring words are learned too. Forward-backward gives each word's posterior, and the text's language is the
one with the largest sum. Weights are fitted on a bounded sample of labelled documents; lines of different documents
are chained in training, so that changes of language occur.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import WORD_BYTES, crc_of_id, has_letter, pick, utf8

#: The sample for fitting: so many documents of each language, at most so many in all, none over so many bytes.
DOCS_PER_LANG, SAMPLE_DOCS, SAMPLE_BYTES = 150, 3000, 20_000
#: Rows without an id all have one place in the order, so no language has more than these of them; ranks up to this are cut before the shuffle.
MOST_PER_LANG = 1000
FEATURES = 1 << 15
LEXICON_LEAST = 3
EPOCHS = 30
#: Chains to learn from are lines, longer ones in pieces of so many words: a pass takes as many steps as the longest chain has words.
PIECE_WORDS = 48
#: Words that a worker remembers; then it starts anew. Words scored at once.
KNOWN_WORDS, AT_ONCE = 200_000, 100_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def lines_of(text: str | None) -> list[list[bytes]]:
    """Words of each line that has some, lower-cased; signs and digits part words."""
    return [w for line in utf8(None if text is None else text.lower()).split(b"\n") if (w := line.translate(WORD_BYTES).split())]


def features(words: list[bytes], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word and where each word's begin: n-grams of 1 to 3 bytes inside the word, affixes of
    2 to 4 bytes with the word's border, and the word itself if its hash is in the sorted lexicon."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    rolled, owner, found = data.copy(), [], []
    for n in range(1, 5):
        if n > 1:
            rolled = rolled[:-1] * np.uint64(257) + data[n - 1 :]
        first = word[: len(rolled)]
        same = first == word[n - 1 :]
        if n == 4:  # affixes only
            same &= (data[: len(rolled)] == 2) | (data[n - 1 :] == 3)
        elif n == 1:
            same &= data > 3
        found.append((rolled[same] + np.uint64(n)) * MULTIPLIER)
        owner.append(first[same])
    key = np.array([hash_word(w) for w in words], np.uint64) if len(lexicon) else np.zeros(0, np.uint64)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, key), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == key)
        found.append((key[known] + np.uint64(9)) * MULTIPLIER)
        owner.append(known)
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    index = (found[order] >> np.uint64(40)) % np.uint64(FEATURES)
    starts = np.searchsorted(owner[order], np.arange(len(words)))
    assert ends[-1] == len(data)
    return index.astype(np.int32), starts


def hash_word(word: bytes) -> int:
    h = 1469598103934665603
    for b in word:
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class Chains:
    """Sequences of different lengths side by side, longest first: step t holds the t-th word of the first live[t] ones."""

    order: np.ndarray
    offsets: np.ndarray
    live: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray) -> Chains:
        order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        live = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        return cls(order, starts, live)


def forward_backward(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each label for each word, expected moves, log normaliser. scores: words of all sequences, end to end."""
    chains = Chains.of(lengths)
    top = scores.max(axis=1, keepdims=True)
    emit, step = np.exp(scores - top), np.exp(moves)
    alpha, beta, expected = np.empty_like(emit), np.empty_like(emit), np.zeros_like(step)
    scale = np.empty(len(emit))
    for t, n in enumerate(chains.live):
        at = chains.offsets[:n] + t
        now = emit[at] * (alpha[at - 1] @ step) if t else emit[at]
        scale[at] = total = now.sum(axis=1)
        alpha[at] = now / total[:, None]
    for t in range(len(chains.live) - 1, -1, -1):
        n = chains.live[t]
        at = chains.offsets[:n] + t
        beta[at] = 1.0
        if t + 1 < len(chains.live) and (m := chains.live[t + 1]):
            next_ = at[:m] + 1
            ahead = emit[next_] * beta[next_] / scale[next_][:, None]
            beta[at[:m]] = ahead @ step.T
            expected += alpha[at[:m]].T @ ahead
    return alpha * beta, expected * step, float(np.log(scale).sum() + top.sum())


@dataclass
class Model:
    """Languages in order, feature weights (FEATURES x languages), transition weights, sorted hashes of the lexicon."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: np.ndarray

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        index, starts = features(words, self.lexicon)
        return np.add.reduceat(self.weights[index], starts, axis=0).astype(np.float64)


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, decay: float = 1e-4) -> Model:
    """A model of these texts, every word of which counts as of its text's language; maximum likelihood by Adam."""
    names = sorted(set(langs))
    lines = [(line[k : k + PIECE_WORDS], names.index(y)) for text, y in zip(texts, langs, strict=True) for line in lines_of(text) for k in range(0, len(line), PIECE_WORDS)]
    if not lines:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0)), np.zeros(0, np.uint64))
    counts = Counter(w for line, _ in lines for w in line)
    lexicon = np.array(sorted(hash_word(w) for w, n in counts.items() if n >= LEXICON_LEAST), np.uint64)
    distinct = {w: k for k, w in enumerate(counts)}
    index, starts = features(list(distinct), lexicon)
    random = np.random.default_rng(7)
    shuffled = [lines[k] for k in random.permutation(len(lines))]
    chains = [shuffled[k : k + 2] for k in range(0, len(shuffled), 2)]
    lengths = np.array([sum(len(line) for line, _ in c) for c in chains])
    ids = np.array([distinct[w] for c in chains for line, _ in c for w in line])
    gold = np.array([y for c in chains for line, y in c for _ in line])
    within = np.ones(len(ids), bool)
    within[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = False
    n = len(names)
    gold_moves = np.zeros((n, n))
    np.add.at(gold_moves, (gold[:-1][within[1:]], gold[1:][within[1:]]), 1)
    gold_words = np.zeros((len(distinct), n))
    np.add.at(gold_words, (ids, gold), 1)
    spread = np.diff(np.append(starts, len(index)))
    owner = np.repeat(np.arange(len(distinct)), spread)
    params = [np.zeros((FEATURES, n)), np.zeros((n, n))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for epoch in range(1, epochs + 1):
        scores = np.add.reduceat(params[0][index], starts, axis=0)
        posterior, expected, _ = forward_backward(scores[ids], params[1], lengths)
        word_error = gold_words - np.stack([np.bincount(ids, posterior[:, k], len(distinct)) for k in range(n)], axis=1)
        grad = np.stack([np.bincount(index, word_error[owner, k], FEATURES) for k in range(n)], axis=1)
        grads = [grad / len(ids) - decay * params[0], (gold_moves - expected) / len(ids) - decay * params[1]]
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += 0.1 * (a / (1 - 0.9**epoch)) / (np.sqrt(b / (1 - 0.99**epoch)) + 1e-10)
    return Model(names, params[0].astype(np.float32), params[1], lexicon)


def learnable(docs: DataFrame) -> Column:
    return docs["lang"].isNotNull() & (crc_of_id(docs["doc_id"]) % 4 != 2)


def train(docs: DataFrame) -> Model:
    """A model from a sample of labelled documents, each language sampled by the hash of doc_id and, with many languages, thinned alike.

    The sample holds DOCS_PER_LANG documents of each language and SAMPLE_DOCS in all; texts over SAMPLE_BYTES are left out of
    it, not out of what is told. fit() chains lines of different documents in random order, so the learned weights of
    changes say how often that order changes language, not how often writers do.
    """
    rows = pick(docs, "doc_id", "text", "lang")
    rows = rows.where(learnable(rows) & F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(SAMPLE_DOCS + 1).collect()}
    if len(sizes) > SAMPLE_DOCS:
        raise ValueError(f"over {SAMPLE_DOCS} languages, more than the sample has documents")
    below = [(lang, int((1 << 40) * min(1.0, DOCS_PER_LANG / n))) for lang, n in sizes.items()]
    some = rows.join(F.broadcast(docs.sparkSession.createDataFrame(below, "lang string, below long")), "lang").where("at < below")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))
    each = max(1, min(MOST_PER_LANG, SAMPLE_DOCS // max(1, len(sizes))))
    got = some.withColumn("rank", rank).where(F.col("rank") <= each).orderBy("at", "doc_id").select("text", "lang").collect()
    return fit([r["text"] for r in got], [r["lang"] for r in got])


class Labeller:
    """Posteriors of the words of texts; remembers words' scores."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.scores = np.zeros((0, len(model.langs)))

    def __call__(self, texts: list[list[list[bytes]]]) -> list[np.ndarray]:
        """For each text a row of posteriors for each of its words."""
        if len(self.index) > KNOWN_WORDS:
            self.index, self.scores = {}, self.scores[:0]
        known = self.index
        lines = [line for text in texts for line in text]
        new = list({w for line in lines for w in line if w not in known})
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.word_scores(new)])
        lengths = np.array([len(line) for line in lines], np.int64)
        ids = np.fromiter((known[w] for line in lines for w in line), np.int64, int(lengths.sum()))
        posterior, _, _ = forward_backward(self.scores[ids], self.model.moves, lengths)
        ends = np.cumsum([sum(map(len, text)) for text in texts])
        return np.split(posterior, ends[:-1])


def summed(posterior: np.ndarray, langs: list[str]) -> tuple[str, float]:
    mean = posterior.mean(axis=0)
    return langs[int(mean.argmax())], float(min(1.0, max(0.0, mean.max())))


def language_of(model: Model):
    """A function of a text column: struct<lang_pred, score, n_words>. Null texts, and texts without letters, are ``und`` with score 0."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64())])

    @F.arrow_udf("struct<lang_pred: string, score: double, n_words: bigint>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        label = Labeller(model)
        for batch in batches:
            out: list[dict] = [{"lang_pred": "und", "score": 0.0, "n_words": 0}] * len(batch)
            some: list[tuple[int, list[list[bytes]]]] = []
            held = 0

            def run(some: list, out: list) -> None:
                for (k, lines), p in zip(some, label([x for _, x in some]), strict=True):
                    lang, score = summed(p, model.langs)
                    out[k] = {"lang_pred": lang, "score": score, "n_words": sum(map(len, lines))}

            for k, text in enumerate(batch):
                lines = lines_of(text.as_py())
                if lines and model.langs and any(map(has_letter, lines)):
                    some.append((k, lines))
                    held += sum(map(len, lines))
                if held >= AT_ONCE:
                    run(some, out)
                    some, held = [], 0
            if some:
                run(some, out)
            yield pa.array(out, kind)

    return of


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line, word, lang, score: one row per word; words as lines_of() gives them.

    Null and empty texts, and texts without words, give no row, as does a model without languages. Rows that repeat or lack
    an id stay rows of their own. Long texts are read whole. An empty table gives no rows.
    """

    @F.arrow_udf("array<struct<line: bigint, word: string, lang: string, score: double>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        label = Labeller(model)
        kind = pa.list_(pa.struct([("line", pa.int64()), ("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            rows = []
            for text in batch:
                lines = lines_of(text.as_py()) if model.langs else []
                flat = [(i, w.decode("utf-8", "replace")) for i, line in enumerate(lines) for w in line]
                best = label([lines])[0] if lines else []
                rows.append([{"line": i, "word": w, "lang": model.langs[int(p.argmax())], "score": float(p.max())} for (i, w), p in zip(flat, best, strict=True)])
            yield pa.array(rows, kind)

    return pick(docs, "doc_id", "text").select("doc_id", F.explode(of("text")).alias("w")).select("doc_id", "w.*")


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words: one row per document, also for repeated rows and null ids (held_out false).

    Null and empty texts, and texts without letters, are ``und`` with score 0, as is everything if nothing could be
    learned (an empty table, no labels). Long texts are read whole.
    """
    model = model or train(docs)
    rows = pick(docs, "doc_id", "text")
    found = language_of(model)
    return rows.select("doc_id", (crc_of_id(F.col("doc_id")) % 4 == 2).alias("held_out"), found("text").alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score", "found.n_words")


def keep_known(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language is told with a mean posterior of ``least``; ``und`` goes. All columns stay, whatever their names.

    Null and empty texts, and texts without letters, are ``und``. Each row is told by its own text, whatever its doc_id. A
    code-switched text, whose mean posterior is split, stays; a text in a language that the labels don't name is
    told as the most similar one. An empty table gives no rows, and without labels nothing is kept.
    """
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = language_of(train(docs))(F.col(f"c{docs.columns.index('text')}"))
    return flat.where((found["lang_pred"] != "und") & (found["score"] >= least)).toDF(*docs.columns)
