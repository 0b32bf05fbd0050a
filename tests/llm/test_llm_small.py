"""Corpus operators on odd rows: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import html
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lineweave.llm import decontamination, html_text, languages, packing, quality, sharding, simhash, token_counts, top_k, toxicity
from lineweave.llm.common import pick
from lineweave.llm.queries import RANKS, TOKENIZER

LONG = " ".join(f"word{k % 977}" for k in range(60_000))
TEXTS = [
    (1, "the cat and the dog are in the house with the others"), (2, "the cat and the dog are in the house with the others"), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG + " end"), (None, "no id here at all"),
    (8, "der Hund und die Katze sind in dem Haus"), (8, "der Hund und die Katze sind in dem Haus"), (9, "12 34 !!"), (10, "x"), (11, "a  b\n\nc <|endoftext|> d e"), (12, "É été à la maison, l'ami — ça va"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else "de", "s", k, 0.5, "x") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, TEXT2 string").withColumnRenamed("TEXT2", "shard")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (8, 1, 0), (8, 1, 1), (99, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int")


def components(fps, bits=4):
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(k) for k in range(len(fps))]


def plain_simhash(text, width=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_pick_takes_exact_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, TEXT string, text string")
    assert pick(df, "text", "doc_id").first() == ("b", 1)
    with pytest.raises(ValueError, match="no column"):
        pick(df, "html")


def test_positions_meet_every_large_enough_match():
    from itertools import combinations

    for matches in range(1, 9):
        sets = simhash.positions(matches)
        assert all(any(set(s) <= set(m) for s in sets) for m in combinations(range(8), matches)), matches
    assert len(simhash.positions(4)) == 20


def test_simhash(spark, docs, none):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_simhash(t) for _, t in TEXTS]
    roots = components(fps)
    low = {r: min((i for (i, _), q in zip(TEXTS, roots, strict=True) if q == r and i is not None), default=None) for r in roots}
    assert got == {(i, f"{f:016x}", low[r]) for (i, _), f, r in zip(TEXTS, fps, roots, strict=True)}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r[0] or 0 for r in kept.select("doc_id").collect()).count(2) == 0


def test_simhash_of_close_fingerprints_in_blocks(spark):
    """Chains of links and a dense group, with posting lists cut into blocks of seven."""
    rnd = np.random.default_rng(3)
    base = [int(x) for x in rnd.integers(0, 2**63, 40)]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(6):
            x ^= sum(1 << int(k) for k in rnd.choice(64, int(rnd.integers(1, 7)), replace=False))
            fps.add(x)
    fps |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    for bits in (4, 5):
        found = simhash.components(simhash.links(df, bits, block_rows=7))
        root = {r["node"] & (2**64 - 1): r["root"] for r in found.collect()}
        want = components(fps, bits)
        mine = [root.get(f, f) for f in fps]
        assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want)), bits


def test_sharding(spark, docs, none):
    rows = sharding.shards(docs, 3, items=4).collect()
    assert len(rows) == len(TEXTS) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    for shard in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert sharding.shards(none).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.repeat(F.lit("w "), (F.col("id") % 97).cast("int"))).alias("text"))
    sums = [r["b"] for r in sharding.shards(many, 24).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 24 and max(sums) <= 1.03 * min(sums)  # a hundred groups, most of some thousand bytes, in shards of nine thousand


def test_equal_texts_stay_together_and_all_is_balanced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = sharding.shards(docs).join(docs.select("doc_id", "text"), "doc_id").withColumn("tokens", F.regexp_count("text", F.lit(r"\S+")))
    assert got.groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    for r in zip(*got.groupBy("shard").agg(F.sum("size"), F.sum("tokens"), F.count("*")).drop("shard").collect(), strict=True):
        assert max(r) <= 1.05 * sum(r) / 24 and min(r) >= 0.95 * sum(r) / 24, r


def test_copies_with_one_id_or_none_fill_more_than_a_shard(spark):
    """Half of the rows are copies, all with the same id or without one: cut into pieces, each no larger than a shard."""
    for own in (F.lit(7), F.lit(None).cast("long")):
        many = spark.range(4000).select(F.when(F.col("id") % 2 == 0, own).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "copy of it").otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"))
        got = sharding.shards(many, 8)
        sums = got.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
        rows, size = [r["n"] for r in sums], [r["b"] for r in sums]
        copies = got.where(F.col("text_crc32") == zlib.crc32(b"copy of it")).select("shard").distinct().count()
        assert sum(rows) == 4000 and max(rows) <= 540 and max(size) <= 1.01 * sum(size) / 8 and copies == 5


def slow_place(sizes, shards):
    """The rule one item at a time: residuals and item measured by what is still to be placed, room for the bytes first."""
    left = [[1.0] * len(sizes[0]) for _ in range(shards)]
    cap = [sum(x[d] for x in sizes) / shards for d in range(len(sizes[0]))]
    out = []
    for k, item in enumerate(sizes):
        rest = [sum(x[d] / cap[d] for x in sizes[k:]) for d in range(len(item))]
        share = [item[d] / cap[d] for d in range(len(item))]
        value = [sum(res[d] / rest[d] * share[d] / rest[d] for d in range(len(item))) for res in left]
        fits = [s for s in range(shards) if left[s][0] >= share[0]]
        best = max(fits, key=lambda s: (value[s], -s)) if fits else max(range(shards), key=lambda s: (left[s][0], -s))
        left[best] = [a - b for a, b in zip(left[best], share, strict=True)]
        out.append(best)
    return out


def test_place_is_the_rule():
    rnd = np.random.default_rng(8)
    for _ in range(20):
        sizes = np.sort(rnd.integers(1, 1000, (60, 3)).astype(float), axis=0)[::-1] * [1.0, 1.7, 3.1]
        assert sharding.place(sizes, 5).tolist() == slow_place(sizes.tolist(), 5)


def test_sharding_with_many_bins_and_a_hot_text(spark):
    """Of 75 and 150 bins each, a third of the bytes in copies of one text, and texts over a bin's share of a shard."""
    for n in (37_500, 75_000):
        text = F.when(F.col("id") % 3 == 0, F.repeat(F.lit("w "), 25)).when(F.col("id") < 30, F.repeat(F.concat(F.lit("v"), F.col("id")), 2000))
        many = spark.range(n).select(F.col("id").alias("doc_id"), text.otherwise(F.concat(F.col("id"), F.repeat(F.lit(" x"), (F.col("id") % 47).cast("int")))).alias("text"))
        got = sharding.shards(many, 24, items=500).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        sums = [r["b"] for r in got]
        assert len(sums) == 24 and sum(r["n"] for r in got) == n
        assert max(sums) <= 1.01 * sum(sums) / 24, max(sums) * 24 / sum(sums)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = sorted(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in TEXTS)
    rows = packing.pack(docs.coalesce(1), TOKENIZER, RANKS, window=64).collect()
    by_doc: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] or 0, r["start"])):
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    total = {(i, len(ids)): ids for i, ids in ((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in TEXTS)}
    for (key, pieces), _ in zip(by_doc.items(), range(99), strict=False):
        ids = total[key]
        for p in pieces:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == p["ids_crc32"] and 0 < p["length"] <= 64
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    fill: dict = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert fill.setdefault(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] += r["length"]
    assert sum(v < 64 for v in fill.values()) <= 1 and max(fill.values()) <= 64
    assert packing.pack(none, TOKENIZER, RANKS).count() == 0


def test_encoder_is_the_tokenizer():
    rnd = np.random.default_rng(1)
    parts = ["the", "Éa", "x1", "don't", ",", ".", "\n", " ", "\t", " ", "ß", "12", "中", "'s", "a.b", "!?", "<|endoftext|>", "\x1c"]
    encode = packing.encoder(TOKENIZER, RANKS)
    for _ in range(3000):
        text = "".join(parts[k] + (" " if rnd.random() < 0.5 else "") for k in rnd.integers(0, len(parts), int(rnd.integers(0, 12))))
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_sum_of_squares_choice():
    p = packing.Packer(8, 0)
    p.levels[[3, 4, 5]] = 1, 2, 1
    p.open = {3: [[(0, 0, b"0" * 12, 3)]], 4: [[(0, 0, b"0" * 16, 4)]] * 2, 5: [[(0, 0, b"0" * 20, 5)]]}
    costs = {h: sum(int(n) ** 2 for n in _after(p.levels, h, 3, 8)[1:8]) for h in (0, 3, 4, 5)}
    before = p.levels.copy()
    p.place((1, 0, b"1" * 12, 3))
    chosen = next(h for h in (5, 4, 3, 0) if np.array_equal(_after(before, h, 3, 8)[1:8], p.levels[1:8]))
    assert costs[chosen] == min(costs.values())


def _after(levels, h, n, window):
    out = levels.copy()
    out[h] -= h > 0
    out[h + n] += h + n < window
    return out


def test_languages(spark, docs, none, labels):
    rows = languages.identify(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(TEXTS) and [by[i]["lang_pred"] for i in (3, 4, 5, 9)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in rows) and {r["lang_pred"] for r in rows} <= {"und", "en", "de"}
    assert by[2]["held_out"] == (zlib.crc32(b"2") % 4 == 2)
    assert languages.identify(none).count() == 0 and languages.keep_known(docs).columns == docs.columns
    model = languages.fit(["the cat and the dog of the house"] * 4 + ["der Hund und die Katze in dem Haus"] * 4, ["en"] * 4 + ["de"] * 4)
    mixed = spark.createDataFrame([(1, "the dog of the house and the cat\nder Hund und die Katze")], "doc_id long, text string")
    words = languages.label_words(mixed, model).orderBy("line").collect()
    assert [w["lang"] for w in words] == ["en"] * 8 + ["de"] * 5


def test_rare_languages_stay_in_the_sample(spark, monkeypatch):
    ids = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    monkeypatch.setattr(languages, "fit", lambda texts, langs: langs)
    for frequent, each, rare in ((28, 400, 10), (0, 0, 310)):
        names = [f"f{k}" for k in range(frequent) for _ in range(each)] + [f"r{k}" for k in range(rare)]
        rows = spark.createDataFrame([(i, "a text", lang) for i, lang in zip(ids, names, strict=False)], "doc_id long, text string, lang string")
        got = languages.train(rows)
        assert set(got) == set(names) and len(got) <= languages.SAMPLE_DOCS


def test_forward_backward_against_all_paths():
    from itertools import product

    rnd = np.random.default_rng(2)
    lengths = np.array([3, 1, 4])
    scores, moves = rnd.normal(size=(8, 3)), rnd.normal(size=(3, 3))
    posterior, expected, log_z = languages.forward_backward(scores, moves, lengths)
    at, all_z, all_moves = 0, 0.0, np.zeros((3, 3))
    for n in lengths:
        part, want, z = scores[at : at + n], np.zeros((n, 3)), 0.0
        counts = np.zeros((3, 3))
        for path in product(range(3), repeat=int(n)):
            w = np.exp(sum(part[k, y] for k, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            z += w
            for k, y in enumerate(path):
                want[k, y] += w
            for a, b in zip(path, path[1:], strict=False):
                counts[a, b] += w
        assert np.allclose(posterior[at : at + n], want / z)
        all_moves += counts / z
        all_z += np.log(z)
        at += n
    assert np.allclose(expected, all_moves) and np.isclose(log_z, all_z)


def test_toxicity_learns_a_pair(spark, docs, none, labels):
    rows = toxicity.rate(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert toxicity.rate(none, labels).count() == 0 and toxicity.rate(docs, labels.where("false")).count() == len(TEXTS)
    rnd = np.random.default_rng(4)
    terms, marks = [], []
    for _ in range(1200):
        t = {int(k) for k in rnd.integers(10, 60, 8)} | ({1} if rnd.random() < 0.5 else set()) | ({2} if rnd.random() < 0.5 else set())
        terms.append(sorted(t))
        marks.append(int({1, 2} <= t))
    model = toxicity.fit(terms, np.array(marks))
    place = {int(t): k for k, t in enumerate(model.terms)}
    score = lambda *t: model.scores(np.zeros(len(t), int), np.array([place[x] for x in t], int), 1)[0]
    assert score(1, 2) > 0.7 > 0.5 > max(score(1), score(2))


def test_toxicity_is_the_double_loop_over_terms():
    """The score of the machine against its definition: a bias, each term's weight, each pair's product of factors."""
    rnd = np.random.default_rng(4)
    texts = [" ".join(f"term{k}" for k in rnd.integers(0, 40, 12)) for _ in range(60)] + ["", "unseen word"]
    model = toxicity.fit([sorted(toxicity.buckets(t)) for t in texts], np.array([("term3 " in f"{t} ") and ("term7 " in f"{t} ") for t in texts], float))
    known = {int(b): k for k, b in enumerate(model.terms)}
    own = [sorted({known[b] for b in toxicity.buckets(t) if b in known}) for t in texts]
    rows, cols = np.repeat(np.arange(len(texts)), [len(x) for x in own]), np.array([c for x in own for c in x], np.int64)
    for x, score in zip(own, model.scores(rows, cols, len(texts)), strict=True):
        z = model.bias + sum(model.w[i] for i in x) + sum(float(model.v[i] @ model.v[j]) for n, i in enumerate(x) for j in x[:n])
        assert abs(score - 1 / (1 + np.exp(-np.clip(z, -60, 60)))) < 1e-9


def test_words_are_labelled_on_odd_rows(spark, docs, none):
    model = languages.fit(["the cat and the dog"] * 4 + ["der Hund und die Katze"] * 4, ["en"] * 4 + ["de"] * 4)
    got = languages.label_words(docs, model).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 6, 7, None, 8, 10, 11, 12} and all(r["lang"] in ("de", "en") and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["doc_id"] == 8 for r in got) == 2 * 9
    assert languages.label_words(none, model).count() == 0 and languages.label_words(docs, languages.fit([], [])).count() == 0


def test_quality_is_the_density(spark, docs, none, labels):
    rows = quality.rate(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.rate(none, labels).count() == 0 and {r["score"] for r in quality.rate(docs, labels.where("false")).collect()} == {0.5}
    assert quality.keep_good(docs, labels, 0.0).columns == docs.columns
    rnd = np.random.default_rng(6)
    d = len(quality.NAMES)
    x = [rnd.normal(size=(200, d)), rnd.normal(size=(300, d)) * 1.5 + 1]
    model = quality.fit([(len(v), v.sum(axis=0), v.T @ v) for v in x])
    logs = []
    for prior, mean, factor in model.classes:
        cov = factor @ factor.T
        logs.append(prior - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", x[1] - mean, np.linalg.inv(cov), x[1] - mean))
    assert np.allclose(model.score(x[1]), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60))))
    assert (model.score(x[1]) > 0.5).mean() > 0.9


def slow_count(word, scores):
    best = [(0.0, 0)] + [None] * len(word)
    for j in range(1, len(word) + 1):
        options = [(best[i][0] + scores[word[i:j]], -best[i][1] - 1) for i in range(j) if word[i:j] in scores]
        s, c = max(options)
        best[j] = (s, -c)
    return best[len(word)][1]


@pytest.mark.parametrize("narrow", [0, 3, 16])
def test_narrow_tries_are_walked_alike(monkeypatch, narrow):
    """Words that part early, late and at their ends, against the whole dynamic programming; a long run without spaces in seconds."""
    monkeypatch.setattr(token_counts, "NARROW", narrow)
    rnd = np.random.default_rng(9)
    scores = {bytes(x): float(-s) for x, s in zip([rnd.choice(list(b"abc"), int(rnd.integers(1, 5))) for _ in range(40)], rnd.integers(1, 30, 40), strict=True)}
    vocabulary = token_counts.Vocabulary(scores)
    base = bytes(rnd.choice(list(b"abcd"), 60))
    for n in (1, 2, 9, 40):
        words = list({base[: int(k)] + bytes(rnd.choice(list(b"abcd"), int(m))) for k, m in zip(rnd.integers(0, 60, n), rnd.integers(1, 9, n), strict=True)})
        want = dict(zip(words, (token_counts.narrow_counts([w], 0, [(0.0, 0, 0)], 0, vocabulary)[0] for w in words), strict=True))
        assert token_counts.trie_counts(words, vocabulary) == want
    if narrow:
        began = time.perf_counter()
        token_counts.trie_counts([bytes(rnd.choice(list(b"abcd"), 300_000))], vocabulary)
        assert time.perf_counter() - began < 10


def test_trie_counts():
    rnd = np.random.default_rng(8)
    raw = {bytes([b]): -5.0 - b % 3 for b in range(256)} | {p: -float(rnd.integers(2, 9)) for p in (b"ab", b"abc", b"bc", b"ca", b" a", b"cab")}
    vocabulary = token_counts.Vocabulary(raw)
    total = np.log(sum(np.exp(v) for v in raw.values()))
    scores = {k: v - total for k, v in raw.items()}
    words = ["".join(rnd.choice(list("abc "), int(rnd.integers(0, 9)))).encode() for _ in range(400)]
    assert token_counts.trie_counts(words, vocabulary) == {w: slow_count(w, scores) for w in words}


def test_chunks_share_a_trie(monkeypatch):
    vocabulary = token_counts.Vocabulary({b"the": -1.0, b" the": -1.5, b"re": -2.0, b" t": -3.0})
    texts = [b"the there the", b"there they", b"", b"the  the", b"\xff\xfe x"]
    whole, single = token_counts.Counter(vocabulary), token_counts.Counter(vocabulary, known=2)
    seen = []
    walk = token_counts.trie_counts
    monkeypatch.setattr(token_counts, "trie_counts", lambda words, v: seen.append(sorted(words)) or walk(words, v))
    assert whole(texts) == [single([x])[0] for x in texts]
    assert len(seen[0]) == len({w for x in texts for w in token_counts.PRE_TOKEN.findall(x)})  # one trie for the chunk


def test_token_counts(docs, none):
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs, RANKS).collect()}
    assert (rows[3]["n_tokens"], rows[4]["n_tokens"], rows[6]["n_bytes"]) == (0, 0, len(LONG))
    assert rows[6]["n_pre_tokens"] == 60_000 and rows[1]["n_tokens"] >= 11
    assert token_counts.count_tokens(none, RANKS).count() == 0
    for _, t in TEXTS:
        assert b"".join(token_counts.PRE_TOKEN.findall((t or "").encode())) == (t or "").encode()


def slow_hits(text, items, size=10):
    import re

    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        n = min(size, len(b))
        for g in {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == g:
                    hit |= set(range(k, k + n))
                    found |= {str(i)} if i is not None else set()
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, docs, none):
    long_item = " ".join(f"Word{k}" for k in range(100, 113))
    items = [(1, long_item), (20, "Word110, word111; word112 word113"), (3, None), (4, "…"), (5, "!!"), (None, "no id here"), (6, "katze sind"), (7, "katze sind")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 0):
        got = sorted(((r["doc_id"] or 0, r["n_words"], sum(1 for _ in _covered(r["spans"])), r["item_ids"]) for r in decontamination.hits(docs, bench, set_windows=limit).collect()), key=str)
        want = sorted(((i or 0, *slow_hits(t, items)) for i, t in TEXTS), key=str)
        assert got == want, limit
    for r in decontamination.report(docs, bench).collect():
        assert r["contaminated"] == (r["n_hit"] > 0)
    assert decontamination.report(docs, bench.where("false")).where("n_hit > 0 or contaminated").count() == 0
    assert decontamination.report(none, bench).count() == 0
    clean = decontamination.without_leaks(docs, bench)
    assert clean.columns == docs.columns and {r[0] for r in clean.select("doc_id").collect()} == {i for i, t in TEXTS if i is not None and slow_hits(t, items)[1] == 0}
    left = {r["doc_id"]: r["words"] for r in decontamination.without_spans(docs.where("doc_id = 8"), bench).collect()}
    assert left == {8: "der hund und die in dem haus"}


def test_spans_go_row_by_row(spark):
    leak = " ".join(f"Word{k}" for k in range(100, 113))
    rows = [(8, f"before {leak} after"), (8, "other text of the same id"), (None, f"x {leak}"), (None, "clean"), (5, None), (6, ""), (7, leak), (7, leak)]
    bench = spark.createDataFrame([(1, leak), (2, leak), (None, None)], "item_id long, text string")
    for part in (rows, rows[::-1]):
        got = decontamination.without_spans(spark.createDataFrame([(*x, 0) for x in part], "doc_id long, text string, words int"), bench).collect()
        want = [(8, "before after"), (8, "other text of the same id"), (None, "x"), (None, "clean"), (5, ""), (6, ""), (7, ""), (7, "")]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert decontamination.without_spans(spark.createDataFrame(rows, "doc_id long, text string").where("false"), bench).count() == 0


def test_rows_without_or_with_equal_ids_are_told_one_by_one(spark):
    leak = " ".join(f"Word{k}" for k in range(100, 113))
    rows = [(None, leak, 1), (None, "a clean text of its own", 2), (7, leak, 3), (7, "another clean text, not like it", 4), (None, "a clean text of its own", 5), (8, "third one, seen twice in all", 6), (8, "third one, seen twice in all", 7), (9, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert sorted(r["at"] for r in decontamination.without_leaks(df, bench).collect()) == [2, 4, 5, 6, 7, 8]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(r["at"] for r in kept.collect())
    assert len(got) == 5 and {3, 4, 8} <= set(got) and len({2, 5} & set(got)) == len({6, 7} & set(got)) == 1


def _covered(spans):
    return {k for s in spans for k in range(s["start"], s["start"] + s["size"])}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-banner">We use cookies</div><div class="ad">Buy this now and for ever, it is cheap</div><main><article><h1>Title &amp; more</h1><p>First paragraph with   several words,
on two lines.<p>Second &eacute;t&#233; <b>bold<i> text</b>.</p><p>So.</p><ul><li>one thing<li>another thing</ul><form><input><p>Your name</p></form></article></main>
<aside>Read also</aside><section id="comments"><p>Great post, I liked it a lot and more</p></section><footer>&copy; 2024</footer></body></html>"""


def test_html(spark):
    want = "Title & more\nFirst paragraph with several words, on two lines.\nSecond été bold text.\nSo.\none thing\nanother thing"
    assert html_text.main_text(PAGE) == want
    assert [html_text.main_text(x) for x in (None, "", "<nav>a</nav>", "<p>only this</p>", "just text")] == ["", "", "", "only this", "just text"]
    long = "<article>" + "".join(f"<p>{html.escape('a < b & c ' * 20)}{k}</p>" for k in range(3000)) + "</article>"
    assert html_text.main_text(long).count("\n") == 2999
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, None, None, 2), (None, "v", "", 3)], "page_id long, url string, html string, text int")
    rows = html_text.extract(pages).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 0, len(want)] and html_text.extract(pages.where("false")).count() == 0


ARTICLE = ["A heading of it", "A long first sentence with many words of the article, and more. " * 4, "Another paragraph, which goes on about the same matter at length. " * 3]
BODY = f"<article><h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p></article>"
KEPT = "\n".join(x.strip() for x in ARTICLE)
PAGES = {
    "a state of the page": f'<html><body class="single no-sidebar">{BODY}</body></html>',
    "comments may be left": f'<html><body class="comments-open">{BODY}</body></html>',
    "a wrapper with a state": f'<body><div class="page has-sidebar"><nav><a>Home</a> <a>Shop</a></nav>{BODY}<div class="sidebar">Buy now</div></div></body>',
    "a marked wrapper of the article": f'<body><div class="header-above"><div class="content">{BODY}</div></div></body>',
    "an open head": f"<html><head><title>Title</title><body>{BODY}</body></html>",
    "no head, no body": f"<title>Title</title>{BODY}",
    "an open noscript": f"<html><head></head><body><noscript><img src=x>{BODY}</body></html>",
    "an open noscript in the head": f"<html><head><noscript><link rel=x></head><body>{BODY}</body></html>",
    "an open header": f"<body><header><div>Site</div>{BODY}</body>".replace("<div>Site</div>", ""),
    "a form around the page": f'<body><form action="/x"><input type="hidden" name="state">{BODY}</form></body>',
    "a form beside it": f"<body>{BODY}<form><label>Your name</label><input><label>Your mail</label><input><p>Our fine letter comes each week</p><button>Go</button></form></body>",
    "a share link in a paragraph": f'<body>{BODY[:-10]}<a class="share-button">Share this on Facebook</a></article></body>',
    "an open share span": f'<body><span class="share">Share this {BODY}</body>',
    "open paragraphs": f"<body><article><h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}<p>{ARTICLE[2]}</article></body>",
    "crossed tags": f"<body><div><b>{BODY}</div></b></span></p></body>",
    "comments below": f'<body>{BODY}<ol class="comment-list"><li><article class="comment"><p>{"I liked it a lot, thank you. " * 9}</p></article></li></ol></body>',
    "a cookie notice": f'<body><div class="cookie-notice"><p>{"We use cookies on this site to serve you. " * 4}</p></div>{BODY}<footer><p>All rights</p></footer></body>',
    "a story at the side": f'<body><nav><a>Home</a></nav><div class="side-story"><h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p></div></body>',
    "results of a search": f'<body><div class="search-results"><h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p></div><footer>All rights</footer></body>',
    "the header of an article": f'<body><div class="article-header"><h1>{ARTICLE[0]}</h1></div><p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p></body>',
    "a marked heading in an article": f'<body><article><div class="post-header"><h1>{ARTICLE[0]}</h1></div><p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p></article><div class="sidebar"><p>{"Other stories that we have. " * 12}</p></div></body>',
    "a long sidebar": f'<body><div class="text"><h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p></div><div class="sidebar"><p>{"Other stories that we have are here. " * 20}</p></div></body>',
    "scripts and styles": f"<body><style>p {{ color: red }}</style>{BODY}<script>if (a < b) document.write('<p>no</p>')</script></body>",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages_keep_their_article_and_nothing_else(page):
    assert html_text.main_text(PAGES[page]) == KEPT


def test_made_pages_give_back_their_article():
    """Pages put together from parts that are content and parts that are not."""
    rnd = np.random.default_rng(6)
    words = [f"word{k}" for k in range(300)]
    say = lambda n: " ".join(words[k] for k in rnd.integers(0, len(words), n))
    menu = lambda: "<ul>" + "".join(f'<li><a href="/{k}">{say(2)}</a></li>' for k in range(int(rnd.integers(4, 12)))) + "</ul>"
    for _ in range(60):
        parts = [say(int(rnd.integers(25, 90))) + " & é" for _ in range(int(rnd.integers(2, 9)))]
        body = "".join(f"<{t}>{html.escape(x)}</{t}>" for x, t in zip(parts, rnd.choice(["p", "blockquote", "p"], len(parts)), strict=True))
        junk = [f"<nav>{menu()}</nav>", f'<div class="sidebar">{menu()}</div>', f"<footer><p>{say(8)}</p></footer>", f'<div id="comments"><p>{say(40)}</p></div>', f'<aside><p>{say(30)}</p></aside>', f'<div class="ad-slot">{say(9)}</div>', f"<script>{say(5)}</script>"]
        rnd.shuffle(junk)
        cut = int(rnd.integers(0, len(junk)))
        wrap = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")][int(rnd.integers(0, 3))]
        page = f"<html><head><title>{say(3)}</title></head><body>{''.join(junk[:cut])}{wrap[0]}{body}{wrap[1]}{''.join(junk[cut:])}</body></html>"
        assert html_text.main_text(page) == "\n".join(parts)


def plain_content(lines, sigma=1.0, threshold=0.5):
    """The lines of content by the rule, in loops: ratio of unlinked text to tags, Gaussian mean, threshold, containers by majority."""
    ratios, smooth = [max(0, len(t) - linked) / max(1, tags) for _, t, tags, linked in lines], []
    for k in range(len(lines)):
        weights = {j: np.exp(-0.5 * ((j - k) / sigma) ** 2) for j in range(len(lines)) if abs(j - k) <= 3 * sigma}
        smooth.append(sum(w * ratios[j] for j, w in weights.items()) / sum(weights.values()))
    mean = sum(smooth) / len(smooth)
    bound = min(threshold * (sum((x - mean) ** 2 for x in smooth) / len(smooth)) ** 0.5, max(smooth))
    good = [x >= bound for x in smooth]
    kept = []
    for c, t, _, _ in lines:
        own = [k for k, x in enumerate(lines) if x[0] == c]
        size, dense, linked = (sum(f(k) for k in own) for f in (lambda k: len(lines[k][1]), lambda k: len(lines[k][1]) * good[k], lambda k: lines[k][3]))
        if size and 2 * dense >= size and 2 * linked <= size:
            kept.append(t)
    return "\n".join(kept)


def test_content_is_the_rule():
    rnd = np.random.default_rng(8)
    some = 0
    for _ in range(300):
        lines = [[int(rnd.integers(0, 4)), "x" * int(rnd.choice([1, 5, 40, 300])), int(rnd.integers(0, 9)), 0] for _ in range(int(rnd.integers(1, 25)))]
        for x in lines:
            x[3] = int(rnd.integers(0, len(x[1]) + 1)) if rnd.random() < 0.4 else 0
        got = html_text._content([[*x, None, None] for x in lines], 1.0, 0.5)
        assert got == plain_content(lines)
        some += 0 < got.count("\n") + 1 < len(lines)
    assert some > 100


@pytest.mark.parametrize("page", ['<div class="menu">' * 100_000 + "text", "<div>" * 50_000 + "text" + "</p>" * 50_000, "<div>" * 50_000 + "</span></b>" * 25_000, '<form><div class="ad">' * 50_000 + "<article>text</article>", "<span class=share>" * 50_000 + "text"])
def test_nesting_takes_linear_time(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 10


def test_smoothing_keeps_a_constant():
    assert np.allclose(html_text.smoothed(np.full(9, 3.0), 1.0), 3.0)


def vectors(spark):
    rnd = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rnd.normal(size=6) * (40 if k % 7 == 0 else 1)], k) for k in range(150)]
    rows += [(k, rows[3][1], 0) for k in range(200, 230)] + [(3, rows[3][1], 0), (20, rows[3][1], 0)]
    rows += [(300, None, 0), (301, [float("nan")] * 6, 0), (302, [1.0, None] * 3, 0), (None, rows[3][1], 0), (320, [1.0, 2.0], 0), (321, [3.0, 4.0], 0), (340, [], 0), (341, [], 0), (360, [3e20] * 6, 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")


def slow_top(rows, k=20):
    usable = [(i, v, [int(max(-(2**62), min(2**62, np.floor(64.0 * x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i in {i for i, _, _ in usable if i % 20 == 0}:
        q = min((v, y) for j, v, y in usable if j == i)[1]  # of twins the smallest vector asks
        scores = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, y, strict=True)))), j) for j, _, y in usable if j != i and len(y) == len(q)))
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])}
    return out


def test_top_k(spark, monkeypatch):
    rows, df = vectors(spark)
    want = slow_top(rows)
    assert {tuple(r) for r in top_k.nearest(df).collect()} == want
    monkeypatch.setattr(top_k, "BLOCK_ROWS", 16)
    monkeypatch.setattr(top_k, "QUERY_ROWS", 3)
    assert {tuple(r) for r in top_k.nearest(df).collect()} == want
    assert top_k.nearest(df.where("false")).count() == 0


def test_a_query_with_an_unusable_twin_is_answered(spark):
    rows = [(20, None), (20, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [3.0, 1.0]), (40, [float("inf"), 0.0]), (60, [None, 1.0]), (60, [0.0, 1.0])]
    for k in range(3):
        got = top_k.nearest(spark.createDataFrame(rows[k:] + rows[:k], "vec_id long, embedding array<double>")).collect()
        assert {r["query_id"] for r in got} == {20, 60} and [r["vec_id"] for r in got if r["query_id"] == 20][:2] == [2, 1]


def test_cells_take_a_byte(spark):
    df = spark.createDataFrame([(k, [k / 50 - 1.0] * 4) for k in range(100)], "vec_id long, embedding array<double>")
    assert {(r["cell_bytes"], r["vector_bytes"]) for r in top_k.blocks(df, 64, 64).collect()} <= {(1, 1), (1, 2)}


def test_a_wide_link_is_told_by_one_list(spark, monkeypatch):
    """A group of near copies stands together in many lists; each link leaves them once, and the closure is that of all links."""
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 256, 64, dtype=np.uint8)
    group = []
    for _ in range(40):
        bits = np.unpackbits(base)
        bits[rnd.choice(512, 25, replace=False)] ^= 1
        group.append(np.packbits(bits))
    fps = np.stack([*group, *rnd.integers(0, 256, (20, 64), dtype=np.uint8)])
    given, found = spark.sparkContext.accumulator(0), simhash._found

    def counted(dealt, find, kind, read):
        def seen(*args):
            a, b = find(*args)
            given.add(len(a))
            return a, b

        return found(dealt, seen, kind, read)

    monkeypatch.setattr(simhash, "_found", counted)
    frame = spark.createDataFrame([(bytes(x),) for x in fps], "fp binary").repartition(4)
    links = [(bytes(r["a"]), bytes(r["b"])) for r in simhash.wide_links(frame)[0].collect()]
    assert len(links) == len(set(links)) and 0 < given.value <= len(links)
    root = {bytes(x): bytes(x) for x in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[top(a)] = top(b)
    assert len({top(bytes(x)) for x in group}) == 1 and len({top(bytes(x)) for x in fps}) == 21


def test_lists_of_a_joined_group_are_not_posted_again(spark, monkeypatch):
    """Lists whose rows the first lists have joined already end with their count; the components are those of all listed links."""
    rnd = np.random.default_rng(7)
    base, fps = rnd.integers(0, 256, 64, dtype=np.uint8), []
    for bits, n in ((25, 300), (60, 60)):  # a group, and rows of which few are close
        for _ in range(n):
            row = np.unpackbits(base)
            row[rnd.choice(512, bits, replace=False)] ^= 1
            fps.append(np.packbits(row))
    fps = np.stack([*fps, *rnd.integers(0, 256, (100, 64), dtype=np.uint8)])
    posted, found = [], simhash._found

    def counted(dealt, find, kind, read):
        posted.append(dealt.count())
        return found(dealt, find, kind, read)

    monkeypatch.setattr(simhash, "_found", counted)
    frame = spark.createDataFrame([(bytes(x),) for x in fps], "fp binary").repartition(4)
    got = {}
    for r in simhash.wide_links(frame)[1].collect():
        got.setdefault(bytes(r["root"]), set()).add(bytes(r["node"]))
    root = list(range(len(fps)))
    for i in range(len(fps)):  # plainly, by all pairs
        for j in np.flatnonzero(simhash.listed_and_close(fps[i][None, :], fps)):
            low, high = sorted((root[i], root[j]))
            root = [low if x == high else x for x in root]
    want = [{bytes(fps[i]) for i in range(len(fps)) if root[i] == r} for r in set(root)]
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want if len(x) > 1)
    listed = sum(int(n[n > 2].sum()) for t in simhash.wide_triples() for n in [np.unique(fps[:, t], axis=0, return_counts=True)[1]])
    assert len(posted) == 2 and sum(posted) < 0.7 * listed


def test_a_dense_group_of_texts_not_quite_alike_makes_no_pairs(spark):
    """Texts close by their fingerprints, of which few are alike: beside lists of two, at most 96 a text, no join makes a row for each pair."""
    rnd = random.Random(21)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(160):
        text = list(base)
        for at in rnd.sample(range(150), 4):
            text[at] = f"own{k}x{at}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, store = [], spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    executions = store.executionsList()
    for k in range(min(before, executions.size() - 1), executions.size()):
        at = executions.apply(k).executionId()
        nodes, values = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for node in (nodes.apply(x) for x in range(nodes.size())):
            for m in (node.metrics().apply(x) for x in range(node.metrics().size())):
                if re.search(r"Join \[a#\d+L?\]", node.desc()) and m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined():
                    seen.append(int(values.get(m.accumulatorId()).get().replace(",", "")))
    assert 0 < sum(seen) <= 10 * len(rows)
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(146)} for k, t in rows}
    roots = {k: k for k in sets}
    for a in sets:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((roots[a], roots[b]))
                roots = {k: low if r == high else r for k, r in roots.items()}
    assert kept == set(roots.values())
