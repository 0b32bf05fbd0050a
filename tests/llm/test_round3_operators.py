"""Merkle manifest, ranked search and chat templates: odd rows, ties, blocks, and plain versions written from their contracts."""

import hashlib
import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineweave.llm import chat_template, merkle, ranked_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long, TEXT2 string, pos long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc, lower=False):
    doc_id, text, lang, source, n_chars = doc[:5]
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower and text is not None else text
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def plain_audit(docs):
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees, proofs = [], []

    def build(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        return levels

    def climb(levels, at, digest):
        siblings = []
        for level in levels[:-1]:
            run = list(level[at // 8 * 8 : at // 8 * 8 + 8])
            siblings += run[: at % 8] + run[at % 8 + 1 :]
            run[at % 8] = digest
            at, digest = at // 8, h(*run)
        return siblings, digest

    for lang in langs:
        rows = sorted((d for d in docs if d[2] == lang), key=lambda d: (d[0] is not None, d[0] or 0, plain_leaf(d)))
        trees.append((rows, build([plain_leaf(d) for d in rows])))
    top = build([levels[-1][0] for _, levels in trees])
    for tree, (rows, levels) in enumerate(trees):
        for at, d in enumerate(rows):
            tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
            first, up = climb(levels, at, plain_leaf(d, tampered))
            second, back = climb(top, tree, up)
            proofs.append((d[0], plain_leaf(d), levels[-1][0], top[-1][0], h(*first, *second), back, back == top[-1][0]))
    return sorted(proofs, key=str)


MERKLE = [
    [],
    [(1, "Alone", "en", "s", 5)],
    [(3, "ABC", None, None, None), (None, None, None, "s", 1)],
    [(k, f"Text {k}", "en", "s", k) for k in range(9)] + [(k, "É X", "de", None, k) for k in range(70, 79)],
    [(k % 5, None if k % 7 == 0 else "" if k % 7 == 1 else f"W{k % 3} " * (k % 4), ("en", "de", None, "zz", "Ä")[k % 5 if k % 3 else 0], "s", None) for k in range(600)] + [(None, "no id", "en", "s", 1)] * 20,
    [(k, "T", f"l{k % 70:02d}", "s", 1) for k in range(200)],
]


@pytest.mark.parametrize("case", range(len(MERKLE)))
def test_merkle(spark, case):
    """An empty table, one leaf, one language, runs of one, nulls, ties and repeated rows, more languages than a run holds."""
    docs = MERKLE[case]
    df = spark.createDataFrame([(*d[:5], "x", 7) for d in [(r[0], r[1], r[2], r[3], r[4]) for r in docs]], DOCS).repartition(5)
    got = merkle.audited(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_audit(docs)


def test_merkle_of_a_long_text_and_places_by_join(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    docs = [(k, "Long " * (200_000 if k == 3 else 1), "en" if k % 4 else "fr", "s", k) for k in range(100)]
    got = merkle.audited(spark.createDataFrame([(*d, "x", 7) for d in docs], DOCS))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_audit(docs)
    bad = {r["doc_id"] for r in got.where("not verified").collect()}
    assert bad == {k for k in range(100) if zlib.crc32(str(k).encode()) % 3 == 0}  # all hold capitals


def test_recursion_limits_are_put_back(spark):
    with merkle._unbounded_recursion(spark):
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "-1"
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) != "-1"


# Ranked search


def plain_search(docs, items, k=10):
    terms = [ranked_search.terms_of(t) for _, t in docs]
    total, n_docs = sum(map(len, terms)), sum(1 for t in terms if t)
    df = {}
    for t in terms:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, _), own in zip(docs, terms, strict=True):
            if own:
                m = 100 - 90 + (90 * len(own) * n_docs) // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * own.count(w)) // (1000 * own.count(w) + 8 * m)) for w in set(ranked_search.terms_of(text)) if w in df)
                if score > 0:
                    scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n=400):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "9a"]
    docs = [(k, " ".join(rnd.choices(words, weights=[1 / (j + 1) for j in range(62)], k=rnd.choice((1, 3, 20, 60))))) for k in range(n)]
    docs += [(n + k, "w5 w6, W7!") for k in range(150)] + [(None, "w5 w6 w7"), (7, "w5 w6 w7"), (7, None), (8, ""), (9, " ?! "), (10, "w1 " * 30_000)]
    items = [(k, " ".join(rnd.choices(words, k=rnd.choice((1, 2, 8, 15))))) for k in range(25)] + [(100, "w5 w6 w7"), (100, "w5 w5 unknown"), (None, "w1 w2"), (101, None), (102, "..."), (103, "unknown")]
    return docs, items


@pytest.mark.parametrize(("seed", "settings_"), [(1, {}), (2, {"block_postings": 40, "block_docs": 7}), (3, {"group_terms": 3, "block_docs": 50})])
def test_ranked_search(spark, seed, settings_):
    """Ties of copies over many blocks and tasks, repeated and null ids, groups of items, against scoring every document."""
    docs, items = corpus(seed)
    df = spark.createDataFrame([(t, i, "x", "y") for i, t in docs], "text string, doc_id long, TEXT2 string, item_id string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = ranked_search.top_documents(df, asked, **settings_)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain_search(docs, items)


def test_ranked_search_on_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.top_documents(docs, items.where("false")).count() == 0
    assert ranked_search.top_documents(docs.where("false"), items).count() == 0
    assert ranked_search.top_documents(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_range_maximum_is_the_first_largest():
    import numpy as np

    rnd = np.random.default_rng(5)
    terms, docs = np.repeat(np.arange(4), 50), np.concatenate([np.sort(rnd.choice(90, 50, replace=False)) for _ in range(4)])
    block = ranked_search.Block.of(np.arange(90), docs, terms, rnd.integers(1, 9, 200), 4)
    a = rnd.integers(0, 50, 300) + 50 * rnd.integers(0, 4, 300)
    b = np.minimum(a + rnd.integers(0, 50, 300), (a // 50 + 1) * 50)
    for x, y, place in zip(a, b, block.largest(a, b), strict=True):
        assert place == (-1 if x == y else x + int(block.impacts[x:y].argmax()))


def test_search_leaves_most_documents_unscored():
    """A rare term and a planted document: the bound closes the search after a small part of the block."""
    import numpy as np

    rnd = np.random.default_rng(6)
    n = 5000
    docs, terms = np.concatenate([np.arange(n), [4321]]), np.concatenate([np.zeros(n, int), [1]])
    impacts = np.concatenate([rnd.integers(1, 1000, n), [5000]])
    block = ranked_search.Block.of(np.arange(n), docs, terms, impacts, 2)
    seen = []

    class Best(ranked_search.Best):
        def offer(self, score, doc_id):
            seen.append(doc_id)
            super().offer(score, doc_id)

    best = Best(3)
    ranked_search.search(block, np.array([0, 1]), best, at_once=1)
    total = impacts[:n] + np.where(np.arange(n) == 4321, 5000, 0)
    assert sorted(best.heap, reverse=True) == sorted(((int(total[d]), -d) for d in range(n)), reverse=True)[:3]
    assert len(seen) == len(set(seen)) < 50


# Chat templates


def rendered(template, turns):
    text, spans, begin = "", [], 0
    for x in chat_template.compiled(template)({"turns": iter(turns)}):
        if x is chat_template.BEGIN:
            begin = len(text)
        elif x is chat_template.END:
            spans.append(text[begin:])
        else:
            text += x
    return text, spans


def test_template_language():
    turns = [{"role": "user", "text": " a "}, {"role": "assistant", "text": "b"}]
    assert rendered("{% for t in turns %}{{ t.text | trim | upper }}{% if not loop.last %}, {% endif %}{% endfor %}.", turns) == ("A, B.", [])
    assert rendered("{% for t in turns %}{% if loop.first and t.role == 'user' %}1{% elif t.role != \"user\" or false %}{% generation %}<{{ t.text }}>{% endgeneration %}{% else %}3{% endif %}{% endfor %}", turns) == ("1<b>", ["<b>"])
    assert rendered("{# no #}{{ 'a' + 'b' + 1 }}{% if (true and not false) %}x{% else %}y{% endif %}{{ '\\n\\'' }}", turns)[0] == "ab1x\n'"
    assert chat_template.folded(chat_template.parse("a{{ 'b' | upper }}{% if 1 == 2 %}{{ turns.x }}{% elif 'q' == 'q' %}c{% endif %}{{ 1 + 2 }}")) == (chat_template.Text("aBc3"),)


@pytest.mark.parametrize(
    "bad",
    ["{% for t in turns %}", "{% endfor %}", "{{ }}", "{{ a b }}", "{{ t.__class__ }}", "{{ t | nothing }}", "{{ f(1) }}", "{{ 'a' * 3 }}", "{% include 'x' %}", "{{ " + "(" * 5000 + "1" + ")" * 5000 + " }}", "{% if true %}" * 500 + "{% endif %}" * 500, "{{ t. }}", "{{ [1] }}"],
)
def test_template_errors_are_told_when_compiling(bad):
    with pytest.raises(chat_template.TemplateError):
        chat_template.compiled(bad)


@pytest.mark.parametrize("bad", ["{{ missing }}", "{% for t in turns %}{{ t.other }}{% endfor %}", "{% for t in turns %}{{ t }}{% endfor %}", "{% for t in turns %}{{ t.text.text }}{% endfor %}"])
def test_a_template_reaches_turns_only(bad):
    with pytest.raises(chat_template.TemplateError):
        rendered(bad, [{"role": "user", "text": "x"}])


MARKS = st.lists(st.sampled_from(["#", "##", "###", "### ", "</turn>", "<", "/", "\\", "\n", ":", ": ", "a", "é", "{{ 1 }}", "assistant"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), MARKS), MARKS), min_size=1, max_size=5), st.sampled_from([1, 7, 1000]))
def test_formatting_is_reversible(turns, piece_chars):
    render, reading, chars = chat_template.compiled(chat_template.TEMPLATE), chat_template._Reading(), 0
    for _, text, start, spans in chat_template._pieces(render({"turns": ({"role": r, "text": t} for r, t in turns)}), piece_chars):
        reading.piece(text, start, spans)
        chars += len(text)
    loss = "".join(t for r, t in turns if r == "assistant")
    assert reading.result() == (len(turns), h(*[f"{r}\n{t}\n" for r, t in turns]), len(loss), h(loss), chars)
    for r, t in turns:
        assert "##" not in chat_template.escape(t) and "</" not in chat_template.escape(t) and chat_template.unescape(chat_template.label(r)) == r


@pytest.mark.parametrize("piece_chars", [1, 1 << 16])
def test_chat_format(spark, piece_chars):
    """Nulls, ties, repeated rows, a long text, a conversation with a third of all rows, one that has the added one's id."""
    rows = [(k // 3, k % 3, ("user", "assistant", None)[k % 3], None if k % 10 == 9 else f"### x{k} </turn>") for k in range(90)]
    rows += [(5, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(60)] + [(None, 1, "user", "a"), (None, None, "assistant", ""), (-7, 0, "user", "given"), (99, 0, "assistant", "\\#" * 100_000), (99, 0, "assistant", "b"), (99, 0, "assistant", "b")]
    df = spark.createDataFrame([(t, r, u, c, "x") for c, u, r, t in rows], "text string, role string, turn long, conv_id long, made string")
    groups = {}
    for c, u, r, t in rows:
        groups.setdefault((False, c), []).append((u is not None, u or 0, r or "", t or ""))
    groups[True, -7] = [(True, k, r, chat_template.TRIAL_TEXT) for k, r in enumerate(("user", "assistant"))]
    want = []
    for (_, c), turns in groups.items():
        turns = [x[2:] for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        want.append((c, len(turns), h(*[f"{r}\n{t}\n" for r, t in turns]), len(loss), h(loss)))
    got = chat_template.digests(df, piece_chars).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert [(r["conv_id"], r["n_turns"]) for r in chat_template.digests(df.where("false")).collect()] == [(-7, 2)]


def test_stored_pieces_read_back(spark, tmp_path):
    df = spark.createDataFrame([(k % 7, k, "assistant" if k % 2 else "user", f"text {k} \\ ###") for k in range(200)], "conv_id long, turn long, role string, text string")
    pieces = chat_template.format_turns(df, piece_chars=40)
    pieces.repartition(9).write.parquet(str(tmp_path / "p"))
    again = spark.read.parquet(str(tmp_path / "p"))
    assert again.count() > 50
    assert sorted(chat_template.read_back(again).collect()) == sorted(chat_template.read_back(pieces, in_order=True).collect())
    with pytest.raises(Exception, match="missing or out of order"):
        chat_template.read_back(again.where("piece <> 1")).collect()
