"""Small helpers against plain twins and small cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.functions import shell
from lineweave.functions.text import similar_bytes
from lineweave.operators import align, match

lines = st.lists(st.sampled_from(["a", "b", "c", "}", "x = 1"]), max_size=9)


def slow_align(old, new):
    n, m = len(old), len(new)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if old[i] == new[j] else max(best[i + 1][j], best[i][j + 1])
    got, i, j = [-1] * m, 0, 0
    while i < n and j < m:
        if old[i] == new[j]:
            got[j] = i
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return got


@settings(max_examples=300, deadline=None)
@given(lines, lines)
def test_alignment(old, new):
    assert align.align(old, new) == slow_align(old, new)


@settings(max_examples=200, deadline=None)
@given(lines, lines)
def test_totals_follow_counts_alone(old, new):
    author = ("AI", "claude", "m", "chat", "s")
    who, _, gone = align.attribute([align.HUMAN] * len(old), "\n".join(old) + "\n" * bool(old), "\n".join(new) + "\n" * bool(new), author)
    for x in set(old) | set(new):
        n_old, n_new = old.count(x), new.count(x)
        assert sum(w == author for w, line in zip(who, new, strict=True) if line == x) == max(0, n_new - n_old)
        assert gone.count(x) == max(0, n_old - n_new)


def test_same_text_again_changes_nothing():
    prior = [("AI", "cursor", "", "", ""), align.HUMAN]
    who, over, gone = align.attribute(prior, "a\nb\n", "a\r\n  b\n", ("AI", "claude", "", "", ""))
    assert (who, over, gone) == (prior, [None, None], [])


def test_moved_block_and_override():
    ai = ("AI", "claude", "", "", "")
    who, over, _ = align.attribute([ai, align.HUMAN, ai], "one\ntwo\nthree", "three\none\nnew", align.HUMAN)
    assert who == [ai, ai, align.HUMAN] and over[0] is None
    who, over, _ = align.attribute([ai, ai], "a\nb", "a\nc", align.HUMAN)
    assert who == [ai, align.HUMAN] and over == [None, ai]


def test_long_alignment_keeps_the_table_rule():
    rnd = random.Random(3)
    for n, kinds in ((150, 4), (200, 60), (120, 1000)):
        old, new = ([str(rnd.randrange(kinds)) for _ in range(n)] for _ in range(2))
        assert align.align(old, new) == slow_align(old, new)


def test_ten_thousand_lines_align():
    rnd = random.Random(4)
    old = [str(rnd.randrange(6000)) for _ in range(10_000)]
    got = align.align(old, old[2500:] + old[:2500])
    pairs = [(i, j) for j, i in enumerate(got) if i >= 0]
    assert len(pairs) >= 7500 and pairs == sorted(pairs) and all(old[i] == (old[2500:] + old[:2500])[j] for i, j in pairs)


def test_raw_lines_of_large_files_go_by_counts(spark):
    """Beyond the bound each old line covers one new line, wherever it stands."""
    pairs = spark.createDataFrame([(1, "a\nb\na\n", "b\na\nc\na\na\n")], "k int, old_text string, new_text string")
    few = sorted((r["line_no"], r["content"], r["exact"]) for r in align.added_or_moved(pairs, ["k"], most_cells=3).collect())
    assert few == [(3, "c", False), (5, "a", False)]
    all_ = sorted((r["line_no"], r["content"], r["exact"]) for r in align.added_or_moved(pairs, ["k"]).collect())
    assert all_ == [(k + 1, x, True) for k, (x, i) in enumerate(zip("bacaa", slow_align(list("aba"), list("bacaa")), strict=True)) if i < 0]


AI, PERSON = "AI", "Human"
# What an editor may do to a file: prior authors by line, text before, text after, who edits; authors after, and whom each line overrode.
STORIES = {
    "an AI writes a new file": ([], "", "p\nq\nr", AI, [AI, AI, AI], [None, None, None]),
    "all is deleted": ([PERSON], "p", "", AI, [], []),
    "an AI goes on below": ([PERSON, PERSON], "first\nsecond", "first\nsecond\nthird\nfourth", AI, [PERSON, PERSON, AI, AI], [None] * 4),
    "the second copy of a line is new": ([PERSON, PERSON], "twin\nother", "twin\nother\ntwin", AI, [PERSON, PERSON, AI], [None] * 3),
    "a whole-file write credits the new line only": ([PERSON] * 3, "p\nq\nr", "p\nq\nr\ns", AI, [PERSON, PERSON, PERSON, AI], [None] * 4),
    "a changed line between kept ones": ([PERSON] * 3, "p\nq\nr", "p\nQ\nr", AI, [PERSON, AI, PERSON], [None, PERSON, None]),
    "a deleted line leaves the rest": ([PERSON] * 3, "p\nq\nr", "p\nr", AI, [PERSON, PERSON], [None, None]),
    "line ends don't count": ([PERSON, PERSON], "p\r\nq", "p\r\nq\r\nr", AI, [PERSON, PERSON, AI], [None] * 3),
    "a person rewrites an AI's line": ([AI, AI], "one\ntwo", "one\nmine", PERSON, [AI, PERSON], [None, AI]),
    "an insertion above shifts down": ([AI, AI], "one\ntwo", "mine\none\ntwo", PERSON, [PERSON, AI, AI], [None] * 3),
    "indentation keeps the author": ([PERSON, PERSON], "if x {\n y()", "if x {\n\t\ty()", AI, [PERSON, PERSON], [None, None]),
    "trailing white space keeps the author": ([AI], "x = y + z", "x = y + z  ", PERSON, [AI], [None]),
    "another value is another line": ([PERSON], "n = 1", "n = 2", AI, [AI], [PERSON]),
    "spaces around signs keep the author": ([PERSON], "k=v", "k = v", AI, [PERSON], [None]),
    "a rewrite of all lines overrides each": ([AI, AI], "one\ntwo", "my one\nmy two", PERSON, [PERSON, PERSON], [AI, AI]),
    "a mere insertion overrides none": ([PERSON], "stays", "stays\nmore", AI, [PERSON, AI], [None, None]),
    "a moved block keeps its authors": ([PERSON] * 4, "p\nq\nr\ns", "r\ns\np\nq", AI, [PERSON] * 4, [None] * 4),
    "a line moved up beside a new one": ([PERSON, PERSON], "stays\nmoves", "moves\nstays\nmore", AI, [PERSON, PERSON, AI], [None] * 3),
    "an AI's block that a person moves": ([AI, AI], "one\ntwo", "gap\none\ntwo", PERSON, [PERSON, AI, AI], [None] * 3),
}


@pytest.mark.parametrize("story", STORIES)
def test_stories(story):
    prior, before, after, editor, want, overrode = STORIES[story]
    who, over, _ = align.attribute([(x, "", "", "", "") for x in prior], before, after, (editor, "tool", "", "", ""))
    assert ([x[0] for x in who], [x and x[0] for x in over]) == (want, overrode)


def slow_walk(rows, units, mode):
    left = [[e, s, True] for e, s in units]
    whole, norm = [[e, s] for e, s in units], [e for e, _ in units]
    out = []
    for line, sha in rows:
        if mode == "flag":
            hit = next((u for u in left if u[2] and u[1] == sha), None) or next((u for u in left if u[2]), None)
            if hit:
                hit[2] = False
                out.append((line, hit[0]))
            continue
        hit = next((u for u in whole if u[1] == sha), None)
        if hit:
            whole.remove(hit)
            if mode == "shared" and hit[0] in norm:
                norm.remove(hit[0])
            out.append((line, hit[0]))
        elif norm:
            out.append((line, norm.pop(0)))
    return out


def test_walk_against_twin():
    rnd = random.Random(5)
    for _ in range(2000):
        units = [(e, rnd.choice("pqr")) for e in range(rnd.randint(0, 3)) for _ in range(rnd.randint(0, 3))]
        rows = [(k, rnd.choice("pqrs")) for k in range(rnd.randint(0, 6))]
        for mode in ("shared", "separate", "flag"):
            assert match.walk(rows, units, mode) == slow_walk(rows, units, mode)


def test_matching_in_spark_is_the_walk(spark):
    rnd = random.Random(9)
    rows, units = [], []
    for group in range(60):
        for k in range(rnd.randint(1, 6)):
            rows.append((group, k, rnd.choice("pqrs"), rnd.choice("nm")))
        rank = 0
        for e in range(rnd.randint(0, 3)):
            rank += 1
            units += [(group, 10 * group + e, rank, rnd.choice("pqr"), rnd.choice("nm")) for _ in range(rnd.randint(1, 3))]
    # a hash belongs to one normalised form
    rows = [(g, k, s + n, n) for g, k, s, n in rows]
    units = [(g, e, r, s + n, n) for g, e, r, s, n in units]
    a = spark.createDataFrame(rows, "g int, line_no int, content_sha string, content_sha_norm string")
    b = spark.createDataFrame(units, "g int, edit_id int, rank int, content_sha string, content_sha_norm string")
    for mode in ("shared", "flag"):
        got = sorted(map(tuple, match.consume_once(a, b, ["g"], mode).collect()))
        want = []
        for g in range(60):
            for n in "nm":
                mine = sorted((r, e, s) for gg, e, r, s, nn in units if (gg, nn) == (g, n))
                pairs = match.walk(sorted((k, s) for gg, k, s, nn in rows if (gg, nn) == (g, n)), [(e, s) for _, e, s in mine], mode)
                want += [(g, *p) for p in pairs]
        assert got == sorted(want), mode


def test_shell_targets():
    assert shell.written("cat > a.py <<'EOF'\nx > y\nEOF\necho 1 >> 'b c.txt'; ls 2> err > /abs/p") == ["a.py"]
    assert shell.written("cat <<X > out.txt\nrm z > q\nX\necho > two") == ["out.txt", "two"]
    assert shell.deleted("git rm -r \"a b.txt\" c\\ d && rm -f 'e'") == ["a b.txt", "c d", "e"]
    assert shell.deleted("del /q x\\y.txt") == ["x\\y.txt"]
    assert shell.deleted("Remove-Item foo.txt -Force; echo rm") == ["foo.txt"]


def test_similar_lines_count_bytes():
    assert similar_bytes("a  b", "a b") and not similar_bytes("", "x")
    assert similar_bytes("abcdefgh", "abcdxxxx") and not similar_bytes("abcdefgh", "abcxxxxx")
    assert similar_bytes("éé", "éa")
