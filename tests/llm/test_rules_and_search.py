"""Quality rules, lexical search and hard negatives against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicgauge.llm import common, hard_negatives, lexical, quality_rules, topk

SCHEMA = "doc_id long, text string, words string, rules string, n long, score double"
STUTTER = "again " * 20_000
ROWS = [
    (1, "One two three four five six seven eight nine ten, eleven twelve.\nHome | About | News | Contact", "x", "x", 1, 0.0),
    (2, None, None, None, None, None),
    (3, "", "x", "x", 1, 0.0),
    (4, "a b c d e f a b c d e f a b c d e", "x", "x", 1, 0.0),
    (4, "a b c d e f a b c d e f a b c d e", "x", "x", 1, 0.0),
    (5, "same line here.\nsame line here.\n\n \n same line here.\nsame line here.", "x", "x", 1, 0.0),
    (None, "The words of this text stand in no order but make a line, all in all.", "x", "x", 1, 0.0),
    (6, "THE WHOLE LINE SHOUTS AT YOU FROM ITS FIRST WORD ON", "x", "x", 1, 0.0),
    (7, "what!! is?? this!! all?? about!! then?? you!! there?? say!! it??", "x", "x", 1, 0.0),
    (8, "a### b$$$ c%%% d&&& e*** f### g$$$ h%%% i&&& j*** k###", "x", "x", 1, 0.0),
    (9, "é ü ñ 你好 x y 10 11 12 13 14 15\x0b16\x0c17。", "x", "x", 1, 0.0),
    (10, STUTTER, "x", "x", 1, 0.0),
    (11, " ".join(f"w{i}" for i in range(60_000)) + ".", "x", "x", 1, 0.0),
]


@pytest.fixture(scope="module")
def odd(spark):
    common.prepare(spark)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- quality rules ----------------------------------------------------------------


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    held = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\f\r")]
    failed = len(words) < 10 or 100 * len(held) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(held), failed)


def test_base_facts_equal_brute_force(odd, empty, spark, folder):
    for df in (odd, spark.read.parquet(f"{folder}/documents.parquet")):
        got = quality_rules.cleaned(df).collect()
        facts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
        expected = sorted(((r.doc_id, *_base(r.text)) for r in df.collect()), key=key)
        assert sorted(((r.doc_id, *(r[f] for f in facts)) for r in got), key=key) == expected
        assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.cleaned(empty).count() == 0


def test_line_rules(odd):
    got = {r.doc_id: r for r in quality_rules.cleaned(odd).collect()}
    reasons = {i: {rule for rule, n in r.removed_by.items() if n} for i, r in got.items()}
    assert reasons[1] == {"navigation"} and got[1].cleaned == ROWS[0][1].split("\n")[0]
    assert (reasons[6], reasons[7], reasons[8]) == ({"shouting"}, {"marks"}, {"symbols"})
    assert reasons[10] == {"stutter"} and reasons[11] == set()
    assert not any(got[i].kept for i in (1, 2, 3, 6, 7, 8, 10))
    assert got[None].kept and got[9].kept and got[11].kept
    assert got[1].lost_words == 7 and got[5].n_removed == 0 and got[5].n_lines == 6
    assert got[2].cleaned == got[3].cleaned == ""


def test_boilerplate_and_short_lines_go_but_a_clean_text_stays(spark):
    body = "The words of this text stand in no order but make a line, all in all."
    other = "Another line follows here – its end is far from the first one's, and it has its own words"
    text = f"A heading\n{body}\nAll rights reserved.\n{other}\nRead more"
    row = quality_rules.cleaned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.kept and row.n_removed == 3
    assert row.cleaned == f"{body}\n{other}"


# ---- lexical search -----------------------------------------------------------------


def _terms(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def _ranked(docs, items, k):
    rows = [(i, Counter(_terms(t))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    n, whole = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc_id, c in rows:
            m = 100 - 75 + (75 * sum(c.values()) * n) // whole
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, times in terms.items() if t in c
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_lexical_equals_brute_force(odd, empty, spark, folder, monkeypatch):
    items = spark.createDataFrame(
        [(1, "A b, TEXT! line", 1.0), (1, "a WORDS", 2.0), (2, None, None), (3, "", 0.0), (4, "你好 w17 zzz", 1.0),
         (None, "again w5", 1.0), (5, " ".join(f"w{i}" for i in range(0, 60_000, 7)), 1.0)],
        "item_id int, text string, score double",
    )
    for pieces in (lexical.PIECE, 11):
        monkeypatch.setattr(lexical, "PIECE", pieces)
        assert [len(p) for p in lexical.terms_of(None)] == []
        flat = [t.decode() for p in lexical.terms_of(ROWS[10][1].encode()) for t in p]
        assert flat == _terms(ROWS[10][1])
    monkeypatch.setattr(lexical, "PIECE", 1 << 20)
    pairs = [(r.doc_id, r.text) for r in odd.collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    for slice_bytes in (1 << 22, 200):
        got = [tuple(r) for r in lexical.rank(odd, items, 4, slice_bytes).collect()]
        assert sorted(got, key=repr) == _ranked(pairs, asked, 4)
    assert lexical.rank(empty, items).count() == 0
    assert lexical.rank(odd, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = docs.select("doc_id", "text").unionAll(docs.select("doc_id", "text").limit(30))
    items = spark.read.parquet(f"{folder}/benchmark.parquet").limit(12)
    got = [tuple(r) for r in lexical.rank(twice, items).collect()]
    pairs, asked = ([tuple(r) for r in d.select(d.columns[0], "text").collect()] for d in (twice, items))
    assert sorted(got, key=repr) == _ranked(pairs, asked, 10)


@pytest.mark.parametrize(("seed", "leaf"), [(1, 1), (2, 8), (3, 64)])
def test_tree_prunes_and_loses_nothing(seed, leaf):
    rng = np.random.default_rng(seed)
    count, vocabulary = 600, 60
    # Topics of common terms, copies of one document, and rare terms.
    sets = [np.unique(np.concatenate([[t % 5], 5 + rng.integers(0, 8, 3) + 8 * (t % 5), rng.integers(45, vocabulary, 2)])) for t in range(count)]
    sets[100:160] = [sets[100]] * 60
    sizes = np.array([len(s) for s in sets])
    ptr, term = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(sets)
    tf, m = rng.integers(1, 9, len(term)), rng.integers(25, 400, count)
    tree = lexical.Tree(np.arange(count), m, ptr, term, tf, leaf)
    looked = 0
    for _ in range(20):
        worth = np.zeros(vocabulary, np.int64)
        worth[rng.integers(0, vocabulary, 6)] = rng.integers(0, 5000, 6)
        best = lexical.Best(7)
        looked += tree.search(worth, best)
        gain = np.repeat(m, sizes)
        every = np.add.reduceat(worth[term] * ((10**9 * tf) // (1000 * tf + 8 * gain)), ptr[:-1])
        order = [i for i in np.lexsort((np.arange(count), -every))[:7] if every[i] > 0]
        assert best.ids.tolist() == order and best.scores.tolist() == every[order].tolist()
    # A tree of few, large leaves has little to leave out.
    assert leaf == 64 or looked < 0.8 * 20 * len(tree.first)


# ---- hard negatives -------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, norm string, row string"


def _vectors(seed, count=400, dims=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(count):
        spread = rng.choice([0.05, 0.3])
        v = [float(np.float32(c + rng.gauss(0, spread))) for c in centres[i % 5]]
        rows.append((i, v, rng.choice([i % 5, i % 5, 7]), "x", "x"))
    rows += [rows[0], rows[100], (100, [0.0] * dims, 3, None, None), (None, rows[3][1], 3, None, None)]
    rows += [(500, None, 1, "x", "x"), (600, [1.0, None], 1, "x", "x"), (700, [float("nan")] * dims, 1, "x", "x")]
    rows += [(800, [float("inf")] * dims, 1, "x", "x"), (900, rows[2][1], None, "x", "x"), (1000, [], 2, "x", "x")]
    return rows


def _mined(rows):
    usable = [
        (i, vec_id, label, [math.floor(256 * x) for x in v])
        for i, (vec_id, v, label, *_) in enumerate(rows)
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    first = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for at, anchor_id, label, a in usable:
        if anchor_id is None or anchor_id % 100:
            continue
        others = [(sum(p * q for p, q in zip(a, v)), i, l) for n, i, l, v in usable if n != at]
        for ps, pid, _ in sorted((o for o in others if o[2] == label), key=first)[:5]:
            fits = [o for o in others if o[2] != label and 80 * ps <= 100 * o[0] <= 100 * ps]
            out += [(anchor_id, pid, r, o[1], ps, o[0]) for r, o in enumerate(sorted(fits, key=first)[:5], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CHUNK", 3)
    rows = _vectors(seed)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    vectors = hard_negatives.usable(df)
    anchor = F.col("vec_id") % 100 == 0
    for slice_bytes in (1 << 20, 700):
        got = [tuple(r) for r in hard_negatives.mine(vectors, anchor, slice_bytes=slice_bytes).collect()]
        assert sorted(got, key=repr) == _mined(rows)
    assert hard_negatives.mine(vectors.limit(0), anchor).count() == 0
    assert hard_negatives.mine(vectors, F.lit(False)).count() == 0


def test_intervals_hold_every_score_and_rule_cells_out(spark):
    rows = [r for r in _vectors(3, 1500) if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    df = spark.createDataFrame(sorted(rows, key=lambda r: (r[0] or 0) % 5), VECTORS).coalesce(1)
    vectors = hard_negatives.usable(df)
    table = hard_negatives.with_angles(vectors, hard_negatives.references(vectors)).toArrow()
    held = hard_negatives.Rows(table)
    lower, upper = hard_negatives.intervals(held.norm, held.angles, (held.norm,) * 2, (held.angles,) * 2)
    score = hard_negatives.scores(held.parts, held.parts, held.largest, held.largest)
    assert (lower <= score).all() and (score <= upper).all()
    cells = held.cells()
    low, high = hard_negatives.intervals(held.norm, held.angles, cells["norms"], cells["angles"])
    of_cell = np.repeat(np.arange(len(cells["starts"])), hard_negatives.CELL)[: len(held)]
    assert (low[:, of_cell] <= score).all() and (score <= high[:, of_cell]).all()
    anything = np.full((len(held), 1), np.inf)
    sought = hard_negatives.Sought(held, -anything, anything, 5, True)
    sought.read(held)
    sought.read(held)
    assert sought.scored < 0.6 * 2 * len(held) ** 2


def test_scores_beyond_doubles_stay_whole():
    a = np.array([[2.0**30 + 1, 3.0]])
    assert hard_negatives.scores(a, a, 2.0**30 + 1, 2.0**30 + 1)[0, 0] == (2**30 + 1) ** 2 + 9


# ---- exact top-k --------------------------------------------------------------------------


def _top(rows, every, k):
    usable = [
        (i, vec_id, [math.floor(256 * x) for x in v])
        for i, (vec_id, v, *_) in enumerate(rows)
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, query_id, a in usable:
        if query_id is None or query_id % every:
            continue
        scored = [(-sum(p * q for p, q in zip(a, v)), i is None, i or 0, i) for n, i, v in usable if n != at]
        out += [(query_id, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_top_k_takes_every_row_as_a_candidate(spark, monkeypatch):
    # Rows of one id with different vectors, rows without an id, and scores that doubles cannot hold.
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "CHUNK", 5)
    rows = _vectors(4, 300) + [(0, [0.5, 0.0, 0.0, 0.0, 0.0, 0.0], 1, "x", "x"), (1, [0.25, 0.0, 0.0, 0.0, 0.0, 0.0], 1, "x", "x")]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(2)
    for slice_bytes in (1 << 20, 500):
        monkeypatch.setattr(topk, "SLICE_BYTES", slice_bytes)
        assert sorted(map(tuple, topk.search(vectors, 50, 5).collect()), key=repr) == _top(rows, 50, 5)
    assert topk.search(vectors.limit(0)).count() == 0
    large = [(50 * i, [float(2**22 + i), 3.0 * i, 1.0], 1, "x", "x") for i in range(8)]
    vectors = spark.createDataFrame(large, VECTORS)
    assert sorted(map(tuple, topk.search(vectors, 50, 3).collect()), key=repr) == _top(large, 50, 3)


def test_reading_stops_early_where_the_bounds_allow_it():
    rng = np.random.default_rng(0)
    # Sparse vectors with few great components: lists need not be read far.
    parts = np.where(rng.random((600, 12)) < 0.1, rng.integers(1, 4000, (600, 12)), 0).astype(float)
    lists = topk.SortedLists(np.arange(600), parts)
    asked = np.arange(0, 600, 20)
    found = lists.best(asked, parts[asked], 3)
    for i in asked:
        scored = sorted((-int(parts[i] @ parts[j]), j) for j in range(600) if j != i)[:3]
        assert [(-s, v) for s, v in scored] == [(s, v) for q, v, s in found if q == i]
    assert sum(n for share, n in lists.read.items() if share <= 0.4) > len(asked) / 2
    # A level from earlier blocks stops queries that can find nothing better at once.
    again = topk.SortedLists(np.arange(600), parts)
    assert again.best(asked, parts[asked], 3, np.full(len(asked), 1e12)) == []
    assert set(again.read) == {topk.DEPTHS[0]}
