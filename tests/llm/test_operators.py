"""The training-data operators on Spark: odd rows, brute force, and the registered queries."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from compare import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from topicgauge.llm import (
    common,
    fingerprint,
    language,
    licenses,
    lines,
    mixing,
    near,
    packing,
    queries,
    secret_scan,
    topk,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, "one two three four five six seven\nthis line is repeated often\nend", "en", "a", 5, "x", 1),
    (2, None, "en", None, None, None, None),
    (3, "", None, "b", 0, "x", 1),
    (4, "This line is repeated often \n\n  this line is repeated often", "de", "a", 1, "x", 1),
    (5, "THIS LINE IS REPEATED OFTEN\nshort", None, None, 1, "x", 1),
    (6, "one two three four five six seven\nthis line is repeated often\nend", "en", "a", 5, "x", 1),
    (6, "one two three four five six seven\nthis line is repeated often\nend", "en", "a", 5, "x", 1),
    (None, "one two three four five six seven\nthis line is repeated often", "en", "a", 5, "x", 1),
    (70, LONG, "en", "b", 3, "x", 1),
    (71, LONG + " end", "en", "b", 3, "x", 1),
    (72, "é ü ñ 你好   x", "fr", "b", 3, "x", 1),
    (73, "\n\n", "fr", "c", 3, "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    common.prepare(spark)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text):
    return (text or "").encode().split()


def _sketch(text):
    words = (text or "").lower().encode().split()
    if not words:
        return []
    hashes = set()
    for i in range(max(1, len(words) - fingerprint.WIDTH + 1)):
        seed = 42
        for w in words[i : i + fingerprint.WIDTH]:
            seed = xxhash.xxh64_intdigest(w, seed=seed)
        hashes.add(seed - (1 << 64) if seed >> 63 else seed)
    return sorted(hashes)[: fingerprint.SIZE]


def _alike(a, b):
    union = sorted(set(a) | set(b))[: fingerprint.SIZE]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def _hex(a):
    return "".join(f"{h & (1 << 64) - 1:016X}" for h in a)


def test_fingerprints_equal_brute_force(odd, empty, folder, spark):
    for df in (odd, spark.read.parquet(f"{folder}/documents.parquet")):
        got = fingerprint.edited_fingerprints(df).collect()
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
        expected = []
        for (doc_id, text), (_, follow) in zip(rows, rows[1:] + rows[:1]):
            cut = len(text) // 3
            edited = text[: len(text) - cut] + follow[:cut]
            own, other = _sketch(text), _sketch(edited)
            expected.append(
                (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), _hex(own), _hex(other))
                + (_alike(own, other), _alike(own, _sketch(follow)))
            )
        key = lambda r: (r[0] is not None, r[0] or 0, r[2])
        assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(expected, key=key)
    assert fingerprint.edited_fingerprints(empty).count() == 0


def test_sketches_merge(spark):
    text = " ".join(f"w{i}" for i in range(900))
    df = spark.createDataFrame([(text, text[:2500], text[2400:])], "a string, b string, c string")
    for name in ("a", "b", "c"):
        df = fingerprint.sketch(df, name, f"s{name}")
    row = df.select(
        fingerprint.merged(F.col("sb"), F.col("sc")).alias("both"),
        "sa",
        fingerprint.distinct_shingles(F.col("sa")).alias("n"),
        fingerprint.containment(F.col("sb"), F.col("sa")).alias("held"),
    ).first()
    assert len(set(row.both) & set(row.sa)) >= fingerprint.SIZE - 8
    assert abs(row.n - 896) < 250 and row.held > 0.85


def test_licences(odd, empty):
    got = licenses.scan(odd).collect()
    assert len(got) == len(ROWS) and all(r.n_base == 0 and r.labels == "" for r in got)
    assert {r.n_words for r in got if r.doc_id in (2, 3, 73)} == {0}
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    assert {r.n_words for r in got if r.doc_id == 72} == {len(re.findall(word, ROWS[10][1].lower()))}
    assert licenses.scan(empty).count() == 0


def test_language_of_odd_rows(odd, empty):
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {2, 3, 73}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_holds_out(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    # Labels of held-out documents change nothing.
    blind = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert language.identify(blind).exceptAll(language.identify(docs)).count() == 0


@pytest.mark.parametrize(("few", "many", "limit"), [(3, 4, 60), (50, 20, 200), (1, 1, 40)])
def test_every_language_is_sampled(spark, few, many, limit):
    # Documents of twelve stretches in most languages, of one line in another.
    long = [(1000 * x + i, f"l{x}", "\n".join(f"{chr(97 + x)}{'on' * (i % 5)} tua" for _ in range(12))) for x in range(many) for i in range(60)]
    rows = long + [(90_000 + i, "xx", "zyx zywxe qqy") for i in range(few)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    got = language.sampled(docs, limit=limit)
    assert got == language.sampled(docs.repartition(2), limit=limit)
    counts = Counter(lang for lang, _ in got)
    allowed = language.shares({lang: n for lang, n in [("xx", few), *((f"l{x}", 720) for x in range(many))]}, limit)
    assert counts["xx"] == allowed["xx"] if few <= language.LEAST else counts["xx"] >= language.LEAST / 2
    assert all(allowed[lang] / 2 <= counts[lang] <= 2 * allowed[lang] for lang in allowed)
    assert {lang for lang, _ in got} == {"xx"} | {f"l{x}" for x in range(many)}
    model = language.fit(docs)
    assert language.Labeller(model).texts(["zyx zywxe qqy"])[0][0] == "xx"


def test_shares_of_languages():
    assert language.shares({"a": 3, "b": 7500, "c": 7500}, 9000) == {"a": 3, "b": 4498, "c": 4499}
    assert language.shares({str(i): 100 for i in range(1000)}, 9000) == {str(i): 30 for i in range(1000)}
    assert language.shares({}, 9000) == {}


def test_mix_of_odd_rows(odd, empty, spark):
    sized = odd.withColumn("size", common.word_count(F.col("text"))).withColumn("target", F.lit("x"))
    got = mixing.mixed(sized).collect()
    assert len(got) == len(ROWS)
    total = sum(r["size"] for r in got)
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    for source, (target, size) in targets.items():
        taken = sum(r.taken for r in got if r.source == source)
        assert target <= 2 * size and abs(taken - target) <= 3 * mixing.BLOCK
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.taken == r.copies * r["size"] + r.cut_to - r.cut_from + r.cut_end
    again = mixing.mixed(sized.repartition(5)).collect()
    key = lambda r: str((r.doc_id, r.text, r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mixed(empty.withColumn("size", F.lit(0).cast("long"))).count() == 0


def test_seats_equal_the_definition(spark):
    draw = random.Random(2)
    rows = [(g, k, draw.randint(0, 500), draw.randint(0, 30), 40) for g in range(6) for k in range(draw.randint(1, 9))]
    df = spark.createDataFrame(rows, "g long, k long, votes long, most long, house long")
    got = {(r.g, r.k): r.seats for r in mixing.apportion(df, ["g"], "k", "seats").collect()}
    for g in range(6):
        own = [r for r in rows if r[0] == g and r[2] > 0]
        quotients = sorted((-v / (2 * j - 1), k) for _, k, v, most, _ in own for j in range(1, most + 1))
        for _, k, _, _, house in own:
            expected = sum(1 for _, x in quotients[:house] if x == k)
            # A bound that binds may leave seats open; no party gets more than its share.
            assert got[g, k] <= max(expected, 0)
            if all(r[3] >= 40 for r in own):
                assert got[g, k] == expected


def test_pieces_and_batches(odd, empty):
    got = packing.packed(odd, context=500, buckets=3, budget=2000).collect()
    for doc_id, text, *_ in ROWS:
        n = len(_words(text))
        same = sum(1 for r in ROWS if r[0] == doc_id and len(_words(r[1])) == n)
        own = [r for r in got if r.doc_id == doc_id]
        assert sum(r.length for r in own) == n * same
    assert all(r.padding == r.bucket - r.length >= 0 for r in got)
    batches = {}
    for r in got:
        batches[r.bucket, r.batch] = batches.get((r.bucket, r.batch), 0) + r.bucket
    assert max(batches.values()) <= 2000 and len({b for b, _ in batches}) <= 3
    assert packing.packed(empty).count() == 0


def test_line_dedup_of_odd_rows(odd, empty):
    got = lines.dedup(odd).collect()
    assert len(got) == len(ROWS)
    kept = {(r.doc_id, r.kept) for r in got}
    # The repeated line stays in the largest id that holds it, however often.
    assert (1, "one two three four five six seven\nend") not in kept
    assert (4, "") in kept and (5, "short") in kept
    assert (6, ROWS[5][1]) in kept
    assert {r.n_lines for r in got if r.doc_id in (2, 3)} == {1}
    assert (72, ROWS[10][1]) in kept and (70, LONG) in kept
    assert lines.dedup(empty).count() == 0


def test_near_copies_equal_brute_force(odd, empty, spark):
    draw = random.Random(8)
    base = [f"w{draw.randint(0, 400)}" for _ in range(120)]
    rows = [(i, t) for i, t, *_ in ROWS if i is not None and i != 6] + [(6, ROWS[5][1]), (6, "a b c")]
    for i in range(100, 260):
        words = list(base)
        for _ in range(draw.randint(0, 9)):
            words[draw.randrange(120)] = f"v{draw.randint(0, 3000)}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(base[: draw.randint(1, 12)])) for i in range(300, 340)] + [(400, "a b c")]
    for width in (4, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = near.linked(df, width=width).collect()
        sets = [near.exact_set(t, width) for _, t in rows]
        root = {i: i for i, _ in rows}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    x, y = sorted((top(rows[i][0]), top(rows[j][0])))
                    root[y] = x
        expected = sorted((i, len(s), top(i), i == top(i)) for (i, _), s in zip(rows, sets))
        assert sorted(tuple(r) for r in got) == expected
    found = near.linked(odd).collect()
    assert len(found) == len(ROWS)
    assert [(r.doc_id, r.kept) for r in found if r.doc_id is None] == [(None, True)]
    assert near.linked(empty).count() == 0


def test_near_stage_keeps_repeated_rows_once(odd, spark):
    got = corpus_pipeline.near_stage(spark, odd, None).collect()
    assert [r.doc_id for r in got].count(1) == 1
    # Rows 6 are near copies of 1 and go; of equal rows one stays, other texts and rows without an id all do.
    words = [f"w{i}" for i in range(60)]
    text, other = " ".join(words), " ".join(reversed(words))
    rows = [(7, text, "en", "a", 1), (7, text, "en", "b", 1), (7, other, "en", "a", 1), (8, text, "en", "a", 1)]
    rows += [(9, None, "en", "a", 1)] * 3 + [(None, "x y", "en", "a", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_stage(spark, docs.repartition(4), None).collect()
    assert Counter(tuple(r) for r in got) == Counter([rows[0], rows[2], rows[4], *rows[-2:]])


def test_secrets_of_odd_rows(odd, empty):
    got = secret_scan.scan(odd).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert len(got) == len(ROWS) and {(r.base_sha256, r.spans) for r in got} == {(none, "")}
    assert secret_scan.scan(empty).count() == 0


def test_toxicity_of_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (4, None), (None, 1), (5, 0), (72, 0)], "doc_id long, toxic int"
    )
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_toxicity_holds_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id"), labels)
    got = got.join(labels, "doc_id").where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] > 0.8 * (counts[1, 1] + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) < 0.005 * counts[0, 0]


def test_top_k_of_odd_rows(spark):
    rows = [
        (0, [0.5, 0.25], "x"), (50, [1.0, -1.0], "x"), (50, [0.1, 0.1], "x"), (7, None, "x"),
        (8, [float("nan"), 1.0], "x"), (9, [1.0, None], "x"), (10, [float("inf"), 1.0], "x"),
        (11, [0.5, 0.25], "x"), (12, [0.5, 0.25], "x"), (13, [0.5], "x"), (14, [], "x"),
        (None, [1.0, 1.0], "x"), (100, [-0.001, 0.3], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, parts string")
    # Every row is a candidate, of repeated ids and without one too; only the query's own is not.
    used = [(0, [128, 64]), (50, [256, -256]), (50, [25, 25]), (11, [128, 64]), (12, [128, 64]), (13, [128, 0]),
            (None, [256, 256]), (100, [-1, 76])]
    last = lambda v: (v is None, v or 0)
    expected = []
    for at, (q, own) in enumerate(used):
        if q in (0, 50, 100):
            scores = [(-sum(a * b for a, b in zip(own, p)), last(v), v) for n, (v, p) in enumerate(used) if n != at]
            expected += [(q, i + 1, v, -s) for i, (s, _, v) in enumerate(sorted(scores)[:5])]
    assert sorted(map(tuple, topk.search(df).collect()), key=repr) == sorted(expected, key=repr)
    assert topk.search(df.limit(0)).count() == 0


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = [(f.name, f.dataType) for f in docs.schema]
    sizes = [docs.count()]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        assert [(f.name, f.dataType) for f in after.schema] == schema, name
        before = spark.createDataFrame(after.toPandas(), after.schema)
        sizes.append(before.count())
    # Languages reject nothing here, lines keep all rows, near copies go.
    assert sizes[0] == sizes[1] == sizes[2] > sizes[3]
    own = before.groupBy("source").agg(F.sum(common.word_count(F.col("text"))).alias("n"))
    assert own.count() > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, before, folder)
    words = before.agg(F.sum(common.word_count(F.col("text")))).first()[0]
    assert packed.agg(F.sum("length")).first()[0] == words


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    assert differences(df.collect(), df.columns, connect(folder), queries.SQL[name]) is None


def test_an_unlabelled_corpus_passes_the_language_stage(spark, odd, empty):
    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_stage(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len([1 for r in ROWS if r[1] and any(c.isalpha() for c in r[1])])
    assert corpus_pipeline.language_stage(spark, empty, "").count() == 0


def test_stages_on_odd_rows_and_empty_tables(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES[1:]:
        found = stage(spark, odd, "")
        assert found.count() >= 0, name
        if name in ("line_dedup", "near_dedup", "mix"):
            assert found.columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, empty, "").count() == 0, name


def test_lines_past_the_broadcast_limit_and_in_many_slices(spark, odd, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    both = docs.unionByName(odd.select("doc_id", "text"))
    rows = lambda: sorted(map(tuple, lines.dedup(both).select("doc_id", "n_dropped", "kept").collect()), key=repr)
    plain = rows()
    assert sum(r[1] for r in plain) > 0
    monkeypatch.setattr(lines, "MAX_BITS", 0)
    assert rows() == plain
    monkeypatch.setattr(lines, "MAX_TASKS", 2)
    monkeypatch.setattr(lines, "BITS_PER_LINE", 100_000)  # hundreds of slices for two tasks
    assert rows() == plain
