"""Hand-computed cases."""

import hashlib
import random
import time

import numpy as np
from pyspark.sql import functions as F

from velora.functions import geometry as G
from velora.functions import text as T
from velora.functions import vector as V
from velora.operators import chunking, corpus, lexicon, metrics


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_lemma(spark):
    assert one(spark, T.lemma(F.lit("[공부1]"))) == "공부"
    assert one(spark, T.lemma(F.lit("2"))) == ""


def test_comparison_key(spark):
    assert one(spark, T.comparison_key(F.lit("가야 한다."))) == one(spark, T.comparison_key(F.lit("가야한다")))


def test_unicode_strip(spark):
    assert one(spark, T.strip(F.lit("\t  a　"))) == "a"


def test_nfkc(spark):
    assert spark.createDataFrame([("ﬁ①",), (None,)], "s string").select(T.nfkc("s").alias("x")).collect()[0].x == "fi1"


def test_small_functions(spark):
    assert one(spark, T.hangul_runs(F.lit("가나 x 다가나, 가나"))) == ["가나", "다가나"]
    assert one(spark, T.collapse(F.lit(" a \t\n b　c "))) == "a b c"
    assert [one(spark, V.clamp(F.lit(x), 2, 5)) for x in (1, 3, 9)] == [2, 3, 5]
    assert abs(one(spark, V.soft_min(F.array(F.lit(1.0), F.lit(4.0), F.lit(2.0)))) - (1 - np.log(0.5 + np.exp(1 - 4)))) < 1e-12
    assert [T_natural for T_natural in sorted(["f10", "f9", "g1", "f9b"], key=lambda x: one(spark, T.natural_key(F.lit(x))))] == ["f9", "f9b", "f10", "g1"]
    loss = lambda a, b, n: one(spark, V.sequence_loss(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)), F.lit(n)))
    assert loss([1.0, 2.0, 9.0], [1.5, 4.0, 0.0], 2) == (0.125 + 1.5) / 2 + 0.5 * (1.5 - 0.5) and loss([1.0], [1.0], 0) == 0 and loss([3.0], [1.0], 1) == 1.5
    pages = spark.createDataFrame([(1, "a\fb")], "k int, value string")
    assert [tuple(r) for r in chunking.pages_of(pages).collect()] == [(1, 0, "a"), (1, 1, "b")]
    places = sorted(r.place for r in corpus.rotated(spark.range(7).withColumnRenamed("id", "place"), "place", "turn").collect())
    assert places == list(range(7)) and corpus.rotated(spark.range(0).withColumnRenamed("id", "place"), "place", "turn").count() == 0


def test_cleaning_brings_to_one_form(spark):
    df = spark.createDataFrame([(1, "ﬁ x"), (2, "fi x"), (3, "\u00a0"), (4, "ａ①"), (5, None)], "id int, t string")
    got = corpus.keep_first(corpus.cleaned(df, ["t"]), ["t"], "id").collect()
    assert sorted((r.id, r.t) for r in got) == [(1, "fi x"), (4, "a1")]


def test_feature_tags(spark):
    assert one(spark, T.feature_tags(F.lit("왜 안 가니?"))) == ["부정", "의문"]
    assert one(spark, T.feature_query(F.lit("a"))) == T.NO_FEATURE


def test_sentences(spark):
    assert one(spark, T.sentences(F.lit("갔다. 왔다.그래! 응"))) == ["갔다.", "왔다.", "그래!", "응"]


def test_motion_round_trip(spark):
    s = one(spark, T.motion_string(F.array(F.lit(3), F.lit(7))))
    assert s == "<motion_id_512><motion_id_3><motion_id_7><motion_id_513>"
    assert one(spark, T.motion_codes(F.lit(s))) == [3, 7]
    assert one(spark, T.motion_codes(F.lit("nothing"))) == [0]


def test_weak_hits_need_four(spark):
    rows = [("가나", "가나다")] * 4 + [("마바", "마바사")] * 3
    got = lexicon.build(spark.createDataFrame(rows, "t string, g string"), "t", "g").collect()
    assert [(r.stem, r.weight) for r in got] == [("가나다", 1)]


def test_greedy_lookup_takes_longest(spark):
    lex = spark.createDataFrame([("abc", "ABC", 1), ("ab", "AB", 5), ("cd", "CD", 2)], "stem string, gloss string, weight long")
    got = lexicon.lookup(spark.createDataFrame([(1, "abcd ab")], "id int, t string"), lex, "id", "t").first()
    assert got.hints == ["abc=ABC", "ab=AB"]


def test_lookup_by_force(spark):
    """Against marking the characters of each text one by one."""
    rng = random.Random(3)
    stems = sorted({"".join(rng.choices("abc", k=rng.randrange(2, 5))) for _ in range(25)})
    lex = spark.createDataFrame([(s, s.upper() + g, w) for s in stems for g, w in (("1", 2), ("2", 2))], "stem string, gloss string, weight long")
    texts = [(i, "".join(rng.choices("abc []", k=rng.randrange(40)))) for i in range(30)] + [(40, None), (41, ""), (42, "a")]
    got = {r.id: r.hints for r in lexicon.lookup(spark.createDataFrame(texts, "id int, t string"), lex, "id", "t", 3).collect()}
    spots = {(r.id, r.stem): r.at for r in lexicon.matches(spark.createDataFrame(texts, "id int, t string"), lexicon.best(lex), "id", "t").collect()}
    for i, t in texts:
        plain, hits = (t or "").replace("[", "").replace("]", ""), []
        marks = ["."] * len(plain)
        assert {s: plain.index(s) + 1 for s in stems if s in plain} == {s: at for (k, s), at in spots.items() if k == i}
        for s in sorted(stems, key=lambda s: (-len(s), s)):
            places = [k for k in range(len(plain)) if plain.startswith(s, k) and "#" not in marks[k : k + len(s)]]
            if places and len(hits) < 6:
                marks[places[0] : places[0] + len(s)] = "#" * len(s)
                hits.append((places[0], f"{s}={s.upper()}1"))
        assert got.get(i, []) == [h for _, h in sorted(hits)[:3]]


def test_lexicon_ties_by_first_seen(spark):
    rows = [(2, "가나다 x", "가나다1 가나다2"), (1, "가나다 y", "가나다2"), (3, "가나다", "가나다1")]
    lex = lexicon.build(spark.createDataFrame(rows, "n int, t string, g string"), "t", "g", order="n")
    assert [(r.stem, r.gloss) for r in lexicon.best(lex).collect()] == [("가나다", "가나다2")]
    assert lexicon.best(lex.drop("seen")).first().gloss == "가나다1"


def test_word_error_rate(spark):
    got = metrics.sequence_scores(spark.createDataFrame([("a b c", "a x c"), ("a", "a b")], "p string, r string"), "p", "r").first()
    assert got.wer == 0.4


def test_token_f1(spark):
    assert abs(one(spark, metrics.token_f1(F.split(F.lit("a a b"), " "), F.split(F.lit("a b b"), " "))) - 2 / 3) < 1e-12


def test_merged_paragraphs():
    a, lens = "x" * 100, lambda p, *limits: [len(c) for c in chunking.merged(p, *limits)]
    assert lens([a, a, a]) == [201, 100] and lens(["y" * 700]) == [700] and lens([]) == lens(["", " \n"]) == []
    assert lens(["x" * 600]) == [600] and lens(["x" * 600, a]) == [600, 100]  # a paragraph that fills a chunk waits for the next
    assert lens([a, "x" * 590, a]) == [100, 590, 100]
    assert chunking.merged(["aa", "b" * 9, "cc"], 4, 8) == ["aa", "b" * 9, "cc"]
    assert chunking.merged(["aa", "bbb. ccc. ddd. e", "f"], 4, 8) == ["aa", "bbb. ccc.", "ddd. e\nf"]
    assert chunking.merged(["a한다.나간다.b. c d"], 3, 6) == ["a한다.", "나간다. b.", "c d"]
    assert chunking.merged([" a ", "b"], 3, 9) == ["a\nb"]


def test_chunks_are_numbered_over_all_documents(spark):
    text = lambda n: "\n".join(f"{i} {'w' * 90}." for i in range(n))
    pages = spark.createDataFrame([(d, p, text(4)) for d in (3, 1, 2) for p in (0, 1)], "doc int, page int, raw string")
    got = chunking.chunks(pages, "doc", first_page=0).orderBy("chunk").collect()
    assert [r.chunk for r in got] == [f"g{i:05d}" for i in range(len(got))] and [(r.doc, r.page) for r in got] == sorted((r.doc, r.page) for r in got)
    assert {r.doc for r in got} == {1, 2, 3}


def test_clean_page(spark):
    """Page, then its text, chapter and section."""
    cases = [
        ("한국수어\n제 2 장 - 3\n수지요소\n본문 한 줄\n1) 각주\n12\n목차·····3\n끝\n77\n", "본문 한 줄\n끝", "제2장", "수지요소"),
        ("제1장-2\n\n이름\n글", "이름\n글", "제1장", "이름"),  # a blank line between ends the header before the name
        ("제1장-2\n이름이 문장이다.\n글", "이름이 문장이다.\n글", "제1장", ""),
        ("제1장-2\n" + "긴" * 21 + "\n글", "긴" * 21 + "\n글", "제1장", ""),
        ("제1장-1\n제2장-2\n이름\n글", "글", "제2장", "이름"),
        ("제1장-1\n제2장-2\n\n\n\n글", "글", "제2장", "제2장-2"),
        ("문법\n문법\n문법\n문법\n문법\n문법\n문법\n글", "문법\n글", "", ""),  # six are looked at
        ("\n\n문법\n제1장-1\n제1장-1\n문법\n문법\n글", "문법\n글", "제1장", "문법"),
        ("글\n9\n\n\n\n끝\n12\n\n", "글\n\n끝", "", ""),
        ("글\n1234\n끝\n5\n\n\n\n\n", "글\n1234\n끝", "", ""),
        ("a \t b\n\n\n\nc  \n2)d\n3) d", "a b\n\nc\n2)d", "", ""),
        ("", "", "", ""), ("\n\n", "", "", ""), ("한국수어", "", "", ""), ("77", "", "", ""), ("제1장-1", "", "제1장", ""),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)] + [(99, None)], "k int, page string")
    got = {r.k: tuple(r.c) for r in df.select("k", chunking.clean_page(F.col("page")).alias("c")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[1:] for c in cases] and got[99] == ("", "", "")


def test_keep_first_and_split(spark):
    df = spark.createDataFrame([(2, " a b ", "s"), (1, "a b", "s"), (3, "", "s"), (4, None, "s")], "id int, text string, src string")
    kept = corpus.keep_first(corpus.cleaned(df, ["text"]), ["text", "src"], "id").collect()
    assert [r.id for r in kept] == [1]
    pair = spark.createDataFrame([("가야 한다.",), ("가야한다",)], "t string")
    assert corpus.split(pair, "t").select("split").distinct().count() == 1


def test_numbered(spark):
    got = corpus.numbered(spark.range(100).select((100 - F.col("id")).alias("k")), ["k"]).orderBy("k").collect()
    assert [r.file_id for r in got] == [f"auto{i:07d}" for i in range(100)]


def test_places_hold_when_ranges_are_merged(spark):
    """Many rows over many partitions, merged by size, with ties: every place once, and in order."""
    n = 200_000
    rows = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(5000)).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"), F.repeat(F.md5(F.col("id").cast("string")), 6).alias("load"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", 4 << 20)
    try:
        got = corpus.placed(rows, [F.col("k").desc()])
        assert got.agg(F.count("*"), F.count_distinct("place"), F.min("place"), F.max("place")).first() == (n, n, 0, n - 1)
        want = {}
        for r in rows.groupBy("k").count().orderBy(F.col("k").desc()).collect():
            want[r.k] = (sum(c for _, c in want.values()) if not want else want[last][0] + want[last][1], r["count"])  # noqa: F821
            last = r.k  # noqa: F841
        spans = got.groupBy("k").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).collect()
        assert all((r.lo, r.hi) == (want[r.k][0], sum(want[r.k]) - 1) for r in spans) and got.columns == [*rows.columns, "place"]
        numbers = corpus.numbered(rows.select("load"), ["load"], "n", "%d").orderBy("load").select("n").limit(50).collect()
        assert [r.n for r in numbers] == [str(i) for i in range(50)]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_frechet_of_equal_sets_is_zero():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    c, m = np.cov(x.T), x.mean(0)
    rows = [(g, i, j, c[i, j], m[i]) for g in (0, 1) for i in range(4) for j in range(i, 4)]
    assert abs(metrics.frechet(rows, 4, 0, 1)) < 1e-6


def kernel_distance_by_force(rows, size, subsets):
    out = []
    for s in range(subsets):
        x, y = (np.array([v for _, v in sorted((hashlib.md5(f"{s}:{i}".encode()).hexdigest(), v) for i, h, v in rows if h == g)[:size]]) for g in (0, 1))
        k = lambda a, b: [[(float(p @ q) / len(p) + 1) ** 3 for q in b] for p in a]
        same = sum(k(z, z)[i][j] for z in (x, y) for i in range(size) for j in range(size) if i != j) / (size * (size - 1)) if size < 20 else None
        if same is None:
            aa, bb = (((z @ z.T) / z.shape[1] + 1) ** 3 for z in (x, y))
            same = (aa.sum() - np.trace(aa) + bb.sum() - np.trace(bb)) / (size * (size - 1))
        out.append(same - 2 * np.mean(((x @ y.T) / x.shape[1] + 1) ** 3))
    return out


def test_kernel_distance_by_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3 % 2, rng.normal(size=3).tolist()) for i in range(90)] + [(1, 1, [9.0, 9.0, 9.0])] * 4
    df = spark.createDataFrame([*rows, (500, None, [0.0] * 3), (501, 0, None)], "i long, g int, v array<double>")
    got = [r.d for r in metrics.kernel_distance(df, "v", "g", "i", subsets=3, size=12).orderBy("seed").collect()]
    assert np.allclose(got, kernel_distance_by_force(rows, 12, 3), rtol=1e-9)
    few = [r.d for r in metrics.kernel_distance(df, "v", "g", "i", subsets=2, size=5000).orderBy("seed").collect()]
    assert np.allclose(few, kernel_distance_by_force(rows, 34, 2), rtol=1e-9)
    assert metrics.kernel_distance(df.limit(0), "v", "g", "i").count() == 0


def test_kid_draws_from_all_rows(spark, tmp_path):
    from velora.plans import catalog

    rng = np.random.default_rng(3)
    rows = [(i, i % 10, (rng.normal(size=3) + (i % 10 >= 5)).tolist()) for i in range(4000)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = kernel_distance_by_force([(i, int(g >= 5), v) for i, g, v in rows], 1000, 100)
    got = catalog.QUERIES["kid"](spark, str(tmp_path)).first()
    assert np.allclose([got.kid, got.deviation], [np.mean(want), np.std(want)], rtol=1e-6)


def test_procrustes_undoes_similarity():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(21, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    assert np.abs(metrics.procrustes(2 * a @ q + 3, a) - a).max() < 1e-9


def test_rotations(spark):
    half = F.array(F.lit(0.5**0.5), F.lit(0.0), F.lit(0.0), F.lit(0.5**0.5))
    turned = one(spark, G.q_rotate(half, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))))
    assert np.allclose(turned, [0, 1, 0])
    assert np.allclose(one(spark, G.q_slerp(F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))), half, F.lit(1.0))), [0.5**0.5, 0, 0, 0.5**0.5])
    between = G.q_between(F.array(*map(F.lit, (1.0, 0.0, 0.0))), F.array(*map(F.lit, (0.0, 1.0, 0.0))))
    assert np.allclose(one(spark, between), [0.5**0.5, 0, 0, 0.5**0.5])


def test_library_does_not_need_the_llm_package():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "velora"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "velora.llm" not in p.read_text(), p


def test_grams_of_long_texts_and_of_rows_that_share_an_id(spark):
    """Texts are cut into words once, not once for each of their n-grams; rows of one id count as one."""
    from collections import Counter

    rows = [(1, "a b c a b", "a b a b d"), (2, "a b c", "x a b c d"), (2, "b c \U0001f600", "b c"), (3, "", "a b"), (4, " ".join(f"w{k % 977}" for k in range(20_000)), " ".join(f"w{k % 983}" for k in range(20_000)))]
    begun = time.monotonic()
    df = spark.createDataFrame(rows, "k int, p string, r string")
    got = {r.n: (r.matched, r.total) for r in metrics.clipped_ngrams(df, "k", "p", "r", 4).collect()}
    chars = {r.n: tuple(r)[1:] for r in metrics.gram_matches(df.where("k < 4").selectExpr("k id", "replace(p, ' ', '') p", "replace(r, ' ', '') r"), 3, "").collect()}
    assert time.monotonic() - begun < 60
    grams = lambda x, n: [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]

    def both(n, of, own):
        out = {}
        for k, p, r in own:
            for side, x in ((0, p), (1, r)):
                out.setdefault(k, (Counter(), Counter()))[side].update(grams(of(x), n))
        return list(out.values())

    for n in range(1, 5):
        own = both(n, str.split, rows)
        assert got[n] == (sum((a & b).total() for a, b in own), sum(a.total() for a, _ in own))
    for n in range(1, 4):
        own = both(n, lambda x: x.replace(" ", ""), rows[:4])
        apart = sum(sum(v for g, v in x.items() if g not in y) for a, b in own for x, y in ((a, b), (b, a)))
        assert chars[n] == (sum((a & b).total() for a, b in own), sum(a.total() for a, _ in own), sum(b.total() for _, b in own), apart)


def test_features_are_sought_once_and_alike(spark):
    """Texts without Hangul are searched for the few patterns that fit them."""
    texts = ["왜 안 가니?", "12 red", "why?", "", None, "a?1", "가장 더 크다 3", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.array_compact(F.array(*[F.when(F.col("t").rlike(p), F.lit(n)) for n, p, _ in T.FEATURES]))
    terms = F.concat_ws(" ", *[F.when(F.col("t").rlike(p), F.lit(w)) for _, p, w in T.FEATURES])
    want = df.select("t", plain, F.when(terms == "", T.NO_FEATURE).otherwise(terms)).collect()
    assert [tuple(r) for r in df.select("t", T.feature_tags(F.col("t")), T.feature_query(F.col("t"))).collect()] == [tuple(r) for r in want]
    begun = time.monotonic()
    long = spark.range(1).select(F.repeat(F.lit("nothing to see here "), 500_000).alias("t"))
    assert long.select(T.feature_tags(F.col("t")).alias("a"), T.feature_query(F.col("t")).alias("b")).first() == ([], T.NO_FEATURE)
    assert time.monotonic() - begun < 10


def test_values_of_placeholders_are_made_where_asked(spark):
    """A placeholder in the caption counts; what no template asks for isn't made."""
    df = spark.createDataFrame([("<Caption_Placeholder>, <Motion_Placeholder>", "in <Frame_Placeholder>", [1, 2], 8), ("x", "c", None, 8)], "t string, c string, k array<int>, f int")
    got = [r[0] for r in df.select(T.fill(F.col("t"), F.col("c"), F.col("k"), F.col("f"))).collect()]
    assert got == ["in 8, <motion_id_512><motion_id_1><motion_id_2><motion_id_513>", None]
    own = df.select(T.fill(F.col("t"), F.col("c"), F.col("k"), F.col("f")).alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert own.count("contains(") >= 7


def test_texts_go_to_python_in_small_batches(spark):
    """Whatever the session asks for: an executor holds a batch for each of its tasks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 10_000)
    try:
        corpus.cleaned(spark.createDataFrame([("Å",)], "t string"), ["t"])
        assert int(spark.conf.get(name)) <= 500
    finally:
        spark.conf.set(name, before)
