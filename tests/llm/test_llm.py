"""The ten operators against brute force, round trips and held-out rows, on small hand-made tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from velora.llm import bpe, components, crf, curriculum, jaccard_join, line_dedup, lsh_search, segment_search, substring_dedup, toxicity, url_filter, words
from velora.llm.queries import QUERIES, URL_RULES
from velora.llm.words import blocks

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score double, label string"
V = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]


def docs(spark, rows):
    """With extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, len(t or ""), 0.5, "x") for i, t in rows], SHAPE)


EDGES = [(0, None), (1, ""), (2, " \t\n "), (3, "a"), (3, "a"), (4, "x" * 200_000), (5, "é ß 日本"), (6, "1 2 3 !"), (7, "word " * 30_000), (None, "no id at all " * 30)]


def test_words_match_a_pattern():
    texts = [t for _, t in EDGES]
    for limit in (1, 100, 1 << 20):
        got = [[b.word(k) for k in range(b.first[i], b.first[i + 1])] for b in blocks(pa.array(texts), limit) for i in range(len(b.at))]
        assert got == [WORD.findall(t or "") for t in texts]


def test_segments_change_no_hash(monkeypatch):
    texts = [t for _, t in EDGES] + ["ab " * 50 + "Q" * 90 + " c", "é" * 40]
    whole = next(blocks(pa.array(texts), 1 << 30))
    want = [whole.rolling(lower).slices(whole.starts, whole.ends) for lower in (False, True)]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(words, "SEGMENT_BYTES", size)
        few = next(blocks(pa.array(texts[-2:]), 1 << 30)) if size < 9 else whole
        assert all(np.array_equal(few.word_hashes(lower), w[len(w) - len(few.starts) :]) for lower, w in zip((False, True), want))
    data, lo, hi = whole.gathered(whole.starts[:9], whole.ends[:9])
    assert [data[a:b].tobytes().decode() for a, b in zip(lo, hi)] == [whole.word(k) for k in range(9)]


def test_texts_of_many_megabytes(spark):
    """A text of 24 MB, and one of a single word of 6 MB, beside small ones, through each operator that reads texts."""
    rng = random.Random(6)
    passage = " ".join(rng.choices(V, k=120))
    big = " ".join(rng.choices(V, k=60_000)) + " "
    rows = [(1, passage + "\n" + big * 80 + passage), (2, passage), (3, "y" * 6_000_000), (4, "idiot you"), (5, "a b")]
    assert len(rows[0][1].encode()) > 22_000_000
    df = docs(spark, rows).repartition(2)
    removed = {r.doc_id: r.n_removed for r in substring_dedup.dedup_passages(df).collect()}
    assert removed[2] == 120 and removed[1] == removed[3] == removed[4] == 0  # within one document nothing is removed
    sizes = {r.doc_id: r.n_shingles for r in jaccard_join.similar(df).collect()}
    all_words = WORD.findall(rows[0][1].lower())
    distinct = set(zip(*[all_words[k:] for k in range(4)]))
    assert sizes == {1: len(distinct), 2: 117, 3: 1, 4: 1, 5: 1}
    assert {r.doc_id: r.n_lines for r in line_dedup.dedup_lines(df).collect()} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1}
    model = crf.train(["aa bb cc", "xx yy zz"] * 20, ["p", "q"] * 20)
    assert all(r.lang_pred in "pq" for r in crf.identify(df, model).collect())
    labels = spark.createDataFrame([(i, int(i == 4)) for i in range(1, 6)], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.fit(df, labels, F.lit(True))).count() == 5
    assert curriculum.mix(df).agg(F.sum("size")).first()[0] == sum(len(WORD.findall(t)) for _, t in rows)


# 1

def chain_by_force(scores, transition):
    n, k = scores.shape
    total, out = 0.0, np.zeros((n, k))
    for path in np.ndindex(*[k] * n):
        w = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
        total += w
        for i, y in enumerate(path):
            out[i, y] += w
    return out / total


def test_forward_backward_is_exact(monkeypatch):
    monkeypatch.setattr(crf, "SEGMENT", 3)
    rng = np.random.default_rng(0)
    scores, t = rng.normal(size=(12, 3)), rng.normal(size=(3, 3))
    first = np.array([0, 0, 1, 5, 12])
    got, pairs = crf.posteriors(scores, first, t, pairs=True)
    for lo, hi in zip(first, first[1:]):
        if hi > lo:
            assert np.abs(got[lo:hi] - chain_by_force(scores[lo:hi], t)).max() < 1e-12
    assert abs(pairs.sum() - (0 + 3 + 6)) < 1e-9


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)
    syllables = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ver", "heit"], "cc": ["eau", "oux", "ment", "é"]}
    make = lambda lang: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(40))
    langs = [rng.choice(list(syllables)) for _ in range(200)]
    return crf.train([make(x) for x in langs], langs), make


def test_field_labels_switched_text(field):
    model, make = field
    text = " ".join(make("aa").split()[:20] + make("bb").split()[:20])
    labels = [y for _, y, _ in crf.label_words(model, text)]
    assert labels[:18] == ["aa"] * 18 and labels[22:] == ["bb"] * 18
    held = [(x, make(x)) for x in ("aa", "bb", "cc") * 20]
    got, _ = crf.predict(model, pa.array([t for _, t in held]))
    assert np.mean([a == x for a, (x, _) in zip(got, held)]) > 0.95


def test_field_edges(spark, field):
    got = crf.identify(docs(spark, EDGES), field[0], cols=["doc_id"]).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(EDGES)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 6))
    assert all(by[i].lang_pred != "und" for i in (3, 4, 5, 7))
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in crf.identify(docs(spark, EDGES), None).collect()} == {"und"}
    marks = docs(spark, [(0, "²"), (1, "½ ①"), (2, "Ⅷ"), (3, "ª"), (4, "x²")]).withColumn("lang_pred", F.lit("mine")).withColumn("w_field", F.lit(1))
    got = crf.identify(marks, field[0])
    assert [r.lang_pred != "und" for r in got.orderBy("doc_id").collect()] == [False, False, False, True, True]
    assert got.columns == [c for c in marks.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    empty = docs(spark, EDGES).limit(0)
    assert crf.fit(empty, F.lit(True)) is None
    assert crf.identify(empty, None).count() == 0


def test_field_learns_from_whole_texts(spark, field):
    """What tells two languages apart stands beyond 5,000 characters; executors' words and the driver's give one model."""
    _, make = field
    rows = [(i, " ".join(make("aa") for _ in range(9)) + " " + (" ".join(make("bb" if i % 2 else "cc") for _ in range(3)))) for i in range(60)]
    assert all(len(t[:2500].split()) < 360 for _, t in rows)
    df = spark.createDataFrame([(i, t, ["cc", "bb"][i % 2]) for i, t in rows] + [(0, rows[0][1], "cc"), (70, None, "cc"), (71, "x", None)], "doc_id long, text string, lang string")
    model = crf.fit(df, F.col("doc_id") < 40)
    got, _ = crf.predict(model, pa.array([make(x) for x in ("bb", "cc") * 10]))
    assert got == ["bb", "cc"] * 10
    order = sorted((r.h, r.doc_id) for r in df.where("doc_id < 40").select(F.xxhash64("doc_id").alias("h"), "doc_id").distinct().collect())
    text = dict(rows)
    same = crf.train([text[i] for _, i in order], [["cc", "bb"][i % 2] for _, i in order])
    assert same.classes == model.classes and np.array_equal(same.emission, model.emission) and np.array_equal(same.lexicon.words, model.lexicon.words) and len(model.lexicon.words)
    assert crf.fit(df, F.col("doc_id") < 40, docs=1).classes == [["cc", "bb"][order[0][1] % 2]]


def test_language_query_by_force(spark, tmp_path):
    """The registered query against word-by-word posteriors of a plain forward-backward pass over dictionaries of features."""
    rng = random.Random(4)
    parts = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ver"]}
    make = lambda lang: " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randrange(1, 12)))
    rows = [(i, make(("aa", "bb")[i % 2]), ("aa", "bb")[i % 2]) for i in range(120)] + [(200, None, "aa"), (201, "12 - 3", "bb"), (202, "", None), (203, make("aa"), None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, str(tmp_path)).collect()}
    model = crf.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    k = len(model.classes)
    for i, text, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        words = WORD.findall(text or "")
        if not re.search("[a-z]", text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        scores = []
        for w in words:
            block = next(blocks(pa.array([w])))
            groups = crf.features(block.rolling(lower=True), block.starts, block.ends, model.lexicon)
            scores.append(sum((model.emission[f].astype(float) for index, _ in groups for f in index), np.zeros(k)))
        forth, back, n = [np.exp(scores[0])], [np.ones(k)], len(words)
        a = np.exp(model.transition)
        for s in scores[1:]:
            forth.append((forth[-1] @ a) * np.exp(s))
        for s in scores[:0:-1]:
            back.append(a @ (np.exp(s) * back[-1]))
        share = sum(f * b / (f * b).sum() for f, b in zip(forth, back[::-1])) / n
        assert got[i].lang_pred == model.classes[int(share.argmax())] and abs(got[i].score - share.max()) < 1e-6


# 2

@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_bpe_equals_the_library(spark, tokenizer):
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(tokenizer), bpe.codec(tokenizer)
    texts = [t for _, t in EDGES] + ["a <|endoftext|> b<|endoftext|>", "  x\n\n y \t z's 'll \x1c q\x85 a\xa0b　 c", "テスト½² é́", "<|endoftext", "  x   ", "a" * 501, "😀👨‍👩", "don't'LL 12ab"]
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert c.encode(x or "") == ids
        assert c.decode(ids) == t.decode(ids, skip_special_tokens=False) == (x or "")
    assert c.decode(t.encode("é").ids[:1]) == t.decode(t.encode("é").ids[:1], skip_special_tokens=False)
    frame = docs(spark, list(enumerate(texts)))
    back = bpe.decode(bpe.encode(frame, tokenizer), tokenizer).collect()
    assert {r.doc_id: r.text for r in back} == {i: x or "" for i, x in enumerate(texts)}
    rows = {r.doc_id: r for r in bpe.round_trip(frame, tokenizer).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == want


def test_bpe_sections_change_nothing(spark, tokenizer, monkeypatch):
    c = bpe.codec(tokenizer)
    texts = ["a  b \n\n c " * 9, "x" * 100 + " y", "   ", "é 日本  語\x85z" * 7, "", "p<|endoftext|>q " * 5]
    whole = [c.round_trip(t) for t in texts]
    assert [w[2] for w in whole] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    for size in (1, 3, 10):
        monkeypatch.setattr(bpe, "SECTION", size)
        assert [c.round_trip(t) for t in texts] == whole and len(list(c.sections(texts[0]))) > 1
    assert bpe.round_trip(docs(spark, EDGES).limit(0), tokenizer).count() == 0


# 3

def test_line_dedup_by_force(spark):
    rng = random.Random(3)
    lines = ["L" * 39, "É" * 40, "Q" * 40, "  " + "q" * 40 + "\t", "z" * 60, "", "short"] + [f"{i} " * 20 for i in range(5)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(9)))) for i in range(60)] + [(70, None), (3, rows_text := "Q" * 40), (3, rows_text)]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holds = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holds.setdefault(key(x), set()).add(i)
    want = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if not (len(key(x)) >= 40 and len(holds[key(x)]) >= 5 and i < max(holds[key(x)]))]
        want.append((i, "\n".join(kept), len((t or "").split("\n")), len((t or "").split("\n")) - len(kept)))
    got = line_dedup.dedup_lines(docs(spark, rows))
    assert sorted(tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == sorted(want)
    assert got.columns[: len(docs(spark, rows).columns)] == docs(spark, rows).columns
    assert line_dedup.dedup_lines(docs(spark, EDGES)).count() == len(EDGES)
    assert line_dedup.dedup_lines(docs(spark, EDGES).limit(0)).count() == 0


# 4 and 5

def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[200:280] = x[7]  # a vector that many rows share
    rows = [(int(i), v.tolist(), 0.5) for i, v in enumerate(x)]
    rows += [(400, None, 0.5), (401, [0.0] * 16, 0.5), (402, [None] + [1.0] * 15, 0.5), (403, [float("nan")] + [1.0] * 15, 0.5), (404, [float("inf")] + [1.0] * 15, 0.5), (450, [1.0, 2.0], 0.5), (405, [], 0.5)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")


def test_lsh_recall_and_form(spark):
    x, df = vectors(spark)
    x = np.array([r.embedding for r in df.where("vec_id < 300").orderBy("vec_id").collect()])
    got = {}
    for r in lsh_search.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r
    hits = 0
    for q in range(0, 300, 50):
        s = x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        mine = [got[q][k].vec_id for k in range(1, 6)]
        hits += len(set(best) & set(mine))
        assert all(abs(got[q][k].score - s[got[q][k].vec_id]) < 1e-12 for k in range(1, 6))
        if q in (200, 250):
            assert mine == best == [7, 201, 202, 203, 204] if q == 200 else mine == best == [7, 200, 201, 202, 203]
    assert hits >= 0.9 * 30 and 450 not in got and len(got) == 6
    assert lsh_search.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_lsh_cells_change_nothing(spark, monkeypatch):
    """Buckets of nearly all rows, split into cells of a few rows and queries."""
    _, df = vectors(spark)
    find = lambda: sorted(map(tuple, lsh_search.search(df, F.col("vec_id") % 5 == 0, width=30.0, count=3).collect()))
    whole = find()
    monkeypatch.setattr(lsh_search, "SHARD", 7)
    monkeypatch.setattr(lsh_search, "CELL", 20)
    assert find() == whole


def test_probes_come_in_order():
    p = np.array([0.1, 2.6, -0.7])
    cells = lsh_search.probes(p, 20)
    cost = [sum((p[j] - c[j] if d < 0 else 1 - (p[j] - np.floor(p[j]))) ** 2 if (d := c[j] - np.floor(p[j])) > 0 else (p[j] - np.floor(p[j])) ** 2 if d < 0 else 0 for j in range(3)) for c in cells]
    assert cost == sorted(cost) and len({tuple(c) for c in cells}) == len(cells)


def test_segment_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(segment_search, "QUERIES", 2)
    monkeypatch.setattr(segment_search, "BLOCK_BYTES", 300)
    _, df = vectors(spark)
    rows = {r.vec_id: np.floor(256 * np.array(r.embedding)).astype(int) for r in df.where("vec_id < 300 or vec_id in (401, 450)").collect()}
    want = []
    for q in (v for v in rows if v % 50 == 0):
        s = sorted((-int(rows[q] @ x), i) for i, x in rows.items() if i != q and len(x) == len(rows[q]))[:5]
        want += [(q, k, i, -v) for k, (v, i) in enumerate(s, 1)]
    got = segment_search.search(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert segment_search.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in segment_search.search(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (2, -(1 << 63))]


def test_segment_search_counts_repeated_rows_once(spark):
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(size=(40, 8))) / 256
    best = np.argsort(-(x @ x[0]))
    best = [int(i) for i in best if i != 0]
    for scale in (1.0, 1e6):  # in doubles, and beyond their exact range
        rows = [(i, (scale * v).tolist()) for i, v in enumerate(x)] + [(i, (scale * x[i]).tolist()) for i in best[:2] for _ in range(7)]
        rows.append((best[0], (scale * (x[best[0]] + x[0] / 8)).tolist()))  # another vector of the first's id
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
        score = {}
        for r in df.collect():
            a, b = ([int(c) for c in np.floor(256 * np.array(e))] for e in (r.embedding, df.where("vec_id = 0").first().embedding))
            if r.vec_id:
                s = min(max(sum(p * q for p, q in zip(a, b)), -(1 << 63)), (1 << 63) - 1)
                score[r.vec_id] = max(score.get(r.vec_id, s), s)
        want = [(k, i, -s) for k, (s, i) in enumerate(sorted((-s, i) for i, s in score.items())[:5], 1)]
        got = segment_search.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
        assert [(r["rank"], r.vec_id, r.score) for r in got] == want


def test_searches_with_repeated_ids_agree_whatever_the_order(spark):
    """An id stands for all its rows; both searches against brute force, rows shuffled."""
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(size=8).round(2).tolist()) for i in [*range(30), 0, 0, 3, 3, 3, 7, 50]] + [(None, [1.0] * 8)]
    cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    whole = lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b))
    for module, score, digits in ((lsh_search, cosine, 9), (segment_search, whole, 0)):
        seen = None
        for turn in range(3):
            df = spark.createDataFrame(rows if turn < 1 else [rows[k] for k in rng.permutation(len(rows))], "vec_id long, embedding array<float>")
            got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, digits)) for r in module.search(df, F.col("vec_id") % 50 == 0).collect())
            assert seen is None or got == seen
            seen = got
        vectors = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect() if r.vec_id is not None]
        want = []
        for q in (0, 50):
            best = {}
            for i, a in vectors:
                for j, b in vectors:
                    if i == q != j:
                        best[j] = max(best.get(j, -np.inf), score(a, b))
            want += [(q, k, j, round(s, digits)) for k, (s, j) in enumerate(sorted((-s, j) for j, s in best.items())[:5], 1) for s in [-s]]
        assert seen == want


@pytest.mark.parametrize(("own", "other"), [(8, 1), (1, 9), (12, 12), (300, 200)])
def test_lsh_search_finds_ids_among_many_rows_of_one(spark, monkeypatch, own, other):
    """All rows share each bucket, so that what is found is what brute force finds: an id with many rows takes one place, its own rows none."""
    rng = np.random.default_rng(10)
    near = lambda n: np.round(np.array([1.0] * 6) + rng.normal(size=(n, 6)) * 0.05, 3).tolist()
    rows = [(0, v) for v in near(own)] + [(1, v) for v in near(other)] + [(i, v) for i in range(2, 9) for v in near(3)] + [(100 + i, near(1)[0]) for i in range(4)]
    rows += [(i, rows[0][1]) for i in range(200, 215)]  # one vector of many ids
    df = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "vec_id long, embedding array<double>")
    for cell in (lsh_search.CELL, 50):
        monkeypatch.setattr(lsh_search, "CELL", cell)
        got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in lsh_search.search(df, F.col("vec_id") % 100 == 0, width=1e6).collect())
        want = []
        for q in {i for i, _ in rows if i % 100 == 0}:
            best = {}
            for i, a in rows:
                for j, b in rows if i == q else ():
                    if j != q:
                        best[j] = max(best.get(j, -np.inf), float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)))
            want += [(q, k, j, round(-s, 9)) for k, (s, j) in enumerate(sorted((-round(s, 12), j) for j, s in best.items())[:5], 1)]
        assert got == sorted(want)


def test_segment_bound_holds():
    rng = np.random.default_rng(5)
    a, b = np.floor(256 * rng.normal(size=(50, 33))), np.floor(256 * rng.normal(size=(60, 33)))
    bounds = [segment_search.statistics(a, s) @ segment_search.statistics(b, s).T for s in segment_search.LEVELS]
    assert all((x >= a @ b.T - 1e-6).all() for x in bounds)
    assert (bounds[0] >= bounds[1] - 1e-6).mean() > 0.99


# 6

def test_url_rules(spark):
    rules = spark.createDataFrame([*URL_RULES, ("example.org", "/es/", "block"), (None, "/", "block"), ("x", None, None)], "host string, path string, verdict string")
    urls = ["http://Sub.Example.ORG/es/1?q", "https://example.org/en/17", "https://example.org/en/2", "a://com/de/x#y", "a://b.com/fr/", "a://notcom/de/", "a://org", "no scheme", None, "a://x.org?/es/", "a://example.org/es", "a://example.org/es/"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(0, urls[0], "x", "y")], "page_id long, url string, host string, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules).collect() if r.page_id != 8)
    assert got[0] == got[1] == (0, "sub.example.org", "/es/1", "example.org/es/", "block")
    assert [g[3:] for g in got[2:]] == [("example.org/en/1", "block"), ("org/", "allow"), ("com/de/", "block"), ("com/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"), ("example.org/es/", "block")]
    for digits in (1, 0):  # keys so short that most rules clash: the digest tells them apart
        assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules, short=digits).collect() if r.page_id != 8) == got
    plan = url_filter.judge(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join[^\n]*v_digest", plan) and re.search(r"Join[^\n]*v_short", plan)
    assert url_filter.judge(df.limit(0), rules).count() == 0 and url_filter.judge(df, rules.limit(0)).where("verdict = 'allow'").count() == len(urls) + 1


# 7

def near_rows(n=260):
    rng = random.Random(5)
    base, tail = [rng.choice(V) for _ in range(60)], [rng.choice(V) for _ in range(9)]

    def changed(b, k):
        b = list(b)
        for _ in range(k):
            b[rng.randrange(len(b))] = rng.choice(V)
        return b

    rows = [(i, " ".join(changed(base, rng.choice([0, 0, 1, 1, 2, 2, 3])))) for i in range(n)]
    rows += [(i, " ".join(changed(base[:52] + tail, rng.choice([0, 1, 2])))) for i in range(n, n + 80)]
    rows += [(i, " ".join(rng.choice(V) for _ in range(rng.choice([0, 1, 3, 4, 5, 8, 30])))) for i in range(n + 80, n + 180)]
    return rows + [(1600, None), (1601, ""), (1602, "A b"), (1603, "a B"), (1604, rows[n + 5][1] + " x")]


def groups_by_force(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(a), find(i)) for i, a in sets.items())


@pytest.mark.parametrize("n, percent, short, pivots", [(4, 85, 8, 0), (4, 85, 1, 2), (5, 80, 64, 2)])
def test_jaccard_join_by_force(spark, monkeypatch, n, percent, short, pivots):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    monkeypatch.setattr(jaccard_join, "BUCKET", 64)
    monkeypatch.setattr(jaccard_join, "FEW_BLOCKS", 0)
    rows = near_rows()
    got = jaccard_join.similar(docs(spark, rows), words=n, percent=percent).collect()
    assert sorted(tuple(r) for r in got) == groups_by_force(rows, n, percent)


def test_jaccard_edges(spark):
    got = jaccard_join.similar(docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and all(r.component_id == r.doc_id for r in got if r.doc_id is not None)
    assert jaccard_join.similar(docs(spark, EDGES).limit(0)).count() == 0
    kept = jaccard_join.one_of_each(docs(spark, [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, ""), (4, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_one_of_each_decides_by_row(spark):
    a, b, c, d = ("a b c d e f g h", "i j k l m n o p", "q r s t u v w x", "1 2 3 4 5 6 7 8")
    rows = [(1, a), (1, a), (2, a), (None, a), (2, b), (None, c), (None, c), (7, d), (8, d), (9, ""), (9, ""), (None, None)]
    kept = jaccard_join.one_of_each(docs(spark, rows))
    want = [(1, a), (2, b), (None, c), (7, d), (9, ""), (9, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert kept.columns == docs(spark, rows).columns
    clash = docs(spark, rows).toDF("doc_id", "text", "w_row", "w_named", "r", "c", "place").withColumns({n: F.lit(1) for n in ("w_nth", "i", "g", "copies", "id", "t_id", "n", "component_id")})
    again = jaccard_join.one_of_each(clash)
    assert again.columns == clash.columns and again.count() == len(want) and {r.w_row for r in again.collect()} == {"en"}
    for f in (line_dedup.dedup_lines, lambda d: curriculum.mixed_documents(d.withColumn("source", F.lit("s")))):
        other = docs(spark, rows).toDF("doc_id", "text", "l_id", "l_of", "l_version", "m_version", "m_v").withColumns({n: F.lit(1) for n in ("l_gone", "m_check", "m_position", "m_c", "m_r", "id", "pos", "version", "check", "key", "bucket", "repeats", "size", "taken")})
        assert set(other.columns) <= set(f(other).columns) and f(other).count() >= 0


def test_trie_finds_what_a_scan_finds(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 120, 90).astype(np.uint64)) for _ in range(60)]
    sets += [sets[0], sets[1][:40], sets[1][:-1], np.array([7], np.uint64), np.unique(rng.integers(200, 900, 300).astype(np.uint64))]
    sets += [np.append(sets[2][:50], rng.integers(200, 300, 5)).astype(np.uint64) for _ in range(9)]
    sets = [np.unique(s) for s in sets]
    probes = [*sets[:10], *sets[-16:]]
    overlap = {(k, j): len(np.intersect1d(p, s)) for k, s in enumerate(sets) for j, p in enumerate(probes)}
    for step in (3, 64):
        monkeypatch.setattr(jaccard_join, "STEP", step)
        for percent in (40, 85, 100):
            want = sorted((k, j, n) for (k, j), n in overlap.items() if 100 * n >= percent * (len(sets[k]) + len(probes[j]) - n))
            assert sorted(jaccard_join.Trie(sets).join(probes, percent)) == want
    assert list(jaccard_join.Trie([]).join(probes, 85)) == list(jaccard_join.Trie(sets).join([], 85)) == []


def test_trie_skips_subtrees(monkeypatch):
    """A thousand sets below one node that no probe can follow cost one look at that node."""
    looks = []
    hits = jaccard_join.Probes.hits
    monkeypatch.setattr(jaccard_join.Probes, "hits", lambda self, nodes: looks.append(len(nodes)) or hits(self, nodes))
    common = np.arange(50, dtype=np.uint64)
    sets = [np.append(common, np.array([100 + 2 * k, 101 + 2 * k], np.uint64)) for k in range(1000)]
    assert list(jaccard_join.Trie(sets).join([np.arange(5000, 5050, dtype=np.uint64)], 85)) == [] and looks == [50]


def test_names_that_clash_are_replaced(spark):
    """With names of four bits most clash, and all still find their other half."""
    rows = near_rows(40)
    assert sorted(tuple(r) for r in jaccard_join.similar(docs(spark, rows), name_bits=4).collect()) == groups_by_force(rows, 4, 85)


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 5)
    links = spark.createDataFrame([(7, i) for i in range(20, 60)] + [(59, 3), (100, 101)], "a long, b long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {i: 3 for i in [3, 7, *range(20, 60)]} | {100: 100, 101: 100}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90}


# 8

def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)

    def make(bad):
        w = [rng.choice(V) for _ in range(60)]
        for _ in range(3 * bad):
            w.insert(rng.randrange(60), rng.choice(["idiot", "grumwort", "grumling", "m0ron"]))
        return " ".join(w)

    rows = [(i, make(i % 4 == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i, _ in rows] + [(0, 0, None)], "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs(spark, rows), labels, ~held)
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, rows), model).collect()}
    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in out]) > 0.95
    edges = toxicity.score(docs(spark, EDGES), model, cols=["doc_id"]).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score <= 1 for r in edges)
    assert all(r.score < 0.5 for r in edges if r.doc_id in (0, 1, 2))
    clash = toxicity.score(docs(spark, EDGES).withColumn("w_text", F.lit("mine")), model)
    assert {r.w_text for r in clash.collect()} == {"mine"} and toxicity.score(docs(spark, EDGES).limit(0), model).count() == 0
    none = toxicity.fit(docs(spark, rows), labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs(spark, EDGES), none).collect()} == {0.5}


def test_toxicity_learns_from_whole_texts(spark):
    rng = random.Random(18)
    make = lambda bad: " ".join(rng.choice(V) for _ in range(2600)) + (" grumwort" * 40 if bad else "")
    rows = [(i, make(i % 3 == 0)) for i in range(150)]
    assert all("grumwort" not in t[:10_000] for _, t in rows)
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    df = docs(spark, rows + rows[:20])  # repeated rows count once
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.fit(df, labels, F.col("doc_id") < 100)).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(100, 150))


def described_by_force(text, words, stems):
    """The features of one text, word by word; words and stems: weights by word and by the first bytes of a word."""
    own = WORD.findall(text)
    lower = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    core = lambda w: re.sub(r"^[\x21-\x40\x5b-\x60\x7b-\x7f]+|[\x21-\x40\x5b-\x60\x7b-\x7f]+$", "", w)
    cores = [lower(core(w)) for w in own]
    begins = lambda c: max([stems.get(c.encode()[:n], 0) for n in toxicity.STEMS if len(c.encode()) >= n], default=0)
    hit, stem = [words.get(c, 0) for c in cores], [begins(c) for c in cores]
    you = [c in toxicity.SECOND_PERSON for c in cores]
    either = [bool(h or s) for h, s in zip(hit, stem)]
    near = [e and any(you[max(0, k - toxicity.NEAR) : k + toxicity.NEAR + 1]) for k, e in enumerate(either)]
    alpha = lambda w: [b for b in w.encode() if chr(b).isascii() and chr(b).isalpha() or b >= 128]
    signs = lambda w: [b for b in w.encode() if chr(b) in "0123456789@$*#%&+|!"]
    upper = lambda w: re.findall("[A-Z]", w)
    mixed = [bool(alpha(w) and signs(w)) for w in own]
    leet = str.maketrans("01345789@$!|", "oieastbgasil")
    hidden = [m and not h and words.get(lower(w).translate(leet), 0) > 0 for m, h, w in zip(mixed, hit, own)]
    drawn = [any(a == b == c and (a >= 128 or chr(a).isalpha()) for a, b, c in zip(w.encode(), w.encode()[1:], w.encode()[2:])) for w in own]
    n, size, letters = max(len(own), 1), max(len(text.encode()), 1), max(len(alpha(text)), 1)
    punct = len([b for b in text.encode() if 33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127])
    return [np.log1p(len(own)), sum(h > 0 for h in hit) / n, sum(h > 0 for h in hit), sum(either) / n, sum(either), sum(hit + stem) / n, sum(near) / max(sum(either), 1), sum(you) / n,
            len(upper(text)) / letters, sum(len(alpha(w)) == len(upper(w)) > 1 for w in own) / n, text.count("!") / size, text.count("?") / size, punct / size, sum(mixed) / n, sum(drawn) / n, sum(hidden) / n]


TOXIC_TEXTS = ["You IDIOT, you m0ron!! Sooo dumm?", "grumwort is here. grumling GRUM", "", "  ", "clean words only, nothing else", "d1rne x1 $tupid é3é ÉÉÉ", "idiot " * 3 + "a b c d e f you", "you " * 2 + "a " * 9 + "moron"]


def test_toxicity_features_by_force():
    words = {"idiot": 2.5, "moron": 3.0, "stupid": 3.0, "grumwort": 2.2}
    stems = {b"grum": 2.6, b"idio": 2.7, b"grumw": 2.9}
    by_hash = lambda keys: toxicity._hash_words(tuple(keys))
    lex = toxicity.Lexicons(toxicity.Lexicon(by_hash(words), np.array([*words.values()])), toxicity.Lexicon(by_hash(s.decode() for s in stems), np.array([*stems.values()])))
    got = np.vstack([toxicity.describe(lex, b) for b in blocks(pa.array(TOXIC_TEXTS), 60)])
    assert got.shape[1] == len(toxicity.FEATURES)
    for row, text in zip(got, TOXIC_TEXTS):
        assert np.allclose(row, described_by_force(text, words, stems)), text


def test_boosting_by_force():
    """The first tree against trying every cut of every feature; all trees against a walk node by node."""
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 4, 400), rng.normal(size=400)]).astype(float)
    y = ((x[:, 1] >= 2) ^ (x[:, 0] > 1.0)).astype(float)
    trees = toxicity.boost(x, y)
    p = y.mean()
    g, h = np.full(400, p) - y, np.full(400, p * (1 - p))
    gain = lambda own: g[own].sum() ** 2 / (h[own].sum() + 1)
    best = max(((gain(x[:, f] <= c) + gain(x[:, f] > c), -f, c) for f in range(3) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, toxicity.BINS + 1)[1:-1])) if toxicity.LEAST <= (x[:, f] <= c).sum() <= 400 - toxicity.LEAST), key=lambda b: b[0])
    assert trees.nodes[0][0][0] == -best[1] and abs(trees.nodes[0][1][0] - best[2]) < 1e-12
    for row in x[:20]:
        score = trees.base
        for feature, threshold, leaf in trees.nodes:
            at = 0
            while at < 2**toxicity.DEPTH - 1:
                at = 2 * at + (2 if row[feature[at]] > threshold[at] else 1)
            score += leaf[at - 2**toxicity.DEPTH + 1]
        assert abs(trees.raw(row[None])[0] - score) < 1e-12
    raw = trees.raw(x)
    assert np.mean((raw > 0) == (y > 0.5)) > 0.97


@pytest.mark.parametrize("labels", [None, [0, 1] + [0] * 99 + [1] * 100, [1] * 3 + [0] * 50 + [1] + [0, 1] * 20, [0] * 30, [1] * 30, [1, 0] * 40])
def test_isotonic_by_force(labels):
    """The rising values nearest to the labels are max over a <= i of min over b >= i of the mean of labels a to b: from the definition, on pools of unequal size too."""
    rng = np.random.default_rng(12)
    y = (rng.random(40) < np.linspace(0.1, 0.9, 40)).astype(float) if labels is None else np.array(labels, float)
    raw, n = np.sort(rng.normal(size=len(y))), len(y)
    x, v = toxicity.isotonic(raw, y)
    sums = np.concatenate(([0], np.cumsum(y)))
    want = [max(min((sums[b + 1] - sums[a]) / (b + 1 - a) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    assert (np.diff(x) > 0).all() and (np.diff(v) > 0).all()
    runs = np.split(np.arange(n), np.flatnonzero(np.diff(want) > 1e-12) + 1)
    assert len(runs) == len(x)
    for r, place, value in zip(runs, x, v):
        assert abs(place - raw[r].mean()) < 1e-9 and abs(value - want[r[0]]) < 1e-9


def test_toxicity_query_by_force(spark, tmp_path):
    """The registered query's scores from plain features, a walk through the trees, and straight lines between the calibration's points."""
    rng = random.Random(16)
    make = lambda bad: " ".join([*rng.choices(V, k=30), *(["grumwort", "you", "idiot"] if bad else [])])
    rows = [(i, make(i % 3 == 0)) for i in range(240)] + [(300, None), (301, ""), (302, "You IDIOT!")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, str(tmp_path)).collect()}
    kept = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), kept)
    assert len(got) == len(rows)
    weight = lambda lexicon, key: float(lexicon.weigh(toxicity._hash_words((key,)))[0]) if key else 0.0

    class Weights(dict):
        def __init__(self, lexicon):
            self.lexicon = lexicon

        def get(self, key, default=0):
            return weight(self.lexicon, key.decode("utf-8", "ignore") if isinstance(key, bytes) else key) or default

    low, high = model.knots[1][0], model.knots[1][-1]
    for i, text in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == int(got[i].score >= 0.5)
        if not (text or "").strip():
            assert abs(got[i].score - low) < 1e-9
            continue
        raw = model.trees.raw(np.array([described_by_force(text, Weights(model.lexicons.words), Weights(model.lexicons.stems))]))[0]
        assert abs(got[i].score - min(max(np.interp(raw, *model.knots), low, 0), high, 1)) < 1e-9


def test_isotonic_rises():
    x, y = toxicity.isotonic(np.array([3.0, 1, 2, 4, 5]), np.array([0.0, 0, 1, 1, 1]))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


# 2, 7: long words, ids with several texts

def test_long_words_merge_alike(monkeypatch):
    """Words of thousands of bytes in typed arrays: the same ids as the short way and the library give."""
    import public_tokenizers
    import tokenizers
    from velora.llm.queries import TOKENIZER

    path = public_tokenizers.path(TOKENIZER)
    codec, library, rng = bpe.Codec(path), tokenizers.Tokenizer.from_file(path), random.Random(17)
    made = lambda letters, k: "".join(rng.choices(letters, k=k))
    texts = [made("abcdefghijklmnopqrstuvwxyz", 20_000), "a" * 9_999, "ab" * 6_000, made("etaoin", 30_000), made("0123456789", 5_000), made("é日本ß", 4_000), made("=-_", 8_000), made(["ing", "the", "tion", "s"], 9_000)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.merge(text.encode()) == want
        with monkeypatch.context() as m:
            m.setattr(bpe, "LONG_PIECE", 1 << 60)
            assert codec.merge(text.encode()) == want
    for k in range(60):
        word = made("abcdeé-", rng.randrange(1, 60)).encode()
        assert codec._merge_long(word) == codec.merge(word)


def test_a_word_of_many_megabytes():
    """5 MB without a space: bounded memory, which grows with the word, and the ids spell it."""
    import resource

    import public_tokenizers
    from velora.llm.queries import TOKENIZER

    codec, rng = bpe.Codec(public_tokenizers.path(TOKENIZER)), np.random.default_rng(18)
    word = rng.choice(np.frombuffer(b"etaoinshrdlu", np.uint8), 5_000_000).tobytes()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids = codec.merge(word)
    assert b"".join(codec.strings[i] for i in ids) == word
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1e3 < 500  # MB, the ids' list and the check above included


def test_ids_with_several_texts_link_their_groups(spark):
    """An id's texts are one document: what links with either links with it, whichever id is smallest."""
    make = lambda k: " ".join(f"{k}{i}" for i in range(40))
    for rows in ([(3, "A"), (5, "A"), (5, "B"), (7, "B")], [(5, "A"), (5, "B"), (7, "B")], [(5, "A"), (5, "B"), (7, "B"), (2, "C"), (7, "C"), (9, "D"), (None, "D"), (5, "")]):
        got = jaccard_join.similar(docs(spark, [(i, make(t) if t else "") for i, t in rows])).collect()
        low = min(i for i, t in rows if i is not None and t in "ABC" and t)
        want = sorted((i if not t else 9 if t == "D" else low) for i, t in rows)
        assert sorted(r.component_id for r in got) == want


# 9

def test_substring_dedup_by_force(spark):
    rng = random.Random(5)
    passages = [[rng.choice(V) for _ in range(rng.choice([50, 51, 60, 90, 200]))] for _ in range(6)] + [["rep"] * 130, ["a", "b", "c"] * 40]
    rows = []
    for i in range(120):
        w = [rng.choice(V) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p) + 1)))
            w += p[a:b] if rng.random() < 0.5 else p
            w += [rng.choice(V) for _ in range(rng.randrange(30))]
        rows.append((i * 3 % 400, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(2000, None), (2001, ""), (2002, " ".join(passages[0][:49])), (2003, rows[7][1]), (2003, rows[7][1])]
    first, want = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), i), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = substring_dedup.dedup_passages(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert substring_dedup.dedup_passages(docs(spark, EDGES)).count() == len(EDGES)
    assert substring_dedup.dedup_passages(docs(spark, EDGES).limit(0)).count() == 0


def test_substring_dedup_needs_its_automata(spark, monkeypatch):
    """Occurrences come from the automata alone: none found, nothing removed; of many small shards or one, the same."""
    rng = random.Random(15)
    passage = [rng.choice(V) for _ in range(120)]
    rows = [(i, " ".join([rng.choice(V) for _ in range(20)] + passage + [rng.choice(V) for _ in range(i)])) for i in range(8)]
    removed = lambda: sorted((r.doc_id, r.n_removed) for r in substring_dedup.dedup_passages(docs(spark, rows)).collect())
    want = [(0, 0)] + [(i, 120) for i in range(1, 8)]
    assert removed() == want
    for size in (1, 100):
        shards = substring_dedup.Shards([" a b ", " b c ", " c "])
        monkeypatch.setattr(substring_dedup, "SHARD_BYTES", size)
        assert sorted(substring_dedup.Shards([" a b ", " b c ", " c "]).ends(" a b c ")) == sorted(shards.ends(" a b c ")) == [4, 6, 6]
    assert removed() == want
    monkeypatch.setattr(substring_dedup.Shards, "ends", lambda self, text: np.empty(0, np.int64))
    block = next(blocks(pa.array([rows[0][1]])))
    assert not substring_dedup._located(block, [[" ".join(["", *passage[:8], ""])]], 8).any()


def test_bit_map_holds_every_hash(spark, monkeypatch):
    hashes = [0, 1, 2**15 - 1, 2**15, 2**15 + 1, -1, -(2**63), 2**63 - 1, 12345678901234]
    for most in (1 << 15, 1 << 20):
        monkeypatch.setattr(substring_dedup, "MOST_BITS", most)
        monkeypatch.setattr(substring_dedup, "BITS_EACH", 1 << 18)
        bits, size = substring_dedup._bit_map(spark.createDataFrame([(h,) for h in hashes], "p long"))
        assert size == most and {int(p) for p in np.flatnonzero(np.unpackbits(bits, bitorder="little"))} == {h & (size - 1) for h in hashes}


# 10

def test_targets_by_force(spark):
    sizes = {"a": 100, "b": 900, "c": 50, "d": 10, None: 40, "e": 0}
    got = {r.source: r for r in curriculum.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in over} if over else {s: left * weight[s] / total for s in free}
        left -= sum(2 * sizes[s] for s in over)
        free = free - over if over else set()
    assert all(abs(got[s].target - target[s]) < 1e-6 for s in sizes)


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(V, k=rng.randrange(30)))) for i in range(300)] + [(400, None)]
    df = docs(spark, rows)
    got = curriculum.mix(df).collect()
    assert got == curriculum.mix(df.orderBy(F.rand(3))).collect() and len(got) == len(rows)
    source = {i: f"s{i % 3}" if i != 5 else None for i, _ in rows}
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken.setdefault(source[r.doc_id], [0, r.target])[0] += r.taken
    assert all(abs(a - b) <= 1 for a, b in taken.values())
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    copies = curriculum.mixed_documents(df)
    assert copies.columns == df.columns
    n = {r.doc_id: r["count"] for r in copies.groupBy("doc_id").count().collect()}
    assert all(abs(n.get(r.doc_id, 0) * r.size - r.taken) <= r.size / 2 for r in got)
    assert curriculum.mix(df.limit(0)).count() == 0 and curriculum.mix(docs(spark, EDGES)).count() == len(EDGES)


def test_mix_agrees_whatever_the_order_of_rows(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices(V, k=rng.randrange(1, 9))), f"s{i % 2}") for i in range(30)]
    rows += [(3, rows[3][1], "s1")] * 3 + [(3, "another text", "s1"), (None, "no id", "s0"), (None, "no id", "s0"), (None, "nor this", None), (None, None, "s1"), (40, "", None)]
    frame = lambda r: spark.createDataFrame([(i, t, s, 1, "v", 2, 3) for i, t, s in r], "doc_id long, text string, source string, version int, m_id string, m_version int, m_position int")
    made, copies = [], []
    for k in range(4):
        df = frame(rows).repartition(3) if k else frame(rows)
        made.append(sorted(map(repr, curriculum.mix(df).collect())))
        copies.append([tuple(r) for r in curriculum.mixed_documents(df).collect()])
        rng.shuffle(rows)
    assert all(m == made[0] for m in made) and all(sorted(c, key=repr) == sorted(copies[0], key=repr) for c in copies)
    assert len(made[0]) == len(rows) and curriculum.mixed_documents(frame(rows)).columns == frame(rows).columns
    planned = {}
    for r in curriculum.mix(frame(rows)).collect():
        if r.size:
            planned[r.doc_id, r.size] = planned.get((r.doc_id, r.size), 0) + int(r.taken / r.size + 0.5)
    got = {}
    for c in copies[0]:
        at = (c[0], len(WORD.findall(c[1])))
        got[at] = got.get(at, 0) + 1
    assert got == {k: n for k, n in planned.items() if n} and any(c[0] is None for c in copies[0])


def test_mix_query_by_force(spark, tmp_path):
    """Sizes, targets and places of each document by plain arithmetic."""
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choices(V, k=rng.randrange(20))), rng.choice(["a", "b", "c", None])) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op10_curriculum"](spark, str(tmp_path)).collect()}
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    for source in ("a", "b", "c", None):
        own = sorted((i for i, _, s in rows if s == source), key=lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i))
        whole, before = sum(size[i] for i in own), 0
        target = got[own[0]].target
        over = round(target - target // whole * whole)
        for i in own:
            assert (got[i].size, got[i].source_size) == (size[i], whole)
            assert got[i].taken == target // whole * size[i] + max(0, min(size[i], over - before))
            before += size[i]


def test_schedule_is_inverted(spark):
    knots = ((0.0, 2.0), (0.25, 0.5), (1.0, 1.0))
    area = lambda t: sum((min(max(t, a), b) - a) * (u + u + (v - u) / (b - a) * (min(max(t, a), b) - a)) / 2 for (a, u), (b, v) in zip(knots, knots[1:]))
    rows = spark.createDataFrame([(k / 20,) for k in range(21)], "s double").select("s", curriculum.invert(F.col("s"), knots).alias("t")).collect()
    assert all(abs(area(r.t) / area(1.0) - r.s) < 1e-9 for r in rows)


def test_all_ten_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
