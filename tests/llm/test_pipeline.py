"""The pipeline, stage by stage, on a small corpus with known duplicates."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from velora.llm import bpe, crf

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, rank string"


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    parts = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ver", "heit"]}
    make = lambda lang: " ".join("".join(rng.choices(parts[lang], k=4)) for _ in range(30))
    common = "this very line is held by many documents of the corpus"
    rows = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, make(lang) + ("\n" + common if i % 10 == 0 else ""), lang, f"s{i % 2}"))
    rows += [(200, rows[3][1], "aa", "s0"), (201, None, None, None), (202, "", "aa", "s1"), (203, "1 2 3", "aa", "s1"), (204, make("aa"), None, None)]
    df = spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], SHAPE)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = at.collect()
        if name != "encode":
            assert at.columns == df.columns
    ids = {n: {r.doc_id for r in k} for n, k in kept.items()}
    assert ids["language_id"] == {r[0] for r in rows} - {201, 202, 203}
    assert ids["line_dedup"] == ids["language_id"]
    assert [r.doc_id for r in kept["line_dedup"] if common in r.text] == [110]
    assert ids["near_dedup"] == ids["line_dedup"] - {200}
    mixed = {}
    for r in kept["mix_sources"]:
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + 1
    assert set(mixed) <= ids["near_dedup"] and max(mixed.values()) <= 2
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in kept["mix_sources"]}
    assert len(kept["encode"]) == len(kept["mix_sources"])
    for r in kept["encode"]:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, c.encode(text[r.doc_id]))).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, kept["encode"]))


def test_pipeline_by_force(spark, tmp_path):
    """Every stage in plain Python, each on the one before it; then the last rows against run()'s."""
    from tokenizers import Tokenizer

    rng = random.Random(21)
    parts = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ver", "heit"]}
    make = lambda lang, n=30: " ".join("".join(rng.choices(parts[lang], k=4)) for _ in range(n))
    lines = ["a line that a good many documents of this corpus hold", "  Another Line that many documents hold, with spaces  ", "short"]
    rows = []
    for i in range(90):
        lang = rng.choice(["aa", "bb"])
        rows.append([i, "\n".join([make(lang, rng.randrange(5, 40)), *rng.sample(lines, rng.randrange(3))]), lang if i % 7 else None, rng.choice(["s0", "s1", "s2", None])])
    for i in range(20):  # near copies, some of copies
        words = rows[rng.randrange(len(rows))][1].split(" ")
        words[rng.choice([0, -1, -1, rng.randrange(len(words))])] = rng.choice(["kakakaka", words[0]])
        rows.append([100 + i, " ".join(words), "aa", rng.choice(["s0", "s1"])])
    rows += [[200, None, None, None], [201, "", "aa", "s1"], [202, "² ½ 12", "aa", "s1"], [203, "日本語 " * 12, "bb", "s0"]]
    shape = "doc_id long, text string, lang string, source string, n_chars long, version string, p_lang int, l_id int, g_id int, m_id int"
    spark.createDataFrame([(*r, len(r[1] or ""), "v", 1, 2, 3, 4) for r in rows], shape).write.parquet(f"{tmp_path}/documents.parquet")

    # language: posteriors of the fitted field, document by document
    model = crf.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    kept = []
    for i, text, _, source in rows:
        langs, scores = crf.predict(model, pa.array([text], pa.string()))
        if re.search(r"[^\W\d_]", (text or "").replace("²", "").replace("½", "")) and langs[0] != "und" and scores[0] >= corpus_pipeline.LEAST_SHARE:
            kept.append((i, text, source))
    assert {r[0] for r in rows} - {k[0] for k in kept} >= {200, 201, 202} and zlib.crc32(b"1") % 3 in (0, 1, 2)

    # lines
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holds = {}
    for i, text, _ in kept:
        for x in text.split("\n"):
            holds.setdefault(key(x), set()).add(i)
    gone = lambda x, i: len(key(x)) >= 40 and len(holds[key(x)]) >= 5 and i < max(holds[key(x)])
    kept = [(i, "\n".join(x for x in text.split("\n") if not gone(x, i)), source) for i, text, source in kept]

    # near copies: all pairs
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t, _ in kept}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    copies = {i for i in sets if sets[i] and find(i) != i}
    kept = [r for r in kept if r[0] not in copies]
    assert copies

    # the mix: targets by sharing again and again, then each source's own order
    size = {i: len(words(t)) for i, t, _ in kept}
    sources = sorted({s for _, _, s in kept}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    whole = {s: sum(size[i] for i, _, own in kept if own == s) for s in sources}
    target, free, left = {}, set(sources), 1.5 * sum(whole.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * whole[s]}
        target |= {s: 2.0 * whole[s] for s in over} if over else {s: left * weight[s] / total for s in free}
        left -= sum(2 * whole[s] for s in over)
        free = free - over if over else set()
    mixed = []
    for s in sources:
        own = sorted((r for r in kept if r[2] == s), key=lambda r: (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16), r[0]))
        epochs, before = int(target[s] // whole[s]), 0
        rest = round(target[s] - epochs * whole[s])
        for i, text, _ in own:
            taken = epochs * size[i] + max(0, min(size[i], rest - before))
            before += size[i]
            mixed += [(i, text)] * int(np.floor(taken / size[i] + 0.5)) if size[i] else []

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in mixed:
        ids = t.encode(text, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
