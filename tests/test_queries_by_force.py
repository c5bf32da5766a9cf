"""The queries that SQL can't express, over the smallest tables, against plain Python."""

import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from velora.operators import chunking, motion, prompts
from velora.plans import catalog
from velora.plans import corpus_queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


def got(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


def turn_pairs():
    text = {(c, t): x for c, t, x in rows("conversations", "conv_id, turn, text")}
    return [(x.split(), text[c, t + 1].split()) for (c, t), x in text.items() if x is not None and text.get((c, t + 1)) is not None]


def table_of(a, b, cost):
    """A whole table of costs or lengths, cell by cell."""
    out = {(i, 0): (i if cost else 0) for i in range(len(a) + 1)} | {(0, j): (j if cost else 0) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1]
            out[i, j] = min(out[i - 1, j] + 1, out[i, j - 1] + 1, out[i - 1, j - 1] + (not same)) if cost else out[i - 1, j - 1] + 1 if same else max(out[i - 1, j], out[i, j - 1])
    return out[len(a), len(b)]


def test_seq_scores(spark):
    pairs = turn_pairs()
    r = got(spark, "seq_scores")[0]
    f1 = []
    for text, gloss in pairs:
        o = sum(min(gloss.count(w), text.count(w)) for w in set(gloss))
        f1.append(2 * o / (len(gloss) + len(text)) if o else 0.0)
    lcs = [table_of(gloss, text, False) for text, gloss in pairs]
    assert abs(r.wer - sum(table_of(g, t, True) for t, g in pairs) / sum(len(t) for t, _ in pairs)) < 1e-4
    assert abs(r.token_f1 - np.mean(f1)) < 1e-4 and abs(r.exact_match - np.mean([t == g for t, g in pairs])) < 1e-4
    assert abs(r.rouge_l - np.mean([2 * n / (len(t) + len(g)) for n, (t, g) in zip(lcs, pairs)])) < 1e-4
    assert abs(r.pred_len - np.mean([len(g) for _, g in pairs])) < 1e-4 and abs(r.ref_len - np.mean([len(t) for t, _ in pairs])) < 1e-4


def vectors():
    return {i: (np.array(v, float), label) for i, v, label in rows("embeddings", "vec_id, embedding, label") if v is not None}


def test_fid(spark):
    a, b = (np.array([v for v, label in vectors().values() if (label >= 5) == high]) for high in (False, True))
    ca, cb, d = np.cov(a.T), np.cov(b.T), a.mean(0) - b.mean(0)
    w, u = np.linalg.eigh(ca)
    half = u @ np.diag(np.sqrt(np.maximum(w, 0))) @ u.T  # the root of a product as that of a symmetric matrix
    root = np.sqrt(np.maximum(np.linalg.eigvalsh(half @ cb @ half), 0)).sum()
    assert abs(got(spark, "fid")[0].fid - (d @ d + np.trace(ca) + np.trace(cb) - 2 * root)) < 1e-4


def test_pa_mpjpe(spark):
    v, errors = vectors(), {}
    for i, (p, label) in v.items():
        if i + 1 in v:
            a, b = p[:63].reshape(-1, 3), v[i + 1][0][:63].reshape(-1, 3)
            x, y = a - a.mean(0), b - b.mean(0)
            u, s, vt = np.linalg.svd(x.T @ y)
            flip = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
            fit = x @ (u @ flip @ vt) * (s * np.diag(flip)).sum() / (x**2).sum() + b.mean(0)
            errors.setdefault(label, []).append(1000 * np.linalg.norm(fit - b, axis=1).mean())
    assert {r.label: (r.frames, r.pa_mpjpe) for r in got(spark, "pa_mpjpe")} == {k: (len(e), pytest.approx(np.mean(e), abs=1e-3)) for k, e in errors.items()}


def test_rotations_come_back(spark):
    assert all(0 <= x < 1e-5 for x in got(spark, "rotation_round_trip")[0])


def test_page_clean_and_chunks(spark):
    """Lines of documents as pages of one line each."""
    want, chars = {}, {}
    for i, text in rows("documents", "doc_id, text"):
        if text is not None:
            lines = [re.sub(r"[ \t]+", " ", x.strip()) for x in text.split("\n")]
            kept = ["" if re.fullmatch(r"\d{1,3}", x) or re.match(r"\d{1,3}\)\s", x) or "···" in x else x for x in lines]
            assert not any(re.fullmatch(r"한국수어|문법|제.*", x) for x in lines)
            want[i] = (len(lines), sum(map(len, kept)))
            chars[i] = kept
    assert {r.doc_id: (r.pages, r.chars) for r in got(spark, "page_clean")} == want
    numbers = [r for r in got(spark, "chunks")]
    assert sorted(r.chunk for r in numbers) == [f"g{k:05d}" for k in range(len(numbers))]
    by = sorted(numbers, key=lambda r: r.chunk)
    assert [(r.doc_id, r.page) for r in by] == sorted((r.doc_id, r.page) for r in by)
    heading = lambda x: len(x) < 40 and re.match(r"\s*(\d+(?:\.\d+)*\.?)\s+(\S.*)$", x)
    sizes = {}
    for i, kept in chars.items():
        for page, line in enumerate(kept, 1):
            for c in chunking.merged([line]) if len(line) >= 40 and not heading(line) else []:
                if len(c) >= 80:
                    sizes.setdefault((i, page), []).append(len(c))
    found = {}
    for r in by:
        found.setdefault((r.doc_id, r.page), []).append(r.n_chars)
    assert found == sizes


def test_chunk_merge(spark):
    """Nothing is lost, and only what has no sentence end is longer than allowed."""
    for r in got(spark, "chunk_merge"):
        text = dict(rows("documents", "doc_id, text"))[r.doc_id]
        made = chunking.merged(text.split("\n"))
        assert (r.chunks, pytest.approx(r.mean_chars)) == (len(made), np.mean([len(c) for c in made]))
        assert re.sub(r"\s", "", "".join(made)) == re.sub(r"\s", "", text)
        longest = [max(len(x) for x in chunking.SENTENCE_END.split(c) if x) for c in made]
        assert all(len(c) <= max(chunking.MAX_CHARS, n + chunking.MIN_CHARS) + 1 for c, n in zip(made, longest))


def test_lexicon_lookup_query(spark):
    lex = {}
    for r in got(spark, "lexicon_best"):
        lex[r.stem] = r.gloss
    want = {}
    for i, text in rows("benchmark", "item_id, text"):
        plain = re.sub(r"[\[\]{}()<>]", "", text)
        free, hits = [True] * len(plain), []
        for stem in sorted(lex, key=lambda s: (-len(s), s)):
            at = next((m.start() for m in re.finditer(f"(?={re.escape(stem)})", plain) if all(free[m.start() : m.start() + len(stem)])), None)
            if at is not None and len(hits) < 24:
                free[at : at + len(stem)] = [False] * len(stem)
                hits.append((at, f"{stem}={lex[stem]}"))
        if hits:
            want[i] = [h for _, h in sorted(hits)[:12]]
    assert {r.item_id: r.hints for r in got(spark, "lexicon_lookup")} == want


def test_template_fill(spark):
    seen = {"t2m": 0, "len": 0, "pred": 0, "mask": 0}
    codes = {r.id: r.s for r in got(spark, "token_string_roundtrip")}
    for r in got(spark, "template_fill"):
        marks = re.findall(r"<[^>]*>", codes[r.id])
        n = len(marks) - 2
        if r.task == "t2m":
            assert (r.input, r.output) == (f"Generate motion: order {r.id}", codes[r.id])
        if r.task == "len":
            assert r.input == f"Motion of {4 * n} frames, {4 * n // 20}.0 seconds"
        if r.task == "pred":
            k = int(n * 0.2 + 1)
            assert r.input == "Continue: " + "".join(marks[:k]) + "<motion_id_513>" and r.output == "<motion_id_512>" + "".join(marks[k:])
        if r.task == "mask":
            a, b = int(n * 0.25 + 1), int(n * 0.75 + 1)
            assert r.input == "Complete: " + "".join(marks[:a]) + "<motion_id_514>" * (b - a) + "".join(marks[b:])
        seen[r.task] += 1
    assert all(seen.values())


def test_prompts(spark):
    """Every mode from its parts, and the registered query from the others' results."""
    q = spark.createDataFrame([(1, " 왜 안 가니? "), (2, "b")], "id int, text string")
    hints = spark.createDataFrame([(1, ["가=GO", "나=ME"]), (3, ["x=X"])], "id int, hints array<string>")
    ex = spark.createDataFrame([(1, 2, "t2", "g2"), (1, 1, "t1", "g1")], "q int, rank int, text string, gloss string")
    sn = spark.createDataFrame([(1, 1, "a \n b" + "c" * 300, "S", "H"), (2, 1, "body", "", "H"), (2, 2, "more", None, None)], "q int, rank int, text string, section string, heading string")
    parts = {"lexicon": " [lex] 가=GO 나=ME", "example": " [ex] t1 => g1 ;; t2 => g2", "features": " [feat] 부정 의문", "grammar": " [gram] (S) a b" + "c" * 217}
    for mode, used in prompts.MODES.items():
        made = {r.id: r.prompt for r in prompts.assembled(q, "id", "text", mode, hints, ex, sn).collect()}
        assert made[1] == "translate: 왜 안 가니?" + "".join(parts[p] for p in used)
        assert made[2] == "translate: b" + (" [gram] (H) body more" if "grammar" in used else "")
    one = spark.createDataFrame([("갈까? 못",)], "t string")
    assert one.select(*[prompts.grammar_query(F.col("t"), m) for m in ("surface", "feature", "hybrid")]).first()[2].endswith(" 갈까? 못")
    asked = {r.id: r.text for r in Q._asked(spark, SF).collect()}
    lex = {r.id: r.hints for r in Q.lexicon.lookup(Q._asked(spark, SF), Q.lexicon_build(spark, SF), "id", "text").collect()}
    assert {r.id for r in got(spark, "context_assembly")} == set(asked)
    for r in got(spark, "context_assembly"):
        assert r.prompt.startswith("translate: " + asked[r.id].strip()) and (" [lex] " + " ".join(lex[r.id]) in r.prompt if lex.get(r.id) else " [lex] " not in r.prompt)
    for r in got(spark, "prompt_grammar"):
        assert r.prompt.startswith("translate: " + asked[r.id].strip())


def test_inverse_kinematics(spark):
    """Turning the offsets by the found rotations gives the joints back."""
    rng = np.random.default_rng(1)
    chains = [[0, 1, 2], [0, 3, 4], [0, 5]]
    offsets = np.array([[0, 0, 0], [1, 0, 0], [0, -1, 0], [-1, 0, 0], [0, -1, 0], [0, 1, 0]], float)
    length = np.array([0, 0.4, 1.0, 0.4, 1.2, 0.7])
    joints = np.zeros((5, 6, 3))
    for f in range(5):
        joints[f, 0] = rng.normal(size=3)
        for chain in chains:
            for a, b in zip(chain, chain[1:]):
                u = rng.normal(size=3)
                joints[f, b] = joints[f, a] + length[b] * u / np.linalg.norm(u)
    body = motion.Body(left_hip=1, right_hip=3, left_shoulder=2, right_shoulder=4, feet=(2, 4))
    df = spark.createDataFrame([("c", f, p.ravel().tolist()) for f, p in enumerate(joints)], "clip string, frame int, pose array<double>")
    made = motion.inverse_kinematics(df, offsets.tolist(), chains, body=body).orderBy("frame").collect()
    q = np.array([r.rotations for r in made]).reshape(5, 6, 4)
    assert np.allclose(q[0, 0], [1, 0, 0, 0])
    w, x, y, z = np.moveaxis(q, -1, 0)
    turn = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], -1).reshape(5, 6, 3, 3)
    assert np.allclose(motion.forward_kinematics(turn, offsets * length[:, None], joints[:, 0], chains), joints)
    across = joints[:, 3] - joints[:, 1] + joints[:, 4] - joints[:, 2]
    ahead = np.cross([0, 1, 0], across)
    ahead[:, 1] = 0
    faced = np.einsum("fij,fj->fi", turn[1:, 0], ahead[1:] / np.linalg.norm(ahead[1:], axis=1, keepdims=True))
    assert np.allclose(faced, [[0, 0, 1]] * 4)


def test_context_assembly_meets_written_parts(spark):
    """The driver holds no plan of hints and examples together: what is left to plan is the texts' joins with both."""
    plan = catalog.QUERIES["context_assembly"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2
    assert "Window" not in plan and "Generate" not in plan and "Aggregate" not in plan
