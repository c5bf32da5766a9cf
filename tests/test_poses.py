"""Operators on poses, rotations, ranges and scores against plain versions."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from velora.functions import geometry as G
from velora.functions import text as T
from velora.operators import corpus, metrics, motion, retrieval, sequence
from velora.plans import pose_queries as P

AXES = {"X": 0, "Y": 1, "Z": 2}


def about(axis, angle):
    c, s = math.cos(angle), math.sin(angle)
    i, j = [k for k in range(3) if k != AXES[axis]]
    m = np.eye(3)
    m[i, i] = m[j, j] = c
    m[i, j], m[j, i] = (-s, s) if axis != "Y" else (s, -s)
    return m


ORDERS = ["".join(o) for o in itertools.product("XYZ", repeat=3) if o[1] not in (o[0], o[2])]


def test_angles_of_all_orders_come_back(spark):
    """The angles give the rotation again, within their ranges, and are the ones put in where these are in range; in gimbal lock too."""
    rng = np.random.default_rng(1)
    rows = [rng.uniform(-3.1, 3.1, 3).tolist() for _ in range(30)] + [[0.3, b, -0.7] for b in (0.0, math.pi / 2, -math.pi / 2, math.pi)] + [[0.0, 0.0, 0.0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<double>")
    assert len(ORDERS) == 12
    for order in ORDERS:
        df = df.withColumn(order, G.matrix_to_euler(G.euler_to_matrix(F.col("a"), order), order))
    for r in df.collect():
        for order in ORDERS:
            make = lambda angles, order=order: about(order[0], angles[0]) @ about(order[1], angles[1]) @ about(order[2], angles[2])
            got, wide = r[order], order[0] == order[2]
            assert np.allclose(make(got), make(rows[r.i]), atol=1e-7)
            low, high = (0, math.pi) if wide else (-math.pi / 2, math.pi / 2)
            assert low - 1e-9 <= got[1] <= high + 1e-9
            if r.i < 30 and low < rows[r.i][1] < high:
                assert np.allclose(got, rows[r.i], atol=1e-6)


def test_wrong_orders_are_refused():
    for order in ("XX", "XXY", "XYA", "YZZ", ""):
        with pytest.raises(ValueError):
            G.matrix_to_euler(F.col("m"), order)


def test_small_rotations_keep_their_digits(spark):
    for size in (0.0, 1e-12, 1e-7, 1e-3, 1.0, 3.0):
        v = [size * x for x in (0.6, 0.0, 0.8)]
        got = spark.range(1).select(G.q_to_axis_angle(G.axis_angle_to_q(F.array(*[F.lit(x) for x in v])))).first()[0]
        assert np.allclose(got, v, rtol=1e-9, atol=1e-16)


def q_mul(a, b):
    w, x = a[0], np.array(a[1:])
    v, y = b[0], np.array(b[1:])
    return np.array([w * v - x @ y, *(w * y + v * x + np.cross(x, y))])


def q_turn(q, v):
    return q_mul(q_mul(q, [0, *v]), q * [1, -1, -1, -1])[1:]


def q_between(a, b):
    q = np.array([np.linalg.norm(a) * np.linalg.norm(b) + np.dot(a, b), *np.cross(a, b)])
    return q / np.linalg.norm(q)


def test_retargeting_by_force(spark):
    rng = np.random.default_rng(2)
    clips = {c: rng.normal(size=(5, 8, 3)) + np.array(P.OFFSETS)[None] for c in "ab"}
    rows = [(c, f, p.ravel().tolist()) for c, x in clips.items() for f, p in enumerate(x)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "clip string, frame int, pose array<float>")
    got = {(r.clip, r.frame): np.array(r.pose).reshape(8, 3) for r in motion.retargeted(df, P.DIRECTIONS, P.OFFSETS, P.CHAINS, P.LEG, body=P.BODY).collect()}
    assert len(got) == 10
    up = {b: a for c in P.CHAINS for a, b in zip(c, c[1:])}
    for c, x in clips.items():
        x = x.astype(np.float32).astype(float)
        long = lambda k: np.linalg.norm(x[0, k] - x[0, up[k]])
        ratio = sum(np.abs(P.OFFSETS[k]).max() for k in P.LEG) / sum(long(k) for k in P.LEG)
        for f, pose in enumerate(x):
            across = pose[3] - pose[1] + pose[7] - pose[6]
            ahead = np.cross([0, 1, 0], across * [1, 0, 1])
            root = np.array([1.0, 0, 0, 0]) if f == 0 else q_between(ahead, np.array([0.0, 0, 1]))
            want = np.zeros((8, 3))
            want[0] = pose[0] * ratio
            for chain in P.CHAINS:
                turn = root
                for a, b in zip(chain, chain[1:]):
                    own = q_mul(turn * [1, -1, -1, -1], q_between(np.array(P.DIRECTIONS[b], float), pose[b] - pose[a]))
                    turn = q_mul(turn, own)
                    want[b] = want[a] + q_turn(turn, P.OFFSETS[b])
            assert np.allclose(got[c, f], want, atol=1e-6)


def test_forward_kinematics_undoes_inverse(spark):
    """On its own skeleton a body comes back as it was."""
    rng = np.random.default_rng(4)
    pose = np.array(P.OFFSETS, float)
    rows = []
    for f in range(4):
        at = np.zeros((8, 3))
        at[0] = rng.normal(size=3)
        for chain in P.CHAINS:
            for a, b in zip(chain, chain[1:]):
                d = rng.normal(size=3)
                at[b] = at[a] + d / np.linalg.norm(d) * np.linalg.norm(pose[b])
        rows.append((0, f, at.ravel().tolist()))
    df = spark.createDataFrame(rows, "clip int, frame int, pose array<double>")
    same = motion.retargeted(df, P.DIRECTIONS, P.OFFSETS, P.CHAINS, P.LEG, body=P.BODY)
    for r in same.join(df.withColumnRenamed("pose", "own"), ["clip", "frame"]).collect():
        assert np.allclose(r.pose, r.own, atol=1e-6)


@pytest.mark.parametrize("kind", ["axis_angle", "quaternion", "six", "matrix"])
def test_canonical_turns_come_back(spark, kind):
    rng = np.random.default_rng(5)
    width = G.WIDTHS[kind]
    rows = [(c, f, rng.normal(size=3).tolist(), rng.normal(size=6).tolist()) for c in "abc" for f in range(4)]
    df = spark.createDataFrame(rows, "clip string, frame int, place array<double>, v array<double>")
    rotation = lambda k: G.matrix_to(kind, G.to_matrix("axis_angle", F.slice("v", 3 * k + 1, 3)))
    df = df.withColumn("rotations", F.concat(rotation(0), rotation(1))).drop("v")
    turned = motion.canonical_turn(df, kind=kind)
    back = motion.turned_back(turned, kind=kind).select("clip", "frame", F.col("place").alias("p"), F.col("rotations").alias("r"))
    for r in df.join(back, ["clip", "frame"]).collect():
        assert np.allclose(r.place, r.p, atol=1e-9) and np.allclose(r.rotations, r.r, atol=1e-9)
    root = lambda x: G.matrix_to("axis_angle", G.to_matrix(kind, F.slice(x, 1, width)))
    first = df.where("frame = 0").select("clip", root("rotations").alias("own"))
    for r in turned.join(first, "clip").select("frame", "turn", "own", F.slice("rotations", width + 1, width).alias("other")).collect():
        assert abs(r.turn - r.own[2] - math.pi / 2) < 1e-9
    straight = motion.canonical_turn(df, kind=kind, quarter=False).where("frame = 0").join(first, "clip").collect()
    assert all(abs(r.turn - r.own[2]) < 1e-9 for r in straight)
    heading = motion.canonical_turn(spark.createDataFrame([("x", 0, [1.0, 2.0, 3.0], [0.0, 0.0, 0.7]), ("x", 1, [2.0, 2.0, 4.0], [0.0, 0.0, 1.0])], "clip string, frame int, place array<double>, rotations array<double>"), kind="axis_angle", quarter=False)
    a, b = (r.rotations for r in heading.orderBy("frame").collect())
    assert np.allclose(a, [0, 0, 0], atol=1e-9) and np.allclose(b, [0, 0, 0.3], atol=1e-9)


def test_cider_by_force(spark):
    rng = random.Random(6)
    words = "a b c d e f g".split()
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(0, 9)))
    preds = [(i, text()) for i in range(12)]
    refs = [(i, k, preds[i][1] if rng.random() < 0.3 else text()) for i in range(12) for k in range(rng.randrange(0, 4))]
    got = {r.id: r.cider for r in metrics.cider(spark.createDataFrame(preds, "i int, t string"), spark.createDataFrame(refs, "i int, k int, t string"), "i", "k", "t").collect()}
    grams = lambda t, n: Counter(tuple(t.split()[j : j + n]) for j in range(len(t.split()) - n + 1))
    sets = defaultdict(set)
    for i, _, t in refs:
        for n in range(1, 5):
            for g in grams(t, n):
                sets[g].add(i)
    many = len({i for i, _, _ in refs})
    weights = lambda t, n: {g: c * (math.log(many) - math.log(max(1, len(sets[g])))) for g, c in grams(t, n).items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    want = {}
    for i, t in preds:
        own = [r for j, _, r in refs if j == i]
        if not own:
            continue
        total = 0
        for r in own:
            for n in range(1, 5):
                a, b = weights(t, n), weights(r, n)
                if norm(a) and norm(b):
                    total += sum(min(a[g], b.get(g, 0)) * b.get(g, 0) for g in a) / norm(a) / norm(b) * math.exp(-((len(t.split()) - len(r.split())) ** 2) / 72)
        want[i] = 10 * total / 4 / len(own)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want) and max(want.values()) > 1


def test_slices_by_force(spark):
    rng = random.Random(7)
    frames = [(c, f) for c in (1, 2, None) for f in range(300)]
    ranges = [(c, s, lo, lo + rng.choice([0, 1, 3, 64, 65, 200, -5])) for c in (1, 2, 3, None) for s in range(25) for lo in [rng.randrange(-20, 310)]]
    got = sequence.sliced(spark.createDataFrame(frames, "clip int, frame int"), spark.createDataFrame(ranges, "r_clip int, segment int, lo int, hi int"))
    assert got.columns == ["clip", "frame", "segment", "lo", "hi"]
    want = [(c, f, s, lo, hi) for c, f in frames for d, s, lo, hi in ranges if c is not None and c == d and lo <= f < hi]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_places_within_groups(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None, "a"]), rng.randrange(1000)) for _ in range(300)]
    got = corpus.placed_within(spark.createDataFrame(rows, "g string, o int"), "g", ["o"]).collect()
    assert len(got) == 300
    for g in ("a", "b", None):
        own = sorted((r.place, r.o) for r in got if r.g == g)
        assert [p for p, _ in own] == list(range(len(own))) and [o for _, o in own] == sorted(o for h, o in rows if h == g)


@pytest.mark.parametrize("part", ["all", "after", "between"])
def test_errors_over_parts_of_clips(spark, part):
    rng = random.Random(9)
    rows = [(c, f, rng.random() if f else None) for c, n in (("a", 1), ("b", 4), ("c", 23)) for f in range(n)]
    got = {r.clip: (r.ade, r.fde) for r in metrics.span_error(spark.createDataFrame(rows, "clip string, frame int, e double"), "clip", "frame", "e", part, 0.25).collect()}
    want = {}
    for c in "abc":
        e = [x for d, _, x in rows if d == c]
        cut = int(len(e) * 0.25)
        lo, hi = {"all": (0, len(e)), "after": (cut, len(e)), "between": (cut, len(e) - cut)}[part]
        if own := [x for x in e[lo:hi] if x is not None]:
            want[c] = (sum(own) / len(own), own[-1])
    assert got.keys() == want.keys() and all(np.allclose(got[c], want[c]) for c in want)


def test_natural_order_of_long_numbers(spark):
    names = ["a1" + "0" * 20 + "9", "a1" + "0" * 20 + "1", "a9" + "0" * 19, "a007", "a7b2", "a7b10", "a", "7", "10", "", "b" + "9" * 500, "b1" + "0" * 500]
    keys = {r.x: r.k for r in spark.createDataFrame([(n,) for n in names], "x string").select("x", T.natural_key(F.col("x")).alias("k")).collect()}
    import re

    want = sorted(names, key=lambda n: [(0, int(r), "") if r.isdigit() else (1, 0, r) for r in re.findall(r"[0-9]+|[^0-9]+", n)])
    assert sorted(names, key=keys.get) == want


def test_tfidf_with_many_short_queries(spark, monkeypatch):
    """Sums are sparse, in slices of any size; against dense products."""
    rng = random.Random(10)
    text = lambda k: "".join(rng.choices("abcde ", k=k))
    rows, asked = [(i, text(30)) for i in range(60)], [(1000 + i, text(rng.randrange(1, 6))) for i in range(150)]
    a, b = spark.createDataFrame(rows, "i long, t string"), spark.createDataFrame(asked, "q long, t string")
    want = None
    for products in (retrieval.PRODUCTS, 40):
        monkeypatch.setattr(retrieval, "PRODUCTS", products)
        got = sorted(map(tuple, retrieval.tfidf_top(a, b, "i", "q", "t", 4).collect()))
        assert want is None or got == want
        want = got
    weights, idf = retrieval.tfidf(a, "i", "t")
    own, other = defaultdict(dict), defaultdict(dict)
    for r in weights.collect():
        own[r.id][r.term] = r.weight
    for r in retrieval.normalised(retrieval.term_counts(b, "q", "t"), idf).collect():
        other[r.id][r.term] = r.weight
    full = []
    for q, w in other.items():
        s = sorted((-round(sum(x * v.get(t, 0) for t, x in w.items()), 6), i) for i, v in own.items())
        full += [(q, k, i, -x) for k, (x, i) in enumerate((r for r in s if r[0] < 0), 1) if k <= 4]
    assert len(want) == len(full) and sum(x == y for x, y in zip(want, sorted(full))) > 0.98 * len(full)


def test_tfidf_weighs_rows_where_they_are(spark, monkeypatch):
    """No term is shuffled while the terms fit; cut in slices of any size or joined, the weights are the same. An id's texts are one."""
    rng = random.Random(11)
    rows = [(i // 2, "".join(rng.choices("aBcdé 한\n", k=rng.randrange(0, 40)))) for i in range(80)] + [(50, None), (51, " ")]
    a = spark.createDataFrame(rows, "i long, t string")
    plain = defaultdict(lambda: defaultdict(int))
    for i, t in rows:
        for w in (t or "").lower().split():
            for n in (2, 3, 4):
                for k in range(len(w) + 3 - n):
                    plain[i][f" {w} "[k : k + n]] += 1
    want, n_docs = {}, len(rows)
    for i, own in plain.items():
        w = {g: (1 + np.log(n)) * (np.log((1 + n_docs) / (1 + sum(g in other for other in plain.values()))) + 1) for g, n in own.items()}
        want[i] = {g: x / np.sqrt(sum(y * y for y in w.values())) for g, x in w.items()}
    for grams, terms in ((1 << 20, 1 << 20), (50, 1 << 20), (1 << 20, 0)):
        monkeypatch.setattr(retrieval, "GRAMS", grams)
        monkeypatch.setattr(retrieval, "MOST_TERMS", terms)
        got, idf = retrieval.tfidf_rows(a, "i", "t")
        found = {r.id: dict(zip(r.terms, r.weights)) for r in got.collect()}
        assert found.keys() == want.keys() and all(found[i].keys() == want[i].keys() and all(abs(found[i][g] - x) < 1e-12 for g, x in want[i].items()) for i in want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not terms or ("Exchange" not in plan and "Join" not in plan)
        flat = retrieval.tfidf(a, "i", "t")[0].collect()
        assert len(flat) == sum(len(w) for w in want.values()) and all(abs(want[r.id][r.term] - r.weight) < 1e-12 for r in flat)


@pytest.mark.parametrize("n_rows, n_asked", [(90, 25), (12, 70)])
def test_tfidf_search_in_blocks_of_either_side(spark, monkeypatch, n_rows, n_asked):
    """The smaller side goes to the tasks, in one block or many, with all, some or no terms dense: the same hits as by force."""
    rng = random.Random(12)
    text = lambda: "".join(rng.choices("abcdefg ", k=rng.randrange(0, 30)))
    rows, asked = [(i, text()) for i in range(n_rows)] + [(None, "abc")], [(1000 + i // 2, text()) for i in range(n_asked)] + [(7, None)]
    a, b = spark.createDataFrame(rows, "i long, t string"), spark.createDataFrame(asked, "q long, t string")
    _, idf = retrieval.tfidf_rows(a, "i", "t")
    of = lambda x, i: {r.id: dict(zip(r.terms, r.weights)) for r in retrieval.weighted(retrieval.words_of(x.where(f"{i} is not null"), i, "t"), idf).collect()}
    own, other, want = of(a, "i"), of(b, "q"), []
    for q, w in other.items():
        s = sorted((-round(sum(x * v.get(t, 0) for t, x in w.items()), 6), i) for i, v in own.items())
        want += [(q, k, i, -x) for k, (x, i) in enumerate((r for r in s if r[0] < 0), 1) if k <= 3]
    for texts, head in ((4096, 2048), (9, 20), (4096, 0)):
        monkeypatch.setattr(retrieval, "TEXTS", texts)
        monkeypatch.setattr(retrieval, "HEAD", head)
        got = retrieval.tfidf_top(a, b, "i", "q", "t", 3).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_cider_deals_its_texts_by_size(spark, monkeypatch):
    """A task adds up the n-grams of a bounded part of the texts, whatever the files are like."""
    monkeypatch.setattr(metrics, "TASK_BYTES", 64)
    rows = spark.createDataFrame([(k, j, f"a b{k} c{j} d e") for k in range(20) for j in range(2)], "i int, k int, t string").coalesce(1)
    out = metrics.cider(rows.where("k = 0").select("i", "t"), rows.where("k = 1"), "i", "k", "t")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    dealt = [int(n) for n in re.findall(r"RepartitionByExpression \[id#\d+L?\], (\d+)", plan)]
    assert dealt and min(dealt) > 1
    assert out.count() == 20


def test_cider_plan_stays_small(spark, monkeypatch):
    """The driver holds the plan and a row for each task: no joins of n-grams, however many parts the texts have; ids that repeat, lack a side or are null as the definition has them."""
    monkeypatch.setattr(metrics, "TASK_BYTES", 16)
    preds = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b x y"), (3, "q"), (None, "a b"), (5, None)], "i long, t string")
    refs = spark.createDataFrame([(1, 0, "a b c d"), (1, 0, "a b c d"), (1, None, "a b c d"), (2, 1, "x y z w"), (4, 1, "z w"), (None, 1, "a b c d"), (5, 1, "a")], "i long, k int, t string")
    out = metrics.cider(preds, refs, "i", "k", "t")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") <= 2
    got = {r.id: r.cider for r in out.collect()}
    assert set(got) == {1, 2, 5} and got[5] is None
    assert math.isclose(got[1], 10 * 2 / 3)  # two references equal the prediction, the one without a name counts as no match
    assert math.isclose(got[2], 10 * (8 / math.sqrt(130) + 4 / math.sqrt(108)) / 4)  # in logs of 2: of four sets, a, z, w and `z w` are in two
