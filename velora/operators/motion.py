"""Whole-clip transforms of joint positions: rows (clip, frame, pose), a pose being the x, y, z of each joint in one flat array, the root first."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velora.functions import geometry as G
from velora.functions.vector import doubles, let
from velora.operators.corpus import placed
from velora.operators.sequence import over, so_far

AXES = 3
#: Fixed value: how soft the minimum is that takes the floor from a clip's lowest feet.
SOFTNESS = 0.5


@dataclass(frozen=True)
class Body:
    """Places of the joints that tell where a body stands and which way it faces; the defaults are those of the usual 22 joints."""

    left_hip: int = 1
    right_hip: int = 2
    left_shoulder: int = 16
    right_shoulder: int = 17
    feet: tuple[int, ...] = (7, 8, 10, 11)


def joint(pose: Column, k: int) -> Column:
    return F.slice(pose, AXES * k + 1, AXES)


def axis_of(pose: Column, k: int, axis: int) -> Column:
    return F.element_at(pose, AXES * k + axis + 1)


def floor_height(feet: Column, clip: str) -> Column:
    """The soft minimum over a clip of each frame's lowest foot."""
    whole = Window.partitionBy(clip)
    low, high = F.min(feet).over(whole), F.max(feet).over(whole)
    return low - F.log(F.lit(SOFTNESS) + F.exp(low - high))


def _turned(x: Column, z: Column, sin: Column, cos: Column) -> tuple[Column, Column]:
    return x * cos - z * sin, x * sin + z * cos


def local_features(clips: DataFrame, clip: str = "clip", frame: str = "frame", pose: str = "pose", body: Body = Body()) -> DataFrame:
    """(clip, frame, features): height of the root over the floor, all other joints as the root and its facing see them, the facing's turn
    since the last frame, and the root's step as the facing sees it. Turn and step of a first frame are 0.

    Windows over a clip's frames; all else is arithmetic on one row.
    """
    w = over(clip, frame)
    p = clips.select(clip, frame, doubles(F.col(pose)).alias("p"))
    p = p.withColumn("floor", floor_height(F.least(*[axis_of(F.col("p"), k, 1) for k in body.feet]), clip))
    ahead = G.forward_direction(*[joint(F.col("p"), k) for k in (body.right_hip, body.left_hip, body.right_shoulder, body.left_shoulder)])
    p = p.withColumn("ahead", ahead).select(clip, frame, "p", "floor", F.get("ahead", F.lit(0)).alias("sin"), F.get("ahead", F.lit(1)).alias("cos"))
    x, z = axis_of(F.col("p"), 0, 0), axis_of(F.col("p"), 0, 2)
    since = lambda v: F.coalesce(v - F.lag(v).over(w), F.lit(0.0))
    p = p.withColumns({"x": x, "z": z, "yaw": F.atan2("sin", "cos")})
    p = p.withColumns({"dx": since(F.col("x")), "dz": since(F.col("z")), "turn": since(F.col("yaw"))})

    def seen(k: Column) -> Column:
        at = lambda axis: F.element_at("p", AXES * k + axis + 1)
        side, front = _turned(at(0) - F.col("x"), at(2) - F.col("z"), F.col("sin"), F.col("cos"))
        return F.array(side, at(1) - F.col("floor"), front)

    others = F.flatten(F.transform(F.sequence(F.lit(1), (F.size("p") / AXES).cast("int") - 1), seen))
    step = _turned(F.col("dx"), F.col("dz"), F.col("sin"), F.col("cos"))
    return p.select(clip, frame, F.concat(F.array(axis_of(F.col("p"), 0, 1) - F.col("floor")), others, F.array(F.col("turn"), *step)).alias("features"))


def from_local(rows: DataFrame, clip: str = "clip", frame: str = "frame", features: str = "features") -> DataFrame:
    """(clip, frame, pose): the inverse of local_features, up to the first frame's place and facing: it stands at the origin and faces along z."""
    sums, first = so_far(clip, frame), over(clip, frame)
    f = F.col("f")
    back = lambda k: F.element_at(f, -k)
    r = rows.select(clip, frame, doubles(F.col(features)).alias("f"))
    gone = lambda v: F.sum(v).over(sums) - F.first(v).over(first.rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("yaw", gone(back(3))).withColumns({"sin": -F.sin("yaw"), "cos": F.cos("yaw")})  # turned back
    dx, dz = _turned(back(2), back(1), F.col("sin"), F.col("cos"))
    r = r.withColumns({"dx": dx, "dz": dz}).withColumns({"x": gone(F.col("dx")), "z": gone(F.col("dz"))})

    def placed_joint(k: Column) -> Column:
        at = lambda axis: F.element_at(f, AXES * k + axis + 2)
        side, front = _turned(at(0), at(2), F.col("sin"), F.col("cos"))
        return F.array(side + F.col("x"), at(1), front + F.col("z"))

    joints = ((F.size(f) - 1 - AXES) / AXES).cast("int")
    others = F.flatten(F.transform(F.sequence(F.lit(0), joints - 1), placed_joint))
    return r.select(clip, frame, F.concat(F.array(F.col("x"), F.element_at(f, 1), F.col("z")), others).alias("pose"))


def forward_kinematics(rotations: np.ndarray, offsets: np.ndarray, root: np.ndarray, chains) -> np.ndarray:
    """Positions from each joint's rotation matrix (frames, joints, 3, 3), bone offsets, the root's path and the chains from the root."""
    frames, joints = rotations.shape[:2]
    place, whole = np.zeros((frames, joints, 3)), np.zeros((frames, joints, 3, 3))
    place[:, 0], whole[:, 0] = root, rotations[:, 0]
    for chain in chains:
        turned = whole[:, 0] if chain[0] == 0 else whole[:, chain[0]]
        for parent, child in zip(chain, chain[1:]):
            turned = turned @ rotations[:, child]
            place[:, child] = place[:, parent] + np.einsum("fij,j->fi", turned, offsets[child])
            whole[:, child] = turned
    return place


def scaled_to(joints: np.ndarray, leg: tuple[int, int, int], target: float) -> np.ndarray:
    """A clip scaled so that its thigh and shin are as long as target together."""
    a, b, c = (joints[0, k] for k in leg)
    return joints * (target / (np.linalg.norm(a - b) + np.linalg.norm(b - c)))


def batches(df: DataFrame, size: int, order: str, values: str, zero: float = 0.0) -> DataFrame:
    """(batch, ids, lengths, padded): rows dealt into batches by place, arrays filled to their batch's longest."""
    rows = placed(df.select(order, values), [order], "_place").withColumn("batch", F.floor(F.col("_place") / size))
    z = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_place", F.col(order).alias("id"), F.col(values).alias("x")))).alias("z"), F.max(F.size(values)).alias("longest"))
    fill = lambda r: F.concat(r["x"], F.array_repeat(F.lit(zero).cast("double"), F.col("longest") - F.size(r["x"])))
    return z.select("batch", F.transform("z", lambda r: r["id"]).alias("ids"), F.transform("z", lambda r: F.size(r["x"])).alias("lengths"), F.transform("z", fill).alias("padded"))


def mapped(pose: Column, places: list[int]) -> Column:
    """A pose in another skeleton's joints: for each of those the place of the joint that stands for it."""
    return F.flatten(F.array(*[joint(pose, k) for k in places]))


def matching(names: list[str], wanted: list[str], other: dict[str, str] | None = None) -> list[int]:
    """Places in names of the wanted joints, under other names where `other` has them; a ValueError names those that are missing."""
    called = [(other or {}).get(w, w) for w in wanted]
    missing = [c for c in called if c not in names]
    if missing:
        raise ValueError(f"no joints {missing}; there are {names}")
    return [names.index(c) for c in called]


def inverse_kinematics(poses: DataFrame, offsets: list[list[float]], chains: list[list[int]], clip: str = "clip", frame: str = "frame", pose: str = "pose", body: Body = Body()) -> DataFrame:
    """(clip, frame, rotations): each joint's quaternion relative to its parent's on the chain, the root's first.

    A joint's own rotation takes its offset's direction to where its bone points; relative to the joint before it on the chain, or to the root, that is the
    product with the other's inverse. The root's turns the facing to z; a clip's first frame faces z already.
    """
    p = poses.select(clip, frame, doubles(F.col(pose)).alias("p"))
    at = lambda k: joint(F.col("p"), k)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    number = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    ahead = G.forward_direction(*[at(k) for k in (body.right_hip, body.left_hip, body.right_shoulder, body.left_shoulder)])
    p = p.withColumn("ahead", ahead)
    facing = F.array(-F.get("ahead", F.lit(0)), F.lit(0.0), -F.get("ahead", F.lit(1)))
    first = F.col(frame) == F.min(frame).over(Window.partitionBy(clip))
    own = {0: F.col("q0")}
    p = p.withColumn("q0", F.when(first, number(1, 0, 0, 0)).otherwise(G.q_between(facing, number(0, 0, 1))))
    local = {0: F.col("q0")}
    for chain in chains:
        before = own[0]
        for parent, child in zip(chain, chain[1:]):
            p = p.withColumn(f"q{child}", G.q_between(number(*offsets[child]), minus(at(child), at(parent))))
            local[child] = G.q_mul(G.q_inverse(before), F.col(f"q{child}"))
            before = F.col(f"q{child}")
    none = number(0, 0, 0, 0)
    return p.select(clip, frame, F.flatten(F.array(*[local.get(k, none) for k in range(len(offsets))])).alias("rotations"))


def recovered(rows: DataFrame, joints: int, clip: str = "clip", frame: str = "frame", features: str = "features") -> DataFrame:
    """(clip, frame, pose) from features: half the root's turn to the next frame, its step there (x, z) as the next frame sees it, its height, and the other joints as the root sees them."""
    w, sums = over(clip, frame), so_far(clip, frame)
    f = F.col("f")
    value = lambda k: F.element_at(f, k + 1)
    r = rows.select(clip, frame, doubles(F.col(features)).alias("f"))
    before = lambda k: F.coalesce(F.lag(value(k)).over(w), F.lit(0.0))
    r = r.withColumn("half", F.sum(value(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumns({"sin": F.sin(2 * F.coalesce("half", F.lit(0.0))), "cos": F.cos(2 * F.coalesce("half", F.lit(0.0))), "vx": before(1), "vz": before(2)})
    dx, dz = _turned(F.col("vx"), F.col("vz"), F.col("sin"), F.col("cos"))
    r = r.withColumns({"dx": dx, "dz": dz}).withColumns({"x": F.sum("dx").over(sums), "z": F.sum("dz").over(sums)})

    def seen(k: Column) -> Column:
        at = lambda axis: F.element_at(f, AXES * k + axis + 5)
        side, front = _turned(at(0), at(2), F.col("sin"), F.col("cos"))
        return F.array(side + F.col("x"), at(1), front + F.col("z"))

    others = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(joints - 2)), seen))
    return r.select(clip, frame, F.concat(F.array(F.col("x"), value(3), F.col("z")), others).alias("pose"))


def velocity_features(rows: DataFrame, clip: str = "clip", frame: str = "frame", place: str = "place", rotations: str = "rotations") -> DataFrame:
    """(clip, frame, features): height (the third coordinate of the root's place), the root's step in the plane (0 in the first frame), all rotations as they are."""
    w = over(clip, frame)
    at = lambda k: F.element_at(F.col("p"), k)
    r = rows.select(clip, frame, doubles(F.col(place)).alias("p"), doubles(F.col(rotations)).alias("r"))
    step = lambda k: F.coalesce(at(k) - F.lag(at(k)).over(w), F.lit(0.0))
    return r.select(clip, frame, F.concat(F.array(at(3), step(1), step(2)), F.col("r")).alias("features"))


def from_velocity(rows: DataFrame, clip: str = "clip", frame: str = "frame", features: str = "features") -> DataFrame:
    """(clip, frame, place, rotations): the inverse, from a first place of 0 in the plane."""
    sums = so_far(clip, frame)
    f = doubles(F.col(features))
    gone = lambda k: F.sum(F.element_at(f, k)).over(sums) - F.first(F.element_at(f, k)).over(sums)
    return rows.select(clip, frame, F.array(gone(2), gone(3), F.element_at(f, 1)).alias("place"), F.slice(f, F.lit(4), F.size(f)).alias("rotations"))


def canonical_turn(rows: DataFrame, clip: str = "clip", frame: str = "frame", place: str = "place", rotations: str = "rotations", kind: str = "matrix", quarter: bool = True) -> DataFrame:
    """(clip, frame, place, rotations, turn): whole clips turned about the upright axis (the third), so that each begins with the same heading.

    turn is the part about that axis of the root's rotation in the clip's first frame, as an axis times an angle, and a quarter turn more if quarter; places in the plane and the root's
    rotations are turned back by it, all else stays. rotations: those of all joints in one array, the root's first, each as kind says.
    """
    w = over(clip, frame).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.select(clip, frame, doubles(F.col(place)).alias("p"), doubles(F.col(rotations)).alias("r"))
    axis = G.matrix_to("axis_angle", G.to_matrix(kind, F.slice("r", 1, G.WIDTHS[kind])))
    r = r.withColumn("own", F.element_at(axis, 3) + (np.pi / 2 if quarter else 0.0)).withColumn("turn", F.first("own").over(w))
    return _whole_turned(r, clip, frame, place, rotations, kind, -F.col("turn"))


def turned_back(rows: DataFrame, clip: str = "clip", frame: str = "frame", place: str = "place", rotations: str = "rotations", kind: str = "matrix", turn: str = "turn") -> DataFrame:
    """(clip, frame, place, rotations, turn): the inverse of canonical_turn."""
    r = rows.select(clip, frame, doubles(F.col(place)).alias("p"), doubles(F.col(rotations)).alias("r"), F.col(turn).alias("turn"))
    return _whole_turned(r, clip, frame, place, rotations, kind, F.col("turn"))


def _whole_turned(r: DataFrame, clip: str, frame: str, place: str, rotations: str, kind: str, angle: Column) -> DataFrame:
    x, y = _turned(F.element_at("p", 1), F.element_at("p", 2), F.sin(angle), F.cos(angle))
    root = G.matrix_to(kind, G.matrix_mul(G.turn_about_z(angle), G.to_matrix(kind, F.slice("r", 1, G.WIDTHS[kind]))))
    others = F.slice("r", F.lit(G.WIDTHS[kind] + 1), F.greatest(F.size("r") - G.WIDTHS[kind], F.lit(0)))
    return r.select(clip, frame, F.array(x, y, F.element_at("p", 3)).alias(place), F.concat(root, others).alias(rotations), "turn")


def _chain_ends(chains: list[list[int]]) -> list[tuple[int, int]]:
    return [(a, b) for c in chains for a, b in zip(c, c[1:])]


def posed(rows: DataFrame, offsets: list[list[float]], chains: list[list[int]], clip: str = "clip", frame: str = "frame", rotations: str = "rotations", root: str = "root") -> DataFrame:
    """(clip, frame, pose) from the quaternions of inverse_kinematics, the root's place and each bone's offset: forward kinematics along the chains, each of which begins with the root's rotation.

    One column for each joint on its way, so that no expression grows with a chain's length."""
    p = rows.select(clip, frame, doubles(F.col(rotations)).alias("r"), doubles(F.col(root)).alias("j0"))
    own = lambda k: F.slice("r", 4 * k + 1, 4)
    for chain in chains:
        turn = own(chain[0] if chain[0] == 0 else 0)
        for parent, child in zip(chain, chain[1:]):
            p = p.withColumn(f"t{child}", G.q_mul(turn, own(child)))
            turn = F.col(f"t{child}")
            bone = G.q_rotate(turn, F.array(*[F.lit(float(x)) for x in offsets[child]]))
            p = p.withColumn(f"j{child}", F.zip_with(F.col(f"j{parent}"), bone, lambda a, b: a + b))
    zero = F.array(*[F.lit(0.0)] * AXES)
    there = {0, *(b for _, b in _chain_ends(chains))}
    return p.select(clip, frame, F.flatten(F.array(*[F.col(f"j{k}") if k in there else zero for k in range(len(offsets))])).alias("pose"))


def retargeted(poses: DataFrame, directions: list[list[float]], offsets: list[list[float]], chains: list[list[int]], leg: tuple[int, int], clip: str = "clip", frame: str = "frame", pose: str = "pose", body: Body = Body()) -> DataFrame:
    """(clip, frame, pose): each clip's movement on another skeleton, whose bones are offsets; directions are those of the bones at rest.

    The clip's leg, both bones as long as in its first frame, to the other's leg is the ratio by which the root's path is scaled. Then inverse kinematics with the
    directions, and forward kinematics with the other's offsets. A bone's length counts along its direction's largest axis, as the offsets' do."""
    w = over(clip, frame).rowsBetween(Window.unboundedPreceding, 0)
    up = {b: a for a, b in _chain_ends(chains)}
    p = poses.select(clip, frame, doubles(F.col(pose)).alias("pose"))
    at = lambda k: joint(F.col("pose"), k)
    length = lambda k: F.sqrt(F.aggregate(F.zip_with(at(k), at(up[k]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v)) * max(abs(float(x)) for x in directions[k])
    wanted = sum(max(abs(float(x)) for x in offsets[k]) for k in leg)
    ratio = F.lit(wanted) / F.first(length(leg[0]) + length(leg[1])).over(w)
    p = p.withColumn("root", F.transform(at(0), lambda x: x)).withColumn("ratio", ratio).withColumn("root", F.transform("root", lambda x: x * F.col("ratio")))
    turns = inverse_kinematics(p, directions, chains, clip, frame, "pose", body)
    roots = p.select(F.col(clip).alias("_clip"), F.col(frame).alias("_frame"), "root")
    both = turns.join(roots, (F.col(clip) == F.col("_clip")) & (F.col(frame) == F.col("_frame"))).select(clip, frame, "rotations", "root")
    return posed(both, offsets, chains, clip, frame)


def standardised(poses: DataFrame, places: list[int], axes: tuple[int, int, int] = (0, 1, 2), signs: tuple[int, int, int] = (1, 1, 1), scale: float = 1.0, rebase: bool = True, clip: str = "clip", frame: str = "frame", pose: str = "pose") -> DataFrame:
    """(clip, frame, pose) in another convention: the joints at places, in that order; each one's axes swapped (axes says which old axis each new one is) and
    turned round where signs says so; lengths times scale; and with rebase from where the first joint is in the clip's first frame."""
    swapped = lambda p, k: [F.element_at(p, AXES * k + a + 1) * F.lit(float(s * scale)) for a, s in zip(axes, signs)]
    r = poses.select(clip, frame, doubles(F.col(pose)).alias("p"))
    r = r.select(clip, frame, F.array(*[x for k in places for x in swapped(F.col("p"), k)]).alias("p"))
    if not rebase:
        return r.withColumnRenamed("p", "pose")
    r = r.withColumn("o", F.first(F.slice("p", 1, AXES)).over(over(clip, frame).rowsBetween(Window.unboundedPreceding, 0)))
    return r.select(clip, frame, F.transform("p", lambda x, i: x - F.element_at("o", (i % AXES + 1).cast("int"))).alias("pose"))


def camera_translation(points: Column, image: Column, weights: Column, focal: float = 5000.0, size: float = 224.0) -> Column:
    """Where a camera has to stand for points (x, y, z of each joint) to fall on image (u, v of each): weighted least squares of three unknowns; null if they aren't determined.

    With t the unknown, each joint asks for f (X + t0) = (u - c) (Z + t2), and likewise for v. The first two normal equations give t0 and t1 by t2, which leaves one."""
    n = F.size(weights)
    c = size / 2
    at = lambda a, i: F.element_at(doubles(a), i.cast("int"))

    def terms(i: Column) -> Column:
        w, x, y, z = at(weights, i + 1), at(points, 3 * i + 1), at(points, 3 * i + 2), at(points, 3 * i + 3)
        u, v = at(image, 2 * i + 1) - c, at(image, 2 * i + 2) - c
        du, dv = u * z - focal * x, v * z - focal * y
        return F.array(w, -w * u, -w * v, w * (u * u + v * v), w * du, w * dv, -w * (u * du + v * dv))

    zero = F.array(*[F.lit(0.0)] * 7)
    joints = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), terms)).otherwise(F.array(zero))
    sums = F.aggregate(joints, zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))

    def solved(s: Column) -> Column:
        w, u, v, uv, bx, by, bz = (F.element_at(s, k) for k in range(1, 8))
        rest = uv - (u * u + v * v) / w
        deep = (bz - (u * bx + v * by) / w) / rest
        found = F.array((bx - u * deep) / (w * focal), (by - v * deep) / (w * focal), deep)
        return F.when((w > 0) & (rest > 1e-12 * uv), found)

    return let(sums, solved)
