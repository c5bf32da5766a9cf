"""Rotations as Column expressions. A quaternion is an array w, x, y, z; a matrix nine values by rows; six values are a matrix's first two columns."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(f):
    """Evaluate array arguments once: each becomes the variable of a one-element transform, so that nested calls don't multiply expressions."""

    @wraps(f)
    def call(*args):
        def bind(k: int, done: list) -> Column:
            if k == len(args):
                return f(*done)
            return F.element_at(F.transform(F.array(args[k]), lambda x: bind(k + 1, [*done, x])), 1)

        return bind(0, [])

    return call


def _at(a: Column, i: int) -> Column:
    return F.element_at(a, i + 1)


def _parts(a: Column, n: int) -> list[Column]:
    return [_at(a, i) for i in range(n)]


def _scaled(parts: list[Column]) -> list[Column]:
    length = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    return [p / length for p in parts]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def q_inverse(q: Column) -> Column:
    """The conjugate, which is the inverse of a unit quaternion."""
    w, x, y, z = _parts(q, 4)
    return F.array(w, -x, -y, -z)


@bound
def q_normal(q: Column) -> Column:
    return F.array(*_scaled(_parts(q, 4)))


@bound
def q_mul(q: Column, r: Column) -> Column:
    a, b, c, d = _parts(q, 4)
    e, f, g, h = _parts(r, 4)
    return F.array(a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)


@bound
def q_rotate(q: Column, v: Column) -> Column:
    """v turned by the unit quaternion q."""
    u, p = _parts(q, 4), _parts(v, 3)
    c = _cross(u[1:], p)
    cc = _cross(u[1:], c)
    return F.array(*[p[i] + 2 * (u[0] * c[i] + cc[i]) for i in range(3)])


@bound
def q_between(a: Column, b: Column) -> Column:
    """The rotation that takes direction a to direction b."""
    p, q = _parts(a, 3), _parts(b, 3)
    squares = lambda v: v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    w = F.sqrt(squares(p) * squares(q)) + p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    return F.array(*_scaled([w, *_cross(p, q)]))


def q_power(q: Column, t: Column) -> Column:
    """A unit quaternion's rotation taken t times."""
    w, *v = _parts(q, 4)
    half = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w)))
    turn = F.when(F.abs(F.sin(half)) > 1e-12, F.sin(t * half) / F.sin(half)).otherwise(t)
    return F.array(F.cos(t * half), *[x * turn for x in v])


def q_slerp(a: Column, b: Column, t: Column) -> Column:
    return q_mul(q_power(q_mul(b, q_inverse(a)), t), a)


@bound
def q_to_matrix(q: Column) -> Column:
    w, x, y, z = _parts(q, 4)
    s = 2 / (w * w + x * x + y * y + z * z)
    return F.array(
        1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
        s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w),
        s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y),
    )


@bound
def matrix_to_q(m: Column) -> Column:
    """With w >= 0; from the largest of the four possible divisors."""
    a, b, c, d, e, f, g, h, i = _parts(m, 9)
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    w, x, y, z = root(1 + a + e + i), root(1 + a - e - i), root(1 - a + e - i), root(1 - a - e + i)
    by_w = [w * w, h - f, c - g, d - b]
    by_x = [h - f, x * x, d + b, c + g]
    by_y = [c - g, d + b, y * y, f + h]
    by_z = [d - b, c + g, f + h, z * z]
    most = F.greatest(w, x, y, z)
    pick = [F.when(w == most, p / (2 * w)).when(x == most, q / (2 * x)).when(y == most, r / (2 * y)).otherwise(s / (2 * z)) for p, q, r, s in zip(by_w, by_x, by_y, by_z)]
    sign = F.when(pick[0] < 0, -1.0).otherwise(1.0)
    return F.array(*[p * sign for p in pick])


def _sinc(x: Column) -> Column:
    """sin(x) / x, which is 1 at 0."""
    return F.when(x == 0, 1.0).otherwise(F.sin(x) / x)


@bound
def axis_angle_to_q(v: Column) -> Column:
    """cos of half the angle, and the axis times its sine: v / 2 times sinc."""
    half = F.sqrt(sum((p * p for p in _parts(v, 3)), F.lit(0.0))) / 2
    return F.array(F.cos(half), *[p / 2 * _sinc(half) for p in _parts(v, 3)])


@bound
def q_to_axis_angle(q: Column) -> Column:
    w, *v = _parts(q, 4)
    half = F.atan2(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]), w)
    return F.array(*[2 * x / _sinc(half) for x in v])


@bound
def six_to_matrix(d: Column) -> Column:
    """Gram-Schmidt on two rows of three values; the third row is their cross product."""
    v = _parts(d, 6)
    a = _scaled(v[:3])
    along = a[0] * v[3] + a[1] * v[4] + a[2] * v[5]
    b = _scaled([v[3 + i] - along * a[i] for i in range(3)])
    return F.array(*a, *b, *_cross(a, b))


def matrix_to_six(m: Column) -> Column:
    return F.slice(m, 1, 6)


@bound
def q_to_six(q: Column) -> Column:
    """The first two columns of the rotation."""
    m = _parts(q_to_matrix(q), 9)
    return F.array(m[0], m[3], m[6], m[1], m[4], m[7])


def euler_to_matrix(angles: Column, order: str) -> Column:
    """Turns about the axes of order, the first outermost."""
    out = None
    for k, axis in enumerate(order.upper()):
        c, s, o, z = F.cos(_at(angles, k)), F.sin(_at(angles, k)), F.lit(1.0), F.lit(0.0)
        m = {"X": [o, z, z, z, c, -s, z, s, c], "Y": [c, z, s, z, o, z, -s, z, c], "Z": [c, -s, z, s, c, z, z, z, o]}[axis]
        out = m if out is None else [sum((out[3 * i + x] * m[3 * x + j] for x in range(1, 3)), out[3 * i] * m[j]) for i in range(3) for j in range(3)]
    return F.array(*out)


def _order(order: str) -> tuple[int, int, int]:
    places = tuple("XYZ".find(c) for c in order.upper())
    if len(places) != 3 or min(places) < 0 or places[1] in (places[0], places[2]):
        raise ValueError(f"{order!r} isn't three axes of which neighbours differ")
    return places


def matrix_to_euler(m: Column, order: str) -> Column:
    """The angles of euler_to_matrix, the middle one from -90 to 90 degrees, or from 0 to 180 where the outer axes are one.

    With outer axes i, k and middle axis j, the entries of the product in row i and column k (or i) hold one factor of each pair of sine and cosine. Where the middle turn lines the outer axes
    up, only their sum or difference is known: the last angle is then 0.
    """
    i, j, k = _order(order)
    third = 3 - i - j
    sign = 1.0 if (j - i) % 3 == 1 else -1.0  # of the permutation i, j, third

    def angles(a: Column) -> Column:
        at = lambda row, col: _at(a, 3 * row + col)
        bounded = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
        if i != k:
            middle = F.asin(bounded(sign * at(i, k)))
            first, last = F.atan2(-sign * at(j, k), at(k, k)), F.atan2(-sign * at(i, j), at(i, i))
            level = F.sqrt(at(i, i) * at(i, i) + at(i, j) * at(i, j))
        else:
            middle = F.acos(bounded(at(i, i)))
            first, last = F.atan2(at(j, i), -sign * at(third, i)), F.atan2(at(i, j), sign * at(i, third))
            level = F.sqrt(at(i, j) * at(i, j) + at(i, third) * at(i, third))
        locked = level < 1e-9
        return F.array(F.when(locked, F.atan2(sign * at(third, j), at(j, j))).otherwise(first), middle, F.when(locked, 0.0).otherwise(last))

    return bound(angles)(m)


def q_to_euler(q: Column, order: str) -> Column:
    return matrix_to_euler(q_to_matrix(q), order)


def turn_about_z(angle: Column) -> Column:
    c, s, o, z = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    return F.array(c, -s, z, s, c, z, z, z, o)


@bound
def matrix_mul(a: Column, b: Column) -> Column:
    x, y = _parts(a, 9), _parts(b, 9)
    return F.array(*[x[3 * i] * y[j] + x[3 * i + 1] * y[3 + j] + x[3 * i + 2] * y[6 + j] for i in range(3) for j in range(3)])


#: Values that each representation of a rotation has.
WIDTHS = {"axis_angle": 3, "quaternion": 4, "six": 6, "matrix": 9}


def to_matrix(kind: str, x: Column) -> Column:
    return {"axis_angle": lambda: q_to_matrix(axis_angle_to_q(x)), "quaternion": lambda: q_to_matrix(x), "six": lambda: six_to_matrix(x), "matrix": lambda: x}[kind]()


def matrix_to(kind: str, m: Column) -> Column:
    return {"axis_angle": lambda: q_to_axis_angle(matrix_to_q(m)), "quaternion": lambda: matrix_to_q(m), "six": lambda: matrix_to_six(m), "matrix": lambda: m}[kind]()


def forward_direction(right_hip: Column, left_hip: Column, right_shoulder: Column, left_shoulder: Column) -> Column:
    """(x, z) of the unit normal of the axis across hips and shoulders."""
    across = [_at(right_hip, i) - _at(left_hip, i) + _at(right_shoulder, i) - _at(left_shoulder, i) for i in (0, 2)]
    return F.array(*_scaled([-across[1], across[0]]))
