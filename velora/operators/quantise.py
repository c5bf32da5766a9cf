"""Vector quantisation: nearest codes, usage, and one step of codebook learning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velora.functions.arrow import matrix
from velora.functions.sampling import sampled

#: Codes of a codebook at most: it is broadcast, so its size is checked.
MOST_CODES = 65_536


def nearest(rows: DataFrame, codebook: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, code, distance): the code of least squared distance, ties to the smaller code. codebook: (code, vector)."""
    got = codebook.select(F.col("code").cast("int"), F.col("vector")).orderBy("code").limit(MOST_CODES + 1).collect()
    if len(got) > MOST_CODES:
        raise ValueError(f"a codebook has at most {MOST_CODES} codes")
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r.code for r in got], np.int32), np.array([r.vector for r in got], np.float64)))

    def run(batches):
        codes, book = shared.value
        for b in batches:
            x = matrix(b.column(1))
            code, least = np.full(len(b), -1, np.int32), np.zeros(len(b))
            for lo in range(0, len(x) if len(book) else 0, 1024):
                part = x[lo : lo + 1024]
                d = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
                at = d.argmin(1)
                code[lo : lo + 1024] = codes[at]
                least[lo : lo + 1024] = ((part - book[at]) ** 2).sum(1)
            yield pa.record_batch([b.column(0), pa.array(code), pa.array(least)], names=[id_col, "code", "distance"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.where(F.col(vector).isNotNull()).select(id_col, vector).mapInArrow(run, f"`{id_col}` {kind}, code int, distance double")


def decoded(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    """The vectors of codes."""
    return assigned.join(codebook.select(F.col("code").alias("c"), F.col("vector").alias("decoded")), F.col("code") == F.col("c"), "left").drop("c")


def usage(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("code").agg(F.count("*").alias("n"))


def perplexity(counts: DataFrame) -> DataFrame:
    """exp(-sum p ln(p + 1e-7)): two aggregates, none of them a window over all rows."""
    total = counts.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return counts.join(F.broadcast(total)).agg(F.exp(-F.sum(p * F.log(p + 1e-7))).alias("perplexity"))  # one row


def code_sums(rows: DataFrame, assigned: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(code, dim, total, n) of the vectors of each code: vectors meet their code whole, and are taken apart after."""
    own = rows.select(F.col(id_col).alias("i"), F.col(vector).alias("v")).join(assigned.select(F.col(id_col).alias("a"), "code"), F.col("i") == F.col("a"))
    return own.select("code", F.posexplode("v").alias("dim", "x")).groupBy("code", "dim").agg(F.sum(F.col("x").cast("double")).alias("total"), F.count("*").alias("n"))


def reset(codebook: DataFrame, counts: DataFrame, rows: DataFrame, id_col: str, vector: str, salt: str = "reset") -> DataFrame:
    """(code, vector): codes without a row get the vectors of rows sampled by a seeded digest, in the order of codes; the others stay. counts: (code, n).
    A codebook is small (MOST_CODES at most), and so is what takes the places of its codes."""
    unused = codebook.join(counts.select(F.col("code").alias("u")), F.col("code") == F.col("u"), "left_anti").select(F.col("code").alias("e_code"), (F.row_number().over(Window.orderBy("code")) - 1).alias("nth"))
    drawn = sampled(rows.select(id_col, F.col(vector).alias("new")), id_col, MOST_CODES, salt)
    drawn = drawn.select("new", (F.row_number().over(Window.orderBy(F.md5(F.concat_ws(":", F.lit(salt), F.col(id_col).cast("string"))), id_col)) - 1).alias("k"))
    fresh = unused.join(drawn, F.col("nth") == F.col("k")).select("e_code", "new")
    return codebook.join(fresh, F.col("code") == F.col("e_code"), "left").select("code", F.coalesce("new", "vector").alias("vector"))


def moving_average(codebook: DataFrame, sums: DataFrame, mu: float = 0.99, keep: bool = True) -> DataFrame:
    """(code, dim, value, count) after one step from counts of 1: codes whose moving count is below 1 keep their old vector, for want of a random one that reruns agree on;
    without keep all take the average."""
    old = codebook.select(F.col("code").alias("o_code"), F.posexplode(F.col("vector")).alias("o_dim", "old"))
    both = old.join(sums, (F.col("o_code") == F.col("code")) & (F.col("o_dim") == F.col("dim")), "left")
    old_d = F.col("old").cast("double")
    total = mu * old_d + (1 - mu) * F.coalesce("total", F.lit(0.0))
    count = mu * F.lit(1.0) + (1 - mu) * F.coalesce("n", F.lit(0))
    return both.select(F.col("o_code").alias("code"), F.col("o_dim").alias("dim"), (F.when(count >= 1.0, total / count).otherwise(old_d) if keep else total / count).alias("value"), count.alias("count"))
