"""Clean, deduplicate and split a parallel corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velora.functions.sampling import below
from velora.functions.text import bucket, comparison_key, nfkc, strip
from velora.sources.staging import small_batches, staged


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df itself; a ValueError that names what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def canonical(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep the columns that exist and give them their canonical names."""
    return df.select(*[F.col(a).alias(b) for a, b in names.items() if a in df.columns])


def placed(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Each row's place in the whole order (columns or expressions), from 0; rows that tie come by a hash of their columns.

    Rows are dealt to sorted ranges, numbered within their range and written once; a range's start follows from the counts of that same
    table. Only one row a range is brought together, so no task sees all rows, as a global row_number() would. Dealing twice and matching
    ranges by number would not do: bounds are sampled, and ranges merged, anew each time.
    """
    nth, start = "_placed_nth", "_placed_start"
    tie = F.xxhash64(*[F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema])
    ranged = df.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    rows = staged(ranged.withColumn(nth, F.monotonically_increasing_id()), "placed")  # the range's number in the bits from 33 on, the row's below
    part, low = F.shiftright(nth, 33), F.col(nth).bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_placed_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part.alias("_placed_part")).count().select("_placed_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias(start))
    rows = rows.join(F.broadcast(starts), part == F.col("_placed_part"))  # as many rows as there are shuffle partitions
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(start) + low).alias(name))


def placed_within(df: DataFrame, group: str, order: list, name: str = "place") -> DataFrame:
    """Each row's place within its group, from 0: its place in the whole, sorted by group first, less that of the group's first row. No task sees a whole group."""
    rows = staged(placed(df, [group, *order], "_whole"), "placed-within")
    starts = rows.groupBy(F.col(group).alias("_group")).agg(F.min("_whole").alias("_start"))
    rows = rows.join(starts, F.col(group).eqNullSafe(F.col("_group")))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_whole") - F.col("_start")).alias(name))


def rotated(df: DataFrame, place: str, salt: str) -> DataFrame:
    """Places counted from a seeded start instead of the first row's, around the end."""
    n = df.agg(F.count("*").alias("_n"))
    start = F.when(F.col("_n") > 0, below(F.greatest(F.col("_n"), F.lit(1)), salt))
    return df.join(F.broadcast(n)).withColumn(place, F.pmod(F.col(place) - start, F.col("_n"))).drop("_n")  # one row


def numbered(df: DataFrame, order: list[str], name: str = "file_id", form: str = "auto%07d") -> DataFrame:
    """A synthetic id from the row's place, counted from 0."""
    return placed(df, order, "_place").withColumn(name, F.format_string(form, F.col("_place"))).drop("_place")


def cleaned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Strip the columns, bring them to Unicode's NFKC, and drop rows where one is then empty or null. Only rows with other than ASCII are sent to Python, each column
    a small batch at a time."""
    small_batches(df.sparkSession)
    plain = ~F.exists(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns]), lambda x: F.octet_length(x) != F.char_length(x))
    same, other = df.where(plain), df.where(~plain)
    for c in columns:
        other = other.withColumn(c, nfkc(F.col(c)))
    df = same.unionByName(other)
    for c in columns:
        df = df.withColumn(c, strip(F.col(c)))
    for c in columns:
        df = df.where(F.col(c) != "")
    return df


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by order of each key: a partial aggregate, not a window, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def split(df: DataFrame, text: str, valid: float = 0.05, test: float = 0.05, seed: int = 42) -> DataFrame:
    """test, valid or train by the hash of the text without white space and marks, so that equal texts share a split."""
    place = bucket(comparison_key(F.col(text)), seed)
    return df.withColumn("split", F.when(place < test, "test").when(place < test + valid, "valid").otherwise("train"))


def vocabulary(df: DataFrame, words: str, least: int = 1) -> DataFrame:
    """(token, n) of an array column, for tokens that occur least times."""
    return df.select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
