"""Queries over clips with captions, seeded choices and prompts. A user's events stand for a clip, a conversation's turns for its captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.functions import sampling as R
from velora.functions import text as T
from velora.operators import clips as C
from velora.operators import prompts, retrieval
from velora.plans import corpus_queries as Q

LEAST, BELOW, FPS, UNIT, WINDOW = 40, 80, 20.0, 4, 60


def _motions(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").alias("clip")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("z"))
    return e.select("clip", F.transform("z", lambda z: z["value"]).alias("motion"))


def _captions(spark: SparkSession, sf: str) -> DataFrame:
    """Every third turn speaks of the whole clip, the others of 2.5 seconds."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    whole = F.col("turn") % 3 == 0
    start = F.when(whole, 0.0).otherwise(F.col("turn") * 0.25)
    end = F.when(whole, 0.0).otherwise(F.col("turn") * 0.25 + 2.5)
    return c.select(F.col("conv_id").alias("clip"), F.col("turn").alias("line"), F.col("text").alias("caption"), T.tokens(F.col("text")).alias("tokens"), start.alias("from"), end.alias("to"))


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey % 5 <> 0").select("c_custkey")


_MOTIONS = "m AS (SELECT user_id AS clip, list(value ORDER BY ts, event_id) AS motion FROM events GROUP BY user_id)"
_CAPTIONS = """c AS (SELECT conv_id AS clip, turn AS line, text AS caption, CASE WHEN turn % 3 = 0 THEN 0.0::DOUBLE ELSE turn * 0.25::DOUBLE END AS f,
  CASE WHEN turn % 3 = 0 THEN 0.0::DOUBLE ELSE turn * 0.25::DOUBLE + 2.5::DOUBLE END AS t FROM conversations)"""


def _digits(key: str) -> str:
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT)"


def _named_parts(unit: int, source: str = "m") -> str:
    lo, hi = f"CAST(trunc(f * 20 / {unit}) AS INTEGER)", f"CAST(trunc(t * 20 / {unit}) AS INTEGER)"
    return f"""whole AS (SELECT CAST(clip AS VARCHAR) AS name, any_value(motion) AS motion, count(*) AS n_texts FROM {source} JOIN c USING (clip) WHERE f = 0 AND t = 0 GROUP BY clip),
parts AS (SELECT printf('%s_%f_%f', CAST(clip AS VARCHAR), f, t) AS name, motion[{lo} + 1:{hi}] AS motion, 1 AS n_texts FROM {source} JOIN c USING (clip) WHERE NOT (f = 0 AND t = 0) AND {hi} > {lo})"""


def clip_join(spark, sf):
    """Listed clips that have both a motion and captions."""
    m = C.listed(_motions(spark, sf), _ids(spark, sf))
    return C.complete(m, _captions(spark, sf)).groupBy("clip").agg(F.count("*").alias("captions"), F.max(F.size("motion")).alias("frames"))


def clip_audit(spark, sf):
    c = _captions(spark, sf)
    return C.audit(_motions(spark, sf).where("clip % 7 <> 1"), c.withColumn("from", F.when(F.col("line") != 4, F.col("from"))), _ids(spark, sf))


def clip_segments(spark, sf):
    d = C.text_motion(_motions(spark, sf), _captions(spark, sf), FPS, LEAST, BELOW)
    return d.select("name", "place", F.size("motion").alias("frames"), F.size("texts").alias("n_texts"), F.round(F.aggregate("motion", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def clip_pointer(spark, sf):
    return C.by_length(C.whole(_motions(spark, sf), _captions(spark, sf)), 70).select("name", "place", F.size("motion").alias("frames"))


def _codes(spark, sf):
    return _motions(spark, sf).select("clip", F.transform("motion", lambda x: F.floor(x).cast("int")).alias("motion"))


def token_segments(spark, sf):
    d = C.token_motion(_codes(spark, sf), _captions(spark, sf), FPS, UNIT)
    return d.select("name", F.size("motion").alias("n"), F.array_join("motion", " ").alias("codes"), F.size("texts").alias("n_texts"))


def clip_windows(spark, sf):
    return C.windows(_motions(spark, sf), WINDOW).select("clip", F.size("motion").alias("n"), F.col("motion")[0].alias("first"), F.element_at("motion", -1).alias("last"))


def clip_training(spark, sf):
    """Whole clips as a training step sees them."""
    d = C.trained(C.whole(_motions(spark, sf), _captions(spark, sf)), UNIT)
    return d.select("name", F.md5("caption").alias("caption"), F.size("motion").alias("n"), F.get("motion", F.lit(0)).alias("first"), F.size("all_captions").alias("n_texts"))


def codes_shortened(spark, sf):
    d = C.shortened(_codes(spark, sf).select(F.col("clip").cast("string").alias("name"), "motion"))
    return d.select("name", F.array_join("motion", " ").alias("codes"))


def sample_clips(spark, sf):
    return R.sampled(_motions(spark, sf), "clip", 20).select("clip", F.size("motion").alias("frames"))


def repeat_clips(spark, sf):
    return R.repeated(_motions(spark, sf).where("clip < 30").select("clip", F.size("motion").alias("frames")), 4)


def span_corruption(spark, sf):
    """Hidden spans of each clip's frames: exact share, exact number."""
    m = _motions(spark, sf).select("clip", F.size("motion").alias("n")).withColumn("spans", R.corrupted_spans(F.col("n"), "span", F.col("clip")))
    return m.select("clip", "n", F.array_join(F.transform("spans", lambda s: F.concat_ws("+", s["start"].cast("string"), s["n"].cast("string"))), " ").alias("spans"))


def _lengths_sql(items: str, spans: str, salt: str) -> str:
    """Segments as the differences of sorted cuts."""
    drawn = f"list_sort(list_transform(range(1, {items}), lambda i: md5('{salt}:' || clip || ':' || i) || ':' || lpad(CAST(i AS VARCHAR), 9, '0')))[1:{spans} - 1]"
    edges = f"list_concat([0], list_sort(list_transform({drawn}, lambda s: CAST(substr(s, 34, 9) AS INTEGER))), [{items}])"
    return f"list_transform(range(1, {spans} + 1), lambda k: ({edges})[k + 1] - ({edges})[k])"


def zip_shorter(spark, sf):
    """Benchmark passages beside nations in their order, as far as there are both."""
    a = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("k"), F.md5("text").alias("v"))
    b = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return C.zipped(a, b, ["k"], "v")


#: Words with a class of their own.
CLASSES = (("red", "Color"), ("blue", "Color"), ("ring", "Obj"), ("bolt", "Obj"))


def word_vectors(spark, sf):
    """The words of part names as nouns; vectors are there for words of an even length, by that length."""
    tokens = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("nth", "word")).select("p_partkey", "nth", F.concat("word", F.lit("/NOUN")).alias("token"))
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    words = tokens.select(T.word_of(F.col("token")).alias("word")).distinct().where("char_length(word) % 2 = 0")
    vectors = words.join(e, F.char_length("word") == F.col("vec_id")).select("word", "vec").union(e.where("vec_id = 0").select(F.lit("unk"), "vec"))
    out = C.with_vectors(tokens, vectors, spark.createDataFrame(list(CLASSES), "word string, class string"))
    return out.select("p_partkey", "nth", "token", "pos", F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


def _with_gloss(hits: DataFrame, rows: DataFrame) -> DataFrame:
    own = rows.select(F.col("id").alias("c"), "text", F.concat(F.lit("turn "), F.col("id").cast("string")).alias("gloss"))
    return hits.join(own, F.col("id") == F.col("c"))


def prompt_example(spark, sf):
    q, c = Q._asked(spark, sf), Q._spoken(spark, sf)
    return prompts.assembled(q, "id", "text", "example", examples=_with_gloss(Q.example_topk_noleak(spark, sf), c))


def prompt_grammar(spark, sf):
    """Feature tags and the best passage of the benchmark for the hybrid query."""
    q = Q._asked(spark, sf)
    passages = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    asked = q.select("id", prompts.grammar_query(F.lower("text"), "hybrid").alias("text"))
    hits = retrieval.search("tfidf", passages, asked, "id", "id", "text", 1).where("score >= 0.1")
    found = hits.join(passages.select(F.col("id").alias("c"), "text", F.lit("").alias("section"), F.concat(F.lit("passage "), F.col("id").cast("string")).alias("heading")), F.col("id") == F.col("c"))
    return prompts.assembled(q, "id", "text", "grammar", snippets=found)


QUERIES = {f.__name__: f for f in (clip_join, clip_audit, clip_segments, clip_pointer, token_segments, clip_windows, clip_training, codes_shortened, sample_clips, repeat_clips, span_corruption, zip_shorter, word_vectors, prompt_example, prompt_grammar)}

_TOTAL = "round(list_sum(motion), 4)"
_CLASS_CASE = "CASE " + " ".join(f"WHEN word = '{w}' THEN '{c}'" for w, c in CLASSES) + " ELSE 'NOUN' END"

ORACLES = {
    "clip_join": f"WITH {_MOTIONS}, {_CAPTIONS} SELECT clip, count(*) AS captions, CAST(max(len(motion)) AS INTEGER) AS frames FROM m JOIN c USING (clip) WHERE clip IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) GROUP BY clip",
    "clip_audit": f"""WITH {_MOTIONS}, {_CAPTIONS}, i AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0),
h AS (SELECT id, id IN (SELECT clip FROM m WHERE clip % 7 <> 1) AS moved, id IN (SELECT clip FROM c) AS said FROM i)
SELECT count(*) AS ids, count(*) FILTER (WHERE NOT moved) AS without_motion, count(*) FILTER (WHERE moved AND NOT said) AS without_caption, (SELECT count(*) FROM c WHERE line = 4) AS bad_captions FROM h""",
    "clip_segments": f"""WITH {_MOTIONS}, {_CAPTIONS}, own AS (SELECT * FROM m WHERE len(motion) >= {LEAST} AND len(motion) < {BELOW}), {_named_parts(1, 'own')},
d AS (SELECT * FROM whole UNION ALL SELECT * FROM parts WHERE len(motion) >= {LEAST} AND len(motion) < {BELOW})
SELECT name, row_number() OVER (ORDER BY len(motion), name) - 1 AS place, CAST(len(motion) AS INTEGER) AS frames, CAST(n_texts AS INTEGER) AS n_texts, {_TOTAL} AS total FROM d""",
    "clip_pointer": f"WITH {_MOTIONS}, {_CAPTIONS}, {_named_parts(1)}, p AS (SELECT name, row_number() OVER (ORDER BY len(motion), name) - 1 AS place, CAST(len(motion) AS INTEGER) AS frames FROM whole) SELECT * FROM p WHERE frames >= 70",
    "token_segments": f"""WITH m AS (SELECT clip, list_transform(motion, lambda x: CAST(floor(x) AS INTEGER)) AS motion FROM ({_MOTIONS[6:-1]})), {_CAPTIONS}, {_named_parts(UNIT)}, d AS (SELECT * FROM whole UNION ALL SELECT * FROM parts)
SELECT name, CAST(len(motion) AS INTEGER) AS n, array_to_string(motion, ' ') AS codes, CAST(n_texts AS INTEGER) AS n_texts FROM d WHERE len(motion) > 0""",
    "clip_windows": f"""WITH {_MOTIONS}, w AS (SELECT clip, motion, CAST({_digits("'window:' || clip")} % (len(motion) - {WINDOW} + 1) AS INTEGER) AS lo FROM m WHERE len(motion) >= {WINDOW})
SELECT clip, {WINDOW} AS n, motion[lo + 1] AS first, motion[lo + {WINDOW}] AS last FROM w""",
    "clip_training": f"""WITH {_MOTIONS}, {_CAPTIONS}, {_named_parts(1)}, texts AS (SELECT CAST(clip AS VARCHAR) AS name, list(caption ORDER BY line) AS texts FROM c WHERE f = 0 AND t = 0 GROUP BY clip),
s AS (SELECT name, motion, texts, CAST(len(motion) // {UNIT} - CASE WHEN {_digits("'trim:' || name")} % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) * {UNIT} AS size FROM whole JOIN texts USING (name)),
p AS (SELECT *, CAST({_digits("'trim-start:' || name")} % (len(motion) - size + 1) AS INTEGER) AS lo FROM s)
SELECT name, md5(texts[{_digits("'trim-caption:' || name")} % len(texts) + 1]) AS caption, size AS n, motion[lo + 1] AS first, CAST(len(texts) AS INTEGER) AS n_texts FROM p""",
    "codes_shortened": f"""WITH m AS (SELECT CAST(clip AS VARCHAR) AS name, list_transform(motion, lambda x: CAST(floor(x) AS INTEGER)) AS motion FROM ({_MOTIONS[6:-1]}))
SELECT name, array_to_string(CASE WHEN {_digits("'drop:' || name")} % 3 <> 2 THEN motion WHEN {_digits("'drop-end:' || name")} % 2 = 0 THEN motion[1:len(motion) - 1] ELSE motion[2:] END, ' ') AS codes FROM m""",
    "sample_clips": f"WITH {_MOTIONS} SELECT clip, CAST(len(motion) AS INTEGER) AS frames FROM m ORDER BY md5('sample:' || clip), clip LIMIT 20",
    "repeat_clips": f"WITH {_MOTIONS} SELECT clip, CAST(len(motion) AS INTEGER) AS frames, CAST(unnest(range(0, 4)) AS INTEGER) AS replica FROM m WHERE clip < 30",
    "span_corruption": f"""WITH {_MOTIONS}, n AS (SELECT clip, CAST(len(motion) AS INTEGER) AS n FROM m), h AS (SELECT clip, n, CAST(least(greatest(round_even(n * 0.15::DOUBLE, 0), 1), n - 1) AS INTEGER) AS hidden FROM n),
k AS (SELECT *, CAST(greatest(round_even(hidden / 3.0::DOUBLE, 0), 1) AS INTEGER) AS spans FROM h),
l AS (SELECT clip, n, spans, {_lengths_sql('hidden', 'spans', 'span-hidden')} AS dark, {_lengths_sql('(n - hidden)', 'spans', 'span-shown')} AS light FROM k)
SELECT clip, n, array_to_string(list_transform(range(1, spans + 1), lambda k: CAST(list_sum(light[1:k]) + coalesce(list_sum(dark[1:k - 1]), 0) AS BIGINT) || '+' || dark[k]), ' ') AS spans FROM l""",
    "zip_shorter": """WITH a AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS place, md5(text) AS pred FROM benchmark), b AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS place, n_name AS ref FROM nation)
SELECT place, pred, ref FROM a JOIN b USING (place)""",
    "word_vectors": f"""WITH t AS (SELECT p_partkey, unnest(range(0, len(string_split(p_name, ' ')))) AS nth, unnest(string_split(p_name, ' ')) AS word FROM part),
v AS (SELECT word, any_value(embedding) AS vec FROM (SELECT DISTINCT word FROM t WHERE length(word) % 2 = 0) JOIN embeddings ON vec_id = length(word) GROUP BY word)
SELECT p_partkey, CAST(nth AS INTEGER) AS nth, word || '/NOUN' AS token, CASE WHEN v.vec IS NULL THEN 'OTHER' ELSE {_CLASS_CASE} END AS pos,
  round(CAST(coalesce(v.vec, (SELECT embedding FROM embeddings WHERE vec_id = 0))[1] AS DOUBLE), 6) AS first FROM t LEFT JOIN v USING (word)""",
    "prompt_example": f"""WITH e AS ({Q._examples_sql(True)}), {Q._SPOKEN},
g AS (SELECT e.q, string_agg(s.text || ' => turn ' || s.id, ' ;; ' ORDER BY rank) AS hits FROM e JOIN spoken s ON s.id = e.id GROUP BY e.q)
SELECT id, 'translate: ' || {Q.strip_sql('text')} || CASE WHEN hits IS NULL THEN '' ELSE ' [ex] ' || hits END AS prompt FROM asked LEFT JOIN g ON q = id""",
}
