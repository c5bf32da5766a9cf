"""Queries over texts: cleaning, splitting, lexicon, retrieval, chunking, context and text metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velora.functions import text as T
from velora.operators import chunking, corpus, lexicon, metrics, retrieval
from velora.sources.staging import staged

W = T.SPACE


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{W}]+|[{W}]+$', '', 'g')"


def key_sql(x: str) -> str:
    return f"regexp_replace({x}, '[{W}{_IGNORED}]+', '', 'g')"


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{W}]+'), lambda t: t <> '')"


def plain_sql(x: str) -> str:
    return f"regexp_replace({x}, '[\\[\\]{{}}()<>]', '', 'g')"


def lemma_sql(x: str) -> str:
    return f"regexp_replace({strip_sql(plain_sql(x))}, '[0-9]+$', '')"


def bucket_sql(x: str) -> str:
    return f"CAST(('0x' || substr(md5('42:' || {x}), 1, 8)) AS BIGINT) / 4294967295.0"


_IGNORED = T.IGNORED.replace("'", "''")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.canonical(corpus.require(table(spark, sf, "documents"), ["text"]), {"doc_id": "file_id", "text": "text", "source": "gloss", "lang": "lang"})
    return corpus.keep_first(corpus.cleaned(docs, ["text", "gloss"]), ["text", "gloss"], "file_id")


_CLEAN = f"""clean AS (SELECT file_id, text, gloss, lang FROM (SELECT *, row_number() OVER (PARTITION BY text, gloss ORDER BY file_id, lang) AS k FROM (
  SELECT doc_id AS file_id, {strip_sql('text')} AS text, {strip_sql('source')} AS gloss, lang FROM documents) WHERE text <> '' AND gloss <> '') WHERE k = 1)"""
_SPLIT = f"split AS (SELECT *, CASE WHEN b < 0.05 THEN 'test' WHEN b < 0.1 THEN 'valid' ELSE 'train' END AS split FROM (SELECT *, {bucket_sql(key_sql('text'))} AS b FROM clean))"


def clean_dedup_split(spark, sf):
    return corpus.split(_clean(spark, sf), "text").groupBy("split", "lang").agg(F.count("*").alias("n"))


def split_no_leak(spark, sf):
    rows = corpus.split(_clean(spark, sf), "text").select(F.md5(T.comparison_key(F.col("text"))).alias("key"), "split")
    return rows.groupBy("key").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).agg(F.count("*").alias("n_keys"), F.sum(F.when(F.col("lo") != F.col("hi"), 1).otherwise(0)).alias("n_leaks"))


def dedup_first(spark, sf):
    return _clean(spark, sf).select("file_id", "gloss", F.md5("text").alias("text_md5"))


def norm_dedup_key(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.groupBy(F.md5(T.comparison_key(F.col("text"))).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def id_autonumber(spark, sf):
    return corpus.numbered(table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])


def token_vocab_minfreq(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null").select(T.tokens(F.lower("text")).alias("words"))
    return corpus.vocabulary(docs, "words", 10)


def feature_tags(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    flags = docs.groupBy(T.feature_flags(F.col("text")).alias("flags")).agg(F.count("*").alias("n"))  # 2**11 groups at most
    return flags.groupBy(F.array_join(T.tags_of(F.col("flags")), "+").alias("tags"), T.query_of(F.col("flags")).alias("terms")).agg(F.sum("n").alias("n"))


_TAGS = "concat_ws('+', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p, _ in T.FEATURES) + ")"
_TERMS = "concat_ws(' ', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{t}' END" for _, p, t in T.FEATURES) + ")"


def gloss_lemma(spark, sf):
    parts = table(spark, sf, "part").select(F.explode(T.tokens(F.concat_ws(" ", "p_name", F.concat(F.lit("["), F.col("p_brand"), F.lit("]"))))).alias("t"))
    return parts.groupBy(T.lemma(F.col("t")).alias("lemma")).agg(F.count("*").alias("n"), F.count_distinct("t").alias("forms"))


def _turn_pairs(spark, sf):
    """A turn with the next of its conversation: an equi-join, so a long conversation is no hot partition of a window."""
    c = table(spark, sf, "conversations").where("text is not null")
    after = c.select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"), F.col("text").alias("gloss"))
    return c.join(after, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2"))).select("conv_id", "turn", "text", "gloss")


_TURNS = "turns AS (SELECT a.conv_id, a.turn, a.text, b.text AS gloss FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL)"
_PLAIN = plain_sql("text")
_LEX = rf"""hits AS (SELECT stem, gloss, CASE WHEN contains(plain, stem) THEN 10 WHEN contains(plain, substr(stem, 1, 2)) THEN 3 END AS w FROM (
  SELECT plain, gloss, {lemma_sql('gloss')} AS stem FROM (SELECT {_PLAIN} AS plain, unnest({tokens_sql('gloss')}) AS gloss FROM turns)) WHERE length(stem) >= 2),
lex AS (SELECT stem, gloss, CAST(floor(sum(w) / 10.0) AS BIGINT) AS weight FROM hits WHERE w IS NOT NULL GROUP BY stem, gloss HAVING sum(w) >= 10),
best AS (SELECT stem, gloss, weight FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY weight DESC, gloss) AS k FROM lex) WHERE k = 1)"""


def lexicon_build(spark, sf):
    return lexicon.build(_turn_pairs(spark, sf), "text", "gloss")


def lexicon_best(spark, sf):
    return lexicon.best(lexicon_build(spark, sf))


def lexicon_pairs(spark, sf):
    return lexicon.matches(table(spark, sf, "benchmark"), lexicon_best(spark, sf), "item_id", "text").select("item_id", "stem", "gloss", "at")


def lexicon_lookup(spark, sf):
    return lexicon.lookup(table(spark, sf, "benchmark"), lexicon_build(spark, sf), "item_id", "text")


def _spoken(spark, sf):
    c = table(spark, sf, "conversations").where("text is not null")
    return c.groupBy("text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("id"))


def _asked(spark, sf):
    """Every conversation turn whose id is divisible by 100, whatever other turns say the same, and the benchmark's passages."""
    c = table(spark, sf, "conversations").where("text is not null")
    own = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text").where(F.col("id") % 100 == 0)
    return own.union(table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text"))


_SPOKEN = "spoken AS (SELECT min(conv_id * 1000 + turn) AS id, text FROM conversations WHERE text IS NOT NULL GROUP BY text), asked AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE text IS NOT NULL AND (conv_id * 1000 + turn) % 100 = 0 UNION ALL SELECT -1 - item_id, text FROM benchmark)"


def _grams_sql(name: str, src: str) -> str:
    padded = f"(SELECT id, ' ' || unnest({tokens_sql('lower(text)')}) || ' ' AS w FROM {src})"
    return f"""{name}_g AS (SELECT id, unnest(g) AS term FROM (SELECT id, list_concat(
    list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)),
    CASE WHEN length(w) >= 4 THEN list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)) ELSE [] END) AS g FROM {padded})),
{name}_c AS (SELECT id, term, 1 + ln(count(*)) AS tf FROM {name}_g GROUP BY id, term)"""


_TFIDF = f"""{_SPOKEN}, {_grams_sql('c', 'spoken')}, {_grams_sql('q', 'asked')},
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM spoken)) / (1 + count(*))) + 1 AS idf FROM c_c GROUP BY term),
c_w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (SELECT id, term, tf * idf AS w FROM c_c JOIN idf USING (term))),
q_w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (SELECT id, term, tf * idf AS w FROM q_c JOIN idf USING (term))),
s AS (SELECT q_w.id AS q, c_w.id, round(sum(q_w.weight * c_w.weight), 6) AS score FROM q_w JOIN c_w USING (term) GROUP BY 1, 2),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 12 AND score >= 0.1)"""


def char_tfidf_weights(spark, sf):
    rows, _ = retrieval.tfidf_rows(_spoken(spark, sf), "id", "text")
    total = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
    return rows.select("id", F.size("terms").cast("long").alias("n_terms"), F.round(F.array_max("weights"), 6).alias("top_weight"), F.round(total, 6).alias("sum_weight"))


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    """What is spoken and what is asked, each written once."""
    return staged(_spoken(spark, sf), "spoken"), staged(_asked(spark, sf), "asked")


def _examples(c: DataFrame, q: DataFrame, exclude: bool):
    return retrieval.examples(retrieval.tfidf_top(c, q, "id", "id", "text", 2 + 10), c, q, "id", "id", "text", exclude_copies=exclude)


def example_topk(spark, sf):
    return _examples(*_sides(spark, sf), False)


def example_topk_noleak(spark, sf):
    return _examples(*_sides(spark, sf), True)


def _examples_sql(exclude: bool) -> str:
    leak = f"AND {key_sql('c.text')} <> {key_sql('a.text')} AND score < 0.95" if exclude else ""
    return f"""WITH {_TFIDF},
h AS (SELECT t.q, t.id, t.score, t.rank, {key_sql('c.text')} AS key FROM t JOIN spoken c ON c.id = t.id JOIN asked a ON a.id = t.q WHERE true {leak}),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, key ORDER BY rank) AS nth FROM h) WHERE nth = 1),
p AS (SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY rank) AS INTEGER) AS rank, id, score FROM o)
SELECT * FROM p WHERE rank <= 2"""


def context_assembly(spark, sf):
    """Prompt of each asked text: prefix and text, then lexicon hints, similar examples and feature tags, each only if there is one.

    Hints and examples are each written before they meet: the driver then holds their plans one after another, not one plan with both."""
    c, q = _sides(spark, sf)
    hits = staged(_examples(c, q, True), "hits").join(c.select(F.col("id").alias("c"), F.col("text").alias("hit")), F.col("id") == F.col("c"))
    hits = hits.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hit"))), lambda z: z["hit"]), " ;; ").alias("examples")).withColumnRenamed("q", "e_id")
    hits = staged(hits, "examples")
    hints = lexicon.lookup(q, lexicon_build(spark, sf), "id", "text", 12).select(F.col("id").alias("h_id"), F.array_join("hints", " ").alias("hints"))
    hints = staged(hints, "hints")
    tags = F.array_join(T.feature_tags(F.col("text")), " ")
    rows = q.join(hits, F.col("id") == F.col("e_id"), "left").join(hints, F.col("id") == F.col("h_id"), "left")
    marked = lambda mark, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(mark), x)).otherwise("")
    prompt = F.concat(F.lit("translate: "), T.strip(F.col("text")), marked(" [lex] ", F.col("hints")), marked(" [ex] ", F.col("examples")), marked(" [feat] ", tags))
    return rows.select("id", prompt.alias("prompt"))


def _pages(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "raw"))


def page_clean(spark, sf):
    p = _pages(spark, sf).withColumn("c", chunking.clean_page("raw"))
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.char_length("c.text")).alias("chars"))


def chunk_merge(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(chunking.merge_paragraphs(F.split("text", "\n", -1))).alias("k", "text")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.avg(F.char_length("text")).alias("mean_chars"))


def chunks(spark, sf):
    return chunking.chunks(_pages(spark, sf), "doc_id", first_page=0).select("doc_id", "chunk", "page", "heading", "n_chars")


def carry_forward(spark, sf):
    c = table(spark, sf, "conversations")
    last = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("conv_id", "turn", F.coalesce(F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(last), F.lit(-1)).alias("last_user_turn"))


def chunk_number(spark, sf):
    c = table(spark, sf, "conversations").where(F.char_length("text") >= 80)
    return corpus.numbered(c.select("conv_id", "turn"), ["conv_id", "turn"], "chunk_id", "g%05d")


def seq_scores(spark, sf):
    return metrics.sequence_scores(_turn_pairs(spark, sf), "gloss", "text")


def seq_token_f1(spark, sf):
    p = _turn_pairs(spark, sf).select("conv_id", "turn", T.tokens(F.col("gloss")).alias("p"), T.tokens(F.col("text")).alias("r"))
    return p.select("conv_id", "turn", (F.col("p") == F.col("r")).cast("int").alias("same"), F.size("p").alias("pred_len"), F.size("r").alias("ref_len"), F.round(metrics.token_f1(F.col("p"), F.col("r")), 6).alias("f1"))


def bleu_counts(spark, sf):
    p = _turn_pairs(spark, sf).withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    return metrics.clipped_ngrams(p, "k", "gloss", "text", 4)


_BLEU = f"WITH {_TURNS}, k AS (SELECT conv_id * 1000 + turn AS k, {tokens_sql('gloss')} AS p, {tokens_sql('text')} AS r FROM turns) " + " UNION ALL ".join(
    f"""SELECT CAST(sum(least(a, coalesce(b, 0))) AS BIGINT) AS matched, CAST(sum(a) AS BIGINT) AS total, {n} AS n FROM
(SELECT k, g, count(*) AS a FROM (SELECT k, unnest(list_transform(range(1, len(p) - {n} + 2), lambda i: array_to_string(p[i:i + {n} - 1], ' '))) AS g FROM k) GROUP BY k, g) x LEFT JOIN
(SELECT k, g, count(*) AS b FROM (SELECT k, unnest(list_transform(range(1, len(r) - {n} + 2), lambda i: array_to_string(r[i:i + {n} - 1], ' '))) AS g FROM k) GROUP BY k, g) y USING (k, g)"""
    for n in (1, 2, 3, 4)
)

QUERIES = {f.__name__: f for f in (clean_dedup_split, split_no_leak, dedup_first, norm_dedup_key, id_autonumber, token_vocab_minfreq, feature_tags, gloss_lemma, lexicon_build, lexicon_best, lexicon_pairs, lexicon_lookup, char_tfidf_weights, example_topk, example_topk_noleak, context_assembly, page_clean, chunk_merge, chunks, carry_forward, chunk_number, seq_scores, seq_token_f1, bleu_counts)}

ORACLES = {
    "clean_dedup_split": f"WITH {_CLEAN}, {_SPLIT} SELECT split, lang, count(*) AS n FROM split GROUP BY split, lang",
    "split_no_leak": f"WITH {_CLEAN}, {_SPLIT} SELECT count(*) AS n_keys, CAST(sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END) AS BIGINT) AS n_leaks FROM (SELECT {key_sql('text')} AS key, min(split) AS lo, max(split) AS hi FROM split GROUP BY 1)",
    "dedup_first": f"WITH {_CLEAN} SELECT file_id, gloss, md5(text) AS text_md5 FROM clean",
    "norm_dedup_key": f"SELECT md5({key_sql('text')}) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "id_autonumber": "SELECT conv_id, turn, 'auto' || lpad(CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS VARCHAR), 7, '0') AS file_id FROM conversations",
    "token_vocab_minfreq": f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens_sql('lower(text)')}) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token HAVING count(*) >= 10",
    "feature_tags": f"SELECT {_TAGS} AS tags, CASE WHEN {_TERMS} = '' THEN '{T.NO_FEATURE}' ELSE {_TERMS} END AS terms, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2",
    "gloss_lemma": f"SELECT {lemma_sql('t')} AS lemma, count(*) AS n, count(DISTINCT t) AS forms FROM (SELECT unnest({tokens_sql("(p_name || ' [' || p_brand || ']')")}) AS t FROM part) GROUP BY 1",
    "lexicon_build": f"WITH {_TURNS}, {_LEX} SELECT stem, gloss, weight FROM lex",
    "lexicon_best": f"WITH {_TURNS}, {_LEX} SELECT stem, gloss, weight FROM best",
    "lexicon_pairs": f"WITH {_TURNS}, {_LEX} SELECT item_id, stem, gloss, CAST(instr({_PLAIN}, stem) AS INTEGER) AS at FROM benchmark JOIN best ON contains({_PLAIN}, stem)",
    "char_tfidf_weights": f"WITH {_TFIDF} SELECT id, count(*) AS n_terms, round(max(weight), 6) AS top_weight, round(sum(weight), 6) AS sum_weight FROM c_w GROUP BY id",
    "example_topk": _examples_sql(False),
    "example_topk_noleak": _examples_sql(True),
    "carry_forward": "SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS last_user_turn FROM conversations",
    "chunk_number": "SELECT conv_id, turn, 'g' || lpad(CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS VARCHAR), 5, '0') AS chunk_id FROM conversations WHERE length(text) >= 80",
    "seq_token_f1": f"""WITH {_TURNS}, k AS (SELECT conv_id, turn, {tokens_sql('gloss')} AS p, {tokens_sql('text')} AS r FROM turns),
o AS (SELECT *, list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))) AS o FROM k)
SELECT conv_id, turn, CAST(p = r AS INTEGER) AS same, CAST(len(p) AS INTEGER) AS pred_len, CAST(len(r) AS INTEGER) AS ref_len, round(CASE WHEN coalesce(o, 0) = 0 THEN 0.0 ELSE 2 * (o / len(p)) * (o / len(r)) / (o / len(p) + o / len(r)) END, 6) AS f1 FROM o""",
    "bleu_counts": _BLEU,
}
