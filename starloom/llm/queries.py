"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import (
    collocations, compression_quality, dart_minhash, decontaminate, importance_resampling, line_rules, packing, ppm_language,
    skip_chain_pii, threshold_search, token_file, token_rollup, toxicity_neighbours,
)
from starloom.llm.batches import held_out, store
from starloom.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Texts reach Python workers in batches of this size unless the session says otherwise: memory of a worker and of
#: Arrow buffers follows it, not the number of rows.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def with_library(spark: SparkSession) -> None:
    """Lets Python workers import the library where it is not installed, and bounds the batches they get."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, environment.get("PYTHONPATH")]))


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with_library(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where(~held_out("doc_id", 5, 0))
    model = compression_quality.train(docs.select("doc_id", "text"), known, "quality")
    scored = compression_quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


@query
def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_file.token_file_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *line_rules.COUNTS, "base_failed", "kept")


@query
def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in; a third moves to another tokenizer, a fifth is cleaned of symbols and a seventh
    is deleted, each as a batch of changes; one batch is sent twice, one after a snapshot."""
    docs, clean = table(spark, sf_dir, "documents"), F.regexp_replace("text", r"[#*$%&|<>]+", " ")
    words, runs = token_rollup.WORDS, token_rollup.RUNS
    moved = F.col("doc_id") % 3 == 0
    counted = store(docs.select(
        "doc_id", "source", "lang",
        token_rollup.count_tokens("text", words).alias("words"), token_rollup.count_tokens("text", runs).alias("runs"),
        F.when(F.col("doc_id") % 5 == 1, F.when(moved, token_rollup.count_tokens(clean, runs)).otherwise(
            token_rollup.count_tokens(clean, words))).alias("cleaned"),
    ), "token_counts")
    now = F.when(moved, F.col("runs")).otherwise(F.col("words"))
    of = F.when(moved, runs).otherwise(words)

    def change(rows: DataFrame, op: str, tokenizer, n, old=None) -> DataFrame:
        tokenizer = F.lit(tokenizer) if isinstance(tokenizer, str) else tokenizer
        return rows.select(
            F.lit(op).alias("op"), "source", "lang", tokenizer.alias("tokenizer"), n.alias("n_tokens"),
            (F.lit(None).cast("long") if old is None else old).alias("old_n_tokens"),
        )

    rollup = token_rollup.Rollup(spark, f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/rollup")
    rollup.commit("1-load", change(counted, "insert", words, F.col("words")))
    move = change(counted.where(moved), "delete", words, F.col("words")).union(
        change(counted.where(moved), "insert", runs, F.col("runs"))
    )
    rollup.commit("2-move", move)
    rollup.compact()
    rollup.commit("2-move", move)
    rollup.commit("3-clean", change(counted.where("doc_id % 5 = 1"), "revise", of, F.col("cleaned"), now))
    rollup.commit("4-delete", change(counted.where("doc_id % 7 = 2"), "delete", of, F.coalesce("cleaned", now)))
    return rollup.totals()


@query
def op9_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity_neighbours.train(docs.select("doc_id", "text"), labels.where(~held_out("doc_id", 5, 0)))
    scored = toxicity_neighbours.score(docs.select("doc_id", "text"), index)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", "neighbours")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = dart_minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_size")


@query
def op7_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return skip_chain_pii.digests(skip_chain_pii.find_pii(docs))


@query
def op6_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 4, 2))
    model = ppm_language.train(docs.where("not held_out").select("lang", "text"))
    return ppm_language.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return threshold_search.top_k(vectors.where("vec_id % 50 = 0"), vectors)


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op10_decontamination"] = f"""
WITH dw AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
iw AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
qs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw)),
n AS (SELECT item_id, count(*) AS item_shingles FROM qs GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN qs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles::DOUBLE AS containment
FROM hit JOIN n USING (item_id) WHERE shared / item_shingles::DOUBLE >= {decontaminate.CONTAINMENT}
"""

ORACLES["op8_token_rollup"] = rf"""
WITH d AS (SELECT source, lang, CASE WHEN doc_id % 3 = 0 THEN '{token_rollup.RUNS}' ELSE '{token_rollup.WORDS}' END AS tokenizer,
                  CASE WHEN doc_id % 5 = 1 THEN regexp_replace(coalesce(text, ''), '[#*$%&|<>]+', ' ', 'g')
                       ELSE coalesce(text, '') END AS t
           FROM documents WHERE doc_id % 7 != 2 OR doc_id IS NULL)
SELECT source, lang, tokenizer, count(*) AS n_docs,
       sum(CASE WHEN tokenizer = '{token_rollup.RUNS}' THEN len(regexp_extract_all(t, '{token_rollup.PATTERNS[token_rollup.RUNS]}'))
                ELSE len(regexp_extract_all(t, '{token_rollup.PATTERNS[token_rollup.WORDS]}')) END)::BIGINT AS n_tokens
FROM d GROUP BY source, lang, tokenizer
"""

ORACLES["op11_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w[i:i + m - 1] AS g, count(*) AS f
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT lang, g, f AS a FROM g WHERE len(g) > 1 AND f >= 100),
cut AS (SELECT c.lang, c.g, c.a, n.n, k, x.f AS l, y.f AS r,
               ((1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
        FROM (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c) c JOIN n USING (lang)
        JOIN g x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN g y ON y.lang = c.lang AND y.g = c.g[k + 1:len(c.g)]),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
held AS (SELECT DISTINCT lang, g[i:i + m - 1] AS g, max(a) AS longest
         FROM (SELECT lang, g, a, m, unnest(range(1, len(g) - m + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS m) WHERE m < len(g))
         GROUP BY ALL)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, encode(array_to_string(low.g, ' '))) AS rank,
       array_to_string(low.g, ' ') AS phrase, a, l, r, n, score
FROM low LEFT JOIN held ON held.lang = low.lang AND held.g = low.g
WHERE longest IS NULL OR 100 * longest < 100 * a
QUALIFY row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, encode(array_to_string(low.g, ' '))) <= 2000
"""

ORACLES["op12_threshold_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id != c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER w::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

#: crc32 by the table of its byte steps; every distinct feature is hashed once.
ORACLES["op13_importance_resampling"] = r"""
WITH bytes AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, j:
                 CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))),
texts AS (SELECT 'd' AS side, doc_id, sha256('7:' || doc_id) AS h, coalesce(text, '') AS text FROM documents
          UNION ALL SELECT 't', NULL, NULL, coalesce(text, '') FROM benchmark),
words AS (SELECT row_number() OVER () AS id, side, doc_id, h, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feature AS (SELECT id, side, f, count(*) AS c FROM (SELECT id, side, array_to_string(w[i:i + m - 1], ' ') AS f
              FROM (SELECT id, side, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest([1, 2]) AS m))) GROUP BY ALL),
coded AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM feature)),
hashed AS (SELECT f, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
                       lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM coded, bytes),
counted AS (SELECT bucket, coalesce(sum(c) FILTER (side = 'd'), 0) AS s, coalesce(sum(c) FILTER (side = 't'), 0) AS t
            FROM feature JOIN hashed USING (f) GROUP BY bucket),
total AS (SELECT sum(s) AS s, sum(t) AS t FROM counted),
gain AS (SELECT bucket, floor(1000 * ln(((counted.t + 1) * (total.s + 10000))::DOUBLE / ((counted.s + 1) * (total.t + 10000))::DOUBLE))::BIGINT AS g
         FROM counted, total),
weighed AS (SELECT id, sum(c)::BIGINT AS n_features, floor(sum(c * g)::DOUBLE / sum(c)::DOUBLE)::BIGINT AS weight
            FROM feature JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS may,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || h[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
           FROM words LEFT JOIN weighed USING (id) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS pos, sum(may::INT) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND pos <= 25 * n // 100 THEN pos END AS rank FROM ranked
"""
