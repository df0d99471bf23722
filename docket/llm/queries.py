"""Registered queries of the training-data operators and their DuckDB twins.

Every query reads whole tables with production parameters.  ``QUERIES`` and
``ORACLES`` are picked up by ``__spark_entry__.py``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm import langid, mixing, secrets, sentencepieces, toxicity
from docket.llm.centroids import cluster_vectors
from docket.llm.common import crc_mod
from docket.llm.exact_dedup import exact_dedup
from docket.llm.line_dedup import dedup_lines
from docket.llm.ngram_join import jaccard_components
from docket.llm.suffix_dedup import dedup_substrings
from docket.llm.token_automaton import token_counts
from docket.llm.topk import topk
from docket.llm.whitening import whiten
from docket.session import read_table

QUERIES = {}
ORACLES: dict[str, str] = {}


#: Wanted token shares of the domains (languages) in the mix.
MIX_WEIGHTS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    """Content of a public SentencePiece model (half a megabyte); it travels to the tasks with the code."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@register("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded, with its round trip and its parity with the sentencepiece library."""
    return sentencepieces.verify(read_table(spark, sf_dir, "documents"), piece_model())


@register("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; learned from text and lang of the documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    net = langid.fit(docs.filter(~held_out))
    return langid.predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; learned from the labels that are not held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels.filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@register("op4_ngram_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id AS reached FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id
FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id""")
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all whole texts: five-word shingles, similarity of 0.8 or more."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))


@register("op5_topk_search", """
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""")
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every vector whose id is divisible by 100, among all other vectors."""
    return topk(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@register("op6_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every whole text; the largest id of each group stays."""
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="max")


@register("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under piece_bpe_32k.model."""
    return token_counts(read_table(spark, sf_dir, "documents"), piece_model(), limit=4096)


@register("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: the rules' spans and those that the network adds."""
    docs = read_table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.fit(docs, least=0.0)))


@register("op7_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
           FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws FROM l),
e AS (SELECT doc_id, line, array_to_string(ws, ' ') AS s, ws, len(ws) AS n, doc_id * 10000000 + line AS place FROM w WHERE len(ws) >= 1),
d AS (SELECT s, any_value(ws) AS ws, any_value(n) AS n, min(place) AS first FROM e GROUP BY s),
v AS (SELECT first, -1 AS pos, s AS v FROM d WHERE n >= 5
      UNION ALL
      SELECT first, p AS pos, array_to_string(list_concat(ws[1:p], ws[p + 2:]), ' ') AS v
      FROM (SELECT first, ws, unnest(range(n)) AS p FROM d WHERE n >= 5)),
near AS (SELECT DISTINCT a.first FROM v a JOIN v b ON a.v = b.v AND b.first < a.first AND (a.pos = b.pos OR a.pos = -1 OR b.pos = -1)),
gone AS (SELECT e.doc_id, e.line, CASE WHEN e.place <> d.first THEN 'exact' ELSE 'near' END AS why
         FROM e JOIN d ON e.s = d.s LEFT JOIN near ON near.first = d.first WHERE e.place <> d.first OR near.first IS NOT NULL),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (why = 'exact') AS n_exact, count(*) FILTER (why = 'near') AS n_near,
             coalesce(string_agg(body, chr(10) ORDER BY l.line) FILTER (why IS NULL), '') AS clean
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.line = gone.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
       sha256(coalesce(clean, '')) AS clean_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id""")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every whole text that repeat an earlier line or are one word edit away from one."""
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    text = F.col("row.text")
    return out.select(F.col("row.doc_id").alias("doc_id"),
                      F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).cast("bigint").alias("n_lines"), "n_exact", "n_near",
                      F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


@register("op10_source_mixing")
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rates whose expected domain tokens have the wanted shares and the natural total."""
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mix(docs, docs, MIX_WEIGHTS, total="natural").drop("th")


@register("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight leading whitened components of all vectors."""
    out = whiten(read_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("bigint"))


@register("op12_suffix_array_dedup", """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT r, h, unnest(range(len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800)),
g AS (SELECT r, i, max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
n AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
s AS (SELECT r, k, min(i) AS s, max(i) + 400 AS e FROM n GROUP BY r, k),
p AS (SELECT r, count(*) AS n_spans, sum(e - s) AS n_removed, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM s GROUP BY r),
c AS (SELECT d.r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept
      FROM (SELECT r, unnest(list_prepend(0, es)) AS a, unnest(list_append(ss, NULL)) AS b0 FROM p) x JOIN d ON d.r = x.r, LATERAL (SELECT coalesce(b0, len(h) // 2) AS b)
      GROUP BY d.r)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(c.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN p ON p.r = d.r LEFT JOIN c ON c.r = d.r""")
def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text that lie in a 400-byte string found anywhere else."""
    out = dedup_substrings(read_table(spark, sf_dir, "documents"), 400)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def _clusters_sql(rounds: int = 3) -> str:
    """Assignment and update steps written out one after the other."""
    nearest = """(SELECT rid, vec_id, q, cluster, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) AS r FROM (
    SELECT v.rid, v.vec_id, v.q, c.cluster, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.q, c.q)]) AS BIGINT) AS distance FROM v, {c} c)) WHERE r = 1)"""
    steps = ["""v AS (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, q FROM v QUALIFY cluster < 16)"""]
    for i in range(1, rounds + 1):
        steps.append(f"""a{i} AS {nearest.format(c=f"c{i - 1}")},
s{i} AS (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
  SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{i}) GROUP BY cluster, i),
m{i} AS (SELECT cluster, list((s - ((s % n + n) % n)) // n ORDER BY i) AS q FROM s{i} GROUP BY cluster),
c{i} AS (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{i - 1} c LEFT JOIN m{i} m ON m.cluster = c.cluster)""")
    return "WITH " + ",\n".join(steps) + f""",
z AS {nearest.format(c=f"c{rounds}")}
SELECT z.vec_id, CAST(z.cluster AS INTEGER) AS cluster, z.distance,
       CAST(sum(z.distance) OVER (PARTITION BY z.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(z.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM z JOIN c{rounds} c ON c.cluster = z.cluster"""


@register("op13_centroid_clustering", _clusters_sql())
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen centroids after three rounds, every vector with its cluster and exact distance."""
    out = cluster_vectors(read_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", *[F.col(c).try_cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], "centroid_sha256")
