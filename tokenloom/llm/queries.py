"""One query for each operator, on its whole table and with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import (
    bitplanes,
    bpe,
    descent,
    language,
    lines,
    merkle,
    mixing,
    neighbours,
    pii,
    simhash,
    substrings,
    token_counts,
    token_files,
    word_bpe,
)
from tokenloom.llm.common import documents, ready
from tokenloom.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = word_bpe.default_path()
    docs = documents(spark, sf_dir, "doc_id", "text")
    coded = bpe.round_trip(docs, path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return token_counts.count_tokens(docs, word_bpe.default_path()).drop("text")


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    return mixing.mix(docs, weights=(5, 2, 1), cap=3.0)



def held_out():
    """Rows kept out of learning: crc32 of the id, as text, leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    filters = language.fit(docs, ~held_out())
    return language.identify(docs.withColumn("held_out", held_out()).drop("lang"), filters).drop("text")


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = simhash.groups(docs, words=3, max_bits=2)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


@query
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours.search(table, F.col("vec_id") % 20 == 0, k=20)


@query
def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = pii.report(docs, disclosure=0.8, chance=0.05)
    base = pii.joined(F.filter("spans", lambda s: s["kind"] < pii.TERM))
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in pii.KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    kept = substrings.dedup(docs, window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    kept = lines.drop_lines(docs, edits=2, min_chars=20)
    return kept.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


@query
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return descent.near_duplicates(table, threshold=0.9)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars", "text")
    return merkle.verified(docs)


@query
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return bitplanes.cluster(table, k=16, rounds=3, seed=1, scale=64)


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_folder(spark, "token-files")
    docs = documents(spark, sf_dir, "doc_id", "text")
    token_files.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    found = token_files.read(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# --- the queries as SQL, where SQL can express them ----------------------------------------------

ORACLES["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_extract([5.0::DOUBLE, 2.0, 1.0],
                      1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) AS weight
  FROM sized GROUP BY source),
caps AS (SELECT *, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / weight AS full_at FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (
           ORDER BY full_at, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY full_at, source NULLS FIRST
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps),
target AS (
  SELECT source, source_size, least(most, coalesce((
           SELECT arg_min(level, full_at) FROM levels WHERE level <= full_at) * weight, most)) AS target
  FROM levels),
budget AS (
  SELECT *, round(target)::BIGINT // nullif(source_size, 0) AS epochs,
         round(target)::BIGINT % nullif(source_size, 0) AS rest FROM target),
run AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, coalesce(b.epochs, 0) AS epochs, coalesce(b.rest, 0) AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key) - s.size AS before
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM run"""

_VECTORS = """v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

ORACLES["op4_nearest_neighbours"] = f"""
WITH {_VECTORS}, scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

ORACLES["op6_embedding_near_dedup"] = f"""
WITH RECURSIVE {_VECTORS}, links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
  SELECT a AS id, a AS c FROM links UNION SELECT l.a, r.c FROM reach r JOIN links l ON l.b = r.id),
named AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links,
       coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN named ON id = vec_id"""

ORACLES["op7_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
windows AS (
  SELECT doc_id, i, w, count(*) OVER f AS n, string_agg(w, ' ') OVER f AS s FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
judged AS (
  SELECT doc_id, i, w,
         n = 20 AND row_number() OVER (PARTITION BY n = 20, s ORDER BY doc_id, i) > 1 AS again FROM windows),
marked AS (
  SELECT doc_id, i, w, bool_or(again) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM judged),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS text
  FROM marked GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)"""

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
                               lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def _climb(name: str, leaves: str) -> str:
    """Nodes of all levels over ``tree, pos, digest``, and the steps from each leaf to its top."""
    return f"""{name}_nodes AS (
  SELECT tree, 0 AS level, pos, digest, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3
  FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, pos // 3, n),
{name}_steps AS (
  SELECT l.tree, l.pos, x.level, string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < l.pos // (3 ** x.level)::BIGINT) AS "left",
         string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > l.pos // (3 ** x.level)::BIGINT) AS "right"
  FROM {leaves} l JOIN {name}_nodes x
    ON l.tree = x.tree AND x.n > 1 AND x.pos // 3 = l.pos // (3 ** (x.level + 1))::BIGINT
  GROUP BY l.tree, l.pos, x.level)"""


ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_LEAF} || {_FIELD.format("text")}) AS digest,
         CASE WHEN {_CRC} % 2 = 0 THEN sha256({_LEAF} || {_FIELD.format("replace(text, chr(10), '')")})
              ELSE sha256({_LEAF} || {_FIELD.format("text")}) END AS changed,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
  FROM documents),
{_climb("doc", "leaves")},
subroots AS (
  SELECT '' AS tree, tree AS source, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos
  FROM doc_nodes WHERE n = 1),
{_climb("source", "subroots")},
steps AS (
  SELECT tree, pos, level, "left", "right" FROM doc_steps
  UNION ALL
  SELECT l.tree, l.pos, 1000 + u.level, u."left", u."right"
  FROM leaves l JOIN subroots s ON s.source = l.tree JOIN source_steps u ON u.pos = s.pos),
placed AS (
  SELECT tree, pos, coalesce("left", '') AS "left", coalesce("right", '') AS "right",
         row_number() OVER (PARTITION BY tree, pos ORDER BY level) AS i FROM steps),
proofs AS (SELECT tree, pos, sha256(string_agg("left" || "right", '' ORDER BY i)) AS proof FROM placed GROUP BY tree, pos),
folds AS (
  SELECT tree, pos, 0::BIGINT AS i, changed AS digest FROM leaves
  UNION ALL
  SELECT f.tree, f.pos, p.i, sha256(p."left" || f.digest || p."right")
  FROM folds f JOIN placed p ON p.tree = f.tree AND p.pos = f.pos AND p.i = f.i + 1),
folded AS (SELECT tree, pos, arg_max(digest, i) AS digest FROM folds GROUP BY tree, pos)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, r.digest AS root,
       coalesce(p.proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM leaves l JOIN subroots s ON s.source = l.tree JOIN folded f ON f.tree = l.tree AND f.pos = l.pos
LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos,
(SELECT digest FROM source_nodes WHERE n = 1) r"""


def _assign(i: int) -> str:
    """Nearest centroids, then the centroids that follow from them."""
    return f"""a{i} AS (
  SELECT vec_id, any_value(x) AS x, min(d) AS d, arg_min(c, d * 16 + c) AS c FROM (
    SELECT x.vec_id, x.x, y.c,
           list_sum(list_transform(list_zip(x.x, y.y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM scaled x, c{i} y) GROUP BY vec_id)"""


def _move(i: int) -> str:
    return f"""c{i + 1} AS (
  SELECT c, coalesce(m.y, o.y) AS y FROM c{i} o LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM (
      SELECT c, i, sum(v)::BIGINT AS s, count(*) AS n
      FROM (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY c, i)
    GROUP BY c) m USING (c))"""


ORACLES["op12_centroid_clusters"] = f"""
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, x AS y
  FROM (SELECT x, sha256('1:' || vec_id) AS h FROM scaled ORDER BY h LIMIT 16)),
{", ".join(f"{_assign(i)}, {_move(i)}" for i in range(3))}, {_assign(3)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c)"""
