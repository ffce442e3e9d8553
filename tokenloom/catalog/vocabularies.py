"""Named queries on words, symbols and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog import sqltext as q
from tokenloom.catalog.documents import documents
from tokenloom.catalog.registry import query
from tokenloom.functions import text
from tokenloom.operators import vocab

# RE2 has no look-ahead. A whitespace run before a word gives up its last character to the word, so
# the twin first marks that place with a private-use character and then splits without look-ahead.
_SPACE = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_SPACE = _SPACE.replace("[", "[^", 1)
_MARK = r"\x{e000}"
_PIECES = (
    r"''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?"
    + _NOT_SPACE[:-1]
    + r"\p{L}\p{N}"
    + _MARK
    + r"]+|"
    + _SPACE
    + "+"
)
_WORDS = f"""words AS (
  SELECT unnest(regexp_extract_all(
    regexp_replace(text, '({_SPACE})({_SPACE}{_NOT_SPACE})', '\\1' || chr(57344) || '\\2', 'g'),
    '{_PIECES}')) AS word FROM documents),
counted AS (SELECT word, count(*)::BIGINT AS n FROM words GROUP BY word)"""
_PAIRS = f"""{_WORDS}, spelled AS (
  SELECT {q.byte_ids('word')} AS ids, n FROM counted),
pairs AS (
  SELECT ids[i]::INT AS "left", ids[i + 1]::INT AS "right", sum(n)::BIGINT AS n
  FROM (SELECT ids, n, unnest(range(1, len(ids))) AS i FROM spelled) GROUP BY 1, 2)"""


@query(f"WITH {_WORDS} SELECT word, n FROM counted")
def word_counts(spark, sf_dir):
    return vocab.word_counts(documents(spark, sf_dir))


@query(
    f"""SELECT ({q.symbol('h')})::INT AS id, count(*)::BIGINT AS n
    FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY 1"""
)
def byte_token_counts(spark, sf_dir):
    return vocab.byte_token_counts(documents(spark, sf_dir))


def _pairs(spark, sf_dir):
    counts = vocab.word_counts(documents(spark, sf_dir))
    return vocab.pair_counts(counts.select(vocab.as_symbols(F.col("word")).alias("syms"), "n"))


def _split_pair(pairs):
    side = lambda i: vocab.symbol_id(F.substring("pair", i, 1))
    return pairs.select(side(1).alias("left"), side(2).alias("right"), "n")


@query(f'WITH {_PAIRS} SELECT "left", "right", n FROM pairs')
def pair_counts(spark, sf_dir):
    return _split_pair(_pairs(spark, sf_dir))


@query(f'WITH {_PAIRS} SELECT "left", "right", n FROM pairs ORDER BY n DESC, 1, 2 LIMIT 20')
def bpe_first_merge(spark, sf_dir):
    return _split_pair(vocab.best_pairs(_pairs(spark, sf_dir), 20))


@query(
    f"""SELECT doc_id, (len(ids) + 1)::INT AS n, sha256({q.joined('list_concat(ids, [1])')}) AS ids
    FROM (SELECT doc_id, {q.byte_ids(q.neutral('text'))} AS ids FROM documents)"""
)
def byte_encode(spark, sf_dir):
    ids = text.with_eos(text.byte_ids(text.neutralize(F.col("text"))))
    rows = documents(spark, sf_dir).select("doc_id", ids.alias("ids"))
    return rows.select(
        "doc_id",
        F.size("ids").alias("n"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids"),
    )


@query("SELECT doc_id, sha256(text) AS digest, true AS same FROM documents")
def decode_roundtrip(spark, sf_dir):
    t = F.col("text")
    back = text.decode_ids(text.byte_ids(t), text.byte_symbols())
    rows = documents(spark, sf_dir).select("doc_id", "text", back.alias("back"))
    return rows.select(
        "doc_id", F.sha2("back", 256).alias("digest"), (F.col("back") == t).alias("same")
    )


# --- learned merges: every step of the loop is a step of the twin ----------------------------------

MERGES = 16
PIECE = 64  # ids that are decoded at once, so that pieces begin and end inside characters
_FIRST = vocab.SYMBOL_BASE + vocab.FIRST_MERGE  # the character of the first learned symbol


def _step(k: int) -> str:
    return f"""m{k} AS MATERIALIZED (
  SELECT substr(syms, i, 2) AS pair FROM (SELECT syms, n, unnest(range(1, length(syms))) AS i FROM s{k})
  GROUP BY pair HAVING sum(n) >= {vocab.MIN_COUNT} ORDER BY sum(n) DESC, pair LIMIT 1),
s{k + 1} AS MATERIALIZED (SELECT word, replace(syms, pair, chr({_FIRST + k})) AS syms, n FROM s{k}, m{k})"""


_LEARNED = f"""{_WORDS}, s0 AS MATERIALIZED (
  SELECT word, array_to_string(list_transform({q.byte_ids('word')}, lambda i: chr(({vocab.SYMBOL_BASE} + i)::INT)), '') AS syms, n
  FROM counted), {", ".join(map(_step, range(MERGES)))}"""
_MERGE_ROWS = " UNION ALL ".join(
    f"""SELECT {k} AS rank, unicode(pair[1]) - {vocab.SYMBOL_BASE} AS "left",
  unicode(pair[2]) - {vocab.SYMBOL_BASE} AS "right", {vocab.FIRST_MERGE + k} AS new_id FROM m{k}"""
    for k in range(MERGES)
)
# Words of a document in order; the marks of ``_WORDS`` keep the look-ahead.
_ENCODED = f"""{_LEARNED}, placed AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(
      regexp_replace(text, '({_SPACE})({_SPACE}{_NOT_SPACE})', '\\1' || chr(57344) || '\\2', 'g'), '{_PIECES}') AS ws
    FROM documents)),
coded AS (
  SELECT doc_id, string_agg(syms, '' ORDER BY i) AS syms FROM placed JOIN s{MERGES} USING (word) GROUP BY doc_id)"""


def _sizes(k: int) -> str:
    """Bytes of the symbols learned up to step ``k``."""
    half = lambda i: f"coalesce((SELECT max(b) FROM z{k} WHERE u = unicode(pair[{i}])), 1)"
    return f"z{k + 1} AS (SELECT u, b FROM z{k} UNION ALL SELECT {_FIRST + k}, {half(1)} + {half(2)} FROM m{k})"


# A piece of a valid text: what a cut left of a character at the front are continuation bytes, each
# of them invalid alone; at the end it is one beginning of a character.
_FRONT, _BACK = "^((?:[89AB][0-9A-F])+)", "(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$"
_PIECES_BACK = f"""{_ENCODED}, z0 AS (SELECT 0 AS u, 0 AS b WHERE false), {", ".join(map(_sizes, range(MERGES)))},
each AS (
  SELECT doc_id, i, coalesce(b, 1) AS b FROM (
    SELECT doc_id, unnest(string_split(syms, '')) AS c, unnest(range(1, length(syms) + 1)) AS i FROM coded)
  LEFT JOIN z{MERGES} ON u = unicode(c)),
run AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM each),
cut AS (
  SELECT doc_id, (i - 1) // {PIECE} AS piece, min(upto - b)::BIGINT AS lo, max(upto)::BIGINT AS hi
  FROM run GROUP BY doc_id, piece),
bytes AS (
  SELECT doc_id, piece, substr(hex(encode(text)), lo * 2 + 1, (hi - lo) * 2) AS h
  FROM cut JOIN documents USING (doc_id)),
fronted AS (
  SELECT doc_id, piece, repeat('EFBFBD', (length(regexp_extract(h, '{_FRONT}', 1)) // 2)::INT)
         || regexp_replace(h, '{_FRONT}', '') AS h FROM bytes)"""


def _small(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs, vocab.learn(vocab.word_counts(docs), vocab.FIRST_MERGE + MERGES)


@query(f"WITH {_LEARNED} {_MERGE_ROWS}")
def bpe_learn_16(spark, sf_dir):
    """The first merges of the learning loop."""
    _, learned = _small(spark, sf_dir)
    return learned.merge_table(spark)


@query(
    f"""WITH {_ENCODED} SELECT doc_id, length(syms)::INT AS n,
    sha256(array_to_string(list_transform(string_split(syms, ''), lambda c: unicode(c) - {vocab.SYMBOL_BASE}), ',')) AS ids
    FROM coded"""
)
def bpe_encode_16(spark, sf_dir):
    """All documents in the symbols of the first merges."""
    docs, learned = _small(spark, sf_dir)
    coded = docs.select("doc_id", vocab.encoder(spark, learned)(F.col("text")).alias("ids"))
    return coded.select(
        "doc_id",
        F.size("ids").alias("n"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids"),
    )


@query(
    f"""WITH {_PIECES_BACK} SELECT doc_id, piece::INT AS piece,
    sha256(decode(unhex(regexp_replace(h, '{_BACK}', 'EFBFBD')))) AS digest FROM fronted"""
)
def bpe_decode_16(spark, sf_dir):
    """Merged ids, cut without regard to characters, each piece decoded on its own."""
    docs, learned = _small(spark, sf_dir)
    coded = docs.select("doc_id", vocab.encoder(spark, learned)(F.col("text")).alias("ids"))
    starts = F.sequence(F.lit(0), F.expr(f"(size(ids) - 1) div {PIECE}").cast("int"))
    cut = coded.where("size(ids) > 0").select(
        "doc_id", F.posexplode(F.transform(starts, lambda i: F.slice("ids", i * PIECE + 1, PIECE))).alias("piece", "ids")
    )
    back = vocab.decoder(spark, learned)(F.col("ids"))
    return cut.select("doc_id", "piece", F.sha2(back, 256).alias("digest"))
