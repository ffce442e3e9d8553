"""Shared fragments of the DuckDB twins. Parameters of the named queries live here too."""

from __future__ import annotations

# Parameters of the named queries; both engines read them from here.
MAX_TOKENS = 500_000
VAL_TOKENS = 5_000
SEQ_LEN = 1024
CHAT_SEQ_LEN = 4096
SHARD_LIMIT = 100_000
CHAT_SHARD_LIMIT = 40_000
MAX_EXAMPLES = 10
MAX_CHARS = 1_000_000
MAX_DOCS = 600
SEED = 42

WS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'), ' ')"


def neutral(x: str) -> str:
    return (
        f"regexp_replace({x}, '<(\\|(?:pad|eos|system|user|assistant|end)\\|>)', '< \\1', 'g')"
    )


def bucket(x: str) -> str:
    return f"(('0x' || substr(sha256({collapsed(f'substr({x}, 1, 4096)')}), 1, 16))::UBIGINT % 100)::INT"


def split(x: str) -> str:
    return f"CASE WHEN {bucket(x)} = 0 THEN 'val' ELSE 'train' END"


def n_bytes(x: str) -> str:
    return f"octet_length(encode({neutral(x)}))"


def symbol(h: str) -> str:
    """Token id of a byte given as two hex digits."""
    b = f"('0x' || {h})::INT"
    return (
        f"CASE WHEN {b} BETWEEN 33 AND 126 THEN {b} - 27 WHEN {b} BETWEEN 161 AND 172 THEN {b} - 61 "
        f"WHEN {b} >= 174 THEN {b} - 62 WHEN {b} <= 32 THEN {b} + 194 "
        f"WHEN {b} BETWEEN 127 AND 160 THEN {b} + 100 ELSE 261 END"
    )


def byte_ids(x: str) -> str:
    pairs = f"regexp_extract_all(hex(encode({x})), '..')"
    return f"list_transform({pairs}, lambda h: {symbol('h')})"


def joined(ids: str) -> str:
    return f"array_to_string({ids}, ',')"


# Documents that pass the length filter, with split and byte-token length (end mark included).
DOCS = f"""doc AS (
  SELECT doc_id, lang, source, text, {split('text')} AS split,
         ({n_bytes('text')} + 1)::BIGINT AS n_tokens
  FROM documents WHERE length({stripped('text')}) >= 100)"""

# Documents a token budget keeps, by running totals over all rows.
BUDGET = f"""{DOCS}, run AS (
  SELECT *, sum(CASE WHEN split = 'train' THEN n_tokens ELSE 0 END) OVER w AS train_run,
         sum(CASE WHEN split = 'val' THEN n_tokens ELSE 0 END) OVER w AS val_run
  FROM doc WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
capped AS (
  SELECT *, (split = 'train' OR val_run - n_tokens < {VAL_TOKENS}) AS in_cap FROM run),
kept_run AS (
  SELECT *, sum(CASE WHEN split = 'val' AND in_cap THEN n_tokens ELSE 0 END)
         OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS val_kept FROM capped),
stop AS (
  SELECT min(doc_id) AS at FROM kept_run
  WHERE train_run >= {MAX_TOKENS} AND val_kept >= {SEQ_LEN + 1}),
budget AS (
  SELECT kept_run.* FROM kept_run, stop
  WHERE in_cap AND (stop.at IS NULL OR doc_id <= stop.at))"""


def rolled(source: str, by: str, limit: int) -> str:
    """Recursive twin of shard rolling: ``roll(<by>, shard, first_run, last_run)`` over ``source``.

    ``source`` needs ``by``, ``doc_id`` and ``n_tokens``.
    """
    return f"""ranked AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY {by} ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run
  FROM {source}),
ends AS (SELECT {by}, max(run) AS total FROM ranked GROUP BY {by}),
roll AS (
  SELECT ends.{by}, 0::BIGINT AS shard, 0::BIGINT AS before,
         coalesce((SELECT min(run) FROM ranked r WHERE r.{by} = ends.{by} AND r.run >= {limit}), total) AS upto,
         total
  FROM ends
  UNION ALL
  SELECT p.{by}, p.shard + 1, p.upto,
         coalesce((SELECT min(run) FROM ranked r WHERE r.{by} = p.{by} AND r.run >= p.upto + {limit}), p.total),
         p.total
  FROM roll p WHERE p.upto < p.total),
placed AS (
  SELECT ranked.*, roll.shard, ranked.run - ranked.n_tokens - roll.before AS "offset"
  FROM ranked JOIN roll ON ranked.{by} = roll.{by} AND ranked.run > roll.before AND ranked.run <= roll.upto)"""


# Message rows joined to per-conversation heads, in the order a chat pack judges them.
HEADS = f"""prompts AS (
  SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS prompt,
         count(*)::BIGINT AS messages,
         sum(coalesce({n_bytes('text')}, 0) + 2)::BIGINT AS n_tokens,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a'
                    ELSE 'x' END, '' ORDER BY turn) AS shape,
         bool_and(coalesce(length({stripped('text')}), 0) > 0) AS filled
  FROM conversations GROUP BY conv_id),
heads AS (
  SELECT *, {split('prompt')} AS split,
         row_number() OVER (PARTITION BY {collapsed('prompt')} ORDER BY conv_id) = 1 AS is_first
  FROM prompts),
judged AS (
  SELECT *, CASE WHEN NOT is_first THEN 'repeated_prompt'
                 WHEN n_tokens > {CHAT_SEQ_LEN + 1} THEN 'too_long'
                 WHEN NOT regexp_full_match(shape, 's?(ua)+') THEN 'bad_turns'
                 WHEN NOT filled THEN 'blank_message' END AS reason
  FROM heads)"""


# Padded-free token and mask lists of accepted conversations.
EXAMPLES = f"""{HEADS},
body AS (
  SELECT c.conv_id, c.turn, c.role, {byte_ids(neutral('c.text'))} AS ids
  FROM conversations c JOIN judged USING (conv_id) WHERE reason IS NULL),
example AS (
  SELECT conv_id,
         flatten(list(list_concat([CASE role WHEN 'system' THEN 2 WHEN 'user' THEN 3 ELSE 4 END],
                                  ids, [5]) ORDER BY turn)) AS ids,
         flatten(list(list_concat([0], list_transform(list_concat(ids, [5]),
                 lambda v: CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)) ORDER BY turn)) AS mask
  FROM body GROUP BY conv_id),
padded AS (
  SELECT conv_id, len(ids)::INT AS n_tokens,
         list_concat(ids, list_transform(range({CHAT_SEQ_LEN + 1} - len(ids)), lambda v: 0)) AS ids,
         list_concat(mask, list_transform(range({CHAT_SEQ_LEN + 1} - len(mask)), lambda v: 0)) AS mask
  FROM example)"""
