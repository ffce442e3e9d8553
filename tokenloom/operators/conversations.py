"""From message rows to checked training conversations.

A conversation longer than the training row is rejected, so nothing long is ever assembled: counts,
token totals and the first prompt come from one aggregate that combines before the shuffle, and
only conversations that fit ``seq_len + 1`` tokens (hence a bounded number of messages) are
gathered. The rest is reported from the aggregate alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import chat, text
from tokenloom.operators.dedup import mark_first
from tokenloom.operators.running import running_totals
from tokenloom.session import materialize

CONV, TURN = "conv_id", "turn"


def body_count(content: Column) -> Column:
    """Byte-tokenizer length of a message body."""
    return text.byte_count(text.neutralize(content))


def heads(
    turns: DataFrame,
    count: Callable[[Column], Column] | Column = body_count,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per conversation: ``messages`` (how many), ``n_tokens``, ``prompt``, ``split``, ``key``.

    ``n_tokens`` adds header and end marks; ``prompt`` is the first user message, empty if none.
    """
    body = count(F.col("text")) if callable(count) else count
    is_user = F.col("role") == "user"
    grouped = turns.groupBy(*by, CONV).agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.coalesce(body, F.lit(0)) + 2).cast("bigint").alias("n_tokens"),
        F.min_by(F.when(is_user, F.col("text")), F.when(is_user, F.col(TURN))).alias("prompt"),
    )
    prompt = F.coalesce("prompt", F.lit(""))
    return grouped.withColumns(
        {
            "prompt": prompt,
            "split": text.split_of(prompt),
            "key": F.sha2(text.collapse(prompt), 256),
        }
    )


def shapes(turns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``grammar`` and ``filled`` of every conversation, of any length, without assembling it.

    A message's place is a running count, so a conversation may spread over many tasks. Each message
    is held against the role due at its place, with a system message first and without one; what
    remains per conversation are counts, which combine before the shuffle.
    """
    by = list(by)
    narrow = materialize(
        turns.where(F.col("role").isNotNull() | F.col("text").isNotNull()).select(
            *by, CONV, TURN, F.coalesce("role", F.lit("")).alias("role"), text.is_blank(F.col("text")).alias("blank")
        ),
        "shapes",
    )
    placed = running_totals(narrow, TURN, {"nth": F.lit(1)}, [*by, CONV])
    odd = F.col("nth") % 2 == 1
    due = lambda user: F.when(user, F.lit("user")).otherwise(F.lit("assistant"))
    wrong = lambda bad: F.sum(F.when(bad, 1).otherwise(0))
    counted = placed.groupBy(*by, CONV).agg(
        F.max("nth").alias("n"),
        wrong(F.col("role") != due(odd)).alias("plain"),
        wrong((F.col("nth") > 1) & (F.col("role") != due(~odd))).alias("led"),
        F.max(F.when(F.col("nth") == 1, F.col("role"))).alias("first"),
        wrong(F.col("blank")).alias("blanks"),
    )
    has_system = F.col("first") == "system"
    whole = F.when(has_system, (F.col("led") == 0) & (F.col("n") % 2 == 1) & (F.col("n") > 1)).otherwise(
        (F.col("plain") == 0) & (F.col("n") % 2 == 0)
    )
    return counted.select(*by, CONV, whole.alias("grammar"), (F.col("blanks") == 0).alias("filled"))


def assemble(
    turns: DataFrame, fitting: DataFrame | None, fields: Sequence[Column], by: Sequence[str] = ()
) -> DataFrame:
    """Ordered ``messages`` arrays of the conversations listed in ``fitting``, or of all.

    Each message holds its turn and ``fields``; ask for no more than the caller reads. A row is as
    long as its conversation.
    """
    rows = turns
    if fitting is not None:
        rows = turns.join(fitting.select(*by, CONV), [*by, CONV], "left_semi")
    return rows.groupBy(*by, CONV).agg(
        F.array_sort(F.collect_list(F.struct(TURN, *fields))).alias("messages")
    )


def judged(
    turns: DataFrame,
    seq_len: int,
    count: Callable[[Column], Column] | Column = body_count,
    by: Sequence[str] = (),
) -> DataFrame:
    """Every conversation with its ``reason``: null when accepted.

    A repeated prompt hides every later copy even when the first copy is itself rejected, because
    the prompt counts as seen before the conversation is checked.
    """
    by = list(by)
    # Three uses follow; written once, the message texts are read and hashed only here.
    summary = materialize(
        heads(turns, count, by).select(*by, CONV, "n_tokens", "split", "key"), "heads"
    )
    marked = mark_first(summary, ["key"], CONV, by)
    fits = F.col("n_tokens") <= seq_len + 1
    shape = [F.col("role"), text.is_blank(F.col("text")).alias("blank")]
    shaped = assemble(turns, marked.where(F.col("is_first") & fits), shape, by).select(
        *by,
        CONV,
        chat.grammar_holds(F.col("messages")).alias("grammar"),
        chat.no_blank(F.col("messages")).alias("filled"),
    )
    reason = (
        F.when(~F.col("is_first"), F.lit("repeated_prompt"))
        .when(~fits, F.lit("too_long"))
        .when(~F.col("grammar"), F.lit("bad_turns"))
        .when(~F.col("filled"), F.lit("blank_message"))
    )
    return marked.join(shaped, [*by, CONV], "left").select(
        *by, CONV, "split", "n_tokens", "is_first", reason.alias("reason")
    )


def byte_bodies() -> Column:
    """Byte-tokenizer ids of a message body."""
    return text.byte_ids(text.neutralize(F.col("text")))


def examples(
    turns: DataFrame, accepted: DataFrame, seq_len: int, ids: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Padded ``tokens`` and ``mask`` of accepted conversations, ``seq_len + 1`` long each.

    ``ids`` gives the ids of a message body. The checks repeat what :func:`judged` settled.
    """
    by = list(by)
    built = assemble(turns, accepted, [F.col("role"), ids.alias("ids")], by).select(
        *by,
        CONV,
        chat.template_ids(F.col("messages")).alias("tokens"),
        chat.template_mask(F.col("messages")).alias("mask"),
    )
    return (
        built.where(chat.supervised(F.col("mask")) > 0)
        .where(F.size("tokens") <= seq_len + 1)
        .select(
            *by,
            CONV,
            F.size("tokens").alias("n_tokens"),
            chat.pad_to(F.col("tokens"), seq_len + 1).alias("tokens"),
            chat.pad_to(F.col("mask"), seq_len + 1, 0).alias("mask"),
        )
    )


def turns_of(conversations: DataFrame, messages: str = "messages") -> DataFrame:
    """Message rows of a table that holds one ``messages`` array per conversation."""
    if not dict(conversations.dtypes)[messages].startswith("array"):
        raise ValueError(f"Expected a list of messages in {messages!r}")
    others = [c for c in conversations.columns if c != messages]
    return conversations.select(*others, F.posexplode_outer(messages).alias(TURN, "_m")).select(
        *others,
        F.coalesce(F.col(TURN), F.lit(0)).cast("bigint").alias(TURN),
        F.col("_m.role").alias("role"),
        F.col("_m.content").alias("text"),
    )
