"""Column functions on conversations: grammar, template, loss mask, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.text import ASSISTANT, END, PAD, SYSTEM, USER

ROLE_IDS = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}


def role_id(role: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, token in ROLE_IDS.items():
        out = F.when(role == name, F.lit(token)).otherwise(out)
    return out


def grammar_holds(messages: Column) -> Column:
    """Optional leading system message, then user and assistant in turn, ending with assistant."""
    letters = F.transform(
        messages,
        lambda m: F.when(m["role"] == "system", F.lit("s"))
        .when(m["role"] == "user", F.lit("u"))
        .when(m["role"] == "assistant", F.lit("a"))
        .otherwise(F.lit("x")),
    )
    return F.coalesce(F.array_join(letters, "").rlike("^s?(ua)+$"), F.lit(False))


def no_blank(messages: Column) -> Column:
    """No message without text. Messages carry ``blank``."""
    return F.coalesce(F.forall(messages, lambda m: ~m["blank"]), F.lit(False))


def template_ids(messages: Column) -> Column:
    """``role header + body + end`` of every message. Messages carry ``role`` and ``ids``."""
    return F.flatten(
        F.transform(
            messages,
            lambda m: F.concat(F.array(role_id(m["role"])), m["ids"], F.array(F.lit(END))),
        )
    )


def template_mask(messages: Column) -> Column:
    """1 for the body and end of assistant messages, 0 elsewhere; headers are never targets."""
    return F.flatten(
        F.transform(
            messages,
            lambda m: F.concat(
                F.array(F.lit(0)),
                F.array_repeat((m["role"] == "assistant").cast("int"), F.size(m["ids"]) + 1),
            ),
        )
    )


def pad_to(values: Column, length: int, fill: int = PAD) -> Column:
    return F.concat(
        values, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.size(values)))
    )


def supervised(mask: Column) -> Column:
    """Targets a model is trained on: the mask without its first entry, which is never a target."""
    return F.aggregate(
        F.slice(mask, F.lit(2), F.greatest(F.size(mask) - 1, F.lit(0))),
        F.lit(0),
        lambda acc, m: acc + m,
    )
