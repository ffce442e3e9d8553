"""Plain sequential forms of the rules, to compare the Spark jobs with."""

import hashlib
import re

import numpy as np

RESERVED = ["pad", "eos", "system", "user", "assistant", "end"]


def neutral(value):
    for name in RESERVED:
        value = value.replace(f"<|{name}|>", f"< |{name}|>")
    return value


def bucket(value):
    digest = hashlib.sha256(" ".join(value[:4096].split()).encode()).hexdigest()
    return int(digest[:16], 16) % 100


def split(value):
    return "train" if bucket(value) else "val"


def budget(rows, max_tokens, val_tokens, seq_len):
    """rows: (ord, split, n). Kept orders, and the order at which reading ends (None: at no row).

    Stated with running totals: a val row stays if those before it hold less than the cap; reading
    ends at the first row where train is full and the val rows that stay hold a block.
    """
    no_end = float("inf")
    max_tokens = no_end if max_tokens is None else max(1, max_tokens)
    val_tokens = no_end if val_tokens is None else val_tokens
    train = np.cumsum([n if s == "train" else 0 for _, s, n in rows])
    val = np.cumsum([n if s == "val" else 0 for _, s, n in rows])
    sizes = np.array([n for _, _, n in rows])
    stays = [s == "train" or v - n < val_tokens for (_, s, n), v in zip(rows, val)]
    val_kept = np.cumsum(np.where([k and s == "val" for k, (_, s, _) in zip(stays, rows)], sizes, 0))
    full = np.flatnonzero((train >= max_tokens) & (val_kept >= seq_len + 1))
    end = int(full[0]) if len(full) else None
    kept = [r[0] for r, k in zip(rows[: None if end is None else end + 1], stays) if k]
    return kept, None if end is None else rows[end][0]


def roll(sizes, limit):
    """(shard, offset) of every row: a shard ends where the running total has grown by the limit
    since it began, found by search."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    begins = [0]
    while begins[-1] < len(sizes):
        begins.append(int(np.searchsorted(total, total[begins[-1]] + limit, "left")))
    shard = np.searchsorted(begins, np.arange(len(sizes)), "right") - 1
    return [(int(s), int(total[i] - total[begins[s]])) for i, s in enumerate(shard)]


def accepts(messages, seq_len, length):
    """Grammar, blanks and length of one conversation."""
    shape = "".join({"system": "s", "user": "u", "assistant": "a"}.get(r, "x") for r, _ in messages)
    if not re.fullmatch("s?(ua)+", shape):
        return False
    if any(not isinstance(c, str) or not c.strip() for _, c in messages):
        return False
    return sum(length(neutral(c)) + 2 for _, c in messages) <= seq_len + 1


def chat_pack(conversations, seq_len, max_examples, length):
    """conversations: (id, messages). Per read conversation: (id, split or 'skipped').

    A conversation counts if it is the first with its prompt and is accepted; reading ends at the
    first place that has enough train conversations and a val one up to it.
    """
    prompts = [next((c for r, c in m if r == "user"), "") or "" for _, m in conversations]
    keys = [" ".join(p.split()) for p in prompts]
    first = {k: i for i, k in reversed(list(enumerate(keys)))}
    label = [
        split(p) if first[k] == i and accepts(m, seq_len, length) else "skipped"
        for i, (p, k, (_, m)) in enumerate(zip(prompts, keys, conversations))
    ]
    train, val = (np.cumsum([x == side for x in label]) for side in ("train", "val"))
    full = np.flatnonzero((train >= max_examples) & (val >= 1))
    end = int(full[0]) + 1 if len(full) else len(label)
    return [(id_, x) for (id_, _), x in zip(conversations[:end], label)]
