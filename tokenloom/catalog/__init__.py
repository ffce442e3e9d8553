"""The named queries of this repository."""

from __future__ import annotations


def _load():
    from tokenloom.catalog import (  # noqa: F401
        chats,
        corpora,
        documents,
        packing,
        roundtrips,
        vocabularies,
    )
    from tokenloom.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES


def all_queries():
    return dict(_load()[0])


def all_oracles():
    return dict(_load()[1])
