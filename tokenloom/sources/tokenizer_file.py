"""The frozen vocabulary as a public ``tokenizer.json``, so other tools can load it."""

from __future__ import annotations

from tokenloom.functions import text
from tokenloom.operators.vocab import FIRST_BYTE, FIRST_MERGE, Vocabulary
from tokenloom.sources import files


def save(vocabulary: Vocabulary, folder: str, provenance: dict | None = None) -> str:
    """Write ``tokenizer.json`` (and ``provenance.json``) to a new folder; gives the file's hash."""
    spelled = [vocabulary.spelled(i) for i in range(len(vocabulary))]
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    files.write_json(
        f"{folder}/tokenizer.json",
        {
            "version": "1.0",
            "truncation": None,
            "padding": None,
            "added_tokens": [
                {
                    "id": i,
                    "content": s,
                    "single_word": False,
                    "lstrip": False,
                    "rstrip": False,
                    "normalized": False,
                    "special": True,
                }
                for i, s in enumerate(text.SPECIALS)
            ],
            "normalizer": None,
            "pre_tokenizer": level,
            "post_processor": None,
            "decoder": level,
            "model": {
                "type": "BPE",
                "dropout": None,
                "unk_token": None,
                "continuing_subword_prefix": None,
                "end_of_word_suffix": None,
                "fuse_unk": False,
                "byte_fallback": False,
                "ignore_merges": False,
                "vocab": {s: i for i, s in enumerate(spelled)},
                "merges": [[spelled[a], spelled[b]] for a, b, _ in vocabulary.merges],
            },
        },
    )
    if provenance is not None:
        files.write_json(f"{folder}/provenance.json", provenance)
    return files.sha256(f"{folder}/tokenizer.json")


def load(folder: str) -> Vocabulary:
    model = files.read_json(f"{folder}/tokenizer.json")["model"]
    byte_of = {c: b for b, c in enumerate(text.byte_alphabet())}
    ids = model["vocab"]
    symbols = [b""] * len(ids)
    for spelled, token in ids.items():
        if token >= FIRST_BYTE:
            symbols[token] = bytes(byte_of[c] for c in spelled)
    expected = text.byte_symbols()
    if symbols[:FIRST_MERGE] != expected or any(ids.get(s) != i for i, s in enumerate(text.SPECIALS)):
        raise ValueError("Not a byte-level vocabulary with the six reserved tokens first")
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return Vocabulary(tuple(symbols), tuple((ids[a], ids[b], ids[a + b]) for a, b in pairs))


def check(folder: str, expected_sha256: str) -> None:
    """Data may only be read with the tokenizer it was packed with."""
    if files.sha256(f"{folder}/tokenizer.json") != expected_sha256:
        raise ValueError(f"The data was packed with another tokenizer than {folder}")
