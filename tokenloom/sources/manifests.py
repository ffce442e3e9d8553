"""Corpus manifests: one JSON document that lists every shard with its hash.

Entries are metadata, one per shard of tens of millions of tokens. They live as a DataFrame; the
JSON document is written from it at the very end and read back with an explicit schema.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import parts as checks
from tokenloom.sources import files
from tokenloom.sources.shards import shard_files

ENTRY = "struct<file:string,tokens:bigint,sha256:string,mask:string,mask_sha256:string>"
SCHEMA = (
    "version int, kind string, seq_len int, vocab_size int, tokenizer_sha256 string, "
    "counts struct<train:bigint,val:bigint,skipped:bigint>, source string, "
    f"splits map<string,array<{ENTRY}>>"
)


def read_manifests(spark: SparkSession, paths) -> DataFrame:
    """One row per manifest, with its file name in ``part``."""
    table = spark.read.schema(SCHEMA).option("multiLine", True).json(paths)
    return table.withColumn("part", F.regexp_extract(F.input_file_name(), "([^/]*)$", 1))


def entries_of(manifests: DataFrame) -> DataFrame:
    """One row per shard: ``part``, ``kind``, ``seq_len``, ``split``, ``shard`` and the entry."""
    per_split = manifests.select(
        "part", "kind", "seq_len", F.explode("splits").alias("split", "_entries")
    )
    return per_split.select(
        "part", "kind", "seq_len", "split", F.posexplode("_entries").alias("_n", "_e")
    ).select(
        "part", "kind", "seq_len", "split", F.col("_n").cast("bigint").alias("shard"), "_e.*"
    )


def write_manifest(
    path: str,
    header: dict,
    entries: DataFrame,
    splits: Sequence[str] = ("train", "val"),
    order: Sequence[str] = ("split", "shard"),
    may_be_empty: bool = False,
) -> dict:
    """Write the JSON document to a new path, entries as a stream; gives the header. Every split
    needs at least one shard, but for parts that ``may_be_empty``: those list it without shards."""
    filled = {r["split"] for r in entries.select("split").distinct().collect()}
    absent = sorted(s for s in splits if s not in filled)
    if absent and not may_be_empty:
        raise ValueError(f"No shard in {absent}; every split needs one")
    rows = entries.where(F.col("split").isin(list(splits))).orderBy(*order)
    files.write_pieces(path, _document(header, rows, absent))
    return header


def _document(header: dict, rows: DataFrame, absent: Sequence[str] = ()):
    """The JSON document in pieces: a partition of the sorted entries is on the driver at a time."""
    yield json.dumps(header, indent=2, sort_keys=True)[:-2] + ',\n  "splits": {'
    yield ",".join(f"\n    {json.dumps(split)}: []" for split in absent)
    open_split, first = None, not absent
    for r in rows.toLocalIterator():
        if r["split"] != open_split:
            if open_split is not None:
                yield "\n    ]"
            yield "" if first else ","
            open_split, first = r["split"], False
            yield f"\n    {json.dumps(open_split)}: [\n      "
        else:
            yield ",\n      "
        yield json.dumps(_entry(r), sort_keys=True)
    yield ("" if open_split is None else "\n    ]") + "\n  }\n}"


def _entry(row) -> dict:
    out = {k: row[k] for k in ("file", "tokens", "sha256")}
    if row["mask"] is not None:
        out.update(mask=row["mask"], mask_sha256=row["mask_sha256"])
    return out


def merge_parts(spark: SparkSession, folder: str) -> dict:
    """Combine all ``manifest.<tag>.json`` of a folder into ``manifest.json``; parts stay.

    Sizes are checked, not hashes: readers check hashes when they open the corpus.
    """
    target = f"{folder}/manifest.json"
    if files.exists(target):
        raise ValueError(f"{target} already exists: this folder is merged")
    fs, base = files.open_fs(folder)
    import pyarrow.fs as pafs

    found = fs.get_file_info(pafs.FileSelector(base))
    names = sorted(
        f.base_name
        for f in found
        if f.base_name.startswith("manifest.") and f.base_name.endswith(".json")
    )
    if not names:
        raise ValueError(f"No manifest of a part in {folder}")
    manifests = read_manifests(spark, [f"{folder}/{n}" for n in names]).persist()
    try:
        _check_parts(spark, folder, manifests)
        first = manifests.where(F.col("part") == names[0]).first()
        for field in checks.AGREED_FIELDS:
            if first[field] is None:
                raise ValueError(f"{names[0]} is missing {field!r}")
        totals = checks.merged_counts(
            manifests.select("part", *[F.col(f"counts.{c}").alias(c) for c in checks.COUNT_FIELDS])
        ).first()
        entries = entries_of(manifests)
        header = {f: first[f] for f in checks.AGREED_FIELDS}
        header["counts"] = totals.asDict()
        header["source"] = {"merged": names, "provenance": _provenance(folder, names)}
        order = ("split", "part", "shard")  # parts by file name, shards in their own order
        return write_manifest(target, header, entries, sorted(first["splits"]), order)
    finally:
        manifests.unpersist()


def _provenance(folder: str, names: Sequence[str]) -> list[dict]:
    out = []
    for name in names:
        meta = files.read_json(f"{folder}/{name}")
        kept = {k: meta.get(k) for k in ("kind", "seq_len", "vocab_size", "counts", "source")}
        out.append({"manifest": name, "manifest_sha256": files.sha256(f"{folder}/{name}"), **kept})
    return out


def _check_parts(spark: SparkSession, folder: str, manifests: DataFrame) -> None:
    described = manifests.withColumn(
        "split_names", F.array_join(F.array_sort(F.map_keys("splits")), ",")
    )
    wrong = checks.disagreements(described, [*checks.AGREED_FIELDS, "split_names"])
    for row in wrong.orderBy("field").collect():
        raise ValueError(f"Parts disagree on {row['field']!r}")
    entries = entries_of(manifests)
    for row in checks.duplicate_files(entries).orderBy("file").take(1):
        raise ValueError(f"Several parts list a shard named {row['file']}")
    faults = checks.layout_faults(entries, shard_files(spark, folder)).where("reason is not null")
    for row in faults.orderBy("file").take(1):
        said = {
            "absent": "is absent",
            "odd_bytes": "has an odd number of bytes",
            "ragged_rows": f"ends within a row of {row['seq_len'] + 1} tokens",
            "bad_mask": "and its mask differ in length",
        }[row["reason"]]
        raise ValueError(f"Shard {row['file']} {said}")
