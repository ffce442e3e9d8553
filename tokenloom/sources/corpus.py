"""Opening a packed corpus, and publishing or checking it as a bundle."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import parts as checks
from tokenloom.operators.blocks import block_starts, lookup_blocks, require_blocks
from tokenloom.session import materialize, ship_package
from tokenloom.sources import files, tokenizer_file
from tokenloom.sources.manifests import entries_of, read_manifests
from tokenloom.sources.shards import dealt, listed_files, read_blocks, read_wanted, shard_hashes


@dataclass(frozen=True)
class Corpus:
    """Blocks of one split with their global index, and what identifies the data.

    ``shards`` lists where blocks lie: ``file``, ``mask`` and the index range of each shard.
    """

    blocks: DataFrame
    n: int
    fingerprint: str
    kind: str
    folder: str
    shards: DataFrame
    seq_len: int

    def fetch(self, wanted: DataFrame, index_col: str = "block_index") -> DataFrame:
        """``wanted`` with ``tokens`` and ``mask`` of the block each row names, read from its shard."""
        placed = lookup_blocks(wanted, index_col, self.shards)
        named = placed.join(self.shards.select("shard", "file", F.col("mask").alias("mask")), "shard")
        return read_wanted(self.folder, named.drop("shard"), self.seq_len, self.kind)


def manifest_entries(spark: SparkSession, folder: str) -> DataFrame:
    return entries_of(read_manifests(spark, f"{folder}/manifest.json"))


def verify_shards(spark: SparkSession, folder: str, entries: DataFrame) -> None:
    """Every listed shard and mask must have a plain name and the recorded content."""
    plain = ~(F.contains("file", F.lit("/")) | F.contains("file", F.lit("\\")) | F.col("file").isin(".", ".."))
    if entries.where(~plain).take(1):
        raise ValueError("A listed shard name has a folder in it")
    for row in checks.checksum_faults(entries, shard_hashes(spark, folder, entries)).take(1):
        raise ValueError(f"Shard {row['file']} does not have the recorded content")


def open_corpus(
    spark: SparkSession,
    folder: str,
    split: str,
    seq_len: int,
    verify: bool = True,
    tokenizer: str | None = None,
) -> Corpus:
    """``split``, ``shard``, ``block``, ``block_index``, ``tokens``, ``mask`` of all usable blocks."""
    entries = manifest_entries(spark, folder).where(F.col("split") == split)
    manifests = read_manifests(spark, f"{folder}/manifest.json")
    head = manifests.select("kind", "seq_len", "tokenizer_sha256").first()
    if tokenizer is not None:
        tokenizer_file.check(tokenizer, head["tokenizer_sha256"])
    if head["kind"] == "sft" and head["seq_len"] != seq_len:
        raise ValueError(f"These chat rows have seq_len {head['seq_len']}, not {seq_len}")
    if verify:
        verify_shards(spark, folder, entries)
    # A chat row has seq_len + 1 positions of its own; as stride-seq_len blocks that is one each.
    sizes = entries.select("split", "shard", "tokens")
    if head["kind"] == "sft":
        rows = F.floor(F.col("tokens") / F.lit(seq_len + 1))
        sizes = sizes.withColumn("tokens", (rows * seq_len + 1).cast("bigint"))
    n = require_blocks(sizes, seq_len, split)
    firsts = block_starts(sizes, seq_len).select("shard", "first_block", "end_block", "blocks")
    shards = materialize(entries.join(firsts, "shard"), "corpus-shards")
    blocks = read_blocks(folder, shards, seq_len, head["kind"])
    return Corpus(blocks, n, files.sha256(f"{folder}/manifest.json"), head["kind"], folder, shards, seq_len)


_NAME = re.compile(r"[A-Za-z0-9_-]+")


def safe_name(name: str) -> str:
    if not _NAME.fullmatch(name or ""):
        raise ValueError("A bundle name has letters, digits, - and _ only")
    return name


def describe(spark: SparkSession, data: str, tokenizer: str) -> dict:
    """What READY.json records: the hashes of the manifest and of the tokenizer it was packed with."""
    manifest = files.read_json(f"{data}/manifest.json")
    verify_shards(spark, data, manifest_entries(spark, data))
    tokenizer_file.check(tokenizer, manifest["tokenizer_sha256"])
    return {
        "format": 1,
        "data_manifest_sha256": files.sha256(f"{data}/manifest.json"),
        "tokenizer_sha256": manifest["tokenizer_sha256"],
    }


def publish(spark: SparkSession, data: str, tokenizer: str, root: str, name: str) -> str:
    """Copy exactly the listed files to ``root/name``; READY.json goes last and is never replaced."""
    target = f"{root}/{safe_name(name)}"
    ready = describe(spark, data, tokenizer)
    if files.exists(f"{target}/READY.json"):
        raise ValueError(f"{target} is finished and stays as it is; publish under another name")
    _copy(listed_files(manifest_entries(spark, data)), data, f"{target}/data")
    # Without READY.json nothing there is final: what an interrupted run left is written over.
    for source, copy in (
        (f"{data}/manifest.json", f"{target}/data/manifest.json"),
        (f"{tokenizer}/tokenizer.json", f"{target}/tokenizer/tokenizer.json"),
    ):
        files.write_over(copy, files.read_bytes(source))
    if describe(spark, f"{target}/data", f"{target}/tokenizer") != ready:
        raise ValueError(f"The copy at {target} differs from its source")
    files.write_json(f"{target}/READY.json", ready)
    return target


def _copy(names: DataFrame, source: str, target: str) -> None:
    """Tasks copy the files among themselves; a repeated copy writes the same bytes."""
    ship_package(names.sparkSession)
    source, target = files.uri(source), files.uri(target)

    def copy(batches):
        from_fs, from_base = pafs.FileSystem.from_uri(source)
        to_fs, to_base = pafs.FileSystem.from_uri(target)
        to_fs.create_dir(to_base, recursive=True)
        for pdf in batches:
            for name in pdf["file"]:
                pafs.copy_files(
                    f"{from_base}/{name}",
                    f"{to_base}/{name}",
                    source_filesystem=from_fs,
                    destination_filesystem=to_fs,
                )
            yield pdf

    dealt(names, "file").mapInPandas(copy, "file string").write.format("noop").mode(
        "overwrite"
    ).save()


def verify_bundle(spark: SparkSession, bundle: str) -> str:
    """Refuse a bundle that is unfinished or whose content differs from READY.json."""
    if not files.exists(f"{bundle}/READY.json"):
        raise ValueError(f"No finished bundle at {bundle}")
    if files.read_json(f"{bundle}/READY.json") != describe(spark, f"{bundle}/data", f"{bundle}/tokenizer"):
        raise ValueError("READY.json was written for other content")
    return bundle


def open_bundle(
    spark: SparkSession, root: str, name: str, splits: Sequence[str], seq_len: int
) -> dict[str, Corpus]:
    bundle = verify_bundle(spark, f"{root}/{safe_name(name)}")
    return {s: open_corpus(spark, f"{bundle}/data", s, seq_len, verify=False) for s in splits}
