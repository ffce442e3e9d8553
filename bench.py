"""Headline timings on one machine: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query runs to completion
with its full result (written to the no-op sink), so nothing is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tokenloom.catalog import all_queries
from tokenloom.operators import vocab
from tokenloom.plans.documents import encoded_documents
from tokenloom.plans.tokenizer import sample
from tokenloom.sources.documents import read_documents

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "holdout_split",
    "split_leakage",
    "token_budget_pack",
    "running_tokens",
    "source_mix",
    "word_counts",
    "pair_counts",
    "bpe_first_merge",
    "byte_encode",
    "shard_roll",
    "pack_blocks",
    "manifest_rows",
    "epoch_order",
    "training_mix",
    "reject_reasons",
    "sft_examples",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, seconds, rates = all_queries(), {}, {}

    def timed(name, job):
        begin = time.perf_counter()
        out = job()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name:22s} {seconds[name]:8.2f}s", file=sys.stderr, flush=True)
        return out

    docs = read_documents(spark, f"{SF_DIR}/documents.parquet")
    timed("warm_up", lambda: run(docs.select(F.octet_length("text"))))
    del seconds["warm_up"]
    for name in HEADLINES:
        timed(name, lambda: run(queries[name](spark, SF_DIR)))
    learned = timed("bpe_learn_512", lambda: vocab.learn(vocab.word_counts(sample(docs)), 512))
    encoded = encoded_documents(docs, learned)
    tokens = timed("bpe_encode", lambda: encoded.agg(F.sum("n_tokens")).first()[0])

    rates["bpe_tokens_per_second"] = round(tokens / seconds["bpe_encode"])
    n_docs = docs.count()
    rates["budget_documents_per_second"] = round(n_docs / seconds["token_budget_pack"])
    chats = spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id").distinct().count()
    rates["conversations_per_second"] = round(chats / seconds["sft_examples"])
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rates": rates,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
