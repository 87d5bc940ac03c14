"""Headline queries, timed.  Prints one JSON line.

BENCH_SF_DIR     table directory (default /root/testdata/sf0.1)
BENCH_CPUS       local threads (default 8)
BENCH_CORPUS_MB  size of a generated JSONL corpus (half one large file, half many
                 small ones) on which verification, owner scan and hashing are
                 timed (default 1600, the size published figures are for; 0: none)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "session_summaries", "integrity_report", "message_table", "document_hashes", "split_turn_dedupe", "duplicate_documents",
    "compare_copies", "union_of_copies", "sync_plan", "sync_plan_documents", "import_plan", "session_listing", "owner_accounts",
    "sync_all_plan", "unlink_plan", "comparison_matrix", "title_candidates", "orphan_transcripts", "snapshot_manifest", "native_rows",
)

#: Published seconds of the reference on 1.6 GB (the owner scan was on 1.2 GB).
PUBLISHED = {"listing": 2.5, "verify": 4.5, "hash_from_files": 13.0, "owner_scan": 2.2 * 1.6 / 1.2}


def session():
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("sessionlake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sessionlake-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run) -> float:
    started = time.perf_counter()
    run()
    return round(time.perf_counter() - started, 3)


def corpus(spark, megabytes: int) -> dict[str, float]:
    """Seconds for a generated corpus: half in one file, half in many."""
    from pyspark.sql import functions as F

    from sessionlake.operators import content, integrity, listing, normalize
    from sessionlake.session import materialize
    from sessionlake.sources import ends, inventory, jsonl

    root = tempfile.mkdtemp(prefix="sessionlake-corpus-")
    rows = megabytes * 1024 * 1024 // 4400
    text = F.substring(F.repeat(F.sha2(F.col("i").cast("string"), 256), 32), 1, 2000)

    def lines(first, count, file_of):
        pair = spark.range(first, first + count, 1, 8).withColumnRenamed("id", "i")
        block = F.concat(F.lit('"content":[{"type":"text","text":"'), text, F.lit('"}]}}'))
        u = F.concat(F.lit('{"type":"user","uuid":"u'), "i", F.lit('","sessionId":"'), file_of, F.lit('","message":{"role":"user",'), block)
        a = F.concat(F.lit('{"type":"assistant","uuid":"a'), "i", F.lit('","message":{"id":"m'), "i", F.lit('","role":"assistant","model":"m",'), block)
        return pair.select(file_of.alias("session"), F.explode(F.array(u, a)).alias("value"))

    half = rows // 2
    folder = f"{root}/projects/p"
    lines(0, half, F.lit("big")).select("value").coalesce(1).write.text(f"{root}/one")
    lines(half, half, (F.col("i") % 200).cast("string")).repartition(8, "session").write.partitionBy("session").text(f"{root}/many")
    # Spark names its output itself; transcripts are named by their session.
    os.makedirs(folder)
    for at, _dirs, names in os.walk(root):
        for name in names:
            if name.endswith(".txt"):
                label = at.rsplit("=", 1)[1] if "=" in at else "big"
                os.link(f"{at}/{name}", f"{folder}/{label}-{name[:11]}.jsonl")
    size = sum(os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder))
    listed = inventory.list_transcripts(spark, root)
    noop = lambda f: f.write.format("noop").mode("overwrite").save()
    out = {"bytes": size}
    out["listing"] = timed(lambda: noop(listing.sampled_meta(ends.read_ends(listed), listed)))
    out["verify"] = timed(lambda: noop(integrity.scan_integrity(spark, folder, listed)))
    out["owner_scan"] = timed(lambda: noop(listing.file_owners(jsonl.number_lines(jsonl.scan(spark, folder)))))
    parsed = []
    out["normalize"] = timed(lambda: parsed.append(
        materialize(normalize.messages(jsonl.read_jsonl(spark, folder), with_position=False), "corpus-messages")))
    numbered = normalize.positions(parsed[0])
    out["hash"] = timed(lambda: noop(content.content_hash(numbered, ["file_path"])))
    return out


def main():
    from sessionlake import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    queries = catalog.queries()
    queries["duplicate_documents"](spark, sf_dir).count()
    seconds = {}
    for name in HEADLINE:
        seconds[name] = timed(lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    megabytes = int(os.environ.get("BENCH_CORPUS_MB", "1600"))
    if megabytes:
        found = corpus(spark, megabytes)
        found["hash_from_files"] = round(found["normalize"] + found["hash"], 3)
        scale = found["bytes"] / 1.6e9
        found["ratio_to_published"] = {k: round(found[k] / (seconds_ * scale), 2) for k, seconds_ in PUBLISHED.items()}
        result["corpus"] = found
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
