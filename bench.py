"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from locusframe.catalog import all_queries
from locusframe.session import local_session

HEADLINE = (
    "dataset_summary",
    "locus_summary",
    "heterozygosity_by_individual",
    "heterozygosity_by_locus",
    "hwe_disequilibrium",
    "shared_markers",
    "thin_uniform_records",
    "sample_vcf",
    "sample_vcfs_shared",
    "generation_levels",
    "kinship",
    "inbreeding",
    "realized_kinship",
    "merge_segments",
    "overlay_first_writer",
    "mrca_summary",
    "in_target_regions",
    "assemble_vcf",
    "topologies",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("locusframe-bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").count().write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "locusframe_headline_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
