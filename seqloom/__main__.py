"""python -m seqloom --fastq reads.fastq ..."""

import logging
import sys

from pyspark.sql import SparkSession

from seqloom.config import parse
from seqloom.plans.pipelines import DASHBOARD, run
from seqloom.session import configure
from seqloom.sources.sinks import serve


def main(argv: list[str]) -> int:
    if not argv:
        print("seqloom: clusters of sequencing reads. Give --fastq or --bam; --help lists the options.")
        return 0
    logging.basicConfig(level=logging.INFO)
    try:
        options = parse(argv)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    if options.min_length < 20:
        logging.warning("reads below 20 bases say little")
    spark = configure(SparkSession.builder.appName("seqloom").getOrCreate())
    result = run(spark, options)
    print(f"{result.stats.count()} clusters in {options.output}")
    if options.dashboard and options.legacy:
        with serve(DASHBOARD) as server:
            print(f"dashboard on http://127.0.0.1:{server.server_port}/, until interrupted")
            try:
                server.serve_forever()
            except KeyboardInterrupt:
                pass
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
