"""Write the formatted physical plan of registered queries to text files.

    python -m spanlake.plans.explain /root/testdata/sf0.1 docs/plans span_end_to_end best_span

The plans are taken after the same DataFrame has been collected, so they are the final ones
of adaptive execution (join strategies, coalesced partitions): for results of a size that
a driver holds. Used to review shuffles, broadcasts and pruning.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys


def explain_queries(spark, sf_dir: str, out_dir: str, names: list[str]) -> list[str]:
    from spanlake.plans.catalog import QUERIES

    os.makedirs(out_dir, exist_ok=True)
    written = []
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        df.collect()  # on this very DataFrame: another action would settle another plan
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        path = os.path.join(out_dir, f"{name}.txt")
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        written.append(path)
    return written


def main(argv: list[str]) -> None:
    from spanlake.session import get_spark

    sf_dir, out_dir, *names = argv
    spark = get_spark("spanlake-explain")
    for path in explain_queries(spark, sf_dir, out_dir, names):
        print(path)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
