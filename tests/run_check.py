"""Command line: compare queries with their SQL. ``python -m tests.run_check [name part ...]``"""

from __future__ import annotations

import os
import sys
import time
import traceback

from clickloom import catalog
from clickloom.session import local_session
from tests.compare import compare, connect


def main() -> None:
    sf = os.environ.get("CHECK_SF", "/root/testdata/sf0.01")
    mods = os.environ.get("CHECK_MODULES")
    if mods:
        import importlib

        for m in mods.split(","):
            importlib.import_module(f"clickloom.catalog.{m}")
    else:
        catalog.load()
    spark = local_session(8)
    con = connect(sf)
    failed = 0
    for name, fn in catalog.QUERIES.items():
        if len(sys.argv) > 1 and not any(p in name for p in sys.argv[1:]):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in catalog.ORACLES:
                problems = compare(df, con, catalog.ORACLES[name])
            else:
                n = len(df.collect())
                problems = [] if n else ["no rows"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
            if os.environ.get("CHECK_TRACE"):
                traceback.print_exc()
        failed += any(not p.startswith("type ") for p in problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n     " if problems else " ", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
