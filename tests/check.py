"""Check catalog queries against their SQL: ``python -m tests.check [--sf DIR] [name ...]``."""

from __future__ import annotations

import sys
import time

from plumbline.catalog.all import REGISTRY
from plumbline.session import local_session
from tests.oracle import compare, connect


def main() -> int:
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        folder = f"/root/testdata/sf{args[1]}"
        args = args[2:]
    names = [n for n in REGISTRY if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark = local_session(8)
    con = connect(folder)
    bad = 0
    built = 0.0
    for n in names:
        q = REGISTRY[n]
        t = time.time()
        timing: dict[str, float] = {}
        try:
            df = q.run(spark, folder)
            built = time.time() - t
            if q.sql is None:
                rows = df.count()
                problems = [] if rows else ["no rows"]
            else:
                problems = compare(df, con, q.sql, timing)
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(problems)
        spent = built + timing.get("spark", 0.0)
        print(f"{'BAD' if problems else 'ok '} {n} spark {spent:.2f}s sql {timing.get('sql', 0):.2f}s {problems or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
