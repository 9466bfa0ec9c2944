"""Prints one line per registered query: ``python tests/check_all.py [sf_dir] [name part]``."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, connect  # noqa: E402

from depotlens.plans import ORACLES, QUERIES  # noqa: E402
from depotlens.session import local_session  # noqa: E402

PAIRS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def main(sf_dir: str, part: str) -> int:
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, build in QUERIES.items():
        if part not in name:
            continue
        start = time.time()
        try:
            if name not in ORACLES:
                print(f"rows {name} {build(spark, sf_dir).count()} {time.time() - start:.2f}s", flush=True)
                continue
            cols, names, types, kinds, mine, theirs = compare(spark, con, build, ORACLES[name], sf_dir)
            ok = cols == names and mine == theirs
            odd = {c: (types[c], kinds.get(c)) for c in types if PAIRS.get(types[c]) != kinds.get(c)}
            print(f"{'ok  ' if ok else 'FAIL'} {name} rows={len(mine)}/{len(theirs)} "
                  f"{time.time() - start:.2f}s {odd or ''}", flush=True)
            if not ok:
                bad += 1
                print("   columns", cols, names) if cols != names else None
                print("   only spark", [r for r in mine if r not in set(theirs)][:2])
                print("   only sql  ", [r for r in theirs if r not in set(mine)][:2])
        except Exception as error:
            bad += 1
            print(f"FAIL {name} {type(error).__name__}: {str(error)[:600]}", flush=True)
            if "-v" in sys.argv:
                traceback.print_exc()
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if a != "-v"]
    sys.exit(main(args[0] if args else "/root/testdata/sf0.01", args[1] if len(args) > 1 else ""))
