"""python tests/check.py [sf] [name ...]: compare queries with their SQL, with seconds for each."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402
from quillspark.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session("check", cores=8)
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                found = f"rows only: {df.count()} {df.columns}"
            else:
                found = compare(df, con, sql)
                bad += found is not None
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:900]}"
            bad += 1
        print(f"{'ok ' if found is None else '?? '} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print("not equal:", bad)


if __name__ == "__main__":
    main()
