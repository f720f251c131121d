"""Run registered queries against their SQL on one folder: python tools/check.py [folder] [name part ...]"""

import hashlib
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from reportlake.session import local_session  # noqa: E402
from reportlake.workloads import ORACLES, QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def digest(table) -> tuple:
    table = table.select(sorted(table.column_names))
    rows = sorted(repr(tuple(r.values())) for r in table.to_pylist())
    return hashlib.md5("\n".join(rows).encode()).hexdigest(), rows


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    names = [n for n in QUERIES if not parts or any(p in n for p in parts)]
    spark = local_session("check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    bad = []
    for n in names:
        start = time.time()
        try:
            mine = QUERIES[n](spark, folder).toArrow()
        except Exception as e:  # noqa: BLE001
            print(f"ERROR {n}: {str(e)[:1500]}")
            bad.append(n)
            continue
        took = time.time() - start
        if n not in ORACLES:
            print(f"rows  {n}: {mine.num_rows} rows, {took:.1f}s")
            continue
        try:
            theirs = con.sql(ORACLES[n]).to_arrow_table()
        except Exception as e:  # noqa: BLE001
            print(f"SQL   {n}: {str(e)[:1500]}")
            bad.append(n)
            continue
        a, b = digest(mine), digest(theirs) if sorted(mine.column_names) == sorted(theirs.column_names) else ("", [])
        types = {f.name: str(f.type) for f in mine.schema}, {f.name: str(f.type) for f in theirs.schema}
        same_types = {k: v.replace("large_", "") for k, v in types[0].items()} == {
            k: v.replace("large_", "") for k, v in types[1].items()
        }
        ok = a[0] == b[0] and same_types
        print(f"{'ok   ' if ok else 'DIFF '} {n}: {mine.num_rows}/{theirs.num_rows} rows, {took:.1f}s")
        if not ok:
            bad.append(n)
            if not same_types:
                print("   types", {k: (v, types[1].get(k)) for k, v in types[0].items() if types[1].get(k) != v})
            only_a, only_b = sorted(set(a[1]) - set(b[1])), sorted(set(b[1]) - set(a[1]))
            print(f"   {len(only_a)} only spark, {len(only_b)} only sql")
            for label, rows in (("spark", only_a), ("sql  ", only_b)):
                for r in rows[:3]:
                    print("  ", label, r[:400])
    print("bad:", bad)


if __name__ == "__main__":
    main()
