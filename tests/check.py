"""Command line: python -m tests.check [name-prefix ...] compares queries at sf0.01."""

import sys
import time

sys.path.insert(0, ".")

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.oracle import DATA, difference, duck  # noqa: E402


def main() -> None:
    sf = f"{DATA}/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf), entry.oracle_sql()
    for name, fn in entry.queries().items():
        if len(sys.argv) > 1 and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            got = df.toPandas()
            took = time.time() - t
            if name not in sqls:
                print(f"rows-only {name} {len(got)} {took:.1f}s", flush=True)
                continue
            t = time.time()
            want = con.execute(sqls[name]).fetchdf()
            bad = difference(got, want)
            types = {f.name: f.dataType.simpleString() for f in df.schema}
            print(f"{'OK ' if not bad else 'BAD'} {name} {len(got)} {took:.1f}s duck {time.time() - t:.1f}s {bad or ''}", flush=True)
            if bad:
                print("    ", types)
        except Exception as exc:  # noqa: BLE001
            print(f"ERR {name} {str(exc)[:1500]}", flush=True)


main()
