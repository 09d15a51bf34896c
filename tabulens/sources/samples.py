"""Small bundled tables to try the engine on, ingested like any other file."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tabulens.sources.normalise import Dataset, ingest
from tabulens.types import TabulensError

#: Invented tables; the second holds what real files do: blanks, markers, mixed spellings, a quoted delimiter.
SAMPLES = {
    "fleet.csv": "vehicle,kind,seats,first_used,electric\nV1,bus,48,2019-04-01,no\nV2,bus,52,2020-09-15,no\nV3,van,8,2021-01-20,yes\nV4,car,5,2021-06-30,yes\nV5,van,9,2022-02-11,no\nV6,bus,50,2023-11-05,yes\n",
    "messy-orders.csv": 'order;region;amount;ordered\n1;North;10.5;2024-01-03\n2;north ;;2024-01-04\n3;South;n/a;2024-01-04 10:30\n4; ;7.25;unknown\n5;"East; far";1200;2024-02-29\n5;"East; far";1200;2024-02-29\n',
}


def ingest_sample(spark: SparkSession, name: str, store: str, owner: str = "") -> Dataset:
    """A bundled table as a dataset; the file lies in ``store`` while it is read."""
    if name not in SAMPLES:
        raise TabulensError(f"there is no sample {name!r}; there are {', '.join(SAMPLES)}")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{store.rstrip('/')}/samples/{uuid.uuid4().hex}/{name}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(at)
    try:
        out.write(bytearray(SAMPLES[name].encode()))
    finally:
        out.close()
    try:
        return ingest(spark, at.toString(), store, owner, name)
    finally:
        fs.delete(at.getParent(), True)
