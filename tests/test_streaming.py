"""A folder of arriving files gives what a batch run gives."""

import random

from pyspark.sql import functions as F

from seqloom.plans import align as plans
from seqloom.streaming import arrivals


def test_arrivals(spark, tmp_path):
    text = "".join(random.Random(1).choices("ACGT", k=2000))
    index = plans.build_index(spark.createDataFrame([(0, "c", text)], "rid bigint, name string, seq string"))
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.fq").write_text("".join(f"@r{k}{i}\n{text[i * 90 + k : i * 90 + k + 120]}\n+\n{'I' * 120}\n" for i in range(4)))
    query = arrivals.align_arrivals(spark, str(tmp_path / "in"), index, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {r.name: r.pos for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("nth") == 0).collect()}
    assert got == {f"r{k}{i}": i * 90 + k for k in range(2) for i in range(4)}
