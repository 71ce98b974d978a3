import numpy as np

from mosaiq.streaming import gram


def test_gram_of_a_stream_equals_that_of_the_table(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = rng.integers(-4, 5, (30, 5)).astype(float)
    source = str(tmp_path / "in")
    schema = "vec_id long, embedding array<double>"
    for part in range(3):
        some = [(k, rows[k].tolist()) for k in range(part * 10, part * 10 + 10)]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        gram.start(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        done = rows[: part * 10 + 10]
        got = np.zeros((5, 5))
        for r in gram.total(spark, str(tmp_path / "out")).collect():
            got[r.i, r.j] = r.re
        assert np.array_equal(got, done.T @ done)
