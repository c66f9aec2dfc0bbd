import numpy as np

from gridloom.meta import SpecBuilder
from gridloom.operators.array import Array
from gridloom.streaming.cells import write_stream


def test_stream_of_cells(spark, tmp_path):
    array = Array.create(str(tmp_path / "a"), SpecBuilder().with_shape(100).with_dtype("int64").with_chunks(30).with_fill(-1))
    source = str(tmp_path / "in")
    for start in (0, 40):
        spark.range(start, start + 40).selectExpr("id AS d0", "id * 2 AS value").write.mode("append").parquet(source)
        stream = spark.readStream.schema("d0 long, value long").parquet(source)
        query = write_stream(stream, array, str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
    want = np.where(np.arange(100) < 80, np.arange(100) * 2, -1)
    assert (array.read() == want).all()
