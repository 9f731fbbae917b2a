"""Spliced files hold the rows of their parts, in order, with pages and indexes in place."""

import io
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from quadrille.sources.sink import write_geoparquet
from quadrille.sources.splice import footer, splice

LOCAL = fs.LocalFileSystem()


def table(n, start=0):
    if not n:
        return table(1).slice(0, 0)
    rng = np.random.default_rng(start)
    return pa.table({"i": range(start, start + n), "s": pa.array([None if i % 7 == 0 else f"text {i % 5}" for i in range(n)], pa.string()), "x": rng.random(n), "l": [[1, i] for i in range(n)], "t": pa.array([{"a": i, "b": None} for i in range(n)], pa.struct([("a", pa.int32()), ("b", pa.string())])), "flag": [i % 2 == 0 for i in range(n)]})


@pytest.mark.parametrize("options", [{}, {"compression": "zstd", "write_page_index": True}, {"use_dictionary": False, "data_page_version": "2.0"}, {"write_page_checksum": True, "data_page_size": 200}])
def test_parts_written_by_arrow(tmp_path, options):
    parts = [table(100), table(0, 100), table(250, 100), table(3, 350)]
    names = []
    for k, t in enumerate(parts):
        names.append(str(tmp_path / f"{k}.parquet"))
        pq.write_table(t, names[-1], row_group_size=40, **options)
    out = io.BytesIO()
    assert splice(LOCAL, names, out, {"geo": "{ü}", "k": "v"}) == 353
    path = tmp_path / "all.parquet"
    path.write_bytes(out.getvalue())
    assert pq.read_table(path).replace_schema_metadata(None).equals(pa.concat_tables(parts))
    meta = pq.read_metadata(path)
    assert meta.metadata[b"geo"] == "{ü}".encode() and meta.num_row_groups == 3 + 7 + 1
    assert [meta.row_group(g).num_rows for g in range(11)] == [40, 40, 20, *[40] * 6, 10, 3]
    assert pq.read_table(path, filters=[("i", ">=", 349)])["i"].to_pylist() == [349, 350, 351, 352]
    assert pq.ParquetFile(path).read_row_group(10)["s"].to_pylist() == parts[3]["s"].to_pylist()


def test_wrong_parts(tmp_path):
    pq.write_table(table(3), tmp_path / "a")
    pq.write_table(table(3).drop(["l"]), tmp_path / "b")
    (tmp_path / "c").write_bytes(b"no parquet at all")
    with pytest.raises(ValueError, match="another schema"):
        splice(LOCAL, [str(tmp_path / "a"), str(tmp_path / "b")], io.BytesIO())
    with pytest.raises(ValueError, match="not a Parquet file"), LOCAL.open_input_file(str(tmp_path / "c")) as f:
        footer(f)
    with pytest.raises(ValueError, match="no files"):
        splice(LOCAL, [], io.BytesIO())


def test_memory_does_not_grow_with_the_data(tmp_path):
    most = []
    for copies in (2, 20):
        name = str(tmp_path / f"{copies}")
        pq.write_table(pa.table({"b": [np.random.default_rng(k).bytes(1 << 20) for k in range(copies)]}), name, compression="none", use_dictionary=False, write_statistics=False)
        tracemalloc.start()
        with open(tmp_path / "out", "wb") as out:
            splice(LOCAL, [name] * 5, out)
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert pq.read_metadata(tmp_path / "out").num_rows == 5 * copies
    assert most[1] < 2 * max(most[0], 10 << 20)


def test_spark_reads_what_spark_wrote(spark, tmp_path):
    """Full row groups in order, though partitions are uneven; the page index survives."""
    df = spark.range(0, 10_003, 1, 7).select("id", F.expr("named_struct('xmin', id / 1e2, 'xmax', id / 1e2, 'ymin', 0e0, 'ymax', 1e0)").alias("bbox"), F.lit(None).cast("binary").alias("geometry"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    path = write_geoparquet(df, str(tmp_path / "f.parquet"), sort=False, row_group_size=1000)
    meta = pq.read_metadata(path)
    assert [meta.row_group(g).num_rows for g in range(meta.num_row_groups)] == [1000] * 10 + [3]
    assert pq.read_table(path)["id"].to_pylist() == list(range(10_003))
    assert meta.row_group(3).column(0).has_offset_index and meta.row_group(3).column(0).statistics.min == 3000
    back = spark.read.parquet(f"file://{path}")
    assert back.where("id >= 9000 and s is not null").count() == df.where("id >= 9000 and s is not null").count()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
