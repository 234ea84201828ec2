"""The files of working tables."""

import glob
import os

import pytest

from brindle.llm.common import cut, drop_cut


def test_a_working_table_has_no_files_but_its_parts_and_damage_is_noticed(spark):
    rows = spark.range(0, 3000, 1, 3).selectExpr("id", "sha2(string(id), 256) AS text")
    out = cut(spark, rows)
    folder = out._brindle_path.removeprefix("file://")
    parts = sorted(os.listdir(folder))
    assert len(parts) == 3 and all(x.startswith("part-") and x.endswith(".parquet") for x in parts)
    assert out.dtypes == rows.dtypes and sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.collect()))
    with open(glob.glob(f"{folder}/part-00001*")[0], "r+b") as f:
        f.seek(20_000)
        was = f.read(1)
        f.seek(20_000)
        f.write(bytes([was[0] ^ 1]))
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        out.selectExpr("xxhash64(id, text)").collect()
    drop_cut(spark, out)
    assert not os.path.exists(folder)
