"""The data source for text tables inside zip files."""

import os
import subprocess
import sys
import zipfile

import pytest

from tessera.sources import readers
from tessera.sources.zipped import FILE, MEMBER, zipped_table

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)


def test_files_and_members(spark, tmp_path):
    for state in ("Ohio", "Utah"):
        archive(tmp_path / f"{state}.zip", {
            "1.County-to-County.csv": f"﻿orig, dest ,tons_2022,trade_type\n01001,01003,2.5,1\n01001,{state},9,2\n",
            "2.County-to-FAF.csv": "orig,zone,tons_2022,trade_type\n01001,11,,1\n\"a,b\",\"\",1,1\n",
            "2.FAF-to-County.csv": "zone,dest,tons_2022,trade_type\n",
        })
    (tmp_path / "notes.txt").write_text("no zip")
    found = readers.zipped_flows(spark, f"file://{tmp_path}", {"county_to_county": ["orig", "dest"], "county_to_zone": ["orig", "zone"], "zone_to_county": ["zone"]})
    assert sorted(map(tuple, found["county_to_county"].collect())) == [("Ohio", "01001", "01003", 2.5), ("Utah", "01001", "01003", 2.5)]
    assert sorted(map(tuple, found["county_to_zone"].where("state = 'Utah'").collect())) == [("Utah", "01001", "11", None), ("Utah", "a,b", "", 1.0)]
    assert found["zone_to_county"].count() == 0
    rows = zipped_table(spark, f"file://{tmp_path}/Ohio.zip", [MEMBER, "orig", FILE], "[12].County*")
    assert rows.rdd.getNumPartitions() == 2 and {os.path.basename(r[FILE]) for r in rows.collect()} == {"Ohio.zip"} and rows.count() == 4
    with pytest.raises(Exception, match="nothing"):
        zipped_table(spark, f"file://{tmp_path}/none.zip", ["a"]).collect()
    with pytest.raises(Exception, match="no member"):
        zipped_table(spark, f"file://{tmp_path}/Ohio.zip", ["a"], "x*").collect()
    with pytest.raises(Exception, match="missing"):
        zipped_table(spark, f"file://{tmp_path}/Ohio.zip", ["dust"]).collect()


def test_sectors(spark, tmp_path):
    names = [*readers.SECTOR_COLUMNS, "emp"]
    rows = [("01001", "11", "74", "5", "4", "", "7"), ("01001", "10", "71", "5", "4", "N", "8"), ("01001", "11", "71", "5", "4", "", "9"), ("01001", "11", "74", "5", "3", "", "1"), ("01001", "11", "74", "1", "4", "", "2")]
    archive(tmp_path / "s.zip", {"s.csv": "\n".join(",".join(r) for r in [names, *rows])})
    got = readers.county_sectors(spark, f"file://{tmp_path}/s.zip", ["emp"])
    assert sorted(r.emp for r in got.collect()) == ["7", "8"]
    archive(tmp_path / "none.zip", {"s.csv": ",".join(names) + "\n"})
    with pytest.raises(ValueError):
        readers.county_sectors(spark, f"file://{tmp_path}/none.zip")


def test_a_large_member_needs_little_memory(tmp_path):
    line = ",".join(["01001", "11", "%d", "5", "4", "x" * 60]) + "\n"
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("big.csv", "w", force_zip64=True) as f:
        f.write(b"area,industry,level,own,qtr,note\n")
        block = "".join(line % (74 if i % 100 == 0 else 75) for i in range(40_000)).encode()
        size = 0
        while size < 300_000_000:
            size += f.write(block)
    code = f"""
import json, resource
from pyspark.sql.types import StructType
from tessera.sources import zipped
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
r = zipped.ZippedReader(StructType().add("area", "string").add("level", "string"), {{"paths": json.dumps(["file://{tmp_path}/big.zip"]), "only": json.dumps({{"level": ["74"]}})}})
before, n = peak(), 0
for p in r.partitions():
    for batch in r.read(p):
        n += batch.num_rows
print(n, before, peak())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}).stdout
    n, before, after = map(int, out.split()[-3:])
    assert n == size // len(block) * 400 and after - before < 100, out
