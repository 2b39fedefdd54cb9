"""Streams over the given tables, as a file or as a folder of files."""

import glob
import shutil

import pytest

from checks import load


@pytest.mark.parametrize("folder", [True, False])
def test_streams_read_files_and_folders(spark, tmp_path, folder):
    rows = [(i, f"<html><body>page {i}</body></html>") for i in range(7)]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(2 if folder else 1)
    pages.write.parquet(str(tmp_path / ("pages.parquet" if folder else "parts")))
    if not folder:
        shutil.copy(glob.glob(str(tmp_path / "parts" / "part-*"))[0], tmp_path / "pages.parquet")
    found = load()[0]["stream_routed_pages"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n"]) for r in found) == [(i, 1) for i in range(7)]
