"""Headers of any length, and lengths inside payloads that no file has."""

import pytest
from strandline.llm import warc

from tests.llm.test_warc import rows

FAR = [f"WARC/1.0\r\nContent-Length: {n}\r\n\r\n" for n in ("9" * 19, "9" * 30, "9" * 5000)]


@pytest.mark.parametrize("split", [warc.SPLIT, 1000])
@pytest.mark.parametrize("pages", [[(1, "u", "a"), (2, "http://a.example/" + "x" * 150_000, "b"), (3, "v", "c")], [(k, "u", t) for k, t in enumerate(FAR)]])
def test_round_trip(spark, tmp_path, split, pages):
    path = "file://" + str(tmp_path / "archive")
    warc.write_pages(spark, spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    assert rows(warc.read_pages(spark, path, split)) == sorted(pages, key=str)
