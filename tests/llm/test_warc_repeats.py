from collections import Counter

from riskloom.llm import warc
from riskloom.llm.queries import op3_warc


def test_every_row_of_pages_comes_back(spark, tmp_path):
    pages = [(2, "http://b", "same")] * 3 + [(2, "http://c", "same"), (5, "http://a", "same"), (5, "http://a", "same"), (None, "http://e", "lone"), (None, "http://f", "lone"), (None, None, None), (None, None, None), (9, "http://g", "one"), (9, "http://g", "two")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in op3_warc(spark, str(tmp_path)).collect())
    assert got == {(2, 4, "response", None): 4, (5, 4, "revisit", 2): 2, (None, 4, "response", None): 2, (None, 0, "response", None): 2, (9, 3, "response", None): 2}
    for least in (0, 10):
        warc.write_pages(df, str(tmp_path / f"w{least}"), least)
        held = warc.assemble(warc.read_records(spark, str(tmp_path / f"w{least}"))).collect()
        assert Counter(r.target_uri for r in held) == {"http://b": 3, "http://c": 1, "http://a": 2, "http://e": 1, "http://f": 1, "urn:page:null": 2, "http://g": 2}
        assert all(r.request and r.metadata for r in held) and sum(r.record_type == "revisit" for r in held) == (2 if least == 0 else 0)
