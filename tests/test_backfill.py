"""Bodies that are missing are filled from pages and written into the stored table."""

from gristmill import queries_more


def test_backfill(spark):
    prose = "".join(f"<p>Sentence number {i} goes on and on about many different things of note.</p>" for i in range(12))
    views = {
        "articles": spark.createDataFrame([("a", 1, "", "rss_summary"), ("b", 2, None, "rss_summary"), ("c", 3, "kept", "web"), ("d", 4, "", "web")], "id string, doc_id long, content_original string, content_extraction_method string"),
        "pages": spark.createDataFrame([(1, f"<article>{prose}</article>"), (2, "<p>short</p>"), (3, prose)], "page_id long, html string"),
    }
    got = {r.state: (r.n, r.chars) for r in queries_more.maint_backfill_body(views.__getitem__).collect()}
    assert got["skipped"] == (1, 0) and got["failed"] == (1, 0) and got["filled"][0] == 1 and got["filled"][1] > 600
