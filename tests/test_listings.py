"""Listing pages that are out of the common run."""

from gristmill.sources import listings


def test_deep_pages_and_pages_that_cannot_be_read(spark):
    card = '<div><a href="/blog/x"><h3>A title</h3></a><span class="date">Jan 2, 2024</span></div>'
    pages = [(1, "<ul>" + "<li>" * 5000 + card), (2, card), (3, "<p>nothing</p>"), (4, None), (5, "<![foo" + card)]
    got = {}
    for r in listings.link_cards(spark.createDataFrame(pages, "page_id long, html string"), "/blog/", "https://q.example.com").collect():
        got[r.page_id] = (r.url, r.title, r.published_at and r.published_at.day, r.found, bool(r.error))
    found = ("https://q.example.com/blog/x", "A title", 2, True, False)
    assert got[1] == got[2] == found and got[3] == got[4] == (None, None, None, False, False) and set(got) >= {1, 2, 3, 4}
