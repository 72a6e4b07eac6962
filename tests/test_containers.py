"""The element of a page that holds the article."""

import pytest

from gristmill.sources import pages

CASES = {
    "two candidates, the larger wins": ("<body><main><p>The whole story is told here at length.</p></main><article><p>A card</p></article></body>", "", "The whole story is told here at length."),
    "chrome beside the article": ("<body><p>Menu words around</p><article><h2>Head</h2><p>Told.</p></article><p>After</p></body>", "", "## Head\n\nTold."),
    "a wrapper is no larger": ("<div class='content'><div class='post-body x'><p>Told.</p></div></div>", "", "Told."),
    "no candidate": ("<div><p>One.</p><p>Two.</p></div>", "", "One.\n\nTwo."),
    "the source's own selector wins over a larger one": ("<main><p>Long words of a page that says much more.</p><div class='blog-post-body'><p>Told.</p></div></main>", "cohere", "Told."),
    "without its source the larger wins": ("<main><p>Long words here.</p><div class='blog-post-body'><p>Told.</p></div></main>", "", "Long words here.\n\nTold."),
    "part of a class": ("<main><p>Long words of a page.</p><div class='my-posting'><p>Told.</p></div></main>", "anthropic", "Told."),
    "a step above": ("<div id='main-content'><section><div class='prose'><p>Told.</p></div></section></div>", "", "Told."),
    "furniture is no candidate": ("<div class='content' role='navigation'><p>Much more text than the story itself has.</p></div><article><p>Told.</p></article>", "", "Told."),
    "an element that never ends": ("<p>Before</p><article><p>Told.<p>More", "", "Told.\n\nMore"),
    "an inline container": ("Before <span class='prose'>told here</span> after", "", "told here"),
    "attributes": ("<p>x</p><div itemprop='articleBody'><p>Told.</p></div><div role='main'><p>Te</p></div>", "", "Told."),
}


@pytest.mark.parametrize("sourced", [True, False])
def test_containers(spark, sourced):
    rows = [(i, html, source) for i, (html, source, _) in enumerate(CASES.values()) if sourced or not source]
    frame = spark.createDataFrame(rows, "page_id long, html string, source_id string")
    got = {r.page_id: r.raw for r in pages.bodies(frame if sourced else frame.drop("source_id")).collect()}
    assert {list(CASES)[i]: raw for i, raw in got.items()} == {k: v[2] for k, v in CASES.items() if sourced or not v[1]}
