"""Pages written by hand, with the text that should be left of each."""

import time

import pytest

from quarry.llm import html

P = "A long paragraph of plain running text that tells the reader what happened in the town yesterday."
SHAPES = {
    "advert in the main block": (f"<body><main><h1>Title here</h1><p>{P}</p><div class='ad-slot'>Buy shoes now</div><p>{P}</p></main></body>", f"Title here {P} {P}"),
    "advert in a post": (f"<body><div class='post-body'><p>{P}</p><div class='ad-container'>Sponsored: great deal on shoes</div><p>{P}</p></div></body>", f"{P} {P}"),
    "footer by its id": (f"<body><div class=content><h1>Title here</h1><p>{P}</p><p>{P}</p></div><div id=ft>All rights reserved 2020</div></body>", f"Title here {P} {P}"),
    "header, body and footer by id": (f"<body><div id=hd><a href=/>Site</a></div><div id=bd><p>{P}</p><p>{P}</p></div><div id=ft>About us</div></body>", f"{P} {P}"),
    "unseen elements": (f"<body><article><p>{P}</p><noscript>Enable JS</noscript><template><p>hidden</p></template></article></body>", P),
    "notice": (f"<body><div id='cookie-bar'>We use cookies.</div><article><h1>T one</h1><p>{P}</p></article></body>", f"T one {P}"),
    "related stories": (f"<body><article><h1>T one</h1><p>{P}</p><div class='related-posts'><h3>Related</h3><ul><li><a href=x>Other story</a></li></ul></div><p>{P}</p></article></body>", f"T one {P} {P}"),
    "letter to subscribe to": (f"<body><main><p>{P}</p><div class='newsletter-box'><p>Sign up for our newsletter today.</p></div><p>{P}</p></main></body>", f"{P} {P}"),
    "comments": (f"<body><article><p>{P}</p></article><div id='comments'><div class=comment><p>Nice article, I liked it a lot.</p></div></div></body>", P),
    "bare paragraphs": (f"<p>{P}</p><p>{P}</p>", f"{P} {P}"),
    "one short block": ("<body><nav><a href=/>Home</a></nav><article><p>Yes.</p></article><footer>c 2020</footer></body>", "Yes."),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(shape):
    page, wanted = SHAPES[shape]
    found = html.leaves(page)
    labels = html.trained().label([found])[0]
    assert " ".join(leaf[1] for leaf, yes in zip(found, labels, strict=True) if yes) == wanted


def text_of(page):
    found = html.leaves(page)
    labels = html.trained().label([found])[0]
    return " ".join(leaf[1] for leaf, yes in zip(found, labels, strict=True) if yes or html.untagged(found))


def test_bare_pages():
    said = ["First paragraph of text here.", "Second paragraph follows it."]
    assert text_of("".join(f"<p>{x}</p>" for x in said)) == " ".join(said)
    assert text_of("<p>Just a text of some words here.</p>") == "Just a text of some words here."
    page = "Home | News | About<br><br>The river rose again in the night, and the town had to be left.<br><br>Nobody was hurt, the mayor said.<br><br>Copyright 2024"
    assert text_of(page) == "The river rose again in the night, and the town had to be left. Nobody was hurt, the mayor said."
    assert text_of("") == "" and text_of("<br><br>") == ""


@pytest.mark.parametrize("piece", ['<a "', "<a", "<!--", "<script>", "<div>x", "<p title=\"x>text", "<a 'x <b \"y> ", "\"'> <b '", "</div>", "&amp", "<"])
def test_malformed_pages_are_read_in_one_pass(piece):
    began = time.process_time()
    html.leaves(piece * (400_000 // len(piece)))
    assert time.process_time() - began < 8


def test_depth_is_bounded():
    deep = html.leaves("<div>" * 1000 + "low" + "</div>" * 1000 + "<p>high</p>")
    assert [(len(path), text) for path, text, _ in deep] == [(html.DEEPEST, "low"), (1, "high")]


def test_attributes_end_outside_of_quotes():
    assert html.leaves("<p class='a > b'>one</p><P ID=x>two<!-- > --></p><p data-x=\">\" class=c>three") == [(("p class=a class=> class=b",), "one", 0.0), (("p id=x",), "two", 0.0), (("p class=c",), "three", 0.0)]


def test_extract_of_an_empty_table(spark):
    pages = spark.createDataFrame([(1, None, "t")], "page_id long, html string, text string")
    assert html.extract(pages.limit(0)).count() == 0
    assert [tuple(r) for r in html.extract(pages).collect()] == [(1, "", 0)]
