"""Pages whose article is not all of their text, or holds more than text."""

from ledgerloom.llm import htmltext

LONG = ("this is the text of a long paragraph and it has many of the words " * 3).strip()


def test_text_outside_an_article_and_links_inside_one():
    page = f"<body><article><p>{LONG} teaser</p></article><div><p>{LONG} body</p><p>ok then</p><p>{LONG} end</p></div></body>"
    assert htmltext.main_text(page).split("\n\n") == [f"{LONG} teaser", f"{LONG} body", "ok then", f"{LONG} end"]
    page = f"<body><article><h1>Title</h1><p>{LONG}</p><ul><li><a href=a>one link</a></li><li><a href=b>another link</a></li></ul><p>{LONG} end</p></article></body>"
    assert htmltext.main_text(page).split("\n\n") == ["Title", LONG, f"{LONG} end"]
