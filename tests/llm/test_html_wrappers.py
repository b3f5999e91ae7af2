"""Pages that are wrapped, broken or in other scripts, and the time that tags without an end take."""

import time

import pytest

from ledgerloom.llm import htmltext

EN = "This is the text of the article, and it is long enough to be taken as content of the page, with all of the words that are common. " * 2
RU = "Это длинный текст на русском языке, в котором рассказывается о строительстве школы и о том, как жители города собирали средства. " * 2
ZH = "这是一个很长的中文段落,讲述了城市的历史和人民的生活,以及他们如何在河边建造房屋并种植水稻。" * 3
MENU = "<div class=menu><a href=x>Home</a> <a href=y>News</a></div>"


@pytest.mark.parametrize("text", [EN, RU, ZH])
@pytest.mark.parametrize("wrapper", ["<form id=aspnetForm>{}</form>", "<div class='post header'>{}</div>", "<div>{}</div>", "<div class=menu/><a href=z>Z</a></div><p>{}</p>"])
def test_wrapped_articles_are_kept(text, wrapper):
    assert htmltext.main_text("<body>" + MENU + wrapper.format(f"<p>{text}</p>") + "</body>") == text.strip()


def test_small_forms_and_comments_stay_out():
    assert htmltext.main_text(f"<form class=login><p>{EN}</p></form><p>{EN}</p><p>{EN}</p>").count("article") == 4
    assert htmltext.main_text(f"<form class='comment form'><p>{EN}</p></form>") == ""
    assert htmltext.main_text(f"<div class='cookie header'><p>{EN}</p></div>") == ""


def test_quoted_values_may_hold_signs():
    assert htmltext.main_text(f"<p title='a > b'>{EN}</p><img alt=\"x < y\">") == EN.strip()


@pytest.mark.parametrize("page", ["<b " * 20_000, '<a "' * 20_000, '<a ">" ' * 20_000, "<script " * 20_000, "<div>" * 20_000 + "</p></span>" * 20_000, "<!-- " * 20_000, "<a '" * 20_001 + ">"])
def test_time_grows_with_the_page(page):
    began = time.time()
    htmltext.main_text(page)
    assert time.time() - began < 3
