"""Articles inside elements whose name or tag sounds like side matter."""

import pytest

from hostlens.llm import maintext as mt

PARTS = ["A long paragraph, with commas, of many words in a row. It ends."] * 3
ARTICLE = "<article><p>" + "</p><p>".join(PARTS) + "</p></article>"
NAV = '<nav><a href="/a">Home</a></nav>'


@pytest.mark.parametrize("wrapper", [
    '<div class="content with-sidebar">', '<div class="no-sidebar">', '<div class="has-ads">', '<div class="search-result">',
    '<div class="popular">', '<form action="/post.aspx">', '<main><div class="popular">',
])
def test_wrapped_article_is_kept(wrapper):
    page = f"<body>{NAV}{wrapper}{ARTICLE}</div></form></main><footer>Copyright X.</footer></body>"
    assert mt.main_text(page, mt.START).split("\n") == PARTS


def test_page_wide_form_without_article():
    page = f"<body><form>{NAV}<div><p>{'</p><p>'.join(PARTS)}</p></div><footer>Copyright X.</footer></form></body>"
    assert mt.main_text(page, mt.START).split("\n") == PARTS


def test_side_matter_with_articles_stays_out():
    teaser = "<article><p>Another story, in few words. Read on.</p></article>"
    for side in (f'<div class="related">{teaser}</div>', f"<aside>{teaser}</aside>", "<form>Name <input> Send</form>"):
        assert mt.main_text(f"<body>{NAV}{ARTICLE}{side}</body>", mt.START).split("\n") == PARTS
        assert mt.main_text(f"<body>{NAV}<div><p>{'</p><p>'.join(PARTS)}</p></div>{side}</body>", mt.START).split("\n") == PARTS
