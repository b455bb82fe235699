"""Which classes are boilerplate, outside and inside an article, against the wanted text."""

import pytest

from stocktide.llm import html_text

GONE = ("post-comments comments comment-list commentList footer-content site-footer cookie-container cookieBanner gdpr-consent sidebar-wrapper sidebar story-share share-bar "
        "social-links nav-container main-nav navMenu breadcrumbs ad-slot advertisement sponsored-post newsletter-signup subscribe-box widget-area pagination post-pager "
        "content-sidebar page-footer main-menu modal-content overlay").split()
STAYS = ("article-header entry-header post-header content main-content page-wrapper story-body has-sidebar layout-with-sidebar no-ads entry text container article-body").split()


def text(html):
    page = html_text.Page(html)
    return html_text.extract(html, page.paths[page.best()])


@pytest.mark.parametrize("name", GONE)
def test_boilerplate_goes_inside_and_outside(name):
    assert text(f'<body><div class="{name}">Gone away</div><article><h1>T</h1><p>Body one.</p><div class="{name}">Gone too, Bob.</div></article></body>') == "T Body one."


@pytest.mark.parametrize("name", STAYS)
def test_content_stays(name):
    assert text(f'<body><article><div class="{name}"><p>Lead words.</p></div><p>Body one.</p></article></body>') == "Lead words. Body one."


@pytest.mark.parametrize("name", ["related-work", "alert", "legal", "search-results", "form", "reply", "notice", "disclaimer"])
def test_soft_words_inside_an_article_drop_links_only(name):
    page = f'<body><article><p>One.</p><section class="{name}"><p>Running text of it.</p><ul><li><a href="x">More stories</a></li></ul></section><p class="{name}">Two.</p></article></body>'
    assert text(page) == "One. Running text of it. Two."
    assert text(f'<body><div class="{name}">Outside</div><article><p>One.</p></article></body>') == "One."


def test_menu_and_footer_with_content_words_go():
    html = ('<body><div class="nav-container">Home About</div><div class="post"><p>Article body one.</p></div><div class="footer-content">All rights reserved by us.</div></body>')
    assert text(html) == "Article body one."
