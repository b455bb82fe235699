"""Main text of pages whose articles are not flat, and of pages with unclosed elements."""

from stocktide.llm import html_text

LONG = "running words of the main part " * 20
NESTED = "<html><body><nav><a href='/'>home</a></nav><article><h1>Title</h1><p>Lead of it.</p>{}<section><p>Last words.</p></section></article><footer>f</footer></body></html>"


def test_nested_articles_keep_title_lead_and_siblings(spark):
    pages = [(k, f"http://h.org/{k}", NESTED.format(f"<div class='entry-content'><p>{LONG}</p></div>")) for k in range(4)]
    pages.append((9, "http://h.org/9", f"<body><h1><a href='/'>Top</a></h1><div><p>{LONG}</p></div><div><p>More words outside.</p></div></body>"))
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(4):
        assert got[k] == f"Title Lead of it. {LONG.strip()} Last words."
    assert got[9].endswith(f"{LONG.strip()} More words outside.")


def test_host_path_never_loses_running_text():
    page = NESTED.format(f"<div class='entry-content'><p>{LONG}</p></div>")
    path = ">html>body>article>div.entry-content"
    assert html_text.extract(page, path) == html_text.extract(page, None) == f"Title Lead of it. {LONG.strip()} Last words."
    linked = f"<body><article><h1><a href='/'>Linked title</a></h1><div><p>{LONG}</p></div></article></body>"
    assert html_text.extract(linked, None) == f"Linked title {LONG.strip()}"


def test_unclosed_and_self_closed_elements_end_with_their_block():
    def text(inner, head=""):
        return html_text.extract(f"<html><head>{head}</head><body><article><p>one</p><div>two {inner} x</div><p>three</p></article></body></html>", None)

    for tag in ("button", "select", "noscript", "object", "template", "canvas", "iframe", "svg"):
        assert text(f"<{tag}>gone") == "one two three"
        assert text(f"<{tag} a='b'>gone</{tag}> kept") == "one two kept x three"
    for tag in ("svg", "object", "iframe"):
        assert text(f"<{tag} a='b'/> kept <svg><title>gone</title></svg>") == "one two kept x three"
    assert text("", "<title>gone") == text("", "<noscript>gone") == "one two x three"
    assert text("wor<svg><path/></svg>ld") == "one two world x three"
    assert text("<script>var a = '</p>';</script><script src='a'/>") == "one two x three"
