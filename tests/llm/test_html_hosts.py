"""What the pages of a host agree on, and an independent plain extractor over generated pages."""

import random

from stocktide.llm import html_text

FRAME = '<div class="x1">Reach us at the old mill, open daily.</div>'


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "p", 0, "r") for k, (u, h) in enumerate(rows)],
                                 "page_id long, url string, html string, path string, salt int, repeated string")


def texts(spark, rows):
    return {r.page_id: r.text for r in html_text.main_text(pages(spark, rows)).collect()}


def page(k, frame=FRAME):
    return (f'<body><div class="t9">Title {k}</div><div class="c7"><p>First words of story {k}, they go on for a while.</p><p>Second words {k * k} of it, and more of them.</p></div>{frame}</body>')


def wanted(k):
    return f"Title {k} First words of story {k}, they go on for a while. Second words {k * k} of it, and more of them."


def test_the_host_decides_on_its_frame(spark):
    rows = [(f"http://one.example/{k}", page(k)) for k in range(6)]
    rows += [("http://one.example/own", page(6, '<div class="x1">A note of this page only.</div>'))]
    rows += [("http://two.example/1", page(7))]
    got = texts(spark, rows)
    assert [got[k] for k in range(6)] == [wanted(k) for k in range(6)]  # the vote takes the frame away, titles stay
    assert got[6] == wanted(6) + " A note of this page only."
    assert got[7] == wanted(7) + " Reach us at the old mill, open daily."  # one page agrees with nobody


def test_copies_of_one_page_are_one_voice(spark):
    got = texts(spark, [("http://one.example/a", page(1))] * 5 + [("http://one.example/b", page(2))])
    assert all(got[k] == wanted(1) + " Reach us at the old mill, open daily." for k in range(5))


def test_generated_pages_give_their_article(spark):
    """Pages are made of known articles and of frames around them; the article must come back exactly."""
    rng, rows, want = random.Random(3), [], []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    for k in range(60):
        blocks = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        main = rng.choice([f"<article>{body}</article>", f'<main><div class="content">{body}</div></main>', f'<div class="post-body">{body}</div>'])
        head = '<header>Site name</header><nav><a href="/">Home</a> <a href="/a">About us all</a></nav><div class="sidebar-wrapper">Side words</div>'
        tail = '<div class="post-comments"><p>I disagree, Bob.</p></div><footer>All rights</footer><script>var x = "<p>no</p>";</script>'
        rows.append((f"http://h{k % 4}.example/{k}", f"<html><head><title>t</title></head><body>{head}{main}{tail}</body></html>"))
        want.append(" ".join(blocks))
    got = texts(spark, rows)
    assert [got[k] for k in range(60)] == want


def test_odd_pages(spark):
    rows = [(None, None), ("no url", ""), ("http://x.example/", "<p>a" * 30_000), ("http://x.example/", "plain words only"), ("", "<div>" * 5_000 + "deep")]
    got = texts(spark, rows)
    assert (got[0], got[1], got[3], got[4]) == ("", "", "plain words only", "deep") and len(got[2]) == 2 * 30_000 - 1
    assert html_text.main_text(pages(spark, rows).limit(0)).count() == 0
