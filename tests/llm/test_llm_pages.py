import pytest

from pitgate.llm.html_blocks import main_text, main_texts

BODY = "A paragraph long enough to be the text of an article, with a few more words. "


@pytest.mark.parametrize(("markup", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>That it.</p>", "That it."),
    (f"<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1><p>{BODY}</p><p>Ti.</p></article>"
     "<footer>&copy; 2020</footer>", f"Title\n{BODY.strip()}\nTi."),
    (f"<header>Site</header><div id=cookie-notice>Cookies!</div><div class=\"main\"><p>{BODY}</p><aside>See also</aside>"
     f"<p>x &lt; y&nbsp;&#233;</p></div><div class='comments'><p>{BODY}</p></div>", f"{BODY.strip()}\nx < y é"),
    (f"<script>var t='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p><b>{BODY}<br>two\n lines<p>next",
     f"{BODY.strip()} two lines\nnext"),
    (f"<main><p>{BODY}</p><form><p>Send</p></form><div class=adBanner>buy</div><p>End</p></main>", f"{BODY.strip()}\nEnd"),
    (f"<article><p>{BODY}</p><svg/><p>After it.</p><svg width=1 class='x' /><p>And then.</p><svg a=b><title>no</title></svg></article>",
     f"{BODY.strip()}\nAfter it.\nAnd then."),
    (f"<article><p title=it's>{BODY}</p><p class=\"a\" title='b \"c\"'>Two of them.</p></article>", f"{BODY.strip()}\nTwo of them."),
    (f"<div><a href=1>one</a> <a href=2>two</a></div><div>{BODY}</div><div><a href=3>three links here</a></div>", BODY.strip()),
])
def test_main_text(markup, text):
    assert main_text(markup) == text


def test_pages_keep_their_rows(spark):
    rows = [(1, "u", None, "x"), (2, "u", "<p>Hello there</p>", "x"), (2, "u", "<p>Hello there</p>", "x"), (None, None, "", "x"),
            (3, "v", f"<p>{BODY * 20_000}</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = main_texts(pages).collect()
    assert sorted((str(r["page_id"]), str(r["url"]), len(r["text"])) for r in out) == [
        ("1", "u", 0), ("2", "u", 11), ("2", "u", 11), ("3", "v", len(BODY) * 20_000 - 1), ("None", "None", 0)]
    assert main_texts(pages.limit(0)).collect() == []


SAID = BODY.strip()


@pytest.mark.parametrize(("markup", "text"), [
    (f"<div class=entry><p>{BODY}</p></div><div><article class='comment-body'><p>{BODY}x</p></article></div>", SAID),
    (f"<div class=entry><p>{BODY}</p></div><aside><article><p>{BODY}x</p></article></aside>", SAID),
    (f"<div class=entry><p>{BODY}</p></div><article><a href=1>Read more</a></article>", SAID),
    (f"<article><p>{BODY}</p><h2 id='discussion'>Discussion</h2><section id='search-methods'><p>{BODY}</p><p>{BODY}</p>"
     f"</section><div class='related-work'><p>{BODY}{BODY}</p></div></article>",
     f"{SAID}\nDiscussion\n{SAID}\n{SAID}\n{BODY}{SAID}"),
    (f"<article><p>{BODY}</p><ul class=related><li><a href=1>{BODY}</a></ul><p>End</p></article>", f"{SAID}\nEnd"),
    (f"<article><ul><li class=share>Share<li>{BODY}<li>{BODY}</ul><p class=promo>Buy<p>{BODY}</article>",
     f"{SAID}\n{SAID}\n{SAID}"),
    (f"<article><ul><li class=share><h3>Share</li><li>{BODY}</ul></article>", SAID),
    (f"<article><div class=ad>buy<p>now</article><div>{BODY}</div>", f"{SAID}"),
    (f"<main><table><tr><td class=ads>buy<td>{BODY}<tr><td>{BODY}</table></main>", f"{SAID}\n{SAID}"),
])
def test_articles_headings_and_missing_end_tags(markup, text):
    assert main_text(markup) == text
