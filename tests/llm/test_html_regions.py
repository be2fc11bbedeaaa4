"""Pages whose main text stands in several regions, or in a wrapper with a misleading class."""

from tidemark.llm.html_text import main_text

LONG = "".join(f"<p>{f'paragraph {x} goes on and on. ' * 20}</p>" for x in range(40))
INTRO, END = "An introduction that tells what follows. " * 8, "What was said above comes to an end here. " * 9


def test_small_regions_beside_a_long_one():
    text = main_text(f"<body><div><h1>Headline</h1><p>{INTRO}</p></div><div>{LONG}</div><blockquote>{INTRO}</blockquote><div><p>{END}</p></div><div><a href=1>one</a> <a href=2>two</a></div></body>")
    assert text.startswith("Headline\nAn introduction") and text.count("paragraph") == 800 and text.count("An introduction") == 16
    assert text.endswith("end here.") and "one two" not in text


def test_articles_of_unlike_length():
    text = main_text(f"<article>{LONG}</article><article><p>{INTRO}</p></article>")
    assert "An introduction" in text and "paragraph 39" in text


def test_marked_wrapper():
    text = main_text(f"<body><div class='content has-sidebar'><div class='sidebar'>Other pages</div><div id='post-header'>{LONG}</div></div><div class='footer'>Imprint</div></body>")
    assert "paragraph 0" in text and "paragraph 39" in text and "Other pages" not in text and "Imprint" not in text


def test_names_that_say_something_else_mark_nothing():
    long = "<p>" + "A sentence of the article that goes on for a while. " * 6 + "</p>"
    page = f"""<article><h1>Title</h1>{long}<p class="related-work">Earlier work on this.</p><h2 id="comments-on-method">Comments on method</h2>
    <p class="social-history">History.</p><div class="comment-list"><p>{"I liked it. " * 9}</p></div><p class="cookie-notice">We use cookies.</p>
    <div class="related-posts"><a href="/x">More</a></div>{long}</article>"""
    text = main_text(page)
    for kept in ("Earlier work", "Comments on method", "History."):
        assert kept in text
    for gone in ("I liked", "cookies", "More"):
        assert gone not in text


def test_unclosed_and_stray_tags_take_linear_time():
    import time

    n = 20_000
    body = "<p>" + "Words of the page. " * 20 + "</p>"
    began = time.process_time()
    for page in ("<div>" * n + body + "</span>" * n, "<p><div>" + "<b>" * n + "<p></p>" * n + body, '<div class="related">' * n + body + "</div></section>" * n):
        assert "Words of the page." in main_text(page)
    assert time.process_time() - began < 6
