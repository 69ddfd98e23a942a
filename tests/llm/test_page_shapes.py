"""Main text of pages of many shapes, labelled by hand."""

import time

import pytest

from sluiceway.llm.html_text import main_text

A = "The cat and the dog sat on the mat with a hat and it was good for the two of them."
B = "It was not the first of the days on which they had to go to the river and they were glad of it."
LIST = "<ul><li><a href=x>Source one</a></li><li><a href=y>Source two</a></li></ul>"
MENU = "<nav><a href=1>Home</a> <a href=2>News</a></nav>"
FOOT = "<footer>© 2020 The paper and all of its owners, with thanks to the readers of it</footer>"


@pytest.mark.parametrize("html,text", [
    ("", ""), (None, ""), (" \n ", ""), ("plain text only", "plain text only"), ("<p>Hello world.</p>", "Hello world."),
    (f"<p>{A}</p>", A), (f"<p>{A}<p>{B}", f"{A}\n{B}"), (f"<div>{A}</div>{MENU}", A), (f"{MENU}<p>{A}</p>{FOOT}", A),
    (f"<article><p>{A}</p></article>", A), (f"<main><p>{A}</p></main>{FOOT}", A),
    (f"<article><h1>Title</h1><p>{A}</p></article>", f"Title\n{A}"),
    (f"<article><p>{A}</p>{LIST}</article>", f"{A}\nSource one\nSource two"),
    (f"<article><p>{A}</p><p>© 2020 the owner</p></article>", f"{A}\n© 2020 the owner"),
    (f"<div><p>{A}</p></div><article><h2>Teaser one</h2></article>", A),
    (f"<article><p>{A}</p></article><div><p>Short aside</p></div>", A),
    (f"<article><p>{A}</p><aside><p>{B}</p></aside></article>", A),
    (f"<article><p>{A}</p><div class='advert'><p>{B}</p></div></article>", A),
    (f"<article><p>{A}</p></article><section id='comments'><p>{B}</p></section>", A),
    (f"<div class='cookie-notice'>{B}</div><article><p>{A}</p></article>", A),
    (f"<article><p>{A}</p><form><p>{B}</p></form></article>", A),
    (f"<article><p>{A}</p><script>var a = '<p>{B}</p>'</script><style>p {{}}</style></article>", A),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>", "Let x=2 be."),
    (f"<p>{A} &amp; &lt;b&gt; &eacute; &#128512;</p>", f"{A} & <b> é 😀"),
    (f"<p>The   cat\n and\tthe dog sat on the mat</p>", "The cat and the dog sat on the mat"),
    (f"<html><head><title>T</title><body><article><p>{A}</p>", A),
    (f"<div class='layout has-sidebar'><p>{A}</p></div>", A),
    ("<div class=ad>buy</div>", ""), ("<nav>a</nav>", ""), ("<footer>b</footer>", ""),
    (f"<article><p>{A}</p><p><a href=x>all of it is a link</a></p><p>{B}</p></article>", f"{A}\nall of it is a link\n{B}"),
    (f"<p>{A}</p><p><a href=x>elsewhere</a></p>", A), (f"<blockquote>{A}</blockquote>", A),
    (f"<table><tr><td>{A}</td></tr></table>", A), (f"<p>{A}</div></span></p><p>{B}</p>", f"{A}\n{B}"),
])
def test_shapes(html, text):
    assert main_text(html) == text


def test_long_and_deep_pages_take_time_in_proportion():
    def seconds(html):
        start = time.process_time()
        main_text(html)
        return time.process_time() - start

    for small, large in (
        (f"<p>{A}</p>" * 2000, f"<p>{A}</p>" * 16000),
        ("<div>" * 2000 + A + "</div>" * 2000, "<div>" * 16000 + A + "</div>" * 16000),
    ):
        assert seconds(large) < 40 * max(seconds(small), 0.02)
