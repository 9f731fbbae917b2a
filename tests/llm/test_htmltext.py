import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quadrille.llm import htmltext
from quadrille.llm.htmltext import extract, main_text

LONG = "A sentence that is long enough to make a window surge over the threshold."
CASES = {
    "elements": (f"<body><header><h1>Site</h1><p>{LONG}</p></header><nav><ul><li>{LONG}</ul></nav><h1>Title</h1><p>{LONG}</p><aside>{LONG}</aside><form><p>{LONG}</p></form><footer>{LONG}</footer></body>", f"Title\n\n{LONG}"),
    "purposes": (f'<div class="cookie-notice">{LONG}</div><div id="sidebar">{LONG}</div><div class="ad">{LONG}</div><p>{LONG} One.</p><section class="comments"><p>{LONG}</p></section><div role="navigation">{LONG}</div><p hidden>{LONG}</p>', f"{LONG} One."),
    "article": (f"<div>{LONG}</div><article><h1>T</h1><p>short</p><header>inside</header></article><div>{LONG}</div>", "T\n\nshort\n\ninside"),
    "named article": (f'<div>{LONG}</div><div class="post-content"><p>Body.</p><div class="share-links">Share</div></div>', "Body."),
    "references": ("<article><p>a &amp; b &#233;&eacute;&#x41; &lt;p&gt; &nbsp;x &amp;lt;</p></article>", "a & b ééA <p> x &lt;"),
    "breaks and space": ("<article><p>one<br>two\n\n three&nbsp;<b>bo</b>ld</p>\n<p> </p></article>", "one two three bold"),
    "unclosed": ("<article><p>one<p>two<li>three<b>four", "one\n\ntwo\n\nthreefour"),
    "stray closings": ("<article></div><p>a</i>b</p></span></article>", "ab"),
    "scripts": ("<article><script>if (a<b) '</p>'</script><style>p{}</style><p>x</p><!-- <p>no</p> --><noscript>n</noscript></article>", "x"),
    "no closing": ("<article><p>x</p><script>var a = '<p>y</p>'", "x"),
    "attributes": ('<article><p title="a > b" data-x=\'<p>\'>x</p></article>', "x"),
    "quote in a value": ("<article><p><img alt=Bob's>one</p><p>two</p></article>", "one\n\ntwo"),
    "quote behind a value": ('<p><b id="x"">one</b></p><p class="k">two</p><p>three</p>', "one\n\ntwo\n\nthree"),
    "quote never closed": ('<article><p class="a>one</p><p class="k">two</p><p title=\'b>three</p></article>', "one\n\ntwo\n\nthree"),
    "quote before a path": ('<article><p id="a>one</p><img src="/k"><p id="a/>two</p><img src="?k=1"/></article>', "one\n\ntwo"),
    "quote without a name": ("<article><p '>one</p><p \"k>two</p></article>", "one\n\ntwo"),
    "values side by side": ('<article><p title="a > b"class="k" data-x = \'c>d\'>x</p></article>', "x"),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\n\nb\n\nc"),
    "no blocks": ("plain", "plain"),
    "nothing": ("", ""),
    "links in the article": ('<article><p>See <a href="r">the full report</a></p><ul><li><a href="a">One source</a><li><a href="b">Another</a></ul></article>', "See the full report\n\nOne source\n\nAnother"),
    "only links": (f'<div><a href="x">{LONG}</a></div>', ""),
    "comparison": ("<p>1 < 2</p>", "1 < 2"),
    "upper case": (f"<NAV>{LONG}</NAV><P>{LONG}</P>", LONG),
    "teaser beside a body": (f"<div><h1>T</h1><div>{LONG}</div><div>{LONG}</div></div><article>x</article>", f"T\n\n{LONG}\n\n{LONG}\n\nx"),
    "related card": (f'<div>{LONG}</div><article class="related"><p>x</p></article>', f"{LONG}\n\nx"),
    "body without teaser": (f"<div><p>{LONG}</p></div><article><p>{LONG}</p><p>{LONG}</p><div></div><div></div><p>end</p></article>", f"{LONG}\n\n{LONG}\n\nend"),
    "script in a line": ("<article><p>Long text <script>var x=1;</script> goes on.</p></article>", "Long text goes on."),
    "style in a line": ("<article><p>Long text <style>p{}</style> goes on.</p></article>", "Long text goes on."),
    "label in a line": ("<article><p>Long text <label>x</label> goes on.</p></article>", "Long text goes on."),
    "share in a line": ('<article><p>Long text <span class="share">Share</span> goes on.</p></article>', "Long text goes on."),
    "button in a line": ("<article><p>Press <label>OK</label> or <button>Go</button> to win.</p></article>", "Press or to win."),
    "select in a line": ("<article><p>Choose <select><option>a<option>b</select> now.</p></article>", "Choose now."),
    "blocks in a dropped span": ('<article><p>a</p>b <span class="share"><div>x</div> y</span> rest <b>bold</b></article>', "a\n\nb\n\nrest bold"),
    "sections of the article": ('<article><p>a</p><div class="related-work"><p>b</p></div><section id="tools"><p>c</p></section><div class="ad-hoc-analysis">d</div><div class="entry-header">e</div></article>', "a\n\nb\n\nc\n\nd\n\ne"),
    "kinds inside the article": ('<article><p>a</p><div class="ad ad-slot-3">b</div><div class="post-comments"><p>c</p></div><div id="newsletter_signup_form">d</div><div class="cookie-notice">e</div><p>f</p></article>', "a\n\nf"),
    "dive": (f"<p>{LONG}</p>{'<div></div>' * 9}<p>tail</p>", LONG),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    source, text = CASES[name]
    assert main_text(source) == text


def windows(lengths, surge, width=3):
    """Kept lines by brute force: those in a run of non-empty windows, one of which reaches `surge`."""
    sums = [sum(lengths[i : i + width]) for i in range(len(lengths))]
    kept = set()
    for i in range(len(lengths)):
        for j in range(i, len(lengths)):
            if all(sums[i : j + 1]) and max(sums[i : j + 1]) >= surge:
                kept |= {k for k in range(i, j + 1) if lengths[k]}
    return sorted(kept)


@given(st.lists(st.sampled_from([0, 0, 0, 1, 5, 20, 39, 40, 90]), max_size=24))
def test_windows(lengths):
    lines = [htmltext.Line(text="x" * n) for n in lengths]
    for surge in (1, 40):
        got = [line for stretch in htmltext._stretches(lines, surge) for line in stretch]
        assert [id(x) for x in got] == [id(lines[i]) for i in windows(lengths, surge)]


def test_windows_decide(monkeypatch):
    """Without the distribution (every stretch surges) the pages' texts are others."""
    gap = "<div></div>" * 9
    pages = {f"<div>login</div>{gap}<p>Short lead.</p><p>{LONG}</p><p>End.</p>{gap}<div>tail</div>": f"Short lead.\n\n{LONG}\n\nEnd.", f"<div>{LONG}{LONG}</div>{gap}<div>x</div>{gap}<article>y</article>": f"{LONG}{LONG}"}
    assert {p: main_text(p) for p in pages} == pages
    monkeypatch.setattr(htmltext, "SURGE", 1)
    assert all(main_text(p) != t for p, t in pages.items())


@pytest.mark.parametrize("source", ["<span>" * 100_000 + "<div>a</div>" * 20_000, "<b><p>" * 50_000 + "x", "<ul><li>" * 50_000 + "</i>" * 50_000, "<td>" * 100_000])
def test_deep_pages_take_time_by_length(source):
    began = time.process_time()
    main_text(source)
    assert time.process_time() - began < 10


def test_operator(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", "<p>a</p>", "x"), (3, "u", "<p>" + "word " * 100_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.url or "", r.text, r.n_chars) for r in extract(pages).collect())
    assert got == sorted([("1", "u", "a", 1), ("2", "", "", 0), ("None", "u", "", 0), ("1", "u", "a", 1), ("3", "u", ("word " * 100_000).strip(), 499_999)])
    assert extract(pages.limit(0)).count() == 0
