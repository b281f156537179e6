"""Passes of the body normaliser, each on markup of its own, and properties of their composition."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.html.body import content_stats, element_counts, normalize, plain_text, srcset

AT = "https://news.example.org/2031/07/river.html"


def same(raw, want, **options):
    assert normalize(raw, AT, **options) == want


def test_addresses_become_absolute():
    same('<p>See <a href="map.html">the map</a>, <a href="?page=2">more</a> and <a href="//cdn.example.org/x">x</a>.</p>', '<p>See <a href="https://news.example.org/2031/07/map.html">the map</a>, <a href="https://news.example.org/2031/07/river.html?page=2">more</a> and <a href="https://cdn.example.org/x">x</a>.</p>')
    same('<blockquote cite="../q"><p>Quoted</p></blockquote>', '<blockquote cite="https://news.example.org/2031/q"><p>Quoted</p></blockquote>')
    same('<p>Up to <a href="#top">top</a></p>', f'<p>Up to <a href="{AT}#top">top</a></p>')


def test_candidates_of_a_srcset():
    assert srcset("small.png 320w,  big.png 640w", lambda u: "/" + u) == "/small.png 320w, /big.png 640w"
    assert srcset("one.png", str.upper) == "ONE.PNG"
    assert srcset("f.png fit(3,4) 1x, g.png", str.upper) == "F.PNG fit(3,4) 1x, G.PNG"
    same('<p><img src="m.png" srcset="m.png?s=1,2 1x, n.png 3x" alt="Mill"></p>', '<p><img src="https://news.example.org/2031/07/m.png" srcset="https://news.example.org/2031/07/m.png?s=1,2 1x, https://news.example.org/2031/07/n.png 3x" alt="Mill"/></p>')


@pytest.mark.parametrize("stand_in", ["", "data:image/svg+xml;utf8,x", "/img/placeholder.gif", "about:blank"])
def test_lazy_images_are_promoted(stand_in):
    same(f'<p><img src="{stand_in}" data-src="/dam.jpg" loading="lazy" decoding="async"></p>', '<p><img src="https://news.example.org/dam.jpg"/></p>')


def test_an_image_with_an_address_keeps_it():
    same('<p><img src="/real.jpg" data-src="/other.jpg"></p>', '<p><img src="https://news.example.org/real.jpg"/></p>')


def test_code_is_flattened_to_its_lines():
    same("<pre>let a = 1<br>let b = 2</pre>", "<pre><code>let a = 1\nlet b = 2</code></pre>")
    same("<pre><ol><li>one</li><li>two</li></ol></pre>", "<pre><code>one\ntwo</code></pre>")
    same('<pre><code class="rust"><span>fn</span>  main() {\n    <b>body</b>\n}\n\n</code></pre>', "<pre><code>fn  main() {\n    body\n}</code></pre>")


def test_embeds_become_links():
    same('<p>Film:</p><iframe src="https://player.vimeo.com/video/777?autoplay=1"></iframe>', '<p>Film:</p><p><a href="https://vimeo.com/777">▶ Watch video</a></p>')
    same('<iframe src="https://maps.example.net/e?q=1" title="Gauge"></iframe>', '<p><a href="https://maps.example.net/e?q=1">Open embedded content: Gauge</a></p>')
    same("<p>a</p><iframe></iframe>", "<p>a</p>")
    got = normalize('<iframe src="https://www.youtube.com/embed/abcdefghij0"></iframe>', AT)
    assert 'href="https://www.youtube.com/watch?v=abcdefghij0"' in got and "<iframe" not in got
    same('<video><source src="clip.webm"></video>', '<p><a href="https://news.example.org/2031/07/clip.webm">▶ Watch video</a></p>')
    assert "<video" in normalize('<video src="clip.webm"></video>', AT, keep_video=True)


def test_only_what_is_allowed_stays():
    same('<p style="color:red" onmouseover="go()" class="lead">Safe <a href="javascript:go()">link</a><script>go()</script></p>', "<p>Safe link</p>")
    same("<p>Ask<form><input value=1><select><option>2</select></form></p><p>Next<textarea>x</textarea></p>", "<p>Ask</p><p>Next</p>")
    same("<p><marquee>Unwrapped</marquee> text<svg><title>gone</title></svg></p>", "<p>Unwrapped text</p>")
    same('<p>Here</p><p class="w-condition-invisible">not here</p><template><p>nor here</p></template>', "<p>Here</p>")


def test_invisible_characters_go_from_texts():
    same("<p>Har\u200b\u2060bour\ufeff news, f\u200dl</p>", "<p>Harbour news, f\u200dl</p>")


def test_blocks_are_tidied():
    same("<div>Water level<table><tr><td>3 m</td></tr></table>is <i>high</i></div>", "<p>Water level</p><table><tbody><tr><td>3 m</td></tr></tbody></table><p>is <i>high</i></p>")
    same("<section><div><p>Deep</p></div><div></div></section>", "<p>Deep</p>")
    same("<p>many \n\t blanks</p>\n\n<p> </p>", "<p>many blanks</p>")


def test_lead_image():
    lead = "https://img.example.org/lead.webp"
    same("<p>No picture here</p>", f'<p><img src="{lead}" alt=""/></p><p>No picture here</p>', lead_image=lead)
    same('<p><img src="https://img.example.org/own.webp"></p>', '<p><img src="https://img.example.org/own.webp"/></p>', lead_image=lead)


def test_nothing_stays_nothing():
    assert normalize("") == "" == plain_text(None) == plain_text("")


def test_plain_text_and_counts():
    assert plain_text("<h2>River</h2><ul><li>rises<br>fast</li></ul>") == "River rises fast"
    assert content_stats("<p>four</p><table><tr><td>x</td></tr></table><pre><code>yz</code></pre>") | {"blocks": 0} == {"chars": 9, "blocks": 0, "img": 0, "pre": 1, "table": 1, "embeds": 0}
    assert element_counts("<ul><li>1<li>2</ul><i></i>") == {"i": 1, "li": 2, "ul": 1}


PIECES = st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<ul><li>", "</ul>", "<pre>", "</pre>", "<img src=a.png>", "<a href=b>", "</a>", "text ", "&amp;", "<script>x</script>", "<iframe src=//v.example/e>", "\n"]), max_size=25)


@settings(max_examples=150, deadline=None)
@given(PIECES)
def test_any_markup_gives_clean_markup(pieces):
    once = normalize("".join(pieces), AT)
    assert not any(f"<{tag}" in once for tag in ("script", "div", "iframe"))
    assert plain_text(normalize(once, AT)) == plain_text(once), "the text stays as it is"
