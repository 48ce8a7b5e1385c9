"""The small labelled table of operator 5: hand-made pages and the texts that belong to their articles.

Three sentences of different length fill eight layouts, from pages whose elements say what they are to
pages of plain divisions, where only word counts and link densities tell.
"""

from __future__ import annotations

from collections.abc import Iterator

LONG = (
    "The committee met on a grey morning to hear the report that everybody had waited for since spring, and it took the secretary almost an hour "
    "to read it out, because nobody wanted to miss a single figure of the long tables that had been added at the end of the second part."
)
MIDDLE = "A second survey of the valley found that the river had moved by almost forty metres since the old map was drawn."
SHORT = "Nobody had expected this."
TINY = "So it went."
TITLE = "River moves west"
LINKS = ("Home", "World", "Sport and leisure", "About us", "Contact")
NOTES = (
    "This site uses cookies.",
    "Buy two, pay for one, only this week in all our shops, and get a free bag with every order that you place before Friday at noon.",
    "We use cookies and similar techniques to improve our pages; by going on you agree to our terms of use and to the processing of your data.",
)
REMARKS = ("Great story, thank you!", "I was there in the sixties and can say that the old bridge stood much further up, close to the mill that burnt down later.")


def _menu(items=LINKS) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(items)) + "</ul>"


def labelled_pages() -> Iterator[tuple[str, set[str]]]:
    """(page, texts of the article's blocks)."""
    bodies = [[TITLE, LONG, MIDDLE], [TITLE, MIDDLE, SHORT, LONG], [TITLE, TINY], [TITLE, SHORT, LONG, TINY, MIDDLE], [TITLE, MIDDLE, MIDDLE + " " + TINY, SHORT]]
    for n, body in enumerate(bodies):
        note, remark = NOTES[n % 3], REMARKS[n % 2]
        paragraphs = "".join(f"<p>{x}</p>" for x in body[1:])
        article = f"<h1>{body[0]}</h1>{paragraphs}"
        foot = f"<p>&copy; 2020 Example. {NOTES[(n + 1) % 3]}</p>"
        listed = set(body)
        # Elements that name themselves.
        yield (
            f"<html><head><title>{body[0]}</title></head><body><header><p>Example Daily</p><form><label>Search</label></form></header><nav>{_menu()}</nav>"
            f"<div class=ad>{note}</div><article>{article}</article><aside><h3>Related</h3><p>{SHORT} {n}</p><p>{LONG} {n}</p></aside><footer>{foot}</footer></body></html>"
        ), listed
        # Classes and ids.
        yield (
            f'<div id="header"><div class="site-title">Example Daily {n}</div>{_menu()}</div><div class="cookie-notice"><p>{note}</p></div>'
            f'<div id="content" class="post">{article}</div><div id="sidebar"><h2>Most read</h2>{_menu(LINKS[1:])}<p>{MIDDLE} {n}</p></div>'
            f'<div id="comments"><h3>2 comments</h3><div class="comment"><p>{remark}</p></div><p>{LONG} {n}</p></div><div id="footer">{foot}</div>'
        ), listed
        # Boilerplate within the article.
        yield (
            f'<main><article>{article}<div class="share">{_menu(LINKS[:2])}</div><div class="advert"><p>{note}</p></div><p>{MIDDLE} {TITLE}.</p>'
            f'<section class="comments"><p>{remark}</p><p>{MIDDLE} {n}</p></section><form><p>Leave a reply, {n}</p></form></article></main><footer>{foot}</footer>'
        ), listed | {f"{MIDDLE} {TITLE}."}
        # Plain divisions and paragraphs: words and links decide.
        yield (
            f'<div><a href="/">Example Daily</a></div><div>{_menu()}</div><div>Sponsored</div><div>{article}</div>'
            f'<div>{_menu(LINKS[2:])}</div><div><a href="/terms">Terms of use</a> <a href="/privacy">Privacy</a> 2020</div><div>Example Daily Press</div>'
        ), listed
        yield (
            f'<table><tr><td><a href="/">Home</a> | <a href="/news">News</a></td></tr><tr><td>{LONG}</td></tr><tr><td>{MIDDLE}</td></tr>'
            f'<tr><td><a href="/a">Earlier</a> <a href="/b">Later</a></td></tr></table>'
        ), {LONG, MIDDLE}
        # An article with lists, quotes and links inside its paragraphs.
        yield (
            f'<nav>{_menu()}</nav><article><h1>{body[0]}</h1><p>{MIDDLE} <a href="/map">The old map</a> shows it.</p><h2>What follows</h2><ul><li>{SHORT}</li><li>{TINY}</li></ul>'
            f"<blockquote>{LONG}</blockquote></article><div class='newsletter'><p>{note}</p></div>"
        ), {body[0], f"{MIDDLE} The old map shows it.", "What follows", SHORT, TINY, LONG}
        # Names that are mixed, negated or tell of a state.
        yield (
            f'<body class="home no-sidebar sidebar-right"><div class="main-nav content-header">{_menu()}</div><div class="entry-content social-share-on related-{n}">{article}'
            f'<div class="post-comments open"><p>{remark}</p></div></div><main class="has-comments with-sidebar"><article class="post has-comments"><p>{LONG} {TINY}</p></article></main>'
            f'<div class="story-related"><p>{MIDDLE} {n}</p></div><div class="content-footer">{foot}</div></body>'
        ), listed | {f"{LONG} {TINY}"}
        # Modal notices and banners around a main element.
        yield (
            f'<div role="dialog"><p>{note}</p></div><div role="banner"><p>Example Daily {n}</p></div><div role="main">{article}</div>'
            f'<div role="complementary"><p>{remark} {n}</p></div><div role="contentinfo">{foot}</div>'
        ), listed
