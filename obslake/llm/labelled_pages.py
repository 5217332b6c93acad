"""Hand-labelled page layouts, to train the extraction of main text.

Each layout is a whole page, written and labelled by hand: a block whose text begins
with MARK belongs to the main text, every other block does not.  Prose, link texts
and the numbers of repeated parts are drawn anew for each copy of a layout, so that
lengths vary and no words of a language are learned.
"""

from __future__ import annotations

import random

MARK = "§"
_SYLLABLES = "ba ne ti ro lu ma ske fra dol vin ge tar po shi mel quo ren ast ilk umb".split()


class Fill:
    """Made-up prose for one copy of a layout."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.r.choice("....!?")

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 4).capitalize()}</a>'

    def links(self, low: int = 3, high: int = 8, tag: str = "li") -> str:
        return "".join(f"<{tag}>{self.link()}</{tag}>" for _ in range(self.r.randint(low, high)))

    def body(self, low: int = 2, high: int = 9) -> str:
        """Paragraphs of main text, some of one short sentence, some that hold a link or bold words."""
        out = []
        for _ in range(self.r.randint(low, high)):
            text = self.prose() if self.r.random() < 0.75 else self.sentence(1, 6)
            if self.r.random() < 0.2:
                text += f" {self.link()} {self.sentence()}"
            if self.r.random() < 0.2:
                text = f"<b>{text}</b><br>"
            out.append(f"<p>{MARK}{text}</p>")
        return "".join(out)

    def head(self) -> str:
        return f"<head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>"


def article(f: Fill) -> str:
    return f"<html>{f.head()}<body><nav><ul>{f.links()}</ul></nav><div class='ad'>{f.prose(1, 3)}</div><article><h1>{MARK}{f.words(2, 9)}</h1>{f.body()}</article><footer>&copy; {f.words(1, 4)} &middot; {f.prose(1, 2)}</footer></body></html>"


def content_and_sidebar(f: Fill) -> str:
    return f"""<html>{f.head()}<body><div id="header"><a href="/">{f.words(1, 3)}</a><p>{f.words(2, 6)}</p></div><div class="content"><h1>{MARK}{f.words(2, 8)}</h1>{f.body()}</div>
    <div class="sidebar"><h3>{f.words(1, 3)}</h3><p>{f.prose(1, 3)}</p><ul>{f.links()}</ul></div><div id="footer"><p>{f.sentence()}</p></div></body></html>"""


def table_layout(f: Fill) -> str:
    menu = "<br>".join(f.link() for _ in range(f.r.randint(3, 8)))
    return f"<html><body><table><tr><td>{menu}</td><td><h2>{MARK}{f.words(2, 7)}</h2>{f.body()}</td></tr><tr><td>{f.link()} | {f.link()} | {f.link()}</td></tr></table></body></html>"


def blog_with_comments(f: Fill) -> str:
    said = "".join(f"<div class='comment'><b>{f.word()}</b><p>{f.prose(1, 4)}</p></div>" for _ in range(f.r.randint(1, 7)))
    return f"""<html>{f.head()}<body><header><h2><a href="/">{f.words(1, 3)}</a></h2></header><div class="post"><h1>{MARK}{f.words(2, 8)}</h1><div class="post-meta">{f.words(2, 4)} {f.link()}</div><div class="post-content">{f.body()}</div>
    <div class="share"><a href="#">{f.word()}</a> <a href="#">{f.word()}</a></div><section id="comments"><h3>{f.words(1, 2)}</h3>{said}<form><label>{f.word()}</label><textarea></textarea><button>{f.word()}</button></form></section></div></body></html>"""


def whole_page_in_a_form(f: Fill) -> str:
    return f"""<html>{f.head()}<body><form method="post" action="page.aspx"><div class="topbar">{f.link()} {f.link()}</div><div class="content"><h1>{MARK}{f.words(2, 8)}</h1>{f.body(3, 9)}</div><div class="footer"><p>&copy; {f.words(2, 5)}</p></div></form></body></html>"""


def form_page_without_classes(f: Fill) -> str:
    return f"""<html><body><form id="aspnetForm"><table><tr><td>{f.link()}</td><td>{f.link()}</td></tr></table><div><h1>{MARK}{f.words(2, 8)}</h1>{f.body(3, 9)}</div><p>© {f.words(2, 5)}</p></form></body></html>"""


def main_with_aside(f: Fill) -> str:
    return f"""<html>{f.head()}<body><div class="cookie-notice"><p>{f.prose(1, 3)}</p><button>{f.word()}</button></div><main><h1>{MARK}{f.words(2, 9)}</h1>{f.body()}<aside><h4>{f.words(1, 3)}</h4>{f.links(2, 5, "p")}<p>{f.prose(1, 3)}</p></aside>{f.body(1, 4)}</main><footer><ul>{f.links()}</ul></footer></body></html>"""


def manual(f: Fill) -> str:
    points = "".join(f"<li>{MARK}{f.sentence(2, 12)}</li>" for _ in range(f.r.randint(2, 7)))
    return f"""<html>{f.head()}<body><nav class="breadcrumbs">{f.link()} › {f.link()}</nav><main role="main"><h1>{MARK}{f.words(1, 5)}</h1><p>{MARK}{f.prose()}</p><h2>{MARK}{f.words(1, 4)}</h2><ul>{points}</ul><pre>{MARK}{f.words(3, 20)}</pre><h2>{MARK}{f.words(1, 4)}</h2>{f.body(1, 5)}</main><div class="pager">{f.link()} {f.link()}</div></body></html>"""


def bare_news(f: Fill) -> str:
    return f"""<html><body><p>{f.link()} {f.link()} {f.link()}</p><h1>{MARK}{f.words(3, 9)}</h1>{f.body(3, 9)}<ul>{f.links()}</ul><p>© {f.words(2, 6)}.</p></body></html>"""


def recipe(f: Fill) -> str:
    parts = "".join(f"<li>{MARK}{f.words(1, 5)}</li>" for _ in range(f.r.randint(3, 9)))
    steps = "".join(f"<li>{MARK}{f.sentence()}</li>" for _ in range(f.r.randint(2, 6)))
    return f"""<html>{f.head()}<body><header><a href="/">{f.word()}</a></header><nav>{f.links(tag="span")}</nav><article class="recipe"><h1>{MARK}{f.words(2, 6)}</h1><p>{MARK}{f.prose()}</p><h3>{MARK}{f.word()}</h3><ul>{parts}</ul><h3>{MARK}{f.word()}</h3><ol>{steps}</ol><div class="newsletter"><p>{f.sentence()}</p></div></article><div class="related"><h3>{f.word()}</h3><ul>{f.links()}</ul></div></body></html>"""


def page_with_forms(f: Fill) -> str:
    return f"""<html>{f.head()}<body><form class="search"><label>{f.word()}</label></form><form action="/login"><p>{f.sentence()}</p><label>{f.word()}</label><button>{f.word()}</button></form><div id="main"><h1>{MARK}{f.words(2, 7)}</h1>{f.body(3, 8)}<form><p>{f.sentence()}</p><select><option>{f.word()}</option><option>{f.word()}</option></select></form></div><div id="footer">{f.link()} {f.sentence()}</div></body></html>"""


def line_breaks(f: Fill) -> str:
    return f"""<html><body><center>{f.link()} | {f.link()} | {f.link()} | {f.link()}</center><hr><h2>{MARK}{f.words(2, 7)}</h2><div>{MARK}<font>{f.prose(3, 9)}</font><br><br>{f.prose(2, 8)}</div><hr><center>{f.link()} {f.link()}</center></body></html>"""


def entry_with_banners(f: Fill) -> str:
    return f"""<html>{f.head()}<body class="single has-sidebar"><div class="banner"><p>{f.prose(1, 3)}</p></div><div class="entry"><h1>{MARK}{f.words(2, 8)}</h1>{f.body(1, 5)}<div class="advertisement"><p>{f.prose(1, 3)}</p></div>{f.body(1, 5)}<p class="tags">{f.link()} {f.link()}</p></div><div class="popup"><p>{f.prose(1, 2)}</p></div></body></html>"""


def tables_and_figures(f: Fill) -> str:
    rows = "".join(f"<tr><td>{MARK}{f.words(1, 3)}</td><td>{MARK}{f.words(1, 3)}</td></tr>" for _ in range(f.r.randint(2, 6)))
    terms = "".join(f"<dt>{MARK}{f.words(1, 2)}</dt><dd>{MARK}{f.sentence()}</dd>" for _ in range(f.r.randint(1, 4)))
    return f"""<html>{f.head()}<body><nav>{f.links(tag="div")}</nav><article><h1>{MARK}{f.words(2, 7)}</h1>{f.body(1, 4)}<figure><img src=x><figcaption>{MARK}{f.sentence()}</figcaption></figure><table>{rows}</table><dl>{terms}</dl><blockquote>{MARK}{f.prose(1, 3)}</blockquote>{f.body(1, 4)}</article><footer><p>{f.sentence()}</p></footer></body></html>"""


def hidden_parts(f: Fill) -> str:
    return f"""<html>{f.head()}<body><div style="display:none"><p>{f.prose(1, 4)}</p></div><div class="article-body"><h1>{MARK}{f.words(2, 8)}</h1>{f.body()}<div hidden><p>{f.prose(1, 3)}</p></div></div><div aria-hidden="true"><p>{f.prose(1, 3)}</p></div><div class="subscribe"><form><p>{f.sentence()}</p></form></div></body></html>"""


def front_page(f: Fill) -> str:
    return f"<html>{f.head()}<body><nav><ul>{f.links()}</ul></nav><ul>{f.links(6, 14)}</ul><div class='widget'><p>{f.sentence()}</p></div><footer><p>© {f.words(1, 5)}</p></footer></body></html>"


def formulas(f: Fill) -> str:
    return f"""<html>{f.head()}<body><div class="nav">{f.link()} {f.link()}</div><article><h1>{MARK}{f.words(2, 7)}</h1>{f.body(1, 4)}<div>{MARK}<math><mi>x</mi><mo>=</mo><mn>{f.r.randint(1, 99)}</mn></math></div>{f.body(1, 4)}<p>{MARK}{f.words(1, 2)}</p></article><div class="disclaimer"><p>{f.prose(1, 2)}</p></div></body></html>"""


def headed_article(f: Fill) -> str:
    return f"""<html>{f.head()}<body><header><div>{f.link()}</div><p>{f.sentence(2, 6)}</p></header><article><header><h1>{MARK}{f.words(2, 9)}</h1><p>{MARK}{f.sentence()}</p></header>{f.body()}
    <footer><p>{f.words(1, 4)}</p>{f.link()}</footer></article><footer><p>{f.sentence()}</p></footer></body></html>"""


def sources_at_the_end(f: Fill) -> str:
    cited = "".join(f"<li>{MARK}{f.link()}</li>" for _ in range(f.r.randint(2, 7)))
    return f"""<html>{f.head()}<body><nav><ul>{f.links()}</ul></nav><article><h1>{MARK}{f.words(2, 8)}</h1>{f.body(3, 8)}<h2>{MARK}{f.words(1, 2)}</h2><ul>{cited}</ul></article><aside><ul>{f.links()}</ul></aside><div class="related"><ul>{f.links()}</ul></div></body></html>"""


def mixed_names(f: Fill) -> str:
    modifier = f.r.choice(("tags-politics", "popular", "sponsored-topic", "social", "related-coverage", "promo", "search-results", "sidebar-left"))
    names = f.r.choice((f"topic {modifier} story", f"{modifier} article", f"{modifier} content", f"post {modifier}"))
    return f"""<html>{f.head()}<body><div class="menu">{f.link()} {f.link()}</div><div class="{names}"><h1>{MARK}{f.words(2, 8)}</h1>{f.body(3, 8)}</div><div class="{modifier.split('-')[0]}"><p>{f.prose(1, 3)}</p>{f.links(tag="p")}</div><div class="footer"><p>{f.sentence()}</p></div></body></html>"""


def entry_with_its_own_header(f: Fill) -> str:
    return f"""<html>{f.head()}<body><div id="site-header"><p>{f.words(2, 5)}</p>{f.link()}</div><div class="entry"><div class="entry-header"><h2>{MARK}{f.words(2, 8)}</h2></div><div class="entry-content">{f.body(2, 8)}</div><div class="entry-footer">{f.link()} {f.link()}</div></div><div class="sidebar-content"><p>{f.prose(1, 2)}</p></div></body></html>"""


def folded_parts(f: Fill) -> str:
    parts = "".join(f"<details><summary>{MARK}{f.words(2, 6)}</summary><p>{MARK}{f.prose(1, 3)}</p></details>" for _ in range(f.r.randint(2, 5)))
    return f"""<html>{f.head()}<body><nav>{f.links(tag="span")}</nav><main><h1>{MARK}{f.words(2, 6)}</h1><p>{MARK}{f.prose(1, 4)}</p>{parts}</main><footer><details><summary>{f.words(1, 3)}</summary><p>{f.sentence()}</p></details></footer></body></html>"""


LAYOUTS = (
    article, content_and_sidebar, table_layout, blog_with_comments, whole_page_in_a_form, form_page_without_classes, main_with_aside, manual, bare_news, recipe, page_with_forms, line_breaks, entry_with_banners,
    tables_and_figures, hidden_parts, front_page, formulas, headed_article, sources_at_the_end, mixed_names, entry_with_its_own_header, folded_parts,
)


def pages(layouts=LAYOUTS, copies: int = 6) -> list[str]:
    """Copies of each layout, with their marks."""
    return [layout(Fill(1000 * k + c)) for k, layout in enumerate(layouts) for c in range(copies)]
