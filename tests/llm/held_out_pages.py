"""Layouts that the extraction is not trained on, labelled by hand in the same way."""

from obslake.llm.labelled_pages import MARK as M
from obslake.llm.labelled_pages import Fill


def encyclopedia(f: Fill) -> str:
    items = "".join(f"<li>{M}{f.sentence(3, 9)}</li>" for _ in range(4))
    return f"""<html>{f.head()}<body><div id="mw-head"><ul>{f.links()}</ul></div><div id="bodyContent"><h1>{M}{f.words(1, 4)}</h1>{f.body(3, 6)}<h2>{M}{f.words(1, 3)}</h2>{f.body(1, 4)}<ul>{items}</ul></div><div id="navigation">{f.links(tag="p")}</div><div id="footer"><p>{f.prose(1, 3)}</p></div></body></html>"""


def magazine(f: Fill) -> str:
    return f"""<html>{f.head()}<body><div class="masthead"><a href="/">{f.words(1, 2)}</a></div><section class="story"><h1>{M}{f.words(3, 9)}</h1><h3>{M}{f.sentence()}</h3>{f.body(3, 8)}<blockquote>{M}{f.sentence()}</blockquote>{f.body(1, 5)}</section><aside class="rail"><h4>{f.word()}</h4><p>{f.prose(1, 4)}</p>{f.links(tag="p")}</aside><div class="trending"><ul>{f.links()}</ul></div></body></html>"""


def table_page_in_a_form(f: Fill) -> str:
    return f"""<html><body><form action="default.aspx"><table><tr><td><ul>{f.links()}</ul></td><td><div class="maincontent"><h1>{M}{f.words(2, 6)}</h1>{f.body(3, 8)}</div></td></tr></table><table><tr><td>© {f.words(1, 4)}</td></tr></table></form></body></html>"""


def journal(f: Fill) -> str:
    said = "".join(f"<li><cite>{f.word()}</cite><p>{f.prose(1, 5)}</p></li>" for _ in range(4))
    return f"""<html>{f.head()}<body class="home with-sidebar"><div id="top"><a href="/">{f.word()}</a></div><div class="entry-content"><h2>{M}{f.words(2, 6)}</h2>{f.body(2, 7)}</div><div class="sharing">{f.link()} {f.link()}</div><ol class="comment-list comments">{said}</ol><div id="respond"><h3>{f.words(1, 3)}</h3><form><p>{f.sentence()}</p></form></div></body></html>"""


def plain(f: Fill) -> str:
    return f"""<html><body><div>{f.link()} {f.link()} {f.link()}</div><h1>{M}{f.words(2, 6)}</h1>{f.body(4, 9)}<h2>{M}{f.words(1, 4)}</h2>{f.body(2, 6)}<div>{f.link()} {f.link()}</div></body></html>"""


def help_page(f: Fill) -> str:
    terms = "".join(f"<dt>{M}{f.words(1, 3)}</dt><dd>{M}{f.prose(1, 3)}</dd>" for _ in range(5))
    return f"""<html>{f.head()}<body><header><form class="search"><input><button>{f.word()}</button></form><nav>{f.links()}</nav></header><main><h1>{M}{f.words(1, 5)}</h1><p>{M}{f.prose(1, 3)}</p><dl>{terms}</dl><p>{M}<math><mi>y</mi></math> {f.sentence()}</p></main><div role="complementary"><p>{f.prose(1, 3)}</p></div><footer>{f.link()}</footer></body></html>"""


def newspaper(f: Fill) -> str:
    """An article with a header of its own, a standfirst and a byline."""
    return f"""<html>{f.head()}<body><header role="banner"><nav>{f.links(tag="span")}</nav></header><main><article class="news"><header><h1>{M}{f.words(4, 9)}</h1><h2>{M}{f.sentence()}</h2></header><p>{M}By {f.words(2, 2)}</p>{f.body(4, 8)}</article><aside><h3>{f.word()}</h3>{f.links(tag="p")}</aside></main><footer><p>{f.prose(1, 2)}</p></footer></body></html>"""


def report_with_references(f: Fill) -> str:
    cited = "".join(f"<li>{M}{f.link()}</li>" for _ in range(5))
    return f"""<html>{f.head()}<body><div class="navbar">{f.links(tag="div")}</div><div class="article-body"><h1>{M}{f.words(3, 8)}</h1>{f.body(4, 8)}<h3>{M}{f.words(1, 2)}</h3><ol>{cited}</ol></div><div class="widget"><ul>{f.links()}</ul></div><div id="footer">{f.link()}</div></body></html>"""


def popular_story(f: Fill) -> str:
    names = f.r.choice(("popular story", "topic tags-politics story", "search-results content"))
    return f"""<html>{f.head()}<body><div class="topbar">{f.link()} {f.link()}</div><div class="{names}"><h1>{M}{f.words(2, 7)}</h1>{f.body(5, 5)}</div><div class="popular"><h4>{f.word()}</h4><ul>{f.links()}</ul></div><div class="footer"><p>© {f.words(2, 4)}</p></div></body></html>"""


def questions(f: Fill) -> str:
    parts = "".join(f"<details open><summary>{M}{f.sentence(3, 8)}</summary><div>{M}{f.prose(1, 4)}</div></details>" for _ in range(4))
    return f"""<html>{f.head()}<body><header>{f.link()}</header><article><h1>{M}{f.words(1, 5)}</h1>{parts}</article><aside><p>{f.prose(1, 2)}</p></aside><footer>{f.link()}</footer></body></html>"""


LAYOUTS = (encyclopedia, magazine, table_page_in_a_form, journal, plain, help_page, newspaper, report_with_references, popular_story, questions)
