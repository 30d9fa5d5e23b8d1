import html
import re

from tidemark.llm import html_text as h

from . import frames

PAGE = (
    '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>'
    '<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies here and there.</p></div>'
    "{body}<aside><p>Side links</p></aside><form><p>Your name</p></form><footer>&copy; us</footer>")
ARTICLE = (
    "<article><h1>Title &amp; more</h1><p><b>First  \n paragraph&nbsp;of the text, long enough to count as content.<br>Same block."
    '<p>Short.</p><!-- ad --><div class="ad">Buy this now</div><ul><li>One<li>Two</ul><p>Last &lt;tag&gt; &#233; of the article, with words.</p>'
    '<section id="comments"><p>A reader writes a long comment that should not be here at all.</p></section></article>')
WANT = (
    "Title & more\nFirst paragraph of the text, long enough to count as content. Same block.\nShort.\nOne\nTwo\n"
    "Last <tag> é of the article, with words.")


def test_article_without_the_rest():
    assert h.main_text(PAGE.replace("{body}", ARTICLE)) == WANT


def test_page_without_article_element():
    body = ARTICLE.replace("<article>", '<div class="story">').replace("</article>", "</div>")
    assert h.main_text(PAGE.replace("{body}", body)) == WANT


def test_hard_pages():
    assert h.main_text("") == "" and h.main_text("<script>x") == "" and h.main_text("<!-- a") == ""
    assert h.main_text("plain text") == "plain text"
    assert h.main_text("<p>cut &am") == "cut &am"
    assert h.main_text("<article>" + "<p>word word</p>" * 20_000 + "</article>").count("\n") == 19_999
    assert h.main_text("<div>" * 3000 + "<p>deep</p>").endswith("deep")


def test_rows(spark):
    rows = [(1, "u", PAGE.replace("{body}", ARTICLE)), (1, "u", PAGE.replace("{body}", ARTICLE)), (2, None, None), (None, "", "")]
    df = frames.clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(map(tuple, h.extract(df, ["page_id", "url"]).collect()), key=repr)
    assert got == sorted([(1, "u", WANT, len(WANT))] * 2 + [(2, None, "", 0), (None, "", "", 0)], key=repr)
    assert h.extract(df.limit(0), ["page_id"]).count() == 0


LINES = [f"Sentence number {i} of the story, with enough words in it to count as content." for i in range(4)]
BODY, STORY = "".join(f"<p>{x}</p>" for x in LINES), "\n".join(LINES)


def test_wrappers_with_marked_names_stay():
    for wrap in ("layout with-sidebar", "hentry comments-open", "page has-banner"):
        assert h.main_text(f'<div class="{wrap}"><article>{BODY}</article><div class="sidebar">Links</div></div>') == STORY
        assert h.main_text(f'<div class="{wrap}">{BODY}</div><footer>us</footer>') == STORY
    assert h.main_text(f"<form><main>{BODY}</main></form>") == STORY
    cards = '<div class="related"><article>Another story to read after this one.</article></div>'
    assert h.main_text(f"<main>{BODY}{cards}</main>") == STORY
    comments = f'<section class="comments">{"<article>A reader writes.</article>" * 3}</section>'
    assert h.main_text(f"<article>{BODY}</article>{comments}") == STORY


def test_omitted_end_tags_end_what_is_marked():
    text = "".join(f"<p>{x}" for x in LINES)
    assert h.main_text(f"<article><p class='ad'>Buy{text}</article>") == STORY
    assert h.main_text(f"<article><p>{LINES[0]}<p class='ad'>Buy<h2>Next</h2>{text}</article>") == f"{LINES[0]}\nNext\n{STORY}"
    items = "".join(f"<li>{x}" for x in LINES)
    assert h.main_text(f"<article><ul><li class='share'>Send{items}</ul></article>") == STORY
    assert h.main_text(f"<article><dl><dt class='ad'>Buy<dd>{LINES[0]}<dt>{LINES[1]}</dl></article>") == "\n".join(LINES[:2])
    rows = "".join(f"<tr><td>{x}" for x in LINES)
    assert h.main_text(f"<article><table><tr class='ad'><td>Buy<td>now{rows}</table></article>") == STORY
    assert h.main_text(f"<article><table><tr><td class='ad'>Buy<td>{LINES[0]}{rows}</table></article>") == f"{LINES[0]}\n{STORY}"


def test_region_grows_to_unmarked_parents():
    page = f"<body><nav>Menu</nav><div><h1>Head</h1><p>Lead.</p><div>{BODY}</div><p>End.</p></div><footer>us</footer></body>"
    assert h.main_text(page) == f"Head\nLead.\n{STORY}\nEnd."


def by_patterns(page):
    """The article of the test pages by plain substitutions, without a parser."""
    found = re.search(r"(?s)<(article|main)\b[^>]*>(.*)</\1>", page)
    body = found.group(2) if found else page
    body = re.sub(r"(?s)<!--.*?-->", "", body)
    body = re.sub(r"(?s)<(script|style|nav|aside|form|footer|head)\b[^>]*>.*?</\1>", "", body)
    marked = r'(?s)<(div|section|ul|p)\b[^>]*(?:class|id)="[^"]*\b(?:ad|ads|comments?|cookie|share|related|sidebar|promo|newsletter|banner)\b[^"]*"[^>]*>(?:(?!<\1\b).)*?</\1>'
    while (less := re.sub(marked, "", body)) != body:
        body = less
    lines = re.split(r"</?(?:p|div|section|article|main|h[1-6]|ul|ol|li|blockquote|figure|table|tr|td|body|html|hr)\b[^>]*>", body)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\b[^>]*>", " ", x))).split()) for x in lines)
    return "\n".join(x for x in texts if x)


def test_pages_of_the_test_data_by_another_way(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("html LIKE '%<article%' AND html LIKE '%</article>%'").collect()
    different = [p.page_id for p in pages if h.main_text(p.html) != by_patterns(p.html)]
    assert len(pages) > 1000 and not different
