"""Main texts of pages that are put together from a known article and known boilerplate."""

import html
import random
import time

import pytest

from loomstead.llm.html_text import SURGE, WINDOW, Line, extract_main_text, main_blocks, main_text, page_lines, window_sums

LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do. " * 4
TEXT = LONG.strip()


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "béta", "x < y", "gam&ma", "delta", "—", "eta."]) for _ in range(n))


def page(rng, article):
    """(html, text): a page whose article text is known; boilerplate around and within it."""
    blocks = [sentence(rng, rng.choice([1, 2, 30, 60])) for _ in range(rng.randrange(2, 9))]
    blocks.insert(rng.randrange(len(blocks)), sentence(rng, 60))
    title = sentence(rng, 5)
    within = ["", "<aside><p>{}</p></aside>", "<div class='ad'>{}</div>", "<form><label>{}</label><input></form>", "<script>var a='{}';</script>", "<!-- {} -->", "<div class='cookie-notice'>{}</div>", "<style>{}</style>"]
    body = f"<h1>{html.escape(title)}</h1>"
    for b in blocks:
        words = html.escape(b).split(" ")
        if len(words) > 4:
            words[2] = f"<b>{words[2]}</b>"
        body += "<p>" + rng.choice([" ", "\n ", "\t"]).join(words) + rng.choice(["</p>", ""]) + rng.choice(within).format(html.escape(sentence(rng, rng.choice([3, 80]))))
    low = html.escape(sentence(rng, 70))
    links = "".join(f"<li><a href='/{i}'>{sentence(rng, 3)}</a></li>".replace("<y", "") for i in range(6))
    around = ["<article>{}</article>", "<main>{}</main>", "<div role='main'>{}</div>"] if article else ["<div class='content'>{}</div>", "<div><section id='story'>{}</section></div>"]
    whole = f"<!DOCTYPE html><html><head><title>t</title></head><body><header><p>{low}</header><nav><ul>{links}</ul></nav><div class='sidebar'><p>{low}</p></div>" + rng.choice(around).format(body)
    whole += f"<div><div><ul>{links}</ul></div></div><div id='comments'><div class='comment'><p>{low}</p></div></div><footer><p>{low}</p><p>&copy;</p></footer></body></html>"
    return whole, " ".join(" ".join(x.split()) for x in [title, *blocks])


@pytest.mark.parametrize("article", [True, False])
def test_the_article_is_found_whole(article):
    rng = random.Random(11 + article)
    for _ in range(150):
        source, text = page(rng, article)
        assert main_text(source) == text


def plain_blocks(lines):
    """Surge and dive points for pages without articles, as the docstring says, one window at a time."""
    def total(i):
        out, at, seen = 0.0, i, 0
        while at < len(lines) and seen < WINDOW:
            counts = not (lines[at].unwanted and (at and lines[at - 1].unwanted))
            out += lines[at].weight if counts else 0
            seen += counts
            at += 1
        return out

    sums = [total(i) for i in range(len(lines))]
    least, keep, free = min(SURGE, max(sums, default=0) / 2), set(), 0
    for i in range(len(lines)):
        if i < free or not lines[i].weight or sums[i] < least:
            continue
        first = i
        while first > free and (lines[first - 1].unwanted or lines[first - 1].text and lines[first - 1].weight):
            first -= 1
        above = [first - b for b in range(1, WINDOW + 1) if first - b >= free and lines[first - b].heading and lines[first - b].weight]
        first = above[0] if above else first
        free = next((j for j in range(i, len(lines)) if not sums[j]), len(lines))
        keep |= {j for j in range(first, free) if lines[j].text and not lines[j].unwanted}
    return [lines[j].text for j in sorted(keep)], sums


def test_windows_equal_their_definition():
    rng = random.Random(4)
    for _ in range(400):
        lines = []
        for i in range(rng.randrange(0, 25)):
            kind = rng.randrange(6)
            unwanted = kind == 0
            lines.append(Line("") if kind == 1 else Line(f"t{i}", 0.0 if unwanted or kind == 2 else float(rng.choice([1, 5, 30, 90])), False, kind == 3, unwanted))
        want, sums = plain_blocks(lines)
        assert window_sums(lines) == sums
        assert main_blocks(lines) == want


def test_the_windows_decide():
    """Without them a page's links, a short line elsewhere and unwanted blocks would stay."""
    source = f"<body><nav>menu</nav><div>Home | About</div><div></div><article><p>{LONG}</p></article><div>Small print</div></body>"
    assert [x.text for x in page_lines(source) if x.text] == ["menu", "Home | About", TEXT, "Small print"]
    assert main_text(source) == TEXT


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<p class="x"">Hello world one</p><p>Two "quoted" text</p>', 'Hello world one Two "quoted" text'),
        ("<!-->Visible text<p>more</p>", "Visible text more"),
        ("<p>a</3 odd>b</p>", "ab"),
        (f'<div class="header-text"><p>{LONG}</p></div>', TEXT),
        (f'<article><p>{LONG}</p><div class="side-by-side">Two.</div><p class="legal-analysis">{LONG}</p><ul class="menu-of-the-day"><li>Soup</li><li>Fish</li></ul></article>', f"{TEXT} Two. {TEXT} Soup Fish"),
        (f"<div>{LONG}</div><article><p>A short teaser of another story.</p></article>", TEXT),
        (f"<article><h1><a href='x'>Title</a></h1><p>{LONG}</p><ul>" + "<li><a href='y'>link</a></li>" * 5 + "</ul><p>End.</p></article>", f"Title {TEXT} End."),
        (f"<article><p>{LONG}</p><aside><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></aside><p>End.</p></article>", f"{TEXT} End."),
        (f"<div class='comment-list'><p>{LONG}</p></div><div class='post-body'><p>{LONG}x</p></div>", f"{TEXT} x"),
    ],
)
def test_marked_up_oddly(source, text):
    assert main_text(source) == text


def test_deep_and_long_pages_take_linear_time():
    def seconds(n):
        source = "<div>" * n + "</span>" * n + "<li></li>" * n + "<b>" * n + "<hr>" * n + "end"
        began = time.process_time()
        assert main_text(source) == "end"
        return time.process_time() - began

    seconds(500)
    assert seconds(16000) < 40 * seconds(2000) + 0.5
    assert main_text("<article>" + "<p>word " * 50_000 + "</article>") == " ".join(["word"] * 50_000)


def test_table_with_nulls_repeated_rows_and_clashing_names(spark):
    rows = [(1, "u", "<p>a</p>", "t", 3), (1, "u", "<p>a</p>", "t", 3), (None, None, None, None, None), (2, None, "", "x", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = extract_main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in out.collect()) == [(0, "", "", 0), (1, "u", "a", 1), (1, "u", "a", 1), (2, "", "", 0)]
    assert extract_main_text(df.limit(0)).count() == 0
