import math
import random
import time

from flowloom.llm import html

ARTICLE = "<h1>A &amp; B</h1><p>First  paragraph,\n with <b>bold</b> &lt;text&gt; and enough characters to be dense.<p>Be.</p>"
AROUND = [
    "<nav><ul><li><a href=/x>menu</a></li></ul></nav>",
    "<header><h1>Site name</h1><p>A slogan that is long enough to look like text, really long.</p></header>",
    "<aside><p>Aside text that goes on for quite a while, to look like a paragraph.</p></aside>",
    "<div class='ad'>Buy this now, it is the best offer that you will ever see in your life.</div>",
    "<div id=cookie-notice><p>We use cookies on this site, as all of them do, to make it better for you.</p></div>",
    "<form><p>Subscribe to the letter with many words in it</p><input name=a><button>Go</button></form>",
    "<script>var t = '</p><p>script</p>';</script><style>p{margin:0}</style><noscript>Turn it on</noscript>",
    "<!-- a <p>comment</p> -->",
    "<section class='comments'><article><p>" + "A reader's comment that is longer than the article. " * 30 + "</p></article></section>",
    "<div class=sidebarWidget><p>Popular in this section of the site are the following things.</p></div>",
    "<footer>&copy; somebody</footer>",
]
WANT = "A & B\nFirst paragraph, with bold <text> and enough characters to be dense.\nBe."


def test_article_without_its_surroundings():
    for open_tag, close in (("<article>", "</article>"), ("<div id=content>", "</div>"), ("<main>", "</main>")):
        for i, part in enumerate(AROUND):
            before = f"<!DOCTYPE html><html><head><title>T</title></head><body>{part}{open_tag}{ARTICLE}{close}</body></html>"
            after = f"<html><body>{open_tag}{ARTICLE}{close}{part}"
            assert html.main_text(before) == WANT, (open_tag, i)
            assert html.main_text(after) == WANT, (open_tag, i)
        everything = f"<body>{''.join(AROUND[:6])}<div class='page has-sidebar'>{open_tag}{ARTICLE}{close}</div>{''.join(AROUND[6:])}"
        assert html.main_text(everything) == WANT


def test_parts_inside_the_article_go_too():
    inside = "".join(AROUND[i] for i in (3, 4, 5, 6, 7, 9))
    assert html.main_text(f"<body><article><h1>A &amp; B</h1>{inside}{ARTICLE[len('<h1>A &amp; B</h1>'):]}</article>") == WANT


def test_density_finds_text_without_names():
    links = "<div>" + "".join(f"<a href=/{i}>link number {i}</a> " for i in range(30)) + "</div>"
    text = "<div><p>" + "Plain words of the article that are long. " * 5 + "</p><p>" + "More of them here. " * 9 + "</p></div>"
    got = html.main_text(f"<html><body>{links}<div>{text}</div>{links}</body></html>")
    assert got == "\n".join([("Plain words of the article that are long. " * 5).strip(), ("More of them here. " * 9).strip()])


def test_links_inside_the_named_article_stay():
    text = "<p>" + "A paragraph of the article with words. " * 8 + "</p>"
    links = "<h2>References</h2><ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li></ul>"
    want = "\n".join([("A paragraph of the article with words. " * 8).strip(), "References", "First source", "Second source", "Last."])
    for start, end in (("<article>", "</article>"), ("<div class=content>", "</div>")):
        assert html.main_text(f"<body>{start}{text}{links}<p>Last.</p>{end}") == want
    nav = "<ul><li><a href=/1>Home page of it</a></li><li><a href=/2>Contact us here</a></li></ul>"
    assert html.main_text(f"<body><div>{nav}{text}{text}</div>") == "\n".join([want.split("\n")[0]] * 2)


def test_density_decides_between_named_elements():
    teaser = "<article><h2>Teaser</h2><p>Short <a href=/x>read on</a></p></article>"
    long = "<article><h2>Story</h2><p>" + "Sentences that the story is made of. " * 20 + "</p><p>" + "And more of them. " * 20 + "</p></article>"
    for page in (teaser * 3 + long, long + teaser * 3, teaser + long + teaser):
        got = html.main_text(f"<body>{page}")
        assert got.startswith("Story\nSentences") and "Teaser" not in got


def brute_densest(tree: tuple) -> tuple:
    """(sum of its children's densities, place) of the first densest element below a body, from the definition.
    An element is (tag, text before its children, children)."""

    def count(node):
        tag, text, children = node
        below = [count(c) for c in children]
        chars = len(text) + sum(b[0] for b in below)
        tags = sum(b[1] + 1 for b in below)
        links, link_chars = (1 + sum(b[2] for b in below), chars) if tag == "a" else (sum(b[2] for b in below), sum(b[3] for b in below))
        return chars, tags, links, link_chars

    all_chars, _, _, all_links = count(tree)

    def density(node):
        chars, tags, links, link_chars = count(node)
        if not chars:
            return 0.0
        base = math.log(chars / max(chars - link_chars, 1) * link_chars + all_links / max(all_chars, 1) * chars + math.e)
        adjusted = chars / max(link_chars, 1) * max(tags, 1) / max(links, 1)
        return chars / max(tags, 1) * math.log(max(adjusted, 1e-9)) / math.log(max(base, 1.1))

    sums = []

    def visit(node):
        if count(node)[0]:
            sums.append(sum(density(c) for c in node[2]))
        for c in node[2]:
            visit(c)

    visit(tree)
    return sums


def test_densities_equal_brute_force():
    rng = random.Random(5)

    def grow(depth):
        tag = rng.choice(["div", "section", "div", "a", "b"]) if depth else "body"
        text = "x" * rng.choice([0, 0, 3, 20, 90]) if depth else ""
        return tag, text, [grow(depth + 1) for _ in range(rng.randint(0, 4))] if depth < 4 and tag != "a" else []

    def write(node):
        tag, text, children = node
        return f"<{tag}>{text}{''.join(map(write, children))}</{tag}>"

    def legal(node, inline=False):  # no block inside an inline element
        return not (inline and node[0] in ("div", "section")) and all(legal(c, node[0] == "b") for c in node[2])

    tried = 0
    while tried < 200:
        tree = grow(0)
        if not legal(tree):
            continue
        nodes = html.parse(write(tree))
        html.measure(nodes)
        got = [n.sum for n in nodes[1:] if n.chars]
        want = brute_densest(tree)
        assert len(got) == len(want) and all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got, want))
        tried += 1


def test_unclosed_elements_take_seconds():
    k, start = 100_000, time.monotonic()
    assert html.main_text("<b>" * k + "x" + "</i>" * k) == "x"
    assert html.main_text("<p>y" + "</a" * k) == "y"
    assert html.main_text("<p>y" + "<!" * k) == "y"
    assert html.main_text("<p>" + "<b>" * k + "z" + "<li>" * k) == "z"
    assert time.monotonic() - start < 60


def test_odd_markup():
    assert html.main_text(None) == html.main_text("") == html.main_text("<div></div>") == html.main_text("<script>x") == ""
    assert html.main_text("a < b & c &nbsp; d<br>e") == "a < b & c d e"
    assert html.main_text("<p>a<p>b</div></span><b>c") == "a\nbc"
    assert html.main_text("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>") == "a\nb\n1 2\n3"
    assert html.main_text("<p title='>'>x</p><p title=\"a'>\">y</p><p a=>z") == "x\ny\nz"
    assert html.main_text("<p>&#233;&eacute;&#x1F642;&am</p>") == "éé🙂&am"
    assert html.main_text("<div>" * 20_000 + "deep") == "deep"
    assert len(html.main_text("<p>" + "word " * 200_000)) == 5 * 200_000 - 1
    html.main_text('<p a="' * 5000 + "<!--" * 5000 + "<" * 5000)


def test_one_row_per_page(spark):
    rows = [(1, "u", None, "t"), (2, None, f"<article>{ARTICLE}</article>", "t"), (2, None, f"<article>{ARTICLE}</article>", "t"), (None, "", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0), r.text, r.n_chars) for r in html.extract(pages).collect())
    assert got == [(0, "", 0), (1, "", 0), (2, WANT, len(WANT)), (2, WANT, len(WANT))]
    assert html.extract(pages.limit(0)).count() == 0
