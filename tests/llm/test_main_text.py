import math
import random
import time

import pytest

from terrace.llm import main_text

NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
CASES = {
    "plain": (f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{NAV}<article><h1>Title</h1><p>One  two\nthree.</p><p>Four &amp; five&nbsp;six.</p></article><footer>&copy; 2020</footer></body></html>", "Title One two three. Four & five six."),
    "unclosed": ("<article><h1>A</h1><p><b>Bold start<br><p>Next one.<p>Last", "A Bold start Next one. Last"),
    "inline": ("<article><p>un<b>bro</b>ken <a href=x>link</a>, ok.</p></article>", "unbroken link, ok."),
    "advert": ('<article><p>Real text here.</p><div class="ad">Buy now</div><p>More text.</p></article><!-- comment <p>no</p> -->', "Real text here. More text."),
    "comments": ('<article><p>The story goes on.</p></article><section id="comments"><article class="comment"><p>First!</p></article></section>', "The story goes on."),
    "divs": ('<body><div id="menu"><a href=1>x</a><a href=2>y</a></div><div class="wrap"><div class="post"><p>A long paragraph of the story, with many words in it.</p><p>Another long paragraph, which also has words.</p></div><div class="sidebar"><p>Links</p></div></div></body>', "A long paragraph of the story, with many words in it. Another long paragraph, which also has words."),
    "form": ("<article><p>Text.</p><form><input name=q><button>Go</button></form><aside>See also</aside></article>", "Text."),
    "cut off": ("<article><p>Text and <b>more</b></p></article><footer>&copy; me &am", "Text and more"),
    "broken tag": ("<article><p>Five</p><p>Six</p><a href='x", "Five Six"),
    "no tags": ("just  words", "just words"),
    "empty": ("", ""),
    "only menu": (f"<body>{NAV}</body>", ""),
    "attributes": ('<article><p title="a > b" hidden>gone</p><p>a &lt; b</p></article>', "a < b"),
    "apostrophe in a bare value": ("<p><a title=it's>link text</a> goes here. And they don't stop now.</p>", "link text goes here. And they don't stop now."),
    "apostrophe at once": ("<p title=it's>hello brave world", "hello brave world"),
    "quote never closed": ('<article><p title="a>One two three.</p><p>Four five.</p></article>', "One two three. Four five."),
    "several articles": ("<main>" + "<article><h2>Part</h2><p>" + "Some words of a longer story. " * 9 + "</p></article>" + "<article><h2>Next</h2><p>" + "Other words of this same story. " * 9 + "</p></article></main><ul><li><a href=1>one</a><li><a href=2>two</a></ul>", "Part " + ("Some words of a longer story. " * 9) + "Next " + ("Other words of this same story. " * 9).strip()),
    "wrapper with noisy words": ("<div class='content no-sidebar'><div class='widget'><p>" + "A story that goes on. " * 9 + "</p><p>" + "It has two parts. " * 9 + "</p></div></div><div class=ad>Buy</div>", ("A story that goes on. " * 9 + "It has two parts. " * 9).strip()),
    "article tag around a menu": ("<article><ul><li><a href=1>one</a><li><a href=2>two</a></ul></article><div><p>" + "Here is the text itself. " * 9 + "</p><p>" + "And here is more of it. " * 9 + "</p></div>", ("Here is the text itself. " * 9 + "And here is more of it. " * 9).strip()),
    "long number": ("<p>a &#" + "9" * 6000 + "; b &#0065; &#x42;</p>", "a \ufffd b A B"),
    "less than": ("<p>1 < 2 and 3 <4 is <> true</p>", "1 < 2 and 3 <4 is <> true"),
    "deep": ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    page, wanted = CASES[name]
    assert main_text.main_text(page) == wanted


BROKEN = ("<a ", "<a b=c ", "<a b='c ", '<a b="c ', "<!--", "</script ", "<script></script ", "</", "<p>", "<li><p>", "x<td>")


@pytest.mark.parametrize("piece", BROKEN)
def test_broken_markup_takes_linear_time(piece):
    begin = time.perf_counter()
    main_text.main_text(piece * 100_000)
    assert time.perf_counter() - begin < 10


def test_deep_stray_tags():
    assert main_text.main_text("<div>" * 20_000 + "</b>" * 20_000 + "<b>" * 20_000 + "<hr>x" * 20_000).count("x") == 20_000


def tree(rng, depth):
    """(tag, class, parts) of a random element; parts are texts and elements."""
    tag = rng.choice(["div", "section", "ul", "div"]) if depth else "p"
    parts = [tree(rng, depth - 1) for _ in range(rng.randrange(1, 5))] if depth else [rng.choice(["word ", "more text ", "x "]) * rng.randrange(12)]
    if rng.random() < 0.3:
        parts.append(("a", "", ["link " * rng.randrange(1, 5)]))
    return tag, rng.choice(["", "", "", "ad", "post"]), parts


def brute(root):
    """The method word for word, on (tag, class, parts): sums of densities, the threshold of the body path, growth."""
    flat = []

    def walk(node, path, noisy):
        noisy = noisy or node[1] == "ad"
        flat.append((node, path, noisy))
        for p in node[2]:
            if not isinstance(p, str):
                walk(p, [*path, node], noisy)

    walk(root, [], False)
    inside = {id(n): noisy for n, _, noisy in flat}
    below = lambda n: [p for p in n[2] if not isinstance(p, str)]

    def rule(ads):
        """density, total and the core, with blocks of class ad or without."""
        seen = lambda n: [p for p in below(n) if ads or p[1] != "ad"]
        chars = lambda n: sum(len("".join(p.split())) for p in n[2] if isinstance(p, str)) + sum(map(chars, seen(n)))
        tags = lambda n: sum(1 + tags(p) for p in seen(n))
        link_chars = lambda n: chars(n) if n[0] == "a" else sum(map(link_chars, seen(n)))
        link_tags = lambda n: tags(n) if n[0] == "a" else sum((p[0] == "a") + link_tags(p) for p in seen(n))
        share = link_chars(root) / max(chars(root), 1)

        def density(n):
            c, t, lc, lt = chars(n), max(tags(n), 1), link_chars(n), link_tags(n)
            if not c or inside[id(n)] and not ads:
                return 0.0
            ratio = max(c / max(lc, 1) * t / max(lt, 1), 1.0)
            return c / t * math.log(ratio) / (1 + math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e)))

        total = lambda n: sum(density(p) for p in below(n)) or density(n) * 0.5
        return density, total, max((x for x in by_level if x[0][0] != "a" and (ads or not x[2])), key=lambda x: total(x[0])), chars

    by_level = sorted(flat, key=lambda x: len(x[1]))  # of equal sums the upper node counts, the first of its level
    density, total, (core, path, _), chars = rule(False)
    more = rule(True)
    if inside[id(more[2][0])] and total(core) < 0.1 * more[1](more[2][0]):
        density, total, (core, path, _), chars = more
    threshold = min(density(n) for n in [*path, core])
    top, up = core, list(path)
    while up and (top[0] == "p" or any(p is not top and p[1] != "ad" and chars(p) and density(p) >= threshold for p in below(up[-1]))):
        top = up.pop()
    held = {id(n) for n in [*path, core]}

    def text(n):
        if n[1] == "ad" and id(n) not in held and n is not top:
            return " "
        inner = "".join(p if isinstance(p, str) else text(p) for p in n[2])
        return inner if n[0] == "a" else f" {inner} "

    return " ".join(text(top).split())


def test_density_rule_against_brute_force():
    rng = random.Random(6)
    write = lambda n: n if isinstance(n, str) else f"<{n[0]}" + (f' class="{n[1]}"' if n[1] else "") + ">" + "".join(map(write, n[2])) + f"</{n[0]}>"
    for _ in range(150):
        root = ("html", "", [tree(rng, rng.randrange(1, 4)) for _ in range(rng.randrange(1, 5))])
        assert main_text.main_text("<html>" + "".join(map(write, root[2])) + "</html>") == brute(root)


def test_long_page():
    page = "<article>" + "<p>Some words of text.</p>" * 20000 + "</article>"
    assert main_text.main_text(page) == " ".join(["Some words of text."] * 20000)


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", CASES["plain"][0]), (2, None, None), (None, "v", "")], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted((tuple(r) for r in main_text.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", CASES["plain"][1], len(CASES["plain"][1])), (2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert main_text.extract(df.limit(0)).count() == 0
