from __future__ import annotations

import html
import re

import pytest
from corpus_cases import from_folder, prose

from quarrymark.llm import template_html as th
from quarrymark.llm.page_blocks import parse

SCHEMA = "page_id long, url string, html string, host string, drop string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "d", "t") for r in rows], SCHEMA)


def texts(frame) -> dict:
    return {r["page_id"]: r["text"] for r in th.extracted(frame).collect()}


def test_pages(spark):
    table = from_folder(spark, "pages", "/root/testdata/sf0.01")
    got = th.extracted(table).collect()
    source = {r["page_id"]: r["html"] for r in table.collect()}
    assert len(got) == len(source)
    for r in got:
        body = re.search("<article>(.*)</article>", source[r["page_id"]], re.DOTALL)[1]
        parts = re.split("</?(?:p|h1)>", body.replace("<br>", " "))
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def site(i: int) -> str:
    links = "".join(f'<li><a href="/{k}{i}">{prose(2, k + i)}</a>' for k in range(5))
    return f"""<html><head><title>T{i}</title><script>var a = "<p>no</p>";</script></head><body><div class=x>
      <ul>{links}</ul></div><div id=main-{i}><h1>Title {i}</h1><div>By our staff &amp; friends</div>
      <p>{prose(60, i)}</p><p>{prose(50, 2 * i)}<br>more&nbsp;text &lt;b&gt;</p></div>
      <div class="comments"><p>{prose(5, i)}</p></div><div>All rights reserved</div></body></html>"""


def test_menus_and_constants_are_template(spark):
    got = texts(pages(spark, [(i, f"https://A.example.org:80/p{i}", site(i)) for i in range(20)]))
    for i, text in got.items():
        assert text == f"Title {i}\n\n{prose(60, i)}\n\n{prose(50, 2 * i)} more text <b>"


def test_few_pages_have_no_template(spark):
    got = texts(pages(spark, [(i, "https://b.example.org/", site(i)) for i in range(3)]))
    assert "All rights reserved" in got[0] and prose(60, 0) in got[0] and prose(5, 0) not in got[0].split("\n\n")


def test_copies_of_one_page_stay_whole(spark):
    got = texts(pages(spark, [(i, f"https://c.example.org/{i}", "<body><h1>One</h1><p>" + prose(30) + "</p></body>") for i in range(30)]))
    assert set(got.values()) == {"One\n\n" + prose(30)}


def test_awkward(spark):
    rows = [
        (1, None, None),
        (2, "not a url", ""),
        (None, "http://h/", "<p>a</p>"),
        (3, "http://h/", "plain text, 1 < 2 & so on"),
        (3, "http://h/", "plain text, 1 < 2 & so on"),
        (4, "http://h/", "<p>" + "long " * 100_000 + "</p>"),
        (5, "http://h/", "<p>open <div>in</p></div></span> out <p attr='>'>q"),
        (6, "http://h/", "<!-- x <p>no</p> --><p>yes<!-- never closed <p>no</p>"),
        (7, "http://h/", "<p>cut <a href="),
    ]
    frame = pages(spark, rows)
    got = th.extracted(frame).collect()
    assert sorted((r["page_id"] or 0) for r in got) == [0, 1, 2, 3, 3, 4, 5, 6, 7]
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == text[2] == "" and text[None] == "a" and text[3] == "plain text, 1 < 2 & so on"
    assert text[4] == ("long " * 100_000).strip() and text[5] == "open\n\nin\n\nout\n\nq"
    assert text[6] == "yes" and text[7] == "cut"
    assert th.extracted(frame.where("false")).count() == 0


@pytest.mark.parametrize(
    "chrome",
    [
        "<nav>no</nav>", "<header>no</header>", "<footer>no</footer>", "<aside>no</aside>", "<form>no</form>",
        "<style>no</style>", "<script>no</script>", '<div class="cookie-notice">no</div>', '<div id="sidebar2">no</div>',
        '<section class="ad">no</section>', '<div class="post-comments"><p>no</p></div>', '<div role="navigation">no</div>',
        "<div hidden>no</div>", '<p style="display: none">no</p>', "<noscript>no</noscript>", "<textarea>no</textarea>",
        '<article class="comment">no</article>',
    ],
)
def test_chrome_goes(chrome):
    assert th.article(f"<body>{chrome}<h1>T</h1><p>yes</p>{chrome}</body>") == "T\n\nyes"
    assert th.article(f"<body><main><h1>T</h1>{chrome.replace('header', 'nav')}<p>yes</p></main>{chrome}x</body>") == "T\n\nyes"


def test_block_text_and_references():
    blocks, events = parse("<div>a&amp;b\n  c<b>d</b>&#233;<ul><li>one<li>two</ul><table><tr><td>x<td>y</table></div>")
    assert [b.text for b in blocks] == ["a&b cdé", "one", "two", "x", "y"]
    assert events.count(">div>ul>li") == 2 and events.count(">div>table>tr>td") == 2


def parsed_rows(htmls: list[str]) -> list[dict]:
    import pyarrow as pa

    n = len(htmls)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array(["u"] * n), pa.array(["h"] * n), pa.array(htmls)], names=["page_id", "url", "host", "html"]
    )
    return [row for out in th._parsed(iter([batch])) for row in out.to_pylist()]


def test_classes_of_sums_are_the_classes_of_stored_vectors(spark):
    """Brute force: the occurrence vectors themselves."""
    table = from_folder(spark, "pages", "/root/testdata/sf0.01")
    read = th.parsed(table)
    vectors, marks = {}, {}
    for row in read.collect():
        if marks.setdefault((row["host"], row["mark"]), row["page_id"]) != row["page_id"]:
            continue
        page = th._page_tokens(row["paths"], row["events"], row["texts"], row["text_path"], row["linked"])
        for token, (_, count, *_) in page.items():
            vectors.setdefault((row["host"], token), {})[row["page_id"]] = count
    by_vector, by_sums = {}, {}
    for (host, token), vector in vectors.items():
        by_vector.setdefault((host, tuple(sorted(vector.items()))), set()).add(token)
    for r in th.token_sums(read).collect():
        by_sums.setdefault((r["host"], r["n"], r["total"], r["sum_a"], r["sum_b"]), set()).add(r["token"])
    assert sorted(map(sorted, by_vector.values())) == sorted(map(sorted, by_sums.values()))


def test_places_of_a_class_in_rounds():
    assert list(th.places([7, 1, 2, 9, 1, 2], {1: 5, 2: 5, 7: 6}, {5: 2, 6: 1})) == [(7, 0), (1, 0), (2, 1), (1, 0), (2, 1)]


def test_members_that_change_their_order_are_no_constants(spark):
    def page(i: int) -> str:
        lines = ["<p>First line</p>", "<p>Second line</p>"]
        return f"<body><div>{''.join(lines if i % 2 else lines[::-1])}<p>{prose(40, i)} {i}</p></div><i>The end</i></body>"

    got = texts(pages(spark, [(i, f"https://k.example.org/{i}", page(i)) for i in range(16)]))
    for i, text in got.items():
        first = ["First line", "Second line"] if i % 2 else ["Second line", "First line"]
        assert text.split("\n\n") == [*first, f"{prose(40, i)} {i}"]


def test_headings_of_articles_stay_and_edges_go(spark):
    def page(i: int) -> str:
        return (
            f"<body><article><p>Sponsored by nobody</p><h2>Abstract</h2><p>{prose(40, i)} {i}</p><p>Inner line</p>"
            f"<h2>References</h2><p>{prose(20, i)} {i}</p><p>Follow us</p><p>Again</p></article></body>"
        )

    got = texts(pages(spark, [(i, f"https://l.example.org/{i}", page(i)) for i in range(20)]))
    for i, text in got.items():
        assert text.split("\n\n") == ["Abstract", f"{prose(40, i)} {i}", "Inner line", "References", f"{prose(20, i)} {i}"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><form id=aspnetForm><div><h1>T</h1><p>yes</p></div></form></body>", "T\n\nyes"),
        ("<body><form><nav>no</nav><p>yes</p></form></body>", "yes"),
        ("<body><h1>Contact</h1><p>Write to us.</p><form><p><label>Name <input></label></p><p><button>Send</button></p></form></body>",
         "Contact\n\nWrite to us."),
        (f"<body><article><p>teaser</p></article><div><h1>T</h1><p>{prose(30)}</p></div></body>", f"teaser\n\nT\n\n{prose(30)}"),
        ("<p>Press <button>OK</button> to go on.</p>", "Press OK to go on."),
        ("<p>a <svg><title>no</title></svg>b <object>no</object>c <canvas>no</canvas>d <select><option>no</select>e</p>", "a b c d e"),
        ("<p>a <svg/>b</p><p>c</p><svg></svg>", "a b\n\nc"),
        ("<p>yes</p><div><button>Share</button> <button>Print</button></div>", "yes"),
        ('<p class="x>lost</p><p>more</p>', "lost\n\nmore"),
        ("<p title='it>lost <b>and</b> found", "lost and found"),
    ],
)
def test_markup_cases(page, text):
    assert th.article(page) == text


@pytest.mark.parametrize(
    "name", ["user-comments", "reader-comments", "comment-thread", "comment-text", "ad-300x250", "google-ad", "ad2", "sidebar-2"]
)
def test_adverts_and_comments_go(name):
    assert th.article(f'<body><article><h1>T</h1><div class="{name}"><p>no</p></div><p>yes</p></article></body>') == "T\n\nyes"


def test_least_pages_is_a_parameter(spark):
    rows = [(i, f"https://m.example.org/{i}", f"<body><p>{prose(30, i)} {i}</p><div>All rights</div></body>") for i in range(7)]
    assert "All rights" in texts(pages(spark, rows))[0]
    few = {r["page_id"]: r["text"] for r in th.extracted(pages(spark, rows), least_pages=5).collect()}
    assert few == {i: f"{prose(30, i)} {i}" for i in range(7)}


def test_constant_beside_article_text_goes(spark):
    def page(i: int) -> str:
        inner = "".join(f"<p>{prose(40 + k, 11 * i + k)} {i}.{k}</p>" for k in range(1 + i % 4))
        return f"<html><body><div>{inner}<p>Follow us for more</p></div></body></html>"

    got = texts(pages(spark, [(i, f"https://d.example.org/{i}", page(i)) for i in range(24)]))
    for i, text in got.items():
        assert text == "\n\n".join(f"{prose(40 + k, 11 * i + k)} {i}.{k}" for k in range(1 + i % 4))


def test_long_constant_goes(spark):
    licence = prose(90, 4)
    assert len(licence) > 400
    rows = [(i, f"https://e.example.org/{i}", f"<body><div><p>{prose(300, i)} {i}</p></div><div><i>{licence}</i></div></body>") for i in range(12)]
    assert texts(pages(spark, rows)) == {i: f"{prose(300, i)} {i}" for i in range(12)}


@pytest.mark.parametrize(
    "page",
    [
        '<body class="has-sidebar"><h1>T</h1><p>yes</p></body>', '<body class="menu"><h1>T</h1><p>yes</p></body>',
        '<html class="no-widget"><body><main class="no-sidebar"><h1>T</h1><p>yes</p></main></body></html>',
        '<main id="search"><h1>T</h1><p>yes</p></main>', '<article class="related share"><h1>T</h1><p>yes</p></article>',
        '<article><h1 id="search">T</h1><section id="related-work"><p>yes</p></section></article>',
        '<article><h1 id="menu-of-the-day">T</h1><section id="comments"><p>yes</p></section></article>',
        '<body><h1 id="notice">T</h1><div class="binary-search no-sidebar"><p>yes</p></div></body>',
    ],
)
def test_names_that_only_contain_a_marked_word_stay(page):
    assert th.article(page) == "T\n\nyes"


@pytest.mark.parametrize("name", ["sidebar-left", "site-footer", "ad_container", "share-buttons", "main-menu"])
def test_marked_names_with_place_go(name):
    assert th.article(f'<body><h1>T</h1><div class="x {name}">no</div><p>yes</p></body>') == "T\n\nyes"


def test_long_frame_around_short_articles_goes(spark):
    frame = "".join(f"<div class=f{k}>{prose(20, 3 * k)}</div>" for k in range(5))
    rows = [(i, f"https://f.example.org/{i}", f"<body>{frame}<p>Short {i} {prose(4, i)}</p></body>") for i in range(20)]
    assert texts(pages(spark, rows)) == {i: f"Short {i} {prose(4, i)}" for i in range(20)}


def test_copies_count_as_one_page(spark):
    def page(i: int, text: int) -> str:
        return f'<body><!-- {i} --><script>n={i}</script><div id="a">About us</div><p data-n="{i}">{prose(30, text)} {text}</p></body>'

    copies = [(i, f"https://g.example.org/c{i}", page(i, 0)) for i in range(60)]
    alone = texts(pages(spark, copies).repartition(4))
    assert set(alone.values()) == {f"About us\n\n{prose(30)} 0"}
    mixed = texts(pages(spark, [*copies, *((100 + i, f"https://g.example.org/{i}", page(i, i)) for i in range(1, 20))]).repartition(4))
    assert mixed == {i: f"{prose(30)} 0" for i in range(60)} | {100 + i: f"{prose(30, i)} {i}" for i in range(1, 20)}


@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_lists_of_links_that_do_not_recur_stay(spark, around):
    def page(i: int) -> str:
        items = "".join(f'<li><a href="/{i}/{k}">{prose(9, i + k)} {i}.{k}</a></li>' for k in range(4))
        return f"<body><{around}><h1>Title {i}</h1><p>{prose(30, i)} {i}</p><ul>{items}<li>plain {i}</li></ul></{around}></body>"

    for i, text in texts(pages(spark, [(i, f"https://i.example.org/{i}", page(i)) for i in range(16)])).items():
        items = [f"{prose(9, i + k)} {i}.{k}" for k in range(4)]
        assert text.split("\n\n") == [f"Title {i}", f"{prose(30, i)} {i}", *items, f"plain {i}"]


def test_recurring_links_in_an_article_stay(spark):
    def page(i: int) -> str:
        items = "".join(f'<li><a href="/{k}">{prose(9, k)}</a></li>' for k in range(i % 5, 3 + i % 5))
        return f"<body><article><p>{prose(30, i)} {i}</p><ul>{items}</ul></article></body>"

    for i, text in texts(pages(spark, [(i, f"https://j.example.org/{i}", page(i)) for i in range(16)])).items():
        assert text.split("\n\n") == [f"{prose(30, i)} {i}", *(prose(9, k) for k in range(i % 5, 3 + i % 5))]
