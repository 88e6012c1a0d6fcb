"""Pages whose markup the given ones do not have."""

from spanloom.llm import html_text


def text_of(page):
    return html_text.page_text(html_text.blocks(page), None)


def test_self_closed_icons_hide_nothing():
    page = '<article><p>First <svg class="icon" href="#a"/> part.</p><math/><p>Second part.</p>{}</article>'
    assert text_of(page.format("")) == "First part.\n\nSecond part."
    assert text_of(page.format("<svg><path d=m /><text>no</text></svg><p>Third.</p>")) == "First part.\n\nSecond part.\n\nThird."


def test_names_of_wrappers_do_not_hide_the_page():
    prose = "<h1>Head</h1><p>" + "some words of the article " * 9 + "</p>"
    want = text_of(f"<body><div>{prose}</div></body>")
    assert want.startswith("Head\n\nsome words")
    for tag, names in (
        ("body", "single has-sidebar"), ("body", "menu"), ("div", "content with-sidebar"), ("main", "main nav-open"),
        ("div", "elementor-widget-container"), ("div", "sidebar"), ("article", "related"), ("form", ""),
    ):
        page = f"<{tag} class='{names}'><div>{prose}</div><div class='ad'><p>buy</p></div></{tag}>"
        assert text_of(page) == want, (tag, names)
    for names in ("sidebar", "cookie-notice", "site-footer", "comments-area", "ad-slot-3"):
        assert text_of(f"<body><div>{prose}</div><div class='{names}'><p>other text here</p></div></body>") == want, names


def test_text_of_nested_containers_is_whole():
    long = "words of the body text " * 40
    page = f"<body><article><h1>Title</h1><p>lead</p><div class='body'><p>{long}</p></div></article><div class='x'>box</div></body>"
    assert text_of(page) == f"Title\n\nlead\n\n{long.strip()}"
    assert text_of(page.replace("article>", "section>")) == f"Title\n\nlead\n\n{long.strip()}"
    two = f"<main><section class='intro'><p>{long[:300]}</p></section><section class='methods'><p>{long}</p></section></main>"
    assert text_of(two) == f"{long[:300].strip()}\n\n{long.strip()}"


def test_two_templates_and_a_page_without_the_winner(spark):
    long = "words of the text " * 20
    rows = [(i, f"http://h.example/a{i}", f"<body><div class='story'><p>{long}{i}</p></div></body>") for i in range(6)]
    rows += [(i, f"http://h.example/b{i}", f"<body><div class='story'><p>short box</p></div><div class='report'><p>{long}{i}</p></div></body>") for i in range(10, 14)]
    rows += [(20, "http://h.example/c", f"<body><div class='story'><p>short box</p></div><div class='once'><p>{long}20</p></div></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.row.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {i: f"{long}{i}" for i, _, _ in rows}


WHOLE = [
    # (page, text): nothing that opens and never closes takes the rest of the page along
    ("<p>First part</p><button>Share<p>Second part", "First part\n\nShare\n\nSecond part"),
    ("<p>First part</p><object data=x>seen<p>Second part", "First part\n\nseen\n\nSecond part"),
    ("<p>First part</p><select><option>a<p>Second part", "First part\n\na\n\nSecond part"),
    ("<p>First <object data=x>inside</object> part</p>", "First inside part"),
    ("<p>First part</p><iframe src=x /><p>Second part</p>", "First part\n\nSecond part"),
    ("<p>First part</p><iframe src=x><p>no</p></iframe><p>Second part</p>", "First part\n\nSecond part"),
    ("<p>First part</p><script>var x = '<p>no</p>'<p>kept</p>", "First part\n\nvar x = '\n\nno\n\n'\n\nkept"),
    ("<p>First<svg><g><svg><text>no</text></svg><text>no</text></g></svg> part</p>", "First\n\npart"),
    ("<div><svg><path d=m><p>Second part</p></div><svg></svg>", "Second part"),
    ("<p>First part<button><div>Share</button> goes on</p>", "First part\n\ngoes on"),
    ("<p title=it's>First part isn't here</p><p>Second</p>", "First part isn't here\n\nSecond"),
    ("<p title=it's>First part</p>", "First part"),
    ("<p title=\"a > b\" class='x>y'>First part</p>", "First part"),
    ("<p data-x=\"class=ad\" title='my class=sidebar'>First part</p>", "First part"),
    ("<!--><p>First part</p><!-- no --!><p>Second</p><!--->Third", "First part\n\nSecond\n\nThird"),
    ("<a href=/x/>First</a> part <script src=/js/></script>goes on", "First part goes on"),
    ("<div>" * 3 + "x" + "</section></div></p>y", "x\n\ny"),
]


def test_whole_pages(spark):
    for page, want in WHOLE:
        assert text_of(page) == want, page
    table = spark.createDataFrame([(i, f"http://h{i}.example/", p) for i, (p, _) in enumerate(WHOLE)], "page_id long, url string, html string")
    assert {r.row.page_id: r.text for r in html_text.extract(table).collect()} == {i: t for i, (_, t) in enumerate(WHOLE)}


def test_nested_page_of_a_megabyte():
    import time

    start = time.time()
    for part, close in (("<div>a", ""), ("<div class='c1 d2'>a", "</section>"), ("<b>a", "<div>"), ("<ul><li>a", ""), ("<div class=ad>a", "</p>"), ("<svg><a>", "")):
        page = part * (1_000_000 // len(part + close)) + close * (1_000_000 // len(part + close))
        found = html_text.blocks(page)
        html_text.page_text(found, [])
        assert sum(len(x) for x in found.strings) < 100 * len(page)
    assert time.time() - start < 120


def test_one_winner_among_ties(spark):
    long = "words of the text " * 20
    rows = [(i, f"http://h.example/a{i}", f"<body><div class='x{chr(97 + i % 26)}{chr(97 + i // 26)}'><p>{long}{i}</p></div></body>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    [found] = html_text.host_paths(pages).collect()
    assert found.path == ">body" and found.paths == [">body"] or found.paths == [found.path]
    got = {r.row.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {i: f"{long}{i}" for i in range(300)}
