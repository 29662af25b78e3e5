import html
import re

from flowlake.llm import host_paths

SF = "/root/testdata/sf0.001"
PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header>no</header><nav><ul><li><a href="/x">no</a></ul></nav><div id="cookie-notice">no</div>
<div class="post-%d"><h2>Head &amp; line</h2><p>One&nbsp;two   <b>th</b>ree<br>four<p>five<!-- no --><form>no<input></form>
<aside>no</aside><div class="comments"><p>no</div><ul><li>six<li>seven</ul></div><div class="ad">no</div><footer>no</footer>"""


def test_what_is_left_out():
    text = "Head & line One two three four five six seven"
    assert host_paths.main_text(PAGE % 7, []) == text
    page = host_paths.parse(PAGE % 7)
    path = host_paths.best_container(page)[0]
    assert host_paths.best_container(host_paths.parse(PAGE % 12))[0] == path  # digits are generalised
    assert host_paths.main_text(PAGE % 9, [5, path]) == text


def test_broken_pages():
    assert host_paths.main_text(None, []) == host_paths.main_text("", []) == ""
    assert host_paths.main_text("just text < 3 & more", []) == "just text < 3 & more"
    assert host_paths.main_text("<p>a<!-- unterminated <p>b", []) == "a"
    assert host_paths.main_text("<article><p>a</div></span>b<script>x", []) == "ab"
    deep = "<div>" * 3000 + "deep" + "</div>" * 10
    assert host_paths.main_text(deep, []) == "deep"
    assert host_paths.main_text("<article>" + "<p>word" * 20000, []).count("word") == 20000


def truth(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
    blocks = [" ".join(html.unescape(re.sub(r"<(?!br)[^>]*>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return " ".join(b for b in blocks if b)


def test_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = host_paths.query(spark, SF).collect()
    assert {r.page_id: r.text for r in found} == {k: truth(h) for k, h in pages.items()}
    assert all(r.n_chars == len(r.text) for r in found)


def test_host_agreement_and_hard_rows(spark, monkeypatch):
    """A page on which two containers hold the article is read by its host's path, and none by a path that holds less."""
    menu = "<ul><li><a href='/x'>a link</a></ul>"
    usual = f"<body>{menu}<div class='text'><p>" + "good words here " * 20 + "</div>"
    odd = f"<body><div class='text'>{menu}<section><p>the text</section></div>"  # its own best one is the section
    split = "<body><div class='text'><p>the text</div><div class='more'>" + "other matter " * 40 + "</div>"
    rows = [(k, "http://Host.example/a", usual) for k in range(30)] + [(98, "http://host.example/b?x", odd), (99, "http://host.example/b?x", split), (100, None, None),
            (101, "no scheme", "<p>x"), (101, "no scheme", "<p>x"), (102, "http://e.example", "")]
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, path string, votes string")
    found = host_paths.extract(pages)
    assert found.columns == ["page_id", "url", "path", "votes", "_text"]
    got = sorted(((r.page_id, r._text) for r in found.collect()))
    assert got[-6:] == [(98, "a link the text"), (99, "the text " + ("other matter " * 40).strip()), (100, ""), (101, "x"), (101, "x"), (102, "")]
    assert len(got) == 36 and {t for k, t in got if k < 30} == {("good words here " * 20).strip()}
    monkeypatch.setattr(host_paths, "BROADCAST_HOSTS", 0)
    assert sorted(((r.page_id, r._text) for r in host_paths.extract(pages).collect())) == got
    assert host_paths.extract(pages.filter("false")).count() == 0


def test_words_that_do_not_leave_out_the_article():
    """Articles, self-named content and large layout containers keep their text whatever their classes say."""
    article = "<h1>Title here</h1>" + "<p>some words of the article</p>" * 5
    whole = " ".join(["Title here", *["some words of the article"] * 5])
    for tag, attributes in (("article", "class='post tag-social'"), ("div", "class='content with-sidebar'"), ("main", "class='no-header'"),
                            ("div", "class='entry-content share'"), ("article", "class='sponsored'"), ("div", "id='post' class='widget'"),
                            ("div", "class='layout page-sidebar-left'"), ("div", "class='elementor-widget'"), ("section", "class='banner'"),
                            ("main", "class='notice'")):
        inside = f"<{tag} {attributes}>{article}</{tag}>"
        nested = f"<div class='site header-fixed'>{inside}</div>"
        for page in (inside, nested, f"<main>{inside}</main>"):
            got = host_paths.main_text(f"<body><nav>no</nav><div class='ad'>no</div>{page}<footer>no</footer>", [])
            assert got == whole, (page[:80], got)


def test_words_still_leave_out_what_is_no_article():
    much = "<p>what a reader or a seller says at length</p>" * 30
    kept = "<article><h1>Title</h1><p>a short article</p>%s</article>"
    for other in ("<div id='comments'>%s</div>", "<div class='post-comments'>%s</div>", "<article class='comment'>%s</article>", "<div class='cookie-notice'>%s</div>",
                  "<div class='site-sidebar'>%s</div>", "<section class='widget-area'>%s</section>"):
        assert host_paths.main_text("<body>" + kept % (other % much), []) == "Title a short article", other
        if "<article" not in other:
            assert host_paths.main_text("<body>" + kept % "" + other % much, []) == "Title a short article", other
    assert host_paths.main_text("<body><div class='text'><p>a short text</p></div><div id='comments'><h1>Talk</h1>" + much, []) == "a short text"
    assert host_paths.main_text("<div class='site-widget'>" * 2000 + "<p>deep text", []) == "deep text"


def test_title_and_lead_outside_the_inner_container(spark):
    """Neither the page's own container nor the host's path drops a part of the article."""
    body = "<p>" + "the body of the text " * 40
    inner = "<div class='entry'>%s</div>"
    title = "<h1>Title</h1><p>A lead of some words.</p>"
    both = "Title A lead of some words. " + ("the body of the text " * 40).strip()
    for outer in ("<article>%s</article>", "<div class='post'>%s</div>", "<div class='wrap'>%s</div>"):
        got = host_paths.main_text("<body><p>tagline</p>" * (outer[1] == "a") + outer % (title + (inner if "wrap" not in outer else "<div>%s</div>") % body), [])
        assert got == both, outer
    menu = "<ul><li><a href='/x'>a link to some other page</a></ul>"
    assert host_paths.main_text("<article>" + menu + inner % body + "</article>", []) == both[28:]  # linked text alone does not keep the outer one

    deep, split = "<article>" + inner % body + "</article>", "<article>" + title + inner % "<p>part one of it" + "<section>" + body + "</section></article>"
    rows = [(k, "http://hot.example/a", deep) for k in range(40)] + [(100 + k, "http://hot.example/b", split) for k in range(10)]
    found = host_paths.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r.page_id // 100: r._text for r in found}
    assert texts == {0: both[28:], 1: both[:28] + "part one of it " + both[28:]}


def test_no_unlinked_block_is_lost_and_no_markup_is_text():
    two = "<div class=a>%s</div><div class=b>%s</div>" % ("x" * 1020, "y" * 200)
    assert host_paths.main_text(two, []) == host_paths.main_text("<body>" + two, []) == "x" * 1020 + " " + "y" * 200
    assert host_paths.main_text("before <div>" + "x" * 90 + "</div> after", []) == "before " + "x" * 90 + " after"
    assert host_paths.main_text('<p>one two <a title="x>link</a> three</p>', []) == "one two link three"
    assert host_paths.main_text("one <b", []) == "one" and host_paths.main_text("one <b title='x", []) == "one"
    assert host_paths.main_text("one <!doctype", []) == "one" and host_paths.main_text("1 < 2 <3", []) == "1 < 2 <3"


def test_votes_are_counted_as_by_hand(spark):
    """Winners of every host against a plain count over the same pages."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("url", "html")
    found = {r._host: r._paths for r in host_paths.winning_paths(pages.withColumn("_host", host_paths.host_of(pages["url"]))).collect()}
    votes, chars = {}, {}
    for r in pages.collect():
        host = re.match(r"(?s).*?://([^/?#]*)", r.url or "")
        own = host_paths.best_container(host_paths.parse(r.html or ""))
        if own:
            key = host.group(1).lower() if host else "", own[0] - (1 << 64) if own[0] >> 63 else own[0]
            votes[key] = votes.get(key, 0) + 1
            chars[key] = chars.get(key, 0) + own[1]
    want = {}
    for (host, path), n in votes.items():
        if n >= host_paths.WINNING_SHARE * sum(m for (h, _), m in votes.items() if h == host):
            want.setdefault(host, []).append((n, chars[host, path], path))
    assert found == {host: [path for _, _, path in sorted(paths, reverse=True)] for host, paths in want.items()}
