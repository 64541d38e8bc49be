import pytest

from plazaflow.llm import html_text as H


def text(html, template=()):
    return H.Page(html).text(set(template))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><h1>T&amp;x</h1><p>a <b>b</b><br>c<p>d\n e&nbsp;f</article><p>out", "T&x\na b c\nd e f"),
        ("<body><nav><a>menu</a></nav><header>h</header><div class='ad-slot'>buy</div><p>keep</p><aside>s</aside><footer>f</footer>", "keep"),
        ("<main><p>a</p><div id=comments><p>no</p></div><form>x</form><p>b</main><p>no", "a\nb"),
        ("<article><header><h1>title</h1></header><section role=complementary>no</section><p>x</article>", "title\nx"),
        ("<p>a<script>if (a < b) '</p>'</script>b<style>p{}</style><!-- <p>c --> d", "ab d"),
        ("<ul><li>x<li>y<ul><li>z</ul></ul><table><tr><td>1<td>2<tr><td>3</table>", "x\ny\nz\n1\n2\n3"),
        ("a<p>b</p></div></p>c", "a\nb\nc"),
        ("<article>one</article><aside><article>no</article></aside><article>two</article>", "one\ntwo"),
        ("<p title='a > b'>q</p><P CLASS=AD>no</P>x &lt;y&gt; &#x41;&#66; &bogus; &amp", "q\nx <y> AB &bogus; &"),
        ("a < b and 1<2 <3", "a < b and 1<2 <3"),
        ("<p>unfinished <b", "unfinished"),
        ("<p>x<!-- never ends", "x"),
        ("<title>no</title><textarea>no</textarea><p>yes", "yes"),
        ("<div class=cookie-notice>no</div><div class='site header'>no</div><div class=adventure>yes</div>", "yes"),
    ],
)
def test_main_text(html, want):
    assert text(html) == want


def page(body, url="http://h.example/x", i=[0]):  # noqa: B006
    i[0] += 1
    return (i[0], url, body)


def extracted(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    return {r.page_id: (r.text, r.n_chars) for r in H.extract(df, **more).collect()}


def test_template_of_a_host_goes(spark):
    box = "<div><p>Read our other stories</p></div>"
    rows = [page(f"<body>{box}<p>story {k}</p></body>") for k in range(6)]
    rows += [page(f"<body>{box}<p>story {k}</p></body>", "http://other.example/") for k in range(2)]
    got = extracted(spark, rows, min_pages=5)
    assert [got[r[0]][0] for r in rows] == [f"story {k}" for k in range(6)] + [f"Read our other stories\nstory {k}" for k in range(2)]


def test_copies_of_a_page_are_no_template(spark):
    rows = [page("<body><p>the same story</p></body>") for _ in range(20)]
    assert {t for t, _ in extracted(spark, rows).values()} == {"the same story"}


def test_repeated_text_of_articles_stays(spark):
    rows = [page(f"<nav>menu</nav><article><p>licence line</p><p>{k}</p></article>") for k in range(9)]
    assert [t for t, _ in extracted(spark, rows).values()] == [f"licence line\n{k}" for k in range(9)]


def test_nulls_and_repeats(spark):
    rows = [(1, None, "<p>a"), (1, None, "<p>a"), (2, "http://x/", None), (None, "x", ""), (3, "http://x/", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.n_chars) for r in H.extract(df).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (2, 0), (None, 0), (3, 249_999)], key=repr)
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div class='layout has-sidebar'><article>a</article></div>", "a"),
        ("<div id=no-comments><main>a</main></div>", "a"),
        ("<div class=sidebar><article>a<div class=ad>no</div></article></div>", "a"),
        ("<form id=aspnetForm><nav>no</nav><article>a</article></form>", "a"),
        ("<article><section id=related-work>a</section><div class=social-science>b</div><h2 id=comments>c</h2></article>", "a\nb\nc"),
        ("<aside class=x><div class=related><article>no</article></div></aside><p>a", "a"),
        ("<div class=related><p>no</div><div class='top ad-box'>no</div><form>no</form><p>a", "a"),
    ],
)
def test_names_of_boilerplate_take_no_content(html, want):
    assert text(html) == want


def test_template_is_a_share_of_the_pages_of_a_host(spark):
    box, passage = "<div><p>Our shop</p></div>", "<section><p>A passage of five pages</p></section>"
    rows = [page(f"<body>{box}<p>story {k}</p>{passage if k < 5 else ''}</body>") for k in range(40)]
    got = extracted(spark, rows)
    assert [got[r[0]][0] for r in rows] == [f"story {k}" + "\nA passage of five pages" * (k < 5) for k in range(40)]


def test_bare_text_blocks_are_no_template(spark):
    rows = [page(f"<body><h2>Introduction</h2><p>One passage</p><p>story {k}</p></body>") for k in range(9)]
    got = extracted(spark, rows)
    assert [got[r[0]][0] for r in rows] == [f"Introduction\nOne passage\nstory {k}" for k in range(9)]


def brute_force(rows, min_pages=H.MIN_PAGES, min_share=H.MIN_SHARE):
    """The texts with templates counted by dictionaries over all pages."""
    pages = {}
    for _, url, html in rows:
        p = H.Page(html)
        pages.setdefault(url.split("/")[2], {}).setdefault(p.text(set()), set()).update(p.digest[e] for e in p.candidates())
    out = {}
    for i, url, html in rows:
        others = pages[url.split("/")[2]]
        recur = others.values()
        n = {d: sum(d in r for r in recur) for r in recur for d in r}
        out[i] = H.Page(html).text({d for d, c in n.items() if c >= max(min_pages, min_share * len(others))})
    return out


def site(k, host, article=True, box=True):
    inner = f"<h1>Title {k}</h1><p>story {k} of {host}</p><p>Free to share under the licence.</p>" + "<div><h3>Read more</h3><ul><li>One</li><li>Two</li></ul></div>" * box + f"<p>end {k}</p>"
    shell = "<article>{}</article>" if article else "{}"
    return page(f"<body><nav>{k}</nav><div class=x1><span>Shop</span><p>Offers of the day</p></div>{shell.format(inner)}<section><p>Visit us</p></section><footer>{k}</footer></body>", f"http://{host}/{k}")


@pytest.mark.parametrize("most", [H.MOST_BROADCAST, 0])
def test_templates_decide_with_and_without_article(spark, most):
    sites = {a: [site(k, "h.example", a) for k in range(12)] for a in (True, False)}
    want = [f"Title {k}\nstory {k} of h.example\nFree to share under the licence.\nend {k}" for k in range(12)]
    for rows in sites.values():
        got = extracted(spark, rows, most_broadcast=most)
        assert [got[r[0]][0] for r in rows] == want, "the box inside the article goes, the licence line stays"


@pytest.mark.parametrize("most", [H.MOST_BROADCAST, 0])
def test_against_brute_force(spark, most):
    rows = [site(k, host, article=k % 3 > 0, box=k % 4 > 0) for host, n in (("a.example", 30), ("b.example", 4), ("c.example", 7)) for k in range(n)]
    rows += rows[:9]
    got = extracted(spark, rows, most_broadcast=most)
    assert {i: t for i, (t, _) in got.items()} == brute_force(rows)
    assert got[rows[30][0]][0].startswith("Shop\nOffers"), "four pages say nothing about their host's template"


def test_one_story_under_many_addresses_stays(spark):
    body = "<div class=x1><p>Shop</p></div><article><div><p>one story</p></div></article>"
    rows = [page(f"<body>{body}<i>{k}</i></body>") for k in range(8)]
    assert {t for t, _ in extracted(spark, rows).values()} == {"one story"}


def test_a_page_that_is_all_template_is_read_without_it(spark):
    box = "<div class=x1><p>Our shop</p></div>"
    rows = [page(f"<body>{box}<p>story {k}</p></body>") for k in range(8)] + [page(f"<body>{box}</body>")]
    assert [extracted(spark, rows)[r[0]][0] for r in rows[7:]] == ["story 7", "Our shop"]
