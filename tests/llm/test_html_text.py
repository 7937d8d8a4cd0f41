"""Main texts of hand-made pages, and of the small table against a plain reading of its articles."""

import html as html_lib
import re

from lodestone.llm import html_text

SCHEMA = "page_id long, url string, html string, host string, template int"


def page(i, body, close="</article>"):
    return (
        f"<html><head><title>T{i}</title><style>p{{x:'<p>'}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        f'<div class="cookie-notice">We use cookies {i}</div><article><h1>Title {i}</h1>{body}{close}'
        f'<div class="comments"><p>Reader {i} says no</p></div><aside>More</aside><footer>&copy; x</footer><script>var a="</p><p>bad";</script></body></html>'
    )


def test_articles(spark):
    bodies = [
        ("<p>One  &amp;\n two&nbsp;three</p><p>a<b>b</b>c<br>d</p>", "One & two three\nabc d"),
        ("<p>Open one<p>open two", "Open one\nopen two"),
        ("<ul><li>x</li><li>y &lt;z&gt;</li></ul><!-- no --><form>Name <input></form>", "x\ny <z>"),
        ('<div class="ad">Buy</div><p>&#233;&#x1F642; end</p>', "é🙂 end"),
        ("<p>" + "long " * 30_000 + "</p>", ("long " * 30_000).strip()),
    ]
    rows = [(i, "http://h.example.com/a", page(i, b), "x", 0) for i, (b, _) in enumerate(bodies)]
    got = {r["page_id"]: r for r in html_text.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (_, want) in enumerate(bodies):
        assert got[i]["text"] == f"Title {i}\n{want}"
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_hard_rows(spark):
    rows = [(1, None, None, "x", 0), (None, "http://a/x", "", "x", 0), (3, "http://a/x", "plain", None, 0), (3, "http://a/x", "plain", None, 0), (4, "??", "<p>cut of", "x", 0), (5, "http://a/y", "<p", "x", 0)]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["page_id"] or 0, r["text"]) for r in html_text.main_texts(pages).collect())
    assert got[:4] == [(0, ""), (1, ""), (3, "plain"), (3, "plain")] and got[4] == (4, "cut of") and len(got) == 6
    assert html_text.main_texts(pages.where("false")).count() == 0


def test_query_against_articles_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in html_text.op8_html_extraction(spark, folder).collect()}
    assert got.keys() == pages.keys()
    squeezed = lambda s: re.sub(r"\s", "", html_lib.unescape(re.sub(r"<[^>]*>", "", s)))
    checked = 0
    for i, r in pages.items():
        found = re.fullmatch(r"(?s).*<article>(.*)</article>.*", r["html"] or "")
        if found and not re.search(r"(?i)<(?:script|style|form|aside|nav|header|footer|div|section|!--)|class=", found[1]):
            assert re.sub(r"\s", "", got[i]) == squeezed(found[1])
            checked += 1
    assert checked > 20


def test_texts_of_the_template_are_removed_whatever_their_names(spark):
    def made(i, extra=""):
        return (
            f"<html><body><div class='x1'><article><p class='q'>Read this next</p><h1>Title {i}</h1><p>Own words {i}</p>{extra}"
            f"<div class='y2'><ul><li>Home</li><li>Contact us</li></ul></div><p>All rights reserved</p></article></div></body></html>"
        )

    pages = [made(i, "<p>Read this next</p>" if i == 2 else "<p>Shared by two</p>" if i in (3, 4) else "") for i in range(8)]
    rows = [(i, "http://h.example.com/a", x, "x", 0) for i, x in enumerate(pages)] + [(10 + i, "http://copies.example.com/", made(0), "x", 0) for i in range(4)] + [(20, "http://one.example.com/", made(0), "x", 0)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(8):
        own = ["Read this next"] if i == 2 else ["Shared by two"] if i in (3, 4) else []  # the same words elsewhere on the page are another token
        assert got[i].split("\n") == [f"Title {i}", f"Own words {i}", *own]
    whole = "Read this next\nTitle 0\nOwn words 0\nHome\nContact us\nAll rights reserved"
    assert {got[i] for i in (10, 11, 12, 13, 20)} == {whole}


def test_names_of_wrappers_do_not_drop_what_they_hold(spark):
    wrappers = ['class="has-sidebar"', 'class="no-banner"', 'class="page-with-nav"', 'class="search-page"', 'id="ad-free"']
    article = lambda i: f"<article><h1>Title {i}</h1><p>Words {i} of its own, and more</p><div class='ad'>Buy {i}</div><div class='comments'><article>Reader {i}</article></div></article>"
    want = lambda i: f"Title {i}\nWords {i} of its own, and more"
    rows = []
    for k, w in enumerate(wrappers):
        rows += [(10 * k + i, f"http://h{k}.example.com/", f"<html><body><nav>Go</nav><div {w}>{article(10 * k + i)}</div></body></html>", "x", 0) for i in range(4)]
    # wrapped on few pages of a host, no article at all, and articles in a list that the names rightly drop
    rows += [(100 + i, "http://few.example.com/", f"<body><div {wrappers[0] if i == 0 else 'class=x'}>{article(100 + i)}</div></body>", "x", 0) for i in range(4)]
    rows += [(200 + i, "http://none.example.com/", f"<body><div class='has-sidebar'><div class='text'><p>Title {i}</p><p>Words {i} of its own, and more</p></div><div class='ad'>Buy {i}</div></div></body>", "x", 0) for i in range(4)]
    rows += [(300 + i, "http://list.example.com/", f"<body><article><h1>Title {i}</h1><p>Words {i} of its own, and more</p></article><div class='related'>" + f"<article>{'Teaser of another ' * 9}{i}</article>" * 3 + "</div></body>", "x", 0) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text in got.items():
        assert text == want(i if i < 200 else i % 100), i


def neutral(i, kind):
    """A page of one of two templates without telling tags or names; what stands beside the article is of its own on every page."""
    if kind == "a":
        return f"<html><body><div class='qa'><p>Menu of the day {i}</p></div><div class='qb'><div class='qc'><h1>Title {i}</h1><p>{f'Words {i} of its own. ' * 20}</p></div></div><div class='qd'><p>Beside {i}</p></div></body></html>"
    return f"<html><body><section class='ra'><div class='rb'><p>Aside {i}</p></div><div class='rc'><section class='rd'><h2>Head {i}</h2><p>{f'Other words {i}. ' * 30}</p></section></div></section><div class='re'><p>End {i}</p></div></body></html>"


def wanted(i, kind):
    return f"Title {i}\n{('Words %d of its own. ' % i * 20).strip()}" if kind == "a" else f"Head {i}\n{('Other words %d. ' % i * 30).strip()}"


def test_frames_decide_where_nothing_tells_the_article(spark):
    kinds = ["b" if i % 5 == 0 else "a" for i in range(40)]
    pages = [neutral(i, k) for i, k in enumerate(kinds)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame([(i, "http://two.example.com/", x, "x", 0) for i, x in enumerate(pages)], SCHEMA)).collect()}
    assert got == {i: wanted(i, k) for i, k in enumerate(kinds)}
    # the same with every token in a class of its own: no frame, so no slot, and what stands beside stays
    stats = {}
    for page in pages:
        for t in map(dict, (zip(html_text.NAMES_OF_TOKENS, t) for t in html_text.tokens(page))):
            kept = stats.setdefault(t["key"], t | {"n": 0, "held": 0, "pages": 0, "vector": t["key"]})
            kept["pages"] += 1
            kept["n"] += t["n"]
            kept["held"] += t["held"]
    template = html_text.deduce(list(stats.values()))
    assert template["slots"] == [] and all(html_text.extract(x, template) != wanted(i, kinds[i]) for i, x in enumerate(pages))


def plain_vectors(pages):
    """Occurrence vectors by counting every token on every page of a host."""
    counts = [{t[0]: t[3] for t in html_text.tokens(x)} for x in pages]
    return {k: tuple(c.get(k, 0) for c in counts) for k in set().union(*counts)}


def test_classes_equal_plain_vectors(spark):
    pages = [neutral(i, "b" if i % 3 == 0 else "a") for i in range(12)]
    table = spark.createDataFrame([(i, "http://two.example.com/", x, "two", 0) for i, x in enumerate(pages)], SCHEMA)
    rows = html_text.page_tokens(table.select("page_id", "html", "host")).collect()
    sums = {}
    for r in rows:
        sums[r["key"]] = sums.get(r["key"], 0) + (r["random"] % 2**64 >> 24) * r["n"]
    want = plain_vectors(pages)
    assert sums.keys() == want.keys()
    assert all((sums[a] == sums[b]) == (want[a] == want[b]) for a in want for b in want)


def test_deep_and_long_pages(spark):
    deep = lambda i: "<html><body>" + "".join(f"<div class='level{'x' * 40} c{k}'>" for k in "abcdefghijklmnopqrstuvwxyz" * 4) + f"<article><p>Deep {i}</p></article>" + "</div>" * 104 + "<nav>Go</nav></body></html>"
    rows = [(i, "http://deep.example.com/", deep(i), "x", 0) for i in range(4)] + [(9, "http://long.example.com/", "<article>" + "<p>word</p>" * 20_000 + "</article>", "x", 0)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Deep {i}" for i in range(4)} | {9: "\n".join(["word"] * 20_000)}


def test_large_sets_of_templates_are_joined_in_salted_parts(spark, monkeypatch):
    table = spark.createDataFrame([(i, f"http://h{i % 3}.example.com/", neutral(i, "a"), "x", 0) for i in range(12)] + [(None, "http://h1.example.com/", None, "x", 0)], SCHEMA)
    want = sorted((str(r["page_id"]), r["text"]) for r in html_text.main_texts(table).collect())
    monkeypatch.setattr(html_text, "BROADCAST", -1)
    assert sorted((str(r["page_id"]), r["text"]) for r in html_text.main_texts(table).collect()) == want


def body_and_teaser(i):
    """The article in a part without a telling name, beside a line that is tagged as one."""
    return f"<html><body><div class='m1'><p>Go {i}</p></div><article class='x9'><p>Teaser {i} of the day</p></article><div class='k3'><h1>Title {i}</h1><p>{f'Words {i} of its own. ' * 25}</p></div></body></html>"


def body_side_and_tail(i):
    """An article of three fifths of its page, between a side and a tail of texts that differ from page to page."""
    fill = lambda word, n: f"{word} {i:03d} " * n
    return f"<html><body><div class='w1'><div class='kc'><h1>Title {i:03d}</h1><p>{fill('body', 62)}</p></div><div class='kd'><p>{fill('side', 25)}</p></div></div><div class='ke'><p>{fill('tail', 13)}</p></div></body></html>"


def test_length_and_variation_decide_before_tags(spark):
    made = {"http://teaser.example.com/": body_and_teaser, "http://side.example.com/": body_side_and_tail}
    rows = [(20 * k + i, host, page(i), "x", 0) for k, (host, page) in enumerate(made.items()) for i in range(20)]
    # a part that is longer than the article, but says the same on every page
    legal = "All rights are reserved, and more of that kind. " * 20
    rows += [(40 + i, "http://legal.example.com/", f"<html><body><div class='ka'><p>Title {i}</p><p>{f'words {i} ' * 40}</p></div><div class='kb'><p>{legal}</p></div></body></html>", "x", 0) for i in range(20)]
    # a tag decides between parts of like length
    rows += [(60 + i, "http://tie.example.com/", f"<html><body><div class='ka'><p>{f'beside {i} ' * 20}</p></div><article><p>{f'inside {i} ' * 21}</p></article></body></html>", "x", 0) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(20):
        assert got[i] == f"Title {i}\n{(f'Words {i} of its own. ' * 25).strip()}"
        assert got[20 + i] == f"Title {i:03d}\n{(f'body {i:03d} ' * 62).strip()}"
        assert got[40 + i] == f"Title {i}\n{(f'words {i} ' * 40).strip()}"
        assert got[60 + i] == (f"inside {i} " * 21).strip()


def test_a_slot_with_texts_of_its_own_is_no_layout(spark):
    page = lambda i: f"<html><body><div class='ka'><h1>Title {i}</h1><p>{f'first {i} ' * 9}</p><div class='kb'><p>{f'then {i} ' * 60}</p></div></div><div class='kc'><p>Beside {i}</p></div></body></html>"
    rows = [(i, "http://own.example.com/", page(i), "x", 0) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Title {i}\n{(f'first {i} ' * 9).strip()}\n{(f'then {i} ' * 60).strip()}" for i in range(8)}
