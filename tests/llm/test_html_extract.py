import random

import numpy as np

from kbspark.llm import html_extract as h


def text(page):
    return h.main_text(h.page_blocks(page))


def test_zones():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
    <div id="cookie-notice">Cookies!</div><article><header><h1>Head &amp;  line</h1></header><p><b>First
    one<br>two<p>Second &lt;p&gt; &eacute;<div class="shareBar socialButtons">Share</div><form><p>Mail<input></form>
    <ul><li>x<li>y</ul><table><tr><td>1<td>2</table><aside>More</aside><section class="comments"><article>Great post</article></section></p></article>
    <footer>&copy; host</footer></body></html>"""
    assert text(page) == "Head & line\nFirst one two\nSecond <p> é\nx\ny\n1\n2"


def test_names_that_only_mention_what_is_no_text():
    for name in ("content no-sidebar", "has-sidebar", "post-body reply-count-3", "ad-free", "with-comments", "navless", "adventure", "loading"):
        assert text(f"<main><div class='{name}'><p>kept</div></main>") == text(f"<main class='sidebar'><p class='{name}'>kept</main>") == "kept"
    assert text("<main><section id='share-prices'>kept</section><h2 id='navigation-in-emacs'>a</h2><h3 id='cookies'>b</h3></main>") == "kept\na\nb"
    assert text("<body class='has-header ad'><article class='post sidebar-article hidden'>kept</article>") == "kept"


def test_names_of_what_is_no_text():
    for name in ("comment-list", "sidebar-left", "site-nav", "post-comments", "ad-banner", "shareBar", "ad ad-2", "x cookie-notice", "footer", "main_navigation"):
        assert text(f"<main><p>kept<div class='{name}'>out</div></main>") == text(f"<main><p>kept<div id='{name}'>out</div></main>") == "kept"
    assert text("<article>kept</article><article class='comment'>reader says</article><section class='comments'><article>more</article></section>") == "kept"
    assert text("<article>kept<article class='reply depth-2 comment-body'>reader</article></article>") == "kept"


def test_names_that_hint_are_asked_about():
    blocks = h.page_blocks("<article><p>own<div class='share-prices'>a</div><div class='related'>b</div></article>")
    assert [(z, t, a) for (z, t), a in zip(blocks, h.asks(blocks))] == [(h.MAIN, "own", False), (h.SUSPECT, "a", True), (h.SUSPECT, "b", True)]


def test_a_megabyte_of_unmatched_tags():
    import time

    for page in ("<b>" * 80_000 + "</i>" * 80_000, "<i><article>" + "<b>" * 80_000 + "</i>" * 80_000, "<div><b><p>" * 40_000 + "</td>" * 40_000, "<table><tr><td>" * 30_000 + "<li>" * 60_000, "<p>" + "<b>" * 80_000 + "<p>" * 80_000):
        began = time.time()
        assert h.page_blocks(page + "x")[-1][1] == "x" and time.time() - began < 5


def test_broken_markup():
    assert text(None) == text("") == text("<nav>only") == text("<script>x") == ""
    assert text("plain &amp; text") == "plain & text"
    assert text("<article>a < b <b title='x>y'>bold</b><p>c</article>after") == "a < b bold\nc"
    assert text("<article><p class='ad'>no<p>yes</div></article>") == "yes"
    assert text("<main><p>one</p><nav>n</main><p>late") == "one"
    assert text("<article>x" + "<div>" * 3000 + "deep") == "x\ndeep"


def test_suffix_ranks_against_all_runs():
    rnd = random.Random(3)
    for _ in range(30):
        pages = [[(1, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9)))) for _ in range(rnd.randrange(0, 9))] for _ in range(rnd.randrange(1, 6))]
        s = h.Streams(pages, np.array([i % 2 for i in range(len(pages))], dtype=np.uint64))
        page, begin, end = s.runs()
        said = {}
        words = [w for p in pages for _, t in p for w in t.split()]
        for p, a, b, c, d in zip(page, begin, end, s.classes(begin, end), s.hashes(begin, end)):
            run = (p % 2, *words[a:b])
            assert said.setdefault(("class", c), run) == run and said.setdefault(run, c) == c and said.setdefault(("hash", d), run) == run


def plain(pages):
    """The texts by comparing the runs of every page with those of every other one."""

    def runs(blocks):
        words = [t.split() for _, t in blocks]
        flat, ends = [w for b in words for w in b], np.cumsum([0, *map(len, words)]).tolist()
        out = [(k, k + h.LONG_RUN) for k in range(len(flat) - h.LONG_RUN + 1)]
        for a in ends[:-1]:
            b = next((e for e in ends if e - a >= h.RUN_TOKENS), None)
            out += [(a, b)] if b and b - a < h.LONG_RUN else []
        return flat, ends, out

    found = [(u.split("/")[2].lower(), h.page_blocks(t)) for _, u, t in pages]
    has = [{tuple(flat[a:b]) for a, b in out} for _, blocks in found for flat, ends, out in [runs(blocks)]]
    texts = []
    for i, (host, blocks) in enumerate(found):
        flat, ends, out = runs(blocks)
        other = set().union(*[has[j] for j in range(len(found)) if j != i and found[j][0] == host and found[j][1] != blocks])
        covered = np.zeros(len(flat), bool)
        for a, b in out:
            if tuple(flat[a:b]) in other:
                covered[a:b] = True
        kept = []
        for k, ((zone, text), asked) in enumerate(zip(blocks, h.asks(blocks))):
            own = h.long_runs(covered[ends[k] : ends[k + 1]], h.LONG_RUN)
            kept.append((zone, " ".join(w for w, c in zip(flat[ends[k] : ends[k + 1]], own) if not c) if asked else text))
        texts.append(h.main_text([x for x in kept if x[1]]))
    return texts


def test_against_all_pairs_of_pages(spark, monkeypatch):
    rnd = random.Random(9)
    parts = [" ".join(f"b{k}{w}" for w in range(rnd.randrange(1, 24))) for k in range(12)]
    pages = []
    for i in range(60):
        body = "".join(f"<p>{rnd.choice(parts)}{rnd.choice(['', f' own {i}'])}" for _ in range(3)) + f"<p>" + " ".join(f"u{i}x{k}" for k in range(120))
        if i % 3 == 0:
            body = f"<article>{body}<div class='related'>{rnd.choice(parts)}</div><div class='tags'>only{i} here{i}</div></article>{rnd.choice(parts)}"
        pages.append((i, f"http://{'a' if i < 50 else 'b'}.example/{i}", body))
    want = plain(pages)
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    for chars in (2_000_000, 3_000):
        monkeypatch.setattr(h, "GROUP_CHARS", chars)
        got = {r.page_id: r.text for r in h.extract(df).collect()}
        assert [got[i] for i in range(60)] == want
    assert sum(t != h.main_text(h.page_blocks(p[2])) for t, p in zip(want, pages)) > 40


def test_hosts_without_marked_articles(spark):
    chrome = "<div>Welcome to the best site of all</div>"
    bottom = "<div>All rights are reserved by nobody at all</div>"
    own = {i: f"<div>story {i} tells of {i * 7} things and nothing else {i}</div>" for i in range(6)}
    rows = [(i, f"http://a.example/{i}", f"<body>{chrome}{own[i]}{bottom}</body>", None) for i in range(5)]
    rows += [(5, "https://B.example/x", f"<body>{chrome}{own[5]}</body>", "t"), (6, "http://a.example/m", f"<nav>{'x ' * 9}</nav><article>{chrome}</article>", "t")]
    rows += [(7, None, None, None), (7, None, None, None), (8, "http://a.example/e", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted((r.page_id, r.text) for r in h.extract(df).collect())
    strip = lambda s: s.replace("<div>", "").replace("</div>", "")
    want = [(i, strip(own[i])) for i in range(5)] + [(5, strip(chrome) + "\n" + strip(own[5])), (6, strip(chrome)), (7, ""), (7, ""), (8, "")]
    assert out == want
    assert h.extract(df.limit(0)).count() == 0


def test_a_run_on_two_pages_of_a_large_host(spark, monkeypatch):
    monkeypatch.setattr(h, "GROUP_CHARS", 20_000)
    notice = "<p>this notice stands on just two pages of the host and nowhere else at all in it"
    rows = [(i, f"http://a.example/{i}", f"<p>page {i} has {i} own words {i}{notice if i in (3, 571) else ''}") for i in range(900)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    for parts in (1, 7):
        out = {r.page_id: r.text for r in h.extract(df.repartition(parts, "page_id")).collect()}
        assert out == {i: f"page {i} has {i} own words {i}" for i in range(900)}


def test_suspects_inside_articles(spark):
    box = "<div class='related'>Get our letter every week for free and unsubscribe whenever you want to do so</div>"
    story = {i: " ".join(f"w{i}x{k}" for k in range(40)) for i in range(4)}
    line = "<p>the same line of the article itself which other articles have too and which stays"
    rows = [(i, f"http://a.example/{i}", f"<article><p>{story[i]}{line}</p>{box if i < 2 else ''}<p class='metadata'>by {i}</article>") for i in range(4)]
    rows += [(9, "http://a.example/copy", f"<article><p>{story[3]}</p></article>"), (8, "http://b.example/", f"<article>{box}</article>")]
    out = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert out == {i: f"{story[i]}\n{line[3:]}\nby {i}" for i in range(4)} | {9: story[3], 8: box[21:-6]}


def test_a_very_long_page(spark):
    long = " ".join(f"w{k}" for k in range(400_000))
    rows = [(i, "http://a.example/x", f"<body><div>{long} {i}</div>") for i in range(2)] + [(2, None, None), (2, None, "")]
    out = sorted((r.page_id, len(r.text)) for r in h.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect())
    assert out == [(0, len(long) + 2), (1, len(long) + 2), (2, 0), (2, 0)]


def test_copies_and_phrases_without_articles(spark):
    story = {i: " ".join(f"w{i}x{k}" for k in range(60)) for i in range(5)}
    near = " ".join("changed" if k == 30 else w for k, w in enumerate(story[1].split()))
    phrase = "at the end of the day"
    chrome = "<div>Welcome to the best site of all</div>"
    partly = {i: f"{story[i]} {phrase} {story[i][::-1]}" for i in (2, 3)}
    advert = " ".join(f"buy{k}" for k in range(20))
    texts = {0: story[0], 1: story[0], 2: story[1], 3: near, 4: partly[2], 5: partly[3], 6: f"{advert} a few unique words of its own", 7: f"some other words of this page {advert}"}
    rows = [(i, f"http://a.example/{i}", f"{chrome}<p>{t}") for i, t in texts.items()]
    out = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert out == texts | {6: "a few unique words of its own", 7: "some other words of this page"}


def test_extreme_keys_of_runs():
    rnd = random.Random(4)
    for _ in range(50):
        rows = [(rnd.randrange(6), rnd.randrange(7)) for _ in range(rnd.randrange(1, 30))]
        place, which, known = h.extremes(*np.array(rows, dtype=np.int64).T)
        for (run, _), w in zip(rows, which):
            keys = sorted({k for r, k in rows if r == run})
            assert rows[place[w]][0] == run and known[:, w].tolist() == [keys[0], keys[min(1, len(keys) - 1)], keys[max(len(keys) - 2, 0)], keys[-1]]


def test_copies_on_a_host_of_any_size(spark, monkeypatch):
    rnd = random.Random(5)
    words = lambda name, many: [f"{name}x{k}" for k in range(many)]
    pages, kept = [], {}
    for n in range(30):
        story, box = words(f"s{n}", rnd.randrange(150, 250)), " ".join(words(f"b{n % 20}", 20))
        near = story[:-9] + [f"changed{n}"] + story[-8:]
        for i, w in ((2 * n, story), (2 * n + 1, near)):
            tag = "article" if n % 3 else "div"
            pages.append((i, "http://a.example/x", f"<nav>{box}</nav><{tag}><p>{' '.join(w)}</p><div class='related'>{box}</div></{tag}>"))
            # boxes 0 to 9 are on pages of another story too; on others only the near copy has it, which leaves the page whole
            if 10 <= n < 20:
                kept[i] = " ".join(w) + "\n" + box
            elif n % 3:
                kept[i] = " ".join(w)
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    seen = []
    for chars in (2_000_000, 60_000, 20_000, 2_000):
        monkeypatch.setattr(h, "GROUP_CHARS", chars)
        seen.append({r.page_id: r.text for r in h.extract(df).collect()})
        assert {i: seen[-1][i] for i in kept} == kept and seen[-1] == seen[0]


def test_a_very_long_page_that_holds_another(spark, monkeypatch):
    part = " ".join(f"w{k % 997}y{k % 31}" for k in range(480_000))
    rows = [(0, "http://a.example/", f"<div>{part}</div><p>its own words"), (1, "http://a.example/", f"<div>{part} {part[::-1]}")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    for chars in (2_000_000, 200_000_000):
        monkeypatch.setattr(h, "GROUP_CHARS", chars)
        assert {r.page_id: r.text for r in h.extract(df).collect()} == {0: "its own words", 1: part[::-1]}
