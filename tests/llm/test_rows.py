"""Sharding, quality rules, URL lists and page text."""

import re
import time
import zlib
from collections import Counter

import duckdb
import pytest
from cases import SCHEMA, frame, rows

from seepage.llm import html_extract, quality_rules, queries, sharding, url_filter
from seepage.llm.url_filter import Rule


def test_lpt_takes_the_largest_first():
    assert sharding.lpt([("a", 3), ("b", 5), ("c", 4), ("d", 1)], 2) == {"b": 0, "c": 1, "a": 1, "d": 0}


@pytest.mark.parametrize("resolution", [1024, 1])
def test_shards_are_level_whole_and_gapless(spark, resolution):
    got = sharding.shard_documents(frame(spark), shards=4, resolution=resolution).collect()
    data = rows()
    assert Counter(r.doc_id for r in got) == Counter(d[0] for d in data)
    assert sum(r["size"] for r in got) == sum(len((d[1] or "").encode()) + 1 for d in data)
    text_of = {d[0]: d[1] for d in data if d[0] is not None}
    where = {}
    for r in got:
        if r.doc_id is not None:
            assert where.setdefault(text_of[r.doc_id], r.shard) == r.shard
            assert (r.text_crc32 is None) == (text_of[r.doc_id] is None)
    for shard in range(4):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    if resolution > 1:
        loads = [sum(r["size"] for r in got if r.shard == s) for s in range(4)]
        largest = max(len((d[1] or "").encode()) for d in data) + 1
        assert max(loads) - min(loads) <= max(largest, sum(loads) // 8)


def test_large_groups_go_where_a_plain_heap_puts_them(spark):
    data = rows(n=200)
    got = sharding.shard_documents(frame(spark, data), shards=4).collect()
    assert all(r.text_crc32 == (None if (t := texts[0]) is None else zlib.crc32(t.encode())) for r in got if len(texts := [d[1] for d in data if d[0] == r.doc_id and d[0] is not None]) == 1)
    # with a bundle for each group at most, loads are those of the plain rule
    sizes = Counter()
    for d in data:
        sizes[d[1]] += len((d[1] or "").encode()) + 1
    loads = [0] * 4
    for size in sorted(sizes.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    ours = Counter()
    for r in got:
        ours[r.shard] += r["size"]
    assert max(ours.values()) <= 4 / 3 * max(loads) and sum(ours.values()) == sum(loads)


def test_sharding_an_empty_table(spark):
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_plain_ones(spark):
    extra = ["a b c d e f g a b c d e x y a b c d e", "a a a a a a a a", "# x | y\n# x | y\n\n \n# x | y", "one two three four five six seven eight nine ten"]
    data = rows() + [(1000 + i, t, "en", "s", 1, *[None] * 7) for i, t in enumerate(extra)]
    got = quality_rules.quality_rules(frame(spark, data)).select("text", "quality.*").collect()
    assert len(got) == len(data)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text), r.text
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_verdicts_and_columns(spark):
    good = "The house of the people is on the hill and the road to it was long for all."
    symbols = " ".join(w + "###" for w in good.split())
    data = [(1, good, "en", "s", 1, *[None] * 7), (2, symbols, "en", "s", 1, *[None] * 7), (3, None, "en", "s", 1, *[None] * 7)]
    out = quality_rules.quality_rules(frame(spark, data))
    assert {r.doc_id: r.quality.kept for r in out.collect()} == {1: True, 2: False, 3: False}
    assert out.columns[:-1] == [f.split()[0] for f in SCHEMA.split(", ")]


def test_urls(spark):
    urls = [
        "http://a.com", "http://a.com/x", "HTTP://WWW.Example.COM/en/1", "http://b.example.com/en/", "http://b.example.com/english",
        "https://x.net/es/?a=b#c", "x.net/es/", None, "", "a://b://c.com/d", "http://com/", "http://.com/", "http://a.com./", "ftp://e.net/fr/\nq", "http://a.com:80/",
    ]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, queries.URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].lower(), found[2]) if found else ("", "")
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path) == (host, path)
        assert (got[i].rule, got[i].verdict) == ((best.name, best.verdict) if best else (None, "allow")), url
    assert url_filter.filter_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_trie_prefers_host_then_path():
    trie = url_filter.build_trie([Rule("allow", "a.b", "/x/long/path"), Rule("block", "c.a.b", "/"), Rule("allow", "a.b", "/x"), Rule("block", "a.b", "/x/l")])
    assert url_filter.longest_match(trie, "c.a.b", "/x/long/path").host == "c.a.b"
    assert url_filter.longest_match(trie, "d.a.b", "/x/lo").path == "/x/l"
    assert url_filter.longest_match(trie, "d.a.b", "/xy").path == "/x"
    assert url_filter.longest_match(trie, "d.a.b", "/y") is None


def test_url_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(map(repr, con.execute(queries.ORACLES["op6_url_trie"]).fetchall()))
    got = queries.QUERIES["op6_url_trie"](spark, sf).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def page(body, cls="post"):
    return (
        f'<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href="/">Menu</a></nav><div class="ad-box">Buy</div>'
        f'<div class="{cls}">{body}</div><div class="comments"><p>I said {"so " * 300}</p></div><footer>&copy; 2020</footer><script>x="</div>"</script>'
    )


def test_main_text(spark):
    long = "<p>Tom &amp; <b>Ann</b><br>went\n home&nbsp;.</p>" * 4
    text = " ".join(["Tom & Ann went home ."] * 4)
    data = [
        (1, "http://h.org/1", page("<h1>Title</h1>" + long, "post post-1")),
        (2, "http://h.org/2", page("<h1>Other</h1>" + long, "post post-22")),
        (3, "http://h.org/3", page("<p>Hi", "post post-3")),  # short: only the host's path tells it apart
        (4, None, None),
        (5, "http://x.org", ""),
        (6, "http://x.org", "<div>a<span>b</span> c<p>x &lt; y<li>q<!-- z"),
        (7, "http://x.org", "plain <"),
        (8, "http://y.org", "<nav>only menu</nav><form>f</form>"),
        (None, "http://y.org", "<main><header><h1>H</h1></header><p>t</p></main>"),
        (1, "http://h.org/1", page("<h1>Title</h1>" + long, "post post-1")),
        (9, "http://z.org", "<p" + " a" * 100_000 + "<" * 1000 + "<p>" + "word " * 100_000),
    ]
    df = spark.createDataFrame([(*d, "t", "h") for d in data], "page_id bigint, url string, html string, text string, host string")
    got = html_extract.extract(df).collect()
    assert len(got) == len(data)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == "Title " + text and by_id[2] == "Other " + text
    assert by_id[3] == "Hi" and by_id[4] == "" and by_id[5] == ""
    assert by_id[6] == "ab c x < y q" and by_id[7] == "plain <" and by_id[8] == "" and by_id[None] == "H t"
    assert by_id[9].endswith("word word")
    assert html_extract.extract(df.limit(0)).count() == 0


ARTICLE = "<h1>Title</h1>" + "<p>One long sentence of the article, and another one.</p>" * 3
TOLD = "Title " + " ".join(["One long sentence of the article, and another one."] * 3)


@pytest.mark.parametrize(
    "layout",
    [
        '<div class="page has-sidebar"><article>{}</article></div>',
        '<div class="with-header"><main>{}</main></div>',
        '<div class="elementor-widget-container">{}</div>',
        '<div class="post no-comments">{}</div>',
        '<div class="site comments-open"><div class="text">{}</div></div>',
        "<form id='aspnetForm'><div>{}</div></form>",
        '<svg class="icon"/><div>{}</div>',
        '<div id="search-results"><div>{}</div></div>',
        '<div class="promo-wrapper"><article>{}</article><div class="ad">Buy now</div></div>',
        '<div class="banner"><div class="sidebar-layout">{}</div></div>',
    ],
)
@pytest.mark.parametrize("around", ["{}", '<nav>Menu</nav>{}<div class="comments"><p>I said so</p><p>so too</p></div><footer>Foot</footer>'])
def test_layout_names_are_no_veto(layout, around):
    page_ = f"<html><body>{around.format(layout.format(ARTICLE))}</body></html>"
    assert html_extract.main_text(page_, []) == TOLD


def test_marked_parts_stay_outside():
    for aside in (
        '<div class="widget"><p>w</p><p>w</p></div>',
        "<form><div><p>Mail</p><p>Name</p></div></form>",
        '<div id="comments"><article class="comment"><p>so</p><p>so</p></article></div>',
        '<aside><article><p>tease</p><p>tease</p></article></aside>',
        '<div class="related-posts"><article><p>more</p></article></div>',
        '<div class="site-header">Site</div>',
    ):
        assert html_extract.main_text(f"<body>{aside}<div class='text'>{ARTICLE}</div>{aside}</body>", ["/body/div.text"]) == TOLD
    assert html_extract.main_text('<body><div class="ad">Buy</div><div class="text"></div></body>', []) == ""


def test_deep_pages_keep_their_paths_apart():
    deep = "<div>" * 200
    page_ = f'{deep}<div class="text">{ARTICLE}</div>' + "</div>" * 100 + '<div class="rest"><p>side</p></div>'
    elements, blocks = html_extract.parse(page_)
    assert len({e.path for e in elements}) == len(elements) - 2  # three paragraphs share theirs
    path = elements[elements[blocks[0].element].parent].path
    assert html_extract.main_text(page_, [path]) == TOLD


def test_hosts_beyond_a_broadcast(spark, monkeypatch):
    shape = "page_id bigint, url string, html string"
    data = [(i, f"http://h{i % 3}.org/{i}", page(f"<p>Text {i} of the page.</p>", f"post c{i % 3}")) for i in range(30)] + [(99, None, "<p>no host</p>")]
    df = spark.createDataFrame(data, shape)
    want = sorted(map(tuple, html_extract.extract(df).collect()))
    monkeypatch.setattr(html_extract, "WINNER_ROWS", -1)
    assert sorted(map(tuple, html_extract.extract(df).collect())) == want
    assert want[0][2] == "Text 0 of the page."


def test_tags_longer_than_any_bound():
    payload = "A" * 70_000
    outer = f'<div class="post"><p>one</p><img src="data:{payload}>"><div data-x=\'{payload}>\'>two</div><p>three</p></div>'
    assert html_extract.main_text(outer, ["/div.post"]) == "one two three"
    assert html_extract.main_text("<p " + "a=1 " * 20_000 + 'b="x>y">t', []) == "t"


@pytest.mark.parametrize("piece", ["<p ", '<a "', "<!x", '<p a="', '<a b="c" ', '<a ">" ', "<a '\">\" '"])
def test_broken_tags_take_linear_time(piece):
    start = time.time()
    html_extract.parse(piece * 50_000)
    html_extract.parse(piece * 50_000 + ">")
    assert time.time() - start < 10


def test_pages_of_the_tables(spark):
    got = queries.QUERIES["op3_consensus_paths"](spark, "/root/testdata/sf0.001").collect()
    html = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(got) == len(html)
    for r in got:
        article = re.search(r"(?s)<article>(.*?)</article>", html[r.page_id])[1]
        plain = " ".join(re.sub(r"<[^>]*>", " ", article).replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">").split())
        assert r.text.replace(" ", "") == plain.replace(" ", "") and r.n_chars == len(r.text)
