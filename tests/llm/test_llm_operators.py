"""The training-data operators against brute force, round trips and held-out labels, with nulls, empties, ties and repeats."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import common, components, fuzzy_hash, html_text, jaccard_join, media_chunks, mixing, packing, quality, sharding, tool_calls, url_filter

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, copies long, hash long, key string"
#: Columns beyond the table's own, with names that the operators use themselves.
EXTRA = ("s", 1, 2, "k")


def rows_of(docs):
    return [(i, t, lang, src, None if t is None else len(t), *EXTRA) for i, t, lang, src in docs]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice(("th", "er", "on", "an", "re", "he")) for _ in range(rng.randint(1, 4))) for _ in range(600)]


@pytest.fixture(scope="module")
def docs(spark, words):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    out = [(i, text(rng.choice((1, 3, 20, 60, 200))), "en", f"s{i % 5}") for i in range(150)]
    out += [(200 + i, base, "en", "s0") for i in range(60)]  # copies
    for i in range(90):  # near copies
        w = base.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((300 + i, " ".join(w), "de", "s0"))
    out += [(500, None, None, None), (501, "", "en", None), (502, "", "en", "s1"), (503, "x" * 90_000, "en", "s2"), (504, text(30_000), "fr", "s2"), (None, "no id " + text(9), "en", "s3")]
    out += [(506, "\xa0 \u2003", "en", "s1")]
    out += [out[0], out[0], (505, "één\t “ﬁne” <|endoftext|> it's 12\n\n", "fr", "s1")]
    return spark.createDataFrame(rows_of(out), DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def local(df):
    return [r.asDict() for r in df.collect()]


def test_mixing(docs, empty):
    got = local(mixing.mix_sources(docs))
    assert len(got) == docs.count() and got[0]["hash"] == 2
    size, total = {}, defaultdict(int)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        total[r["source"]] += r["size"]
        size[r["source"]] = r["source_size"]
    assert size == dict(total)
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    want, open_, left = {}, set(order), sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * total[s]]
        for s in full or list(open_):
            want[s] = 3.0 * total[s] if full else level * weight[s]
            left -= want[s]
            open_.discard(s)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= max(2, 0.02 * want[s])
    again = {(r["doc_id"], r["text"]): r["taken"] for r in local(mixing.mix_sources(docs)) if r["doc_id"] != 0}
    assert all(again[r["doc_id"], r["text"]] == r["taken"] for r in got if r["doc_id"] != 0)
    assert mixing.mix_sources(empty).count() == 0
    odd = docs.withColumnRenamed("hash", "a.b").limit(50)
    staged = mixing.mixing_stage(docs.sparkSession, odd, DATA)
    assert staged.columns == odd.columns and {r["copies"] for r in local(staged)} == {1} and {r["size"] for r in local(staged)} == {"s"}


def test_mixing_of_many_sources(spark):
    """More sources than a range of the running sums holds, of few different sizes."""
    sizes = [i % 7 for i in range(4500)]
    docs = spark.createDataFrame([(i, "w " * n, f"{i:05}") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    lo, hi = 0.0, 1e9
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(3 * n, level * (i % 3 + 1)) for i, n in enumerate(sizes)) < sum(sizes) else (lo, level)
    for r in local(mixing.mix_sources(docs)):
        assert r["size"] == sizes[r["doc_id"]] and r["target"] == pytest.approx(min(3 * r["size"], hi * (r["doc_id"] % 3 + 1)))
        assert abs(r["taken"] - r["target"]) <= max(1, r["size"])


def test_fit_budget_is_a_subset_sum():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 60, 8))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 1))
        take = mixing.fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        sums = {0}
        for x, n in zip(lengths, counts, strict=True):
            sums = {s + k * int(x) for s in sums for k in range(n + 1)}
        assert abs(int((take * lengths).sum()) - budget) <= 2 + min(abs(s - budget) for s in sums)


def test_sharding(spark, docs, empty):
    got = local(sharding.kd_shards(docs, 5))
    texts = {(r["doc_id"]): r["text"] or "" for r in local(docs)}
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data)
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    even = spark.createDataFrame(rows_of([(i, "w" * (50 + i % 97), "en", "s") for i in range(4000)] + [(9000 + i, "copy" * 30, "en", "s") for i in range(2000)]), DOC)
    sizes = Counter()
    for r in local(sharding.kd_shards(even, 40)):
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(sizes.values()) < 1.01 * mean and min(sizes.values()) > 0.99 * mean
    assert sharding.kd_shards(empty, 40).count() == 0


def test_shards_are_even_beside_large_documents(spark):
    """At sf0.01 the largest document is half a shard."""
    sizes = Counter()
    for r in sharding.op3_kd_tree_shards(spark, "/root/testdata/sf0.01").collect():
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and 0.97 * mean < min(sizes.values()) <= max(sizes.values()) < 1.03 * mean


def test_kd_leaves_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    rng = random.Random(4)
    top = sharding.KEY_BITS - sharding.COORD_BITS
    rows = [(i, rng.randint(16, 400), *[(rng.randint(0, 60) * wide << top) + rng.getrandbits(top) for wide in (900, 500)]) for i in range(700)]
    rows += [(700 + i, 50, (7 << top) + 5, (9 << top) + 5) for i in range(200)]  # one point
    points = spark.createDataFrame(rows, "i long, w long, x long, y long").cache()
    got = {r["i"]: r["leaf"] for r in points.select("i", sharding.kd_leaves(points, ["x", "y"], "w", 7).alias("leaf")).collect()}
    total, want = sum(r[1] for r in rows), {}

    def split(node, first, leaves, before):
        if leaves == 1:
            want.update({r[0]: first for r in node})
            return
        wide = [max(r[2 + d] >> sharding.KEY_BITS - sharding.RADIX[0] for r in node) - min(r[2 + d] >> sharding.KEY_BITS - sharding.RADIX[0] for r in node) for d in (0, 1)]
        d = 2 + wide.index(max(wide))
        goal, held, cut = total * (first + leaves // 2) // 7 - before, 0, 1 << 60
        for key in sorted({r[d] for r in node}):
            w = sum(r[1] for r in node if r[d] == key)
            if held + w > goal:
                cut = key if goal - held < held + w - goal else key + 1
                break
            held += w
        left, right = [r for r in node if r[d] < cut], [r for r in node if r[d] >= cut]
        split(left, first, leaves // 2, before)
        split(right, first + leaves // 2, leaves - leaves // 2, before + sum(r[1] for r in left))

    split(rows, 0, 7, 0)
    assert got == want


def test_exchanges_level_the_leaves():
    rng = random.Random(2)
    free = [[rng.randint(1, 100) for _ in range(30)] for _ in range(12)]
    held = [sum(f) + rng.randint(3000, 3800) for f in free]
    moved = sharding.exchanges(held, free)
    now = list(held)
    for (k, i), to in moved.items():
        now[k], now[to] = now[k] - free[k][i], now[to] + free[k][i]
    goal = sum(held) / 12
    assert max(abs(x - goal) for x in held) > 0.05 * goal and max(abs(x - goal) for x in now) < 0.005 * goal


def test_url_filter(spark):
    urls = ["https://" + "a." * 30_000 + "com/en/" + "x" * 60_000, "h" * 90_000, "https://a.com/en/1", "http://example.com/en/72", "HTTP://X.Example.COM:80/en/7?q", "http://net/de/", "http://www.example.net/de/8#x", "ftp://q.org/es/", "http://notcom/en/1", "http://com/en", "x", None, "http://", "://a.com/en/", "http://a.net/de/8", "http://a.b.example.net/de/81"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string, keys string")
    parted = local(url_filter.filter_urls(pages, literal_bits=64, part_keys=1))
    key = lambda r: str(sorted(r.items()))
    assert sorted(map(key, parted)) == sorted(map(key, local(url_filter.filter_urls(pages))))
    for r in parted:
        u = ([*urls, urls[0]])[r["page_id"]] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[1], best[2])
    assert url_filter.filter_urls(pages.limit(0)).count() == 0 and url_filter.filter_urls(pages.limit(0), literal_bits=64).count() == 0


def test_bloom_cascade_of_a_million_keys(spark, tmp_path):
    spark.range(2_500_000).selectExpr("concat('k', id) as key", "id % 5 < 2 as listed").write.parquet(str(tmp_path / "u"))
    universe = spark.read.parquet(str(tmp_path / "u"))
    cascade = url_filter.build_cascade(universe)
    assert isinstance(cascade, url_filter.PartedCascade) and cascade.parts == 5
    assert cascade.mark(universe, "m").where("m <> listed").count() == 0


def test_bloom_cascade_is_exact(spark):
    universe = spark.range(3000).selectExpr("cast(id as string) as key", "id % 7 = 0 as listed").cache()
    cascade = url_filter.build_cascade(universe)
    assert len(cascade.levels) >= 1
    from pyspark.sql import functions as F

    assert universe.where(cascade.member(F.col("key")) != F.col("listed")).count() == 0
    parted = url_filter.build_cascade(universe, literal_bits=64, part_keys=100)
    assert parted.parts == 5 and parted.mark(universe, "m").where("m <> listed").count() == 0
    assert url_filter.build_cascade(universe.where("not listed")).levels == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><a href=/>Home</a></header><nav><ul><li>Menu</nav>
<div class="cookie-notice">We use cookies</div><div id="side" class="sidebar"><p>Side text. With marks, many of them, in a long line.</p></div><div class="ad">Buy</div>
{open}<h1>Title &amp; more</h1><p>First   <b>bold</b>\ntext &eacute;&#33;<br>next.</p><form><input value=x>Send</form><p>Second paragraph, with marks; and more words to read than any menu has.</p>{close}
<section id="comments"><p>Nice article, thanks.</p></section><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("frame", [("<article>", "</article>"), ("<main>", "</main>"), ('<div id="x">', "</div>")])
def test_html(frame):
    got = html_text.extract_main_text(PAGE.replace("{open}", frame[0]).replace("{close}", frame[1]))
    body = "First bold text é! next. Second paragraph, with marks; and more words to read than any menu has."
    assert got.endswith(body) and "cookies" not in got and "Side" not in got and "Menu" not in got and "Nice" not in got and "Buy" not in got
    if "div" not in frame[0]:
        assert got == "Title & more " + body


PROSE = "<p>" + "The first sentence of a paragraph has words, marks, and more words; it reads on, as prose does. " * 4 + "</p>"
SAID = PROSE[3:-4].strip()


@pytest.mark.parametrize("tag", ["article", "main"])
def test_html_scores_framed_pages(tag):
    menu = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul>"
    page = f"<body><{tag}><h1>Title</h1>{menu}{PROSE}<div>Buy shoes now</div><pre>x = 1</pre>{PROSE}<h3>Related</h3>{menu}<div><p>Nice post</p></div></{tag}></body>"
    assert html_text.extract_main_text(page) == f"Title {SAID} x = 1 {SAID}"
    whole = f"<body><{tag}><header><h1>Title</h1><div>By me</div></header><h2>Points</h2><ul><li>one<li>two</ul>{PROSE}<div><pre>y = 2</pre></div><table><caption>Cap</caption><tr><td>1<td>2</table></{tag}></body>"
    assert html_text.extract_main_text(whole) == f"Title By me Points one two {SAID} y = 2 Cap 1 2"


def test_html_keeps_short_blocks_without_a_frame():
    div = ('<div id="x">', "</div>")
    body = "First bold text é! next. Second paragraph, with marks; and more words to read than any menu has."
    assert html_text.extract_main_text(PAGE.replace("{open}", div[0]).replace("{close}", div[1])) == "Title & more " + body
    side = "<div><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></div>"
    parts = f"<h1>A title of about forty characters, say</h1>{PROSE * 3}<h2>Points</h2><ul><li>short one<li>short two</ul>{PROSE * 3}<table><caption>Cap</caption><tr><td>1<td>two</table>"
    want = f"A title of about forty characters, say {SAID} {SAID} {SAID} Points short one short two {SAID} {SAID} {SAID} Cap 1 two"
    assert html_text.extract_main_text(f"<body>{side}<div>{parts}</div><div>Imprint</div></body>") == want
    assert html_text.extract_main_text(f"<body><div>{side}<h1>Title</h1><div>{PROSE}</div><div>Imprint</div></div></body>") == f"Title {SAID}"


def test_html_weighs_names_against_text():
    side, want = '<div class="sidebar"><p>Side text, with marks.</p></div>', f"Title {SAID}"
    for tag in ("article", "main", "div"):
        inner = f"<{tag}><h1>Title</h1>{PROSE}</{tag}>"
        for wrap in ('div class="content-sidebar-wrap"', 'div class="layout has-sidebar"', 'div id="search-page"', 'section class="share-story"', "form id=aspnetForm", 'div class="discussion-page"'):
            page = f"<body><nav><a href=1>Home</a></nav><{wrap}>{inner}{side}</{wrap.split()[0]}><footer>Imprint, and so on.</footer></body>"
            assert html_text.extract_main_text(page) == want, page
            assert html_text.extract_main_text(f'<body><div class="has-menu">{page[6:]}</div>') == want
    for said in (f"<div id=comments>{PROSE * 6}</div>", f"<section class=comments><article>{PROSE * 6}</article></section>"):
        for tag in ("article", "div"):
            assert html_text.extract_main_text(f"<body><div id=search-page><{tag}><h1>Title</h1>{PROSE}</{tag}></div>{said}") == want
    cards = "<aside><article><p>A card, and its text.</p></article></aside>"
    assert html_text.extract_main_text(f"<body><div><h1>Title</h1>{PROSE}</div>{cards}") == want


def test_html_raw_elements_end_where_they_do():
    for i in ("\u0130", "\u0130" * 40):
        for end in ("</script>", "</SCRIPT >"):
            page = f"<body><title>{i}</title><p>{i}</p><script>x{end}<article>text</article></body>"
            assert html_text.extract_main_text(page) == "text"


@pytest.mark.parametrize("frame", [False, True])
def test_html_ratios_need_no_frame_and_no_names(spark, frame):
    """Without article elements and with meaningless class names the pages give the same text, by the ratios of their paths."""
    rng, same, counted = random.Random(1), 0, []
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in pages:
        page = r["html"] if frame else re.sub(r"<(/?)(article|main)\b", r"<\1div", r["html"])
        page = re.sub(r'\b(class|id|role)="[^"]*"', lambda m: f'{m[1]}="c{rng.randint(0, 99999)}"', page)
        want, got = html_text.extract_main_text(r["html"]), html_text.extract_main_text(page)
        same += got == want
        counted.append(sum((Counter(want.split()) & Counter(got.split())).values()) / max(1, len(want.split())))
    assert same >= 0.98 * len(pages) and min(counted) >= 0.99


def test_path_ratios_against_brute_force():
    """Every page is scored: which blocks are content, against the formula written out."""
    page = html_text.read_page(f"<body><div>Buy, now, and here.</div><div><h1>Title</h1>{PROSE}<p>Short.</p>{PROSE}</div><ul><li>x</ul></body>")
    blocks = [[e, t, len(t.strip()), 0] for e, t, _ in page.nodes]
    per = defaultdict(list)
    for e, t, size, _ in blocks:
        per[page.path[e]].append((size, len(re.findall(r"[.,;:!?]", t))))
    fused = {k: sum(x for x, _ in v) / len(v) * (1 + sum(y for _, y in v) / len(v)) for k, v in per.items()}
    fused[page.path[blocks[0][0]]] /= 2  # bare text of a container
    own = [fused[page.path[b[0]]] for b in blocks]
    weight = [np.exp(-(d * d) / 2) for d in (-2, -1, 0, 1, 2)]
    smooth = defaultdict(float)
    for j, b in enumerate(blocks):
        near = [(own[j + d], w) for d, w in zip((-2, -1, 0, 1, 2), weight, strict=True) if 0 <= j + d < len(own)]
        smooth[page.path[b[0]]] = max(smooth[page.path[b[0]]], sum(v * w for v, w in near) / sum(w for _, w in near))
    size = {k: sum(x for x, _ in v) for k, v in per.items()}
    bar = 0.5 * sum(min(fused[k], 400) * size[k] for k in fused) / sum(size.values())
    want = [smooth[page.path[b[0]]] >= bar and o >= bar / 2 for b, o in zip(blocks, own, strict=True)]
    want[0] = False  # outside the paragraphs' container
    assert html_text._core(page, blocks, [False] * len(page.tag)) == want and sum(want) == 3


BIG = [(1 << 53) + 1, (1 << 53) + 3, None]


def test_ids_beyond_floats(spark):
    """Ids that a float cannot hold, beside a null."""
    docs = spark.createDataFrame([(i, f"text {i} of some words") for i in BIG], "doc_id long, text string")
    pages = docs.select(docs.doc_id.alias("page_id"), docs.text.alias("url"), docs.text.alias("html"))
    order = lambda ids: sorted(ids, key=str)
    for got in (html_text.extract_text(pages).withColumnRenamed("page_id", "doc_id"), fuzzy_hash.fingerprints(docs), packing.pack_documents(docs, packing.default_tokenizer()), media_chunks.media_columns(docs), jaccard_join.jaccard_join(docs)):
        assert dict(got.dtypes)["doc_id"] == "bigint" and order(r["doc_id"] for r in got.collect()) == order(BIG)
    named = html_text.extract_text(pages.select(pages.page_id.cast("string").alias("page_id"), "url", "html"))
    assert order(r["page_id"] for r in named.collect()) == order(None if i is None else str(i) for i in BIG)


def test_scratch_folder_is_shared():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common.scratch_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert common.scratch_dir(Session).startswith("file:///")


def test_join_hot(spark):
    rows = spark.range(1000).selectExpr("id", "if(id < 600, 0, id % 9) as k")
    side = spark.range(9).selectExpr("id as k", "id * 10 as v")
    hot = rows.groupBy("k").count().withColumnRenamed("count", "n").where("n > 100")
    got = common.join_hot(rows, side, "k", hot, 2, per_copy=100)
    assert got.count() == 1000 and got.where("v <> k * 10").count() == 0 and sorted(got.columns) == ["id", "k", "v"]


def test_html_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain text only"), (4, "u", "<p>" * 500 + "deep"), (5, "u", "<article>a" + " b" * 50_000), (3, "u", "plain text only")]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[0][1:] == ("", 0) and got[1][1:] == ("", 0) and got[2] == got[3] == (3, "plain text only", 15) and got[5][2] == 100_001
    odd = spark.createDataFrame([(1, "u", "<p>x</p>", "t", 5)], "page_id long, url string, html string, text string, n_chars long")
    assert local(html_text.extract_text(odd)) == [{"page_id": 1, "url": "u", "text": "x", "n_chars": 1}] and html_text.extract_text(odd.limit(0)).count() == 0


def test_fingerprints(docs, empty):
    from pyspark.sql import functions as F

    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in local(fuzzy_hash.fingerprints(plain, ranges=7))}
    text = {r["doc_id"]: r["text"] or "" for r in local(plain)}
    ids = sorted(text, reverse=True)
    for i, d in enumerate(ids):
        t, nxt = text[d], text[ids[(i + 1) % len(ids)]]
        half = len(t) // 2
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert got[d]["near_next"] == pytest.approx(fuzzy_hash.likeness(got[d]["fingerprint"], got[ids[(i + 1) % len(ids)]]["fingerprint"]))
    prints = defaultdict(set)
    for d, t in text.items():
        prints[t].add(got[d]["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())
    assert fuzzy_hash.fingerprints(docs).count() == docs.count() and fuzzy_hash.fingerprints(empty).count() == 0
    assert fuzzy_hash.fingerprints(docs.where(F.col("doc_id") == 503)).first()["near_next"] == 1.0


def test_fingerprints_of_repeated_and_null_ids(spark):
    """One id over many ranges: its rows form one ring with all others."""
    rows = [(7, f"text {i}") for i in range(120)] + [(i, "x") for i in range(5)] + [(None, "y"), (None, "y")]
    got = local(fuzzy_hash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), ranges=9))
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    sha = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()
    assert [r["edited_sha256"] for r in got if r["doc_id"] == 4] == [sha("x", "x")] and {r["near_next"] for r in got if r["doc_id"] in (1, 2, 3, 4)} == {1.0}


def test_rolling_hash_against_a_sliding_window():
    rng = random.Random(9)
    for n in (1, 3, 7, 8, 400):
        data = bytes(rng.randrange(256) for _ in range(n))
        want = []
        for i in range(n):
            h = 0
            for k, b in enumerate(reversed(data[max(0, i - fuzzy_hash.WINDOW + 1) : i + 1])):
                h += (b + 1) * int(fuzzy_hash._MIX[k])
            h &= 0xFFFFFFFF
            h ^= h >> 15
            h = h * 0x2C1B3C6D & 0xFFFFFFFF
            want.append(h ^ h >> 12)
        assert fuzzy_hash.rolling(data).tolist() == want


def test_fingerprints_cover_the_text():
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("etaoin shrdlu,.") for _ in range(n))
    texts = [w * (3000 // len(w)) + prose(n) for w in ("And ", "Und ", "El ", "Heea ", "x", "Ndnd Of. ") for n in (0, 40, 3000)] + [prose(n) for n in (1, 64, 65, 200, 5000)]
    for text in texts:
        data = text.encode()
        h = fuzzy_hash.rolling(data)
        size, *parts = fuzzy_hash.fingerprint(text).split(":")
        for up, part in enumerate(parts[: fuzzy_hash.SIZES]):
            cuts = {i for i, x in enumerate(h.tolist()) if x % (int(size) << up) == 0} | {len(data) - 1}
            assert len(part) == len(cuts) <= fuzzy_hash.PIECES
    text = "And " * 782
    assert fuzzy_hash.likeness(fuzzy_hash.fingerprint(text), fuzzy_hash.fingerprint(text[:1564] + prose(1564))) <= 0.6
    assert fuzzy_hash._alike("A", "A") == 0.0 and fuzzy_hash._alike("AB", "AB") == 1.0
    assert len({fuzzy_hash.fingerprint(chr(i)) for i in range(1, 128)}) == 127
    assert all(fuzzy_hash.likeness(fuzzy_hash.fingerprint(x), fuzzy_hash.fingerprint(x)) == 1.0 for x in ("", "a", "x" * 999))


def test_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 70))) for _ in range(2))
        assert fuzzy_hash.edit_distance(a, b) == slow(a, b)


def test_media(docs, empty):
    got = local(media_chunks.media_columns(docs))
    texts = defaultdict(list)
    for r in local(docs):
        texts[r["doc_id"]].append(r["text"] or "")
    assert len(got) == docs.count()
    for r in got:
        t = texts[r["doc_id"]][0].encode()
        p = t + bytes(-len(t) % 64 or (0 if t else 64))
        media = media_chunks.wav(p)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["media_bytes"] == len(media) and r["media_sha256"] == hashlib.sha256(media).hexdigest()
    assert media_chunks.media_columns(empty).count() == 0


def test_media_of_texts_alike_when_padded(spark):
    texts = ["", "\0", "abc", "abc\0", "abc\0\0", "abc"]
    got = local(media_chunks.media_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {r["doc_id"]: r["n_bytes"] for r in got} == {i: len(x) for i, x in enumerate(texts)}


def test_gear_cuts():
    data = np.random.default_rng(4).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    cuts = media_chunks.gear_cuts(data)
    h, at, want = 0, 0, []
    for i, b in enumerate(data):
        h = (h << 1) + int(media_chunks._GEAR[b]) & 0xFFFFFFFF
        if (i + 1 - at >= media_chunks.LEAST and h % (1 << media_chunks.BITS) == 0 and len(data) - at > media_chunks.LEAST) or i + 1 - at == media_chunks.MOST or i + 1 == len(data):
            want.append(i + 1)
            at = i + 1
    assert cuts == want
    pieces = lambda d: {d[a:b] for a, b in zip([0, *media_chunks.gear_cuts(d)], media_chunks.gear_cuts(d))}  # noqa: B905,E731
    assert len(pieces(data) & pieces(b"inserted" + data)) > 0.8 * len(cuts)


def test_media_hot_chunks(spark, monkeypatch):
    monkeypatch.setattr(media_chunks, "PER_COPY", 3)
    rng = random.Random(8)
    shared = "".join(chr(rng.randint(97, 122)) for _ in range(40_000))
    docs = spark.createDataFrame([(i, shared + str(i) * 50) for i in range(12)], "doc_id long, text string")
    assert media_chunks.media_columns(docs).count() == 12


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    got = local(packing.pack_documents(docs, path, block=64))
    tok, want = Tokenizer.from_file(path), Counter()
    for r in local(docs):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4").tobytes()
            want[r["doc_id"], n, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    lengths = [r["length"] for r in got]
    assert -(-sum(lengths) // 2048) <= len(bins) <= len(packing.best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, 2048))
    assert packing.pack_documents(empty, path).count() == 0
    odd = docs.limit(9).selectExpr("*", "1 as length", "2 as uid", "3 as block", "4 as sequence_id", "5 as piece")
    assert packing.packing_stage(docs.sparkSession, odd, DATA).where("piece = 0").count() == 9


def test_tokens_are_the_tokenizers():
    """Looked up and pieced together, ids are those of the tokenizer, also when the memory of words is short."""
    tok = packing.WordTokenizer(packing.default_tokenizer())
    rng, some = random.Random(1), "abz é ' s t re'll 'd0 19 <| |> \t\n\x0b\x1c \xa0 ß ſ Ⅷ İ ŉ ǰ ﬁ . , -- “ ” \u212a Å"
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", " ", "<|endoftext|> x"]
    want = tok._encode(texts)
    before, packing.MEMORY, packing.TOGETHER = (packing.MEMORY, packing.TOGETHER), 400, 2000
    try:
        assert list(tok.ids(texts)) == want == list(tok.ids(texts))
    finally:
        packing.MEMORY, packing.TOGETHER = before


def test_packing_evolves():
    """Three documents a sequence: fewer sequences than best-fit decreasing, by crossovers; and crossovers in easy cases, too."""
    for seed in range(4):
        rng, lengths = random.Random(seed), []
        for _ in range(20):
            a = rng.randint(760, 980)
            b = rng.randint(512, 2048 - a - 500)
            lengths += [a, b, 2048 - a - b]
        rng.shuffle(lengths)
        decreasing = packing.best_fit(sorted(range(60), key=lambda i: -lengths[i]), lengths, 2048)
        best, crossovers = packing.evolve(lengths, 2048, seed, [], generations=40)
        assert len(best) < len(decreasing) and crossovers > 0 and sorted(i for items, _ in best for i in items) == list(range(60))
    rng = random.Random(1)
    lengths = [rng.randint(1, 1500) for _ in range(2000)]
    best, crossovers = packing.evolve(lengths, 2048, 1, [])
    assert crossovers > 0 and len(best) <= len(packing.best_fit(sorted(range(2000), key=lambda i: -lengths[i]), lengths, 2048))


def test_crossover_keeps_every_item():
    rng = random.Random(6)
    lengths = [rng.randint(1, 900) for _ in range(400)]
    a, b = (packing.best_fit(rng.sample(range(400), 400), lengths, 2048) for _ in range(2))
    child = packing.crossover(a, b, lengths, 2048, rng)
    assert sorted(i for items, _ in child for i in items) == list(range(400))
    assert all(used == sum(lengths[i] for i in items) <= 2048 for items, used in child)


def _brute(docs):
    sets, ids = {}, []
    for n, r in enumerate(docs):
        w = (r["text"] or "").lower().split()
        k = min(5, len(w))
        sets[n] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
        ids.append(-(1 << 63) if r["doc_id"] is None else r["doc_id"])
    links, root = [0] * len(ids), list(range(len(ids)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in sets:
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    classes = defaultdict(list)
    for i in sets:
        classes[find(i)].append(ids[i])
    return Counter((ids[i], min(classes[find(i)]), links[i]) for i in sets), len(classes)


@pytest.mark.parametrize("bucket,block", [(32, 512), (4, 7)])
def test_jaccard(docs, empty, monkeypatch, bucket, block):
    """Small buckets and blocks send the near copies through tasks of blocks."""
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "PIECE", max(2, block // 2))
    want, n = _brute(local(docs))
    got = Counter((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["class_id"], r["n_links"]) for r in local(jaccard_join.jaccard_join(docs)))
    assert got == want
    kept = jaccard_join.jaccard_stage(docs.sparkSession, docs, DATA)
    assert kept.columns == docs.columns and kept.count() == n
    if bucket == 4:
        assert jaccard_join.jaccard_stage(docs.sparkSession, empty, DATA).count() == 0 and jaccard_join.jaccard_join(empty).count() == 0


def test_jaccard_finds_every_link(spark):
    """Recall at sf0.01, against an exact join in SQL."""
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in local(jaccard_join.op8_ngram_jaccard_join(spark, "/root/testdata/sf0.01"))}
    assert got == set(con.sql(jaccard_join.ORACLE_OP8).fetchall())


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 5)
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1060)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(90)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_quality(spark, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.classify(docs, train).join(held, "doc_id").select("_wl_keep", "quality").collect()
    wrong = Counter((r["_wl_keep"], r["quality"]) for r in got)
    assert (wrong[True, 0] + wrong[False, 1]) / len(got) < 0.03 and wrong[False, 1] <= 2
    odd = spark.createDataFrame(rows_of([(1, None, None, None), (2, "", "en", "s"), (2, "", "en", "s")]), DOC)
    assert quality.classify(odd, labels).count() == 3 and quality.classify(odd, labels.limit(0)).where("_wl_keep").count() == 3
    assert quality.classify(empty, labels).count() == 0
    # repeated rows and ties of a sampled document do not change the model from run to run
    some = docs.where("doc_id < 300")
    models = [quality.train(d, labels, rows=100) for d in (some, some.unionByName(some).repartition(7), some.unionByName(some.selectExpr("doc_id", "text", "lang", "source", "n_chars")).repartition(3))]
    assert all(np.array_equal(models[0][0], m[0]) and models[0][1] == m[1] for m in models)


def test_tool_calls_of_one_message(spark):
    """Many calls, a chain in the order against which they come; empty tables, clashing columns, a very long text."""
    calls = [{"id": str(i), "name": "search", "arguments": {"query": "q"}, "after": [str(i + 1)] if i < 199 else []} for i in range(200)]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": calls}), "x", 1), (2, 0, "user", "long " * 200_000, "x", 1)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string, step int")
    got = local(tool_calls.link_calls(m))
    assert {r["call_id"]: r["step"] for r in got if r["conv_id"] == 1} == {str(i): 199 - i for i in range(200)} and {r["error"] for r in got} == {"no result"}
    assert tool_calls.link_calls(m.limit(0)).count() == 0 and tool_calls.left_out(m.limit(0)).count() == 0


def test_tool_calls(spark, duck):
    call = lambda i, name, args, after=(): {"id": i, "name": name, "arguments": args, "after": list(after)}
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", json.dumps({"tool_calls": [call("b", "calculate", {"expression": "1+1", "exact": True}, ["a"]), call("a", "search", {"query": "q", "limit": 5})]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "found"})), (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "2"})), (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "2"})),
        (2, 1, "assistant", json.dumps({"tool_calls": [call("x", "search", {"query": 5}), call("y", "nope", {}), call("z", "search", {"query": "q", "more": 1}), call("c", "search", {"query": "q"}, ["d"]), call("d", "search", {"query": "q"}, ["c"]), call("l", "search", {"limit": 0, "query": "q"}), call("m", "search", {"query": "q"}, ["gone"])]})),
        (3, 0, "user", None), (3, 0, None, "x"), (None, None, "user", "x"), (4, 0, "user", "{broken"),
    ]
    got = {(r["conv_id"], r["call_id"]): r for r in local(tool_calls.link_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))}
    assert got[1, "a"]["step"] == 0 and got[1, "b"]["step"] == 1 and got[1, "b"]["error"] is None and got[1, "b"]["result_turn"] == 3
    assert got[1, "b"]["message"] == '{"arguments":{"exact":true,"expression":"1+1"},"error":null,"id":"b","name":"calculate","result":"2"}'
    assert {k[1]: got[k]["error"] for k in got if k[0] == 2} == {"x": "bad query", "y": "unknown tool", "z": "unknown more", "c": "cycle", "d": "cycle", "l": "bad limit", "m": "no call gone"}
    assert got[3, "call_3_0"]["error"] == "missing prompt" and got[4, "call_4_0"]["error"] == "no result"
    df, want = tool_calls.op7_tool_call_linking(spark, DATA), duck.sql(tool_calls.ORACLE_OP7)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in df.collect()))) == sorted(map(str, want.fetchall()))


def test_tool_calls_left_out(spark):
    tool = lambda i: json.dumps({"tool_call_id": i, "content": "c"})
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 4, "assistant", "late"), (1, 5, None, "x"), (1, 6, "tool", "plain"),
        (2, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "q"}, "after": []}]})),
        (2, 1, "tool", tool("a")), (2, 2, "tool", tool("a")), (2, 3, "tool", tool("gone")), (2, 4, "assistant", json.dumps({"tool_calls": []})),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["reason"] for r in local(tool_calls.left_out(m))}
    none = "no call or result"
    assert got == {(1, 0): none, (1, 4): "result of no call", (1, 5): none, (1, 6): none, (2, 2): "further result", (2, 3): "result of no call", (2, 4): none}


def test_url_oracle(spark, duck):
    df, want = url_filter.op5_url_filter(spark, DATA), duck.sql(url_filter.ORACLE_OP5)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in df.collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    sizes, docs = [], spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == names
        sizes.append(docs.count())
    last = corpus_pipeline.run(spark, DATA).cache()
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert last.where("piece = 0").count() == docs.count()
    assert max(Counter(r["doc_id"] for r in docs.select("doc_id").collect()).values()) <= 3
