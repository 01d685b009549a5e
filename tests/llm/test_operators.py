import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, licences, linededup, media, neardup, packing, queries, rules, topk, toxicity, urlfilter
from ledgerloom.llm.common import connected_components

DOCS = "doc_id long, text string, score double, id string"  # the last two clash with names used inside
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = ["", None, " \n ", "a b c", "a b c", LONG, "é 日本語 \x1c  x\n\n<|endoftext|>", "one two three four five six seven\nlast line of it all here"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.5, "x") for i, t in enumerate(TEXTS)] + [(3, "a b c", 0.5, "x"), (None, "null id text", None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_round_trip_and_edits(docs, empty):
    import public_tokenizers as p
    import tiktoken

    ranks = bpe.load_ranks(bpe.RANKS)
    e = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = "null id text" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.ids == e.encode_ordinary(want) and bytes(r.decoded) == want.encode()
    assert bpe.decode(bpe.encode(empty)).count() == 0
    b, rng = bpe._bpe(bpe.RANKS), random.Random(3)
    own = bpe.Editable(b, b"start")
    for _ in range(60):
        if rng.random() < 0.4:
            own.append(bytes(rng.choice(b"abc =1\xc3\xa9") for _ in range(rng.randint(0, 9))))
        else:
            i = rng.randint(0, len(own.data))
            own.replace(i, rng.randint(i, len(own.data)), bytes(rng.choice(b"then the ") for _ in range(rng.randint(0, 5))))
        assert own.ids() == b.encode(own.data) == next(b.encode_many([own.data]))


def test_packing(spark, docs, empty):
    import zlib

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.TOKENIZER)
    pieces = packing.cut(docs)
    rows = packing.pack(pieces).toPandas()
    for key, text in [(i, t) for i, t in enumerate(TEXTS) if i != 3] + [(None, "null id text")]:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = rows[rows.doc_id.isna() if key is None else rows.doc_id == key].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() == len(ids)
        assert (own.length[1:] == 1024).all() and (len(ids) <= 1024) == (len(own) == 1)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)]
    assert 50256 in tok.encode(TEXTS[6], add_special_tokens=False).ids and (rows.doc_id == 3).sum() == 2
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 1024 and (s.offset == s.length.cumsum() - s.length).all()
    assert packing.pack(packing.cut(empty)).count() == 0
    rng = random.Random(7)
    many = spark.createDataFrame([(i, rng.randint(1, 1024), "x", "y", i) for i in range(3_000)] + [(-1, None, "x", "y", 0), (-2, 5, None, None, None), (-2, 5, None, None, None)], "doc_id long, length long, number string, dealt string, offset long")
    got = packing.pack(many, shard=500).toPandas()
    filled = got.length.fillna(0).groupby(got.sequence_id).sum()
    assert len(got) == 3_003 and filled.max() <= 1024 and len(filled) <= -(-int(filled.sum()) // 1024) * 1.03 + 7 and set(got.number.dropna()) == {"x"}
    got["length"] = got.length.fillna(0)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values(["offset", "length"])
        assert (s.offset == s.length.cumsum() - s.length).all()
    caps = np.array([10.0, 2, 60])
    d = np.array([[n, 1, n * n] for n in (7, 5, 5, 3, 2, 1, 1)], float)
    for rule in ("norm", "dot"):
        bins = packing.best_fit(d, caps, np.ones(3), rule)
        assert all((d[bins == k].sum(0) <= caps).all() for k in set(bins))
        tight = packing.pack(many.where("length <= 300"), max_documents=4, max_cost=150_000.0, weights=(1.0, 1.0, 1.0), rule=rule).toPandas()
        each = tight.groupby("sequence_id").length
        assert each.count().max() <= 4 and (tight.length**2).groupby(tight.sequence_id).sum().max() <= 150_000 and each.sum().max() <= 1024 and len(tight) == len(got[(got.length <= 300) & (got.doc_id != -1)])


def test_rules_and_toxicity(spark, docs, empty):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + ("$$$" if i % 4 == 0 else "") for _ in range(40)) + (" vile" if i % 3 == 0 else "")) for i in range(300)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 3 == 0)) for i in range(300)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    m = rules.train(many, labels)
    got = rules.score(many, m).select("doc_id", "score").collect()
    assert m.rules and all((r.score >= 0.3) == (r.doc_id % 4 != 0) for r in got)
    assert all(0 <= r[0] <= 1 for r in rules.score(docs, m, score_col="s").select("s").collect())
    assert rules.train(empty, labels.limit(0)).score({}) is not None
    x = toxicity.train(many, labels)
    assert 0 < len(x[0]) < 1000 and all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in toxicity.score(many, x).collect())
    assert toxicity.score(docs, x).count() == len(TEXTS) + 2
    none = toxicity.train(empty, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_media(spark, docs, empty):
    got = media.media_columns(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        data = ("null id text" if r.doc_id is None else TEXTS[int(r.doc_id)] or "").encode()
        assert r.n_bytes == len(data) and len(r.payload) % 64 == 0 and len(r.payload) >= 64 and bytes(r.payload) == data.ljust(len(r.payload), b"\0")
    assert len({hashlib.sha256(r.media).hexdigest() for r in got if r.doc_id == "3" or r.doc_id == "4"}) == 1
    assert media.media_columns(empty).count() == 0
    named = spark.createDataFrame([("null", "x"), (None, "y"), ("a/b.png", "z")], "doc_id string, text string")
    assert {r.doc_id: bytes(r.payload)[:1] for r in media.media_columns(named).collect()} == {"null": b"x", None: b"y", "a/b.png": b"z"}


def test_media_query(spark, tmp_path):
    import zlib

    texts = ["", None, "x" * 64, "y" * 65, "é" * 40, "a", "a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op4_media(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[i]
        n, samples = media.from_png(media.to_png(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.to_png(data)).hexdigest() and r.media_bytes == len(media.to_png(data)) and r.feature == media.feature(samples) and n == len(data)
    assert got[5].feature == got[6].feature and len({r.feature for r in got.values()}) > 3


def test_damaged_member_is_one_row(spark, docs, tmp_path):
    at = media.write_archives(docs.coalesce(1), to=f"file://{tmp_path}/m", range_bytes=500)
    spark.dataSource.register(media.ArchiveSource)
    read = spark.read.format("archive_members").load(at)
    good = read.collect()
    assert read.rdd.getNumPartitions() > 3 and {r.name.split("/")[0].split(".")[0] for r in good} == {str(k) for k in range(len(TEXTS) + 2)}
    (path,) = (tmp_path / "m/archives").glob("*.zip")
    data = bytearray(path.read_bytes())
    data[good[0].offset] ^= 1
    path.write_bytes(bytes(data))
    got = spark.read.format("archive_members").option("permissive", "true").load(at).collect()
    assert len(got) == len(good) and [r.error is not None for r in got].count(True) == 1


def test_topk_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)] + [(300, None), (301, [1.0, None] * 3), (302, [float("nan")] * 6), (303, [0.0] * 6), (350, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for i, x in rows if x and None not in x and not np.isnan(x).any()}
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=64, query_block=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (i for i in v if i % 50 == 0):
        want = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    ties = spark.createDataFrame([(i, [1.0, 0.0], 7, 8) for i in range(40)] + [(3, [0.0, 1.0], 7, 8), (3, [0.0, 1.0], 7, 8)], "vec_id long, embedding array<double>, b int, qb int")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.top_k(ties, F.col("vec_id") == 3, block=8, query_block=1).collect()]
    assert got == [(k + 1, i, 0) for k, i in enumerate([0, 1, 2, 4, 5])]  # the smaller vector of the repeated query counts
    v = rng.normal(size=(500, 3)) * np.linspace(0.01, 4, 500)[:, None] ** 3
    lists = topk.SortedLists(np.arange(500), np.floor(256 * v).astype(np.int64))
    q, ids, score, scored = lists.search(lists.vectors[-3:], np.arange(497, 500), 5, step=2)
    whole = lists.vectors[-3:] @ lists.vectors.T
    assert scored < 3 * 500 and [sorted(score[q == r])[-1] for r in range(3)] == [max(np.delete(whole[r], 497 + r)) for r in range(3)]


def test_licences(spark, docs, empty):
    own = spark.createDataFrame([(1, "x\nreleased under the mit  LICENSE\ny"), (2, None), (3, "Licensed under the Apache License, Version 2.0")], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(own, licences.templates(spark)).collect()}
    assert (got[1].licence, got[1].line, got[1].dice) == ("MIT", 1, 1.0) and got[2].n_matches == 0 and got[3].licence == "Apache-2.0"
    assert licences.scan(docs, licences.templates(spark)).count() == len(TEXTS) + 2 and licences.scan(empty, licences.templates(spark)).count() == 0


def test_lines_brute_force(spark, docs, empty):
    rng = random.Random(4)
    pool = [[f"t{rng.randrange(60)}" for _ in range(rng.randint(3, 14))] for _ in range(60)]
    rows = []
    for i in range(80):
        ls = []
        for _ in range(rng.randint(0, 6)):
            own = list(rng.choice(pool))
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = f"t{rng.randrange(60)}"
            ls.append(" ".join(own))
        rows.append((i, "\n".join(ls)))
    base = [f"g{i}" for i in range(40)]  # one line in many versions, that match the first one, others or none
    for i in range(80, 200):
        rows.append((i, " ".join(f"h{rng.randrange(20)}" if rng.random() < rng.choice([0.02, 0.1, 0.2]) else w for w in base)))
    seen, want = [], {}
    for i, text in rows:
        cut = []
        for k, line in enumerate(text.split("\n")):
            s = set(line.split())
            if len(line.split()) >= 5:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    cut.append(k)
                seen.append(s)
        want[i] = cut
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").repartition(3)).collect()}
    assert {i: list(r.removed_lines) for i, r in got.items()} == want
    assert all(got[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in rows)
    tight = linededup.Limits(hot=3, crowd=4, tries=1, local=2, salted=5)  # pairs of tokens, crowds, keys in several groups and second rounds everywhere
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), limits=tight).collect()
    assert {r.doc_id: list(r.removed_lines) for r in got} == want
    clash = spark.createDataFrame([(1, "a b c d e\na b c d e", "x", 1, 2, "y", "z")], "doc_id long, text string, row string, gone int, may int, n_lines string, removed_lines string")
    (r,) = linededup.dedup_lines(clash).collect()
    assert (r.text, r.row, r.gone, r.may, r.n_lines, r.removed_lines) == ("a b c d e", "x", 1, 2, 2, [1])
    names = spark.createDataFrame([("b", "a b c d e f"), ("a", "f e d c b a"), (None, "a b c d e f x")], "doc_id string, text string")
    assert {r.doc_id: r.removed_lines for r in linededup.dedup_lines(names).collect()} == {None: [], "a": [0], "b": [0]}
    assert linededup.dedup_lines(docs).count() == len(TEXTS) + 2 and linededup.dedup_lines(empty).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://WWW.Example.com/en/a"), (2, "https://x.example.com/en/"), (3, "http://a.org/1"), (4, "http://b.net/es/2"), (5, None), (6, "nothing"), (7, "https://b.org/9?q#f"), (None, "http://a.com")], "page_id long, url string")
    known = spark.createDataFrame([("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")], "verdict string, host string, path string")
    links = spark.createDataFrame([("http://a.org/1", "http://c.org/"), ("http://c.org/", "http://b.net/es/2"), ("http://www.example.com/en/a", "http://c.org/"), (None, "x")], "source string, target string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, known, links).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block")
    assert got[3][2:] == (None, "block") and got[5] == ("", "", None, "allow") and got[7] == ("b.org", "/9", None, "allow") and got[None][2:] == (None, "allow")
    assert urlfilter.judge_urls(pages.limit(0), known, links).count() == 0


def test_links_of_pages(spark):
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    tags = [
        ('<link rel="canonical" href="{}">', True), ("<LINK href='{}' rel='nofollow Canonical'/>", True), ("<link rel=canonical href={}>", True), ('<meta http-equiv="refresh" content="0; url={}">', True), ("<meta content='5;URL={}' http-equiv=Refresh>", True),
        ('<!-- <link rel="canonical" href="{}"> -->', False), ('<link rel="stylesheet" href="{}">', False), ('<link rel="canonicalish" href="{}">', False), ('<meta name="x" content="0; url={}">', False), ('<a rel="canonical" href="{}">', False),
    ]
    targets = ["http://x.org/a?b=1&amp;c=2", "//y.org/p", "/root/./z/../w", "2", "../up/3.html", "?q=4", "./", "..", "https://z.net", "d/e/../f?x=../y#frag", "#only", "mailto:a@b.c", ""]
    bases = ["http://Site.com/dir/page.html?old=1#f", "https://site.com", "http://site.com/a/b/"]
    rng, rows, want = random.Random(3), [], []

    class Tags(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out = []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag == "link" and "canonical" in (a.get("rel") or "").lower().split():
                self.out.append(a.get("href") or "")
            if tag == "meta" and (a.get("http-equiv") or "").lower() == "refresh":
                self.out.append((a.get("content") or "").partition("=")[2])

    for i in range(120):
        html = "<html><head>" + " ".join(rng.choice(tags)[0].format(rng.choice(targets)) for _ in range(rng.randint(0, 4))) + "</head>canonical</html>"
        base = rng.choice(bases)
        p = Tags()
        p.feed(html.replace("href=>", "href=''>"))
        rows.append((i, base, html))
        want += [(base, urljoin(base if base.count("/") > 2 else f"{base}/", x).partition("#")[0]) for x in p.out if x and not x.startswith(("#", "mailto:"))]
    pages = spark.createDataFrame([*rows, (500, None, rows[0][2]), (501, "", "<link rel=canonical href=/x>"), (502, bases[0], None), (503, bases[0], "")], "page_id long, url string, html string")
    got = [(r.source, r.target.partition("#")[0]) for r in urlfilter.html_links(pages).collect()]
    assert sorted(got) == sorted(want) and len(set(want)) > 20


def test_url_query_with_links_equals_sql(spark, tmp_path):
    import duckdb

    rng, rows = random.Random(11), []
    urls = [f"http://{h}/{p}" for h in ("a.org", "b.net", "example.com", "www.example.com", "c.com", "D.org") for p in ("", "en/1", "es/2?x=1", "fr/3#f", "q/r/s.html")]
    for i in range(90):
        refs = [rng.choice([rng.choice(urls), "../" + rng.choice(["en/1", "es/2", "k"]), "/es/2", "//b.net/fr/3", "?x=1", "./s.html", "#f", "mailto:x@y.z", "http://e.org/?a=1&amp;b=2"]) for _ in range(rng.randint(0, 2))]
        tags = [rng.choice(['<link rel="canonical" href="{}">', "<meta http-equiv=refresh content='1; url={}'>", "<!-- <link rel=canonical href={}> -->", '<link rel=next href="{}">']).format(r) for r in refs]
        rows.append((i, rng.choice([*urls, "nothing"]), "<html>" + "".join(tags) + "</html>"))
    spark.createDataFrame([*rows, (500, None, rows[0][2]), (501, urls[0], None)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = {r[0]: r for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE['op8_urls']})").fetchall()}
    got = {r.page_id: tuple(r) for r in queries.op8_urls(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()}
    assert got == want and len(got) == 92 and sum(x[3] is None and x[4] == "block" for x in got.values()) > 5


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    hub = [(1000, i) for i in range(1001, 1400)] + [(1399, 2000), (999, 1200)]
    odd = [(None, 5), (7, None), (5000, 5000), (3, 2), (2, 3), (6001, 6000)]
    rng = random.Random(1)
    edges = chain + hub + odd
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(range(301), 0) | dict.fromkeys([999, *range(1000, 1400), 2000], 999) | {6001: 6000, 6000: 6000}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_brute_force(spark, docs, empty):
    rng = random.Random(6)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 5, 7, 60, 200]))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"z{rng.randrange(4000)}"
            rows.append((len(rows), " ".join(own)))
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    odd = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert {(0, 0, 0), (1, 0, 1), (4, 1, 3), (None, 1, None)} <= odd and neardup.near_duplicates(empty).count() == 0
