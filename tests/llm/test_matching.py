"""Line dedup, n-gram join, decontamination and the URL filter against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination as dc, line_dedup as ld
from millrace.llm.clusters import verified
from millrace.llm.decontamination import contaminated, without_contaminated
from millrace.llm.graphs import components
from millrace.llm.ngram_join import jaccard_classes, prefix_depth, recall, without_copies
from millrace.llm.url_filter import judge_urls, listed_among
from millrace.sources.tables import scan_parquet
from tests.llm.conftest import FOLDER, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_banded_distance_and_probes_lose_nothing():
    rng = random.Random(1)
    for _ in range(4000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(2))
        for k in range(4):
            near = distance(a, b) <= k
            assert ld.within(a, b, k) == near
            long, short = (a, b) if len(a) >= len(b) else (b, a)
            if near and len(short) > k:
                filed = {(t, i, short[s:e]) for t, i, s, e, own in ld.probes(len(short), k) if own}
                assert filed & {(t, i, long[s:e]) for t, i, s, e, _ in ld.probes(len(long), k)}


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        chars[rng.randrange(len(chars))] = rng.choice("xyz")
    return "".join(chars)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    base = [prose(rng, 12) for _ in range(6)]
    texts = ["\n".join(edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(5)) + "\nshort" for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if len(x) >= ld.LEAST_CHARS]
    distinct = sorted({x for *_, x in lines})
    root = roots(distinct, [(a, b) for a in distinct for b in distinct if a < b and distance(a, b) <= ld.EDITS])
    seen, gone = set(), set()
    for i, k, x in lines:
        if root[x] in seen:
            gone.add((i, k))
        seen.add(root[x])
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in ld.dedup_lines(docs).collect()} == want


def test_short_lines_that_repeat_go(spark):
    cjk = "これは三十九文字に満たない短い文ですが全体で一つの意味を持つものです。"
    texts = ["All rights reserved.\n \n" + cjk, "all rights reserved.\nx\n \n\nAll rights reserved.", "x\n" + cjk + "\ny\ny"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in ld.dedup_lines(docs).collect()}
    assert found == {0: (texts[0], 3, 0), 1: ("all rights reserved.\nx\n \n", 5, 1), 2: ("y", 4, 3)}


def test_line_dedup_on_odd_rows(odd, none):
    found = {(r.doc_id, r.text) for r in ld.dedup_lines(odd).collect()}
    text = odd.filter("doc_id = 1").first()["text"]
    assert (None, text) in found and (1, "") in found and (2, "") in found and (3, None) in found
    assert ld.dedup_lines(odd).count() == 10 and ld.dedup_lines(none).count() == 0
    with pytest.raises(ValueError):
        ld.dedup_lines(odd.withColumn("n_lines", F.lit(1)))


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_jaccard_classes_equal_brute_force(spark):
    rng = random.Random(7)
    base = [prose(rng, 60).split() for _ in range(8)]
    texts = []
    for _ in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    sets = dict(enumerate(map(shingles, texts)))
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    root, n = roots(sets, links), dict.fromkeys(sets, 0)
    for a, b in links:
        n[a], n[b] = n[a] + 1, n[b] + 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard_classes(docs).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == {i: (root[i], n[i]) for i in sets}
    assert sorted(r.doc_id for r in without_copies(docs).collect()) == sorted(set(root.values()))


def test_prefixes_are_as_short_as_the_recall_needs():
    depth = prefix_depth(0.8, 0.999)
    assert recall(depth, 0.8) >= 0.999 > recall(depth + 1, 0.8)


def test_jaccard_on_odd_rows(odd, none):
    found = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(odd).collect()), key=str)
    assert found.count((1, 1, 2)) == 2 and (2, 1, 2) in found and (3, 3, 0) in found and (None, None, 0) in found
    assert len(found) == 10 and jaccard_classes(none).count() == 0


def test_components_of_chains_stars_and_pairs(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    found = {r["node"]: r["class"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert found == want


def test_chunks_meet_in_every_pair(spark):
    members = spark.range(40).selectExpr("1L AS class", "id AS node", "1L AS weight")

    def pairs(table):
        node, chunk = table["node"].to_pylist(), table["chunk"].to_pylist()
        two = min(chunk) != max(chunk)
        import pyarrow as pa
        out = [(a, b) for a, i in zip(node, chunk) for b, j in zip(node, chunk) if a < b and (i != j or not two)]
        return pa.table({"a": [x for x, _ in out], "b": [x for _, x in out]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    found = verified(members, pairs, "a long, b long", most=7)
    assert found.count() == found.distinct().count() == 40 * 39 // 2


def test_contamination(spark, odd, none):
    rng = random.Random(9)
    items = [prose(rng, 40) for _ in range(5)] + [prose(rng, 5), None, ""]
    def planted(item, changed):
        words = items[item].split()[5:30]
        for i in changed:
            words[i] = "Other"
        return prose(rng, 30) + " " + " ".join(words).upper().replace(" ", ", ") + " " + prose(rng, 30)
    docs = [(0, planted(0, [])), (1, planted(1, [6, 20])), (2, prose(rng, 300)), (3, planted(2, range(0, 25, 2))), (4, items[5]), (5, None)]
    d = spark.createDataFrame(docs + docs[:1], "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (100_000, 20):
        assert sorted((r.doc_id, r.item_id) for r in contaminated(d, b, block).collect()) == [(0, 0), (1, 1)]
    assert without_contaminated(d, b).count() == 4
    assert contaminated(odd, b).count() == 0 and contaminated(none, b).count() == 0 and contaminated(d, b.limit(0)).count() == 0


def test_two_changes_anywhere_leave_a_seed_whole():
    for changed in itertools.combinations(range(dc.RUN), dc.RUN - dc.AGREE):
        windows = [{a + p for p in mask} for mask in dc.MASKS for a in range(dc.RUN - mask[-1])]
        assert any(not window & set(changed) for window in windows), changed


def test_contamination_equals_an_alignment_without_seeds(spark):
    rng = random.Random(21)
    common = prose(rng, 12).split()  # frequent words, so that seeds of other passages meet as well
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else w for w in prose(rng, n).split()]
    items = [text(rng.randint(10, 30)) for _ in range(12)]
    docs = []
    for _ in range(120):
        item = rng.choice(items)
        a = rng.randint(0, max(0, len(item) - 13))
        passage = item[a : a + rng.randint(12, 18)]
        for i in rng.sample(range(len(passage)), min(len(passage), rng.randint(0, 4))):
            passage[i] = rng.choice(common)
        docs.append(text(rng.randint(0, 25)) + passage + text(rng.randint(0, 25)))

    def agreeing(doc, item):
        runs = [sum(doc[i + k] == item[j + k] for k in range(13) if 0 <= i + k < len(doc))
                for j in range(len(item) - 12) for i in range(-12, len(doc))]
        return max(runs, default=0)

    wanted = {(i, j, n) for i, d in enumerate(docs) for j, b in enumerate(items) if (n := agreeing(d, b)) >= 11}
    frame = lambda rows, id: spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], f"{id} long, text string")
    found = contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {w[:2] for w in wanted} and len(wanted) > 40


def test_verdicts_are_of_rows_and_not_of_ids(spark):
    rng = random.Random(11)
    item, *own = (prose(rng, 40) for _ in range(7))
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = [(None, item), (None, own[0]), (1, own[1] + " " + item), (1, own[2]), (2, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in without_contaminated(docs, benchmark).collect()} == {rows[i] for i in (1, 3, 4, 5)}
    rows = [(1, own[0]), (2, own[0]), (2, own[1]), (3, own[2]), (3, own[2]), (None, own[2]), (None, own[3]), (None, own[3]),
            (None, own[4]), (4, None), (4, None), (5, ""), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [rows[i] for i in (0, 2, 3, 6, 8, 9, 10, 11, 12)]
    assert sorted(map(str, map(tuple, without_copies(docs).collect()))) == sorted(map(str, want))


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def judged(url, listed):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1].split("#", 1)[0].split("?", 1)[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
    best = None
    for verdict, rule in RULES:
        domain, _, tail = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + tail):
            if best is None or len(rule) > len(best[1]):
                best = verdict, rule
    key = host.removeprefix("www.") + path.rstrip("/") if host else None
    return (host, path, best[1], best[0]) if best else (host, path, None, "block" if key in listed else "allow")


def test_urls(spark):
    urls = ["http://a.Example.net/en/1?x", "https://x.net", "http://net/", "http://badnet/", "http://example.com/de/x#y", None, "",
            "no scheme", "http://w.org/fr/", "http://org/fr", "HTTP://www.list.test/p/", "http://list.test/p?q=://z", "http://list.test/P",
            "a://b://c/d", "http://example.net/en", "http://h/a\nb", "http://?x/y"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumn("html", F.lit("x"))
    listed = spark.createDataFrame([("https://list.test/p",), (None,), ("nothing",)], "url string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, listed, RULES).collect())
    assert got[1:] == [(i, *judged(u, {"list.test/p"})) for i, u in enumerate(urls)] and got[0] == got[1]
    assert judge_urls(pages.limit(0), listed, RULES).count() == 0 == judge_urls(pages, listed.limit(0), ()).filter("verdict = 'block'").count()


def test_the_filter_passes_all_listed_and_nothing_else_comes_through(spark):
    listed = spark.range(0, 4000, 2).selectExpr("concat('h/', id) AS canonical")
    urls = spark.range(4000).selectExpr("concat('h/', id) AS canonical")
    assert listed_among(urls, listed).count() == 2000


def test_near_documents_of_the_given_table(spark, documents):
    found = jaccard_classes(documents)
    assert found.count() == documents.count() and found.filter("n_links > 0 AND class_id > doc_id").count() == 0
    leaks = contaminated(documents, scan_parquet(spark, FOLDER, "benchmark"))
    assert leaks.filter("agreeing < 11").count() == 0
