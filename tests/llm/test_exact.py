"""Queries that SQL expresses: equal on the tables and on odd rows, empty tables included."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOCUMENTS, SF, clashing, odd_documents, oracle, rows, unharmed
from tidelog.llm import exact_dedup, jaccard, substring_dedup, url_filter
from tidelog.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_matches_sql(spark, name):
    assert rows(QUERIES[name](spark, SF)) == rows(oracle(ORACLES[name]))


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op4_mix_sources"])
def test_odd_rows_match_sql(spark, tables, name):
    sf = tables(documents=odd_documents(spark))
    assert rows(QUERIES[name](spark, sf)) == rows(oracle(ORACLES[name], sf))


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op6_substring_dedup", "op9_jaccard"])
def test_empty_table(spark, tables, name):
    assert QUERIES[name](spark, tables(documents=spark.createDataFrame([], DOCUMENTS))).count() == 0


def test_one_row_of_each_text_is_kept(spark):
    docs = odd_documents(spark).withColumnRenamed("lang", "__extra")
    kept = exact_dedup.drop_copies(docs).collect()
    text = lambda r: hashlib.sha256((r.text or "").encode().lower()).hexdigest()
    best = defaultdict(lambda: -1)
    for r in docs.collect():
        best[text(r)] = max(best[text(r)], r.doc_id or -1)
    assert sorted((text(r), r.doc_id or -1) for r in kept) == sorted(best.items())
    found = exact_dedup.copy_groups(docs).collect()
    assert sum(r.kept for r in found) == len(best)


@pytest.mark.parametrize("held", [50, 4_000_000])
def test_many_copies_of_one_text(spark, monkeypatch, held):
    monkeypatch.setattr(exact_dedup, "HELD", held)
    docs = spark.range(5000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'the same' else concat('text ', id) end as text")
    found = {r.doc_id: r for r in exact_dedup.copy_groups(docs).collect()}
    assert (found[0].keep_id, found[0].group_size, found[4998].kept, found[3].kept) == (4998, 1667, True, False)
    assert exact_dedup.drop_copies(docs).count() == 5000 - 1667 + 1


# Substrings.


def cut_by_hand(docs, window=20):
    """docs: (id, text) in order. Number of words and the words that stay."""
    split = [(i, substring_dedup.words_of(t)) for i, t in docs]
    seen, removed = set(), defaultdict(set)
    for at, (_, words) in enumerate(split):
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                removed[at] |= set(range(s, s + window))
            seen.add(key)
    return [(i, len(words), len(removed[at]), hashlib.sha256(b" ".join(w for p, w in enumerate(words) if p not in removed[at])).hexdigest()) for at, (i, words) in enumerate(split)]


def test_substrings_by_hand(spark, tables):
    passage = " ".join(f"p{i}" for i in range(35))
    texts = {
        0: f"start here {passage} and more", 1: passage, 2: f"{passage} {passage}", 3: "again " * 70, 4: "again " * 25, 5: None, 6: "", 7: " ".join(f"p{i}" for i in range(19)),
        8: f"other\u00a0white\u2003space \x1c {passage.replace(' ', chr(11))} end", 9: f"P0 {passage}".upper(), 10: " ".join(["p0"] + [f"p{i}" for i in range(1, 20)]),
    }
    sf = tables(documents=spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOCUMENTS).repartition(4))
    got = sorted(tuple(r) for r in substring_dedup.op6_substring_dedup(spark, sf).collect())
    assert got == cut_by_hand(list(texts.items()))


def test_substrings_of_odd_rows(spark):
    docs = odd_documents(spark)
    kept = substring_dedup.with_kept(docs)
    assert kept.columns == [*docs.columns, "n_words", "n_removed"]
    # The long texts repeat themselves every 977 words, and each other. Rows that share an id are in any order, but equal.
    rows_in = sorted(((r.doc_id is not None, r.doc_id or 0), r.text) for r in docs.where("doc_id is not null").collect())
    want = [(n, gone) for _, n, gone, _ in cut_by_hand([(i, t) for (_, i), t in rows_in])]
    found = sorted((r.doc_id, r.n_words, r.n_removed) for r in kept.where("doc_id is not null").collect())
    assert [(n, gone) for _, n, gone in found] == want
    assert {(r.doc_id, r.n_removed) for r in kept.collect()} >= {(6, 30000 - 977), (7, 30000), (None, 0)}
    assert substring_dedup.drop_repeats(docs).columns == docs.columns


def test_clashing_columns(spark):
    docs = clashing(odd_documents(spark))
    for kept in (exact_dedup.drop_copies(docs), jaccard.keep_one(docs), substring_dedup.drop_repeats(docs)):
        assert kept.columns == docs.columns and unharmed(kept)
    assert exact_dedup.copy_groups(docs).count() == docs.count()
    kept = substring_dedup.with_kept(docs)
    assert unharmed(kept, ("n_words", "n_removed")) and {r.n_words for r in kept.collect()} >= {0, 30000}
    judged = url_filter.judge(clashing(spark.createDataFrame([(1, "http://a.com/x", "<p>")], "page_id long, url string, html string")))
    assert unharmed(judged, ("host", "path", "rule", "verdict")) and judged.first().host == "a.com"


def test_a_common_run_in_many_contexts(spark):
    """Its windows don't meet in one bucket, and are still found where they repeat."""
    import random

    import numpy as np
    import pyarrow as pa

    from tidelog.llm.words import Words, run_hashes

    rng = random.Random(3)
    # The run that comes first in the order of minimisers, of many.
    run = min((f"a{i} b{i} c{i} d{i}" for i in range(2000)), key=lambda r: int(run_hashes(Words(pa.array([r])).hashes(), 4)[0]))
    word = lambda: f"w{rng.randrange(100_000)}"
    texts = [" ".join([*(word() for _ in range(25)), run, *(word() for _ in range(25))]) for _ in range(100_000)]
    texts[70_000] = "before " + texts[5]
    rows_in = substring_dedup.staged(spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(8))
    levels = substring_dedup.common_runs(rows_in, 32)
    size = {}
    for name, own in (("plain", np.zeros_like(levels)), ("levels", levels)):
        packed = rows_in.mapInArrow(substring_dedup.packer(32, spark.sparkContext.broadcast(own)), "bucket long, blob binary").where("bucket >= 0")
        found = sorted(r.n for r in packed.groupBy("bucket").agg(F.sum(F.octet_length("blob")).alias("n")).collect())
        size[name] = found[-1] / found[len(found) // 2]
    assert size["plain"] > 5 > 2 > size["levels"]
    found = sorted((r.row, r.start + i) for r in substring_dedup.repeat_intervals(rows_in).collect() for i in range(r.n))
    assert found == [(70_000, 1 + i) for i in range(len(texts[5].split()) - 19)]


def test_equal_hashes_of_other_words_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(substring_dedup, "run_hashes", lambda words, n: np.zeros(max(0, len(words) - n + 1), np.uint64))
    flat = np.array([*range(20), *range(20), *range(1, 21)])
    found = substring_dedup.repeats_in_bucket(flat, np.array([20, 20, 20]), np.array([5, 3, 1]), np.array([0, 0, 7]))
    assert found.tolist() == [[5, 0]]


# Similar sets.


def components_by_hand(docs, words, percent):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + words]) for a in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def near_texts(seed, groups, size):
    import random

    rng = random.Random(seed)
    shared = [f"s{i}" for i in range(40)]
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 12, 60, 150]))]
        if g % 3 == 0:
            base = base[: len(base) // 2] + shared + base[len(base) // 2 :]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["new" + str(rng.randrange(99))], [words[at], "extra"]])
                words = words or ["none"]
            out.append(" ".join(words))
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed, groups, size, words, percent", [(1, 25, 8, 4, 85), (2, 2, 120, 4, 85), (3, 20, 8, 5, 80)])
def test_components_by_hand(spark, seed, groups, size, words, percent):
    docs = [*near_texts(seed, groups, size), (9000, None), (9001, ""), (9002, "one two"), (9003, "ONE two"), (9004, "one two three")]
    rows_in = spark.createDataFrame([(i, i, t) for i, t in docs], "at long, doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.memberships(rows_in, words, percent).collect())
    assert got == components_by_hand(docs, words, percent)


@pytest.mark.parametrize("kind", ["near", "templates", "chain"])
def test_components_of_many_blocks(spark, monkeypatch, kind):
    """Batches, buckets, blocks, chunks and slices all of a few rows."""
    import random

    for name, n in {"HELD": 300, "BUCKET": 200, "MEMBERS": 5, "PARTNERS": 4, "SLICE": 6, "AHEAD": 50, "NARROW": 0}.items():
        monkeypatch.setattr(jaccard, name, n)
    rng = random.Random(11)
    if kind == "near":
        docs = near_texts(5, 6, 30)
    elif kind == "templates":
        passages = [" ".join(f"p{i}w{k}" for k in range(25)) for i in range(9)]
        docs = [(i, " ".join(passages[k] for k in sorted(rng.sample(range(9), 4))) + f" tail {i % 7} {i % 5}") for i in range(150)]
    else:  # each links with the next ones only
        words = [f"w{i}" for i in range(400)]
        docs = [(i, " ".join(words[2 * i : 2 * i + 80])) for i in range(120)]
    rows_in = spark.createDataFrame([(i, i, t) for i, t in docs], "at long, doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.memberships(rows_in, 4, 85).collect())
    assert got == components_by_hand(docs, 4, 85)


def test_answers_from_answers(monkeypatch):
    """Answers that follow from a similar set's are those of whole index lists; and such sets are read by their differences only."""
    import numpy as np

    rng = np.random.default_rng(2)
    rule = jaccard.Rule(4, 80)
    base = np.unique(rng.integers(0, 1 << 62, 300).astype("<u8"))

    def changed(n):
        return np.unique(np.concatenate([rng.permutation(base)[n:], rng.integers(0, 1 << 62, n).astype("<u8")]))

    hosts = [(i, i, changed(n), jaccard.HOST) for i, n in enumerate([0, 5, 20, 35, 60, 90, 200] * 4)]
    block, read = jaccard.Block(hosts, rule), []
    monkeypatch.setattr(block, "listed", lambda own, whole=block.listed: (read.append(len(own)), whole(own))[1])
    for k, n in enumerate([0, 3, 10, 30, 30, 50, 80, 5, 0, 4]):
        own = changed(n)
        got = sorted(b for _, b in block.links(100 + k, 100 + k, own))
        assert got == [i for i, _, h, _ in hosts if 100 * len(np.intersect1d(own, h)) >= 80 * len(np.union1d(own, h))]
    assert read[0] == len(base) and sum(read[1:]) < 9 * len(base) / 1.5
    # Nothing is read where the difference leaves nothing open.
    before = len(read)
    block.links(200, 200, block.kept[-1][0])
    assert len(read) == before


def test_one_of_each_component_is_kept(spark):
    docs = odd_documents(spark)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id or -1) for r in kept.collect())
    assert ids == [-1, -1, 1, 3, 4, 5, 6, 8, 9, 10, 11]


@pytest.mark.parametrize("held", [10, 200_000])
def test_chains_of_links(spark, held):
    from tidelog.llm.components import components

    links = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 40)] + [(7, 7)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    found = [(r.node, r.label) for r in components(frame, held).collect()]
    assert sorted(found) == sorted([(i, 0) for i in range(61)] + [(100 + i, 100) for i in range(40)])
    assert components(frame.limit(0), held).count() == 0


# Urls.


def test_urls(spark, tables):
    urls = {
        1: "http://WWW.Example.com/en/1", 2: "https://a.example.com/en/x?y#z", 3: "http://example.com/en", 4: None, 5: "no scheme", 6: "x://net/es/", 7: "http://dotnet/es/", 8: "http://a.net?/es/",
        9: "http://b.net/fr/://c.com/", 10: "http://192.168.0.1/", 11: "http://shop.co.uk/a", 12: "", 13: "http://a.com", 14: "ftp://É.org/É",
    }
    pages = spark.createDataFrame([(i, u, "<p>", "clash") for i, u in urls.items()], "page_id long, url string, html string, host string")
    sf = tables(pages=pages)
    found = {r.page_id: r for r in url_filter.op3_url_filter(spark, sf).collect()}
    assert rows(url_filter.op3_url_filter(spark, sf)) == rows(oracle(url_filter.SQL, sf))
    assert [(found[i].host, found[i].path, found[i].rule) for i in (1, 2, 3, 4, 6, 7, 8, 9)] == [
        ("www.example.com", "/en/1", "www.example.com/en/"), ("a.example.com", "/en/x", "example.com/en/"), ("example.com", "/en", "com/"), ("", "", None),
        ("net", "/es/", "net/es/"), ("dotnet", "/es/", None), ("a.net", "", None), ("b.net", "/fr/://c.com/", "net/fr/"),
    ]
    assert found[14].host == "É.org"
    judged = url_filter.judge(pages)
    assert judged.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    rows_in = [("a.bad.net", 0)] * 40 + [("b.bad.net", None)] + [("a.good.org", 1)] * 40 + [("b.good.org", None), ("new.info", None)] + [("mixed.com", 1), ("mixed.com", 0)] * 5
    found = {r.host: r.rate for r in url_filter.reputation(spark.createDataFrame(rows_in, "host string, good int")).collect()}
    assert found["a.bad.net"] < found["b.bad.net"] < found["new.info"] < found["b.good.org"] < found["a.good.org"]
