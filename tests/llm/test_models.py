"""Operators against brute force, libraries, or held-out labels; the mix has SQL as well."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOCUMENTS, SF, clashing, odd_documents, unharmed
from tidelog.llm import ann, bpe, language_id, mixing, quality, toxicity
from tidelog.llm.catalog import QUERIES

LABELS = "doc_id long, quality int, toxic int"

# Mixing.


def targets_by_hand(sizes):
    """Reshare the excess of capped sources until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    fixed, budget = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left = budget - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def seats_by_hand(claims, n):
    seats = {k: 0 for k in claims}
    for _ in range(n):
        best = max(sorted(claims), key=lambda k: claims[k] / (2 * seats[k] + 1))
        seats[best] += 1
    return seats


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_by_hand(spark, seed):
    rng = random.Random(seed)
    claims = {i: rng.choice([0.0, 1.0, rng.random() * 100, 5000.0]) + 0.001 * i for i in range(rng.choice([1, 3, 17]))}
    n = rng.choice([0, 1, 7, 200])
    frame = spark.createDataFrame([(k, v, n) for k, v in claims.items()], "k int, claim double, n long")
    found = {r.k: r.seats for r in mixing.apportion(frame, [], "claim", "seats", "n", ["k"]).collect()}
    if sum(claims.values()) > 0:
        assert found == seats_by_hand(claims, n)


def mix_by_hand(spark, docs):
    """docs: rows of doc_id, text and source. Words taken of each row, and its whole copies; only the seeded hashes are Spark's."""
    text = F.col("text").cast("string")
    hashed = docs.select("doc_id", "text", "source", mixing.deal_of(F.col("doc_id"), text).alias("deal"), mixing.place_of(F.col("doc_id"), text).alias("place")).collect()
    seen = [(("s" + r.source) if r.source is not None else "n", r.deal, r.place, len((r.text or "").encode().split()), r.doc_id) for r in hashed]
    sizes = {}
    for key, _, _, size, _ in seen:
        sizes[key] = sizes.get(key, 0) + size
    by_source = lambda k: (k == "n", k)
    targets = {("n" if s is None else "s" + s): t for s, t in targets_by_hand({None if k == "n" else k[1:]: v for k, v in sizes.items()}).items()}
    order = sorted((k for k in sizes if targets[k] > 0), key=by_source)
    seats = {k: n for k, n in zip(order, seats_by_hand(dict(enumerate(targets[k] for k in order)), round(sum(targets.values()) / 16)).values(), strict=True)}
    count = {k: min(mixing.SHARDS, max(1, v // mixing.SHARD_WORDS)) for k, v in sizes.items()}
    rings = {}
    for r in seen:
        rings.setdefault((r[0], r[1] % count[r[0]]), []).append(r)
    starts = {(r.k, r.s): r.h for r in spark.createDataFrame(list(rings), "k string, s int").select("k", "s", mixing.seeded(F.lit("run"), F.col("k"), F.col("s")).alias("h")).collect()}
    copy = {r.p: r.h % (1 << 20) / (1 << 20) for r in spark.createDataFrame([(r[2],) for r in seen], "p long").select("p", mixing.seeded(F.lit("copy"), F.col("p")).alias("h")).collect()}
    taken, copies = {}, {}
    for key in sizes:
        words = {s: sum(r[3] for r in own) for (k, s), own in sorted(rings.items()) if k == key}
        most = {s: -(-2 * w // 16) for s, w in words.items()}
        quota = dict.fromkeys(words, 0)
        for _ in range(seats.get(key, 0)):
            free = [s for s in quota if words[s] and quota[s] < most[s]]
            if free:
                quota[max(free, key=lambda s: (words[s] / (2 * quota[s] + 1), -s))] += 1
        for s, w in words.items():
            own, at = sorted(rings[key, s], key=lambda r: (r[2], r[3])), 0
            run = min(16 * quota[s], 2 * w)
            start = starts[key, s] % -(-w // 16) * 16 if w else 0
            for r in own:
                # Word by word, on the ring.
                got = sum(1 for x in range(at, at + r[3]) for lap in range(4) if start <= x + lap * w < start + run)
                taken.setdefault(r[4], []).append((r[3], got))
                whole, part = divmod(got, r[3]) if r[3] else (0, 0)
                copies[r[4]] = copies.get(r[4], 0) + min(2, whole + (part > 0 and part / r[3] > copy[r[2]]))
                at += r[3]
    return {k: sorted(v) for k, v in taken.items()}, copies


@pytest.mark.parametrize("kind", ["table", "three words", "four words", "one source", "many small"])
def test_mix_by_hand(spark, documents, kind, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 700)
    rng = random.Random(7)
    if kind == "table":
        docs = documents.where("doc_id < 300").select("doc_id", "text", "source")
    else:
        source = {"three words": lambda i: "a" if i < 900 else "b", "four words": lambda i: "abc"[min(2, i // 334)], "one source": lambda i: "a", "many small": lambda i: f"s{i % 40}" if i % 41 else None}[kind]
        words = {"three words": lambda i: 3, "four words": lambda i: 4, "one source": lambda i: rng.randrange(0, 30), "many small": lambda i: rng.randrange(1, 12)}[kind]
        docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(99)}" for _ in range(words(i))), source(i)) for i in range(1200)], "doc_id long, text string, source string")
    want, copies = mix_by_hand(spark, docs)
    found = mixing.take(docs).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.size, r.taken))
    assert {k: sorted(v) for k, v in got.items()} == want
    for s in {r.source for r in found}:
        own = [r for r in found if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target + 32
    mixed = {r.doc_id: r["count"] for r in mixing.mixed(docs).groupBy("doc_id").count().collect()}
    assert mixed == {k: n for k, n in copies.items() if n}


def test_mix_meets_its_targets(spark, documents):
    taken = mixing.take(documents.select("doc_id", "text", "source")).toPandas()
    by = taken.groupby("source", dropna=False)
    want = targets_by_hand(by["size"].sum().to_dict())
    for source, group in by:
        assert group["source_size"].iloc[0] == group["size"].sum()
        assert group["target"].iloc[0] == pytest.approx(want[source])
        assert abs(group["taken"].sum() - want[source]) <= 0.01 * want[source] + 32
    assert (taken["taken"] <= 2 * taken["size"]).all()
    again = mixing.take(documents.select("doc_id", "text", "source").repartition(13)).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == taken.sort_values("doc_id")["taken"].tolist()
    mixed = mixing.mixed(documents)
    assert mixed.columns == documents.columns
    words = mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == pytest.approx(taken["target"].groupby(taken["source"]).first().sum(), rel=0.06)


def test_texts_are_not_shuffled_by_the_mix(spark, documents):
    plan = mixing.mixed(documents)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_mix_of_odd_rows(spark, tables):
    docs = odd_documents(spark)
    clash = docs.withColumn("Size", F.lit("clash")).withColumn("__key", F.lit("own")).withColumn("row", F.lit("own")).withColumn("shard", F.lit("own"))
    found = mixing.take(clash)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "__key", "row", "shard", "size", "source_size", "target", "taken"]
    found = found.collect()
    assert len(found) == docs.count()
    assert all(0 <= r.taken <= 2 * r.size and (r["__key"], r["row"], r["shard"]) == ("own", "own", "own") for r in found)
    assert {r.source: r.source_size for r in found}[None] == 30000
    assert mixing.mixed(clash).columns == clash.columns
    sf = tables(documents=docs.limit(0))
    assert QUERIES["op4_mix_sources"](spark, sf).count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.take(docs.where("text is null")).select(F.sum("taken")).first()[0] == 0
    assert mixing.mixed(docs.where("text is null")).count() == 0


# Nearest neighbours.


def nearest_by_hand(rows, top=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        some = np.flatnonzero(score >= np.partition(score, max(0, len(score) - top - 1))[max(0, len(score) - top - 1)] - 1e-9)
        order = [k for k in some[np.lexsort((ids[some], -score[some].round(9)))] if ids[k] != ids[i]][:top]
        out[int(ids[i])] = [(int(ids[k]), float(score[k])) for k in order]
    return out


def found_by(spark, frame):
    rows = ann.clean(frame, "vec_id", "embedding")
    out = {}
    for r in ann.nearest(rows, rows.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_shards_are_bounded_by_bytes():
    for n in (0, 1, 500, 5000, 60_000, 10**6, 10**8):
        for d in (2, 64, 768, 4096):
            shards = ann.shards_of(n, 8 * d)
            assert n * 8 * d / shards <= ann.SHARD_BYTES and (shards == 1 or n / shards >= 512 or n * 8 * d > ann.SHARD_BYTES)


@pytest.mark.parametrize("n, d", [(8192, 384), (20_000, 64)])
def test_recall_of_one_graph(n, d):
    """Random directions, the hardest case: the beam is as wide as they ask for."""
    rng = np.random.default_rng(1)
    x, queries = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(n, d)), rng.normal(size=(100, d))))
    graph = ann.Graph(ann.lifted(x))
    found, _ = graph.beam(np.column_stack([queries, np.zeros(100)]).astype(np.float32), graph.width, ring=True)
    best = np.argsort(-(queries @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20].tolist()) & set(b.tolist())) / 20 for a, b in zip(found, best, strict=True)]) >= 0.95


@pytest.mark.parametrize("kind", ["table", "norms", "copies", "many"])
def test_recall(spark, kind, monkeypatch):
    rng = np.random.default_rng(3)
    if kind == "table":
        monkeypatch.setattr(ann, "BLOCK_BYTES", 10_000)
        frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    elif kind == "many":
        n, d = 50_000, 64
        x = rng.normal(size=(n, d)) + 1.5 * rng.normal(size=(200, d))[rng.integers(0, 200, n)]
        import pandas as pd

        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
        frame = ann.staged(spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)})))
    else:
        x = rng.normal(size=(1500, 16))
        if kind == "norms":
            x *= rng.lognormal(0, 0.5, size=(1500, 1))
        else:
            x[::3] = x[0]
        frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    want = nearest_by_hand([(r.vec_id, r.embedding) for r in frame.select("vec_id", "embedding").collect()])
    got = found_by(spark, frame)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9
    if kind == "copies":  # the copies tie: the smallest ids come first
        assert [i for i, _ in got[0]] == [3 * k for k in range(1, 21)]
    for q in want:
        true = dict(want[q])
        assert all(s == pytest.approx(true[i], abs=1e-12) for i, s in got[q] if i in true)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0]), (20, [-0.0, 2.0]), (40, None), (1, [0.5, 0.5])]
    got = found_by(spark, spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<double>, vec string"))
    assert got == {0: [(1, 0.5), (20, 0.0), (9, -1.0)], 20: [(1, 1.0), (0, 0.0), (9, 0.0)]}
    wide = found_by(spark, spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e-200, 1.0]), (2, [-1e150, 3.0])], "vec_id long, embedding array<double>"))
    assert wide == {0: [(1, 1.0), (2, -1e200 * 1e150)]}
    assert found_by(spark, spark.createDataFrame([], "vec_id long, embedding array<double>")) == {}
    assert found_by(spark, spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")) == {}


# Tokens.


def test_tokens_match_the_library(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.VOCABULARY)
    docs = documents.select("doc_id", "text").unionByName(odd_documents(spark).select((F.monotonically_increasing_id() + 10000).alias("doc_id"), "text"))
    docs = docs.unionByName(spark.createDataFrame([(20000, "a<|endoftext|> b<|endoftext|><|endoftext|>c"), (20001, "\x00\u2003 \u00a0x\r\n\n  y '\u2019s 1²½ \U0001f600")], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.round_trip(docs).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_columns_of_ids(spark):
    docs = odd_documents(spark).withColumn("ids", F.lit("clash"))
    out = bpe.encode_documents(docs).withColumn("back", bpe.decoded(F.col("ids")))
    assert all((r.text or "") == r.back and r.n_tokens * 4 == len(r.ids) for r in out.collect())
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_stale_entries_are_skipped():
    # Of "aaa" only one pair of two merges; the other entry is stale by then.
    ranks, results = {0 << bpe.ID_BITS | 0: 0, 1 << bpe.ID_BITS | 0: 1}, [1, 2]
    assert bpe.merged([0, 0, 0], ranks, results) == [2]
    assert bpe.merged([0, 0, 0, 0], ranks, results) == [1, 1]
    assert bpe.merged([], ranks, results) == []


def test_old_pieces_come_back(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    codec = bpe.Codec(bpe.VOCABULARY)
    words = "one two three four one two five six one seven one"
    assert codec.encode(words) == bpe.Codec(bpe.VOCABULARY).encode(words) and codec.decode(codec.encode(words)) == words
    assert len(codec.pieces) <= 3 and len(codec.pieces.old) <= 3
    codec.pieces.forget()
    assert not codec.pieces and not codec.pieces.old


# Languages.


def test_languages_held_out(spark, documents):
    found = QUERIES["op8_language_id"](spark, SF).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert len(found) == documents.count() and len(held) > 100
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.97
    assert found["score"].between(0, 1).all()


def test_languages_of_odd_texts(spark, documents, tables):
    languages, model = language_id.learn(documents)
    found = {r.doc_id: r for r in language_id.predict(odd_documents(spark).withColumn("score", F.lit("clash")), languages, model).collect()}
    assert {found[i].lang_pred for i in (3, 4, 5, 10)} == {"und"}
    assert found[1].lang_pred in languages
    half = {lang: " ".join(r.text for r in documents.where(F.col("lang") == lang).limit(6).collect())[:6000] for lang in ("en", "de")}
    both = language_id.predict(spark.createDataFrame([(" ".join(half.values()),)], "text string"), languages, model).first()
    assert set(both.lang_shares) == {"en", "de"} and 0.35 < both.lang_shares["en"] < 0.65
    assert QUERIES["op8_language_id"](spark, tables(documents=odd_documents(spark).withColumn("lang", F.lit(None).cast("string")))).where("lang_pred != 'und'").count() == 0
    assert QUERIES["op8_language_id"](spark, tables(documents=spark.createDataFrame([], DOCUMENTS))).count() == 0


# Toxicity and quality.


def labelled(spark, name, column):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return QUERIES[name](spark, SF), labels.select("doc_id", F.col(column).alias("label"))


def test_toxicity_held_out(spark, documents):
    found, labels = labelled(spark, "op2_toxicity", "toxic")
    assert found.count() == documents.count()
    held = found.join(labels, "doc_id").where("held_out").toPandas()
    assert ((held["score"] >= 0.5) == held["label"]).mean() >= 0.95
    # Six of the held-out documents are toxic, and one has no word that any other toxic one has.
    toxic, clean = held[held["label"] == 1]["score"], held[held["label"] == 0]["score"]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.85
    assert found.where("score < 0 or score > 1 or predicted != cast(score >= 0.5 as int)").count() == 0


def test_quality_held_out(spark, documents):
    found, labels = labelled(spark, "op10_quality", "quality")
    assert found.count() == documents.count()
    held = found.join(labels, "doc_id").where("held_out").toPandas()
    assert (held["keep"] == (held["label"] == 1)).mean() >= 0.95


@pytest.mark.parametrize("name", ["op2_toxicity", "op10_quality"])
def test_models_without_much_to_learn_from(spark, tables, name):
    docs = odd_documents(spark)
    for labels in ([], [(1, 1, 0), (2, 1, 0)], [(1, 1, 0), (2, 0, 1), (3, None, None), (99, 1, 1), (4, 0, 0), (4, 0, 0)]):
        sf = tables(documents=docs, labels=spark.createDataFrame(labels, LABELS))
        assert QUERIES[name](spark, sf).count() == docs.count()
    sf = tables(documents=spark.createDataFrame([], DOCUMENTS), labels=spark.createDataFrame([], LABELS))
    assert QUERIES[name](spark, sf).count() == 0


def test_one_grade(spark):
    docs = odd_documents(spark)
    for label, expected, tail, keep in ((0, 0.0, 0.0, False), (1, 1.0, 1.0, True), (None, None, None, True)):
        labels = spark.createDataFrame([(i, label, 0) for i in (1, 2, 4)], LABELS)
        found = quality.score(docs, quality.learned(docs, labels)).select("expected_grade", "tail_probability", "keep").distinct().collect()
        assert [tuple(r) for r in found] == [(expected, tail, keep)]


def test_clashing_columns(spark, documents):
    docs = clashing(odd_documents(spark).unionByName(documents.limit(50)))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learned(documents, labels)
    assert unharmed(quality.score(docs, model), ("expected_grade", "tail_probability", "keep"))
    assert unharmed(quality.keep_good(docs, model)) and quality.keep_good(docs, model).columns == docs.columns
    assert unharmed(toxicity.score(docs, toxicity.learned(documents, labels)), ("score", "predicted"))
    found = language_id.predict(docs, *language_id.learn(documents))
    assert unharmed(found, ("lang_pred", "score", "lang_shares")) and found.where("LANG_PRED = 'en'").count() > 0
    assert unharmed(bpe.encode_documents(docs), ("ids", "n_tokens")) and unharmed(bpe.round_trip(docs), ("n_tokens", "ids_sha256", "decoded_sha256"))
    assert unharmed(mixing.take(docs), ("size", "source_size", "target", "taken")) and unharmed(mixing.mixed(docs))
    vectors = clashing(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>"))
    assert ann.clean(vectors, "vec_id", "embedding").count() == 30


def test_three_grades():
    rng = np.random.default_rng(0)
    kinds = ["zzz qqq xxx", "zzz abc def", "abc def ghi"]
    grades = rng.integers(0, 3, 300)
    texts = [" ".join(rng.permutation((kinds[g] + " mmm nnn").split())) for g in grades]
    model = quality.fit([quality.features(t) for t in texts], grades, {0: 0.2, 1: 0.3, 2: 0.5})
    assert (np.diff(model.thresholds) >= 0).all()
    expected = [model.above(t).sum() for t in texts]
    assert np.mean([np.mean(np.array(expected)[grades == g]) for g in (0, 1)]) < np.mean(np.array(expected)[grades == 2])
    assert np.corrcoef(expected, grades)[0, 1] > 0.9


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    raw = toxicity.raw_scores(x, toxicity.boost(x, y))
    assert ((raw > 0) == y).mean() > 0.95
    at, level = toxicity.isotonic(raw, y, np.ones(600))
    assert (np.diff(at) >= 0).all() and (np.diff(level) >= 0).all() and 0 < level.min() < level.max() < 1
