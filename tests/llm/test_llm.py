"""The corpus operators against plain versions, on small fixtures with nulls, empty, long, equal and clashing rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from evigraph.llm import common, components, langid, lm, mixing, neardup, packing, pii, queries, sharding, simhash, topk, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, label int"
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), 5, 0.5, 1) for i, t, l, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    words = "alpha beta gamma delta der die und le la des".split()
    random.seed(3)
    long = " ".join(random.choice(words) for _ in range(6000))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, long, "en", "a"), (5, long, "en", "b"), (5, long, "en", "b"), (6, "One two three four.", "de", "b"), (7, "one TWO three four.", "fr", None), (8, "1234 !!", "en", "c"), (9, "ÀÉ ﬁ x\x1cy 日本 <|endoftext|>", None, "c")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def small():
    return duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    """The odd rows, and empty tables, as tables to read."""
    root = tmp_path_factory.mktemp("odd")
    odd.write.parquet(f"{root}/rows/documents.parquet")
    odd.filter("false").write.parquet(f"{root}/none/documents.parquet")
    labels = spark.createDataFrame([(i, None if i == 3 else 1, None if i == 2 else i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    vectors = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0, 0.0], 1), (8, [], 1), (100, [0.5, 0.5], 2)]
    v = spark.createDataFrame([(i, x, y, "x") for i, x, y in vectors], "vec_id long, embedding array<float>, label int, node string")
    for name, keep in (("rows", True), ("none", False)):
        labels.filter(F.lit(keep)).write.parquet(f"{root}/{name}/labels.parquet")
        v.filter(F.lit(keep)).write.parquet(f"{root}/{name}/embeddings.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows_and_empty_tables(spark, folder, name):
    rows = queries.QUERIES[name](spark, f"{folder}/rows").collect()
    assert rows
    assert queries.QUERIES[name](spark, f"{folder}/none").collect() == []
    if name not in ("op2_packing", "op4_neardup", "op5_topk", "op11_filter_audit", "op12_best_fit"):
        assert len(rows) == 10


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    order = sorted(got.columns)
    got, want = (x[order].sort_values(order).fillna(-1).values.tolist() for x in (got, want))
    assert got == want


# 1 ---------------------------------------------------------------------------------------------------------------
def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for rank, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or "", flags=re.A):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


TRICKY = [
    "a@b.c_d@e.f x..y@z.com.", "a@b a@@b.c .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111-1111 1111 4111111111111111111111 4111111111111111 5", "+1 (234) 567-8901 +12 +1234567890123456 +1()()2345678901 ++4912345678",
    "é😀 mail a@b.de, 10.0.0.1 tel +49 (30) 1234567", "john (at) mail (dot) com call 555-123-4567 x", "a" * 5000 + "@" + "b" * 5000, "1" * 5000, "1.1.1.1 " * 300, "+" * 3000 + "1 2", "1 1 1 1 1 1 1 1-1-1-1-1-1-1-1",
]


def test_pii_base_is_that_of_the_plain_patterns(spark, small):
    texts = TRICKY + [t for _, t in small] + [None, ""]
    got = {r["doc_id"]: r for r in pii.find(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (i, want, got[i]["spans"])
        spans = got[i]["spans"].split(",")
        assert set(want.split(",")) <= set(spans) or not want
        assert [got[i][f"n_{k}"] for k in KINDS] == [want.count(f"{k}:") for k in KINDS]
    assert "email:5:28" not in got[6]["spans"] and got[6]["spans"]


def test_pii_plan_is_native(spark):
    d = pii.redacted_documents(documents(spark, [(1, "write to a@b.de or +49 30 12345678", "en", "s"), (2, None, "en", "s"), (3, "nothing", "en", "s")]))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert {r["doc_id"]: r["text"] for r in d.collect()} == {1: "write to <EMAIL> or <PHONE>", 2: None, 3: "nothing"}


# 2 ---------------------------------------------------------------------------------------------------------------
def test_packing_is_a_partition_of_all_ids(spark, odd, small):
    from tokenizers import Tokenizer

    docs = documents(spark, [(i, t, "en", "s") for i, t in small]).unionByName(odd.filter("doc_id <> 5").withColumn("doc_id", F.col("doc_id") + 10_000))
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    pieces, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, shard_docs=20).collect():
        pieces[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids)
    for i, rows in pieces.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            part = np.array(ids[i][at : at + r["length"]], dtype="<u4")
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(part.tobytes()), len(ids[i]))
            at += r["length"]
        assert at == len(ids[i])
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0  # whole, or a power of two: no padding


def bags_of(rests):
    return [np.unique(r, return_counts=True) for r in rests]


def test_packing_puts_like_with_like():
    rng = np.random.default_rng(1)
    topics = [np.arange(k * 1000, k * 1000 + 300) for k in range(4)]
    rests = [rng.choice(topics[k % 4], 1000).astype("<u2") for k in range(32)]
    idf = np.ones(1 << 16)
    whole = [s for s in packing.pack_shard(rests, bags_of(rests), np.full(32, 1000), idf, 1000.0) if len(s) > 3]
    assert all(len({d % 4 for d, _, _ in s}) <= 2 for s in whole)


def test_packing_fills_in_the_order_of_plain_bm25():
    rng = np.random.default_rng(2)
    rests = [rng.integers(0, 60, rng.integers(300, 900)).astype("<u2") for _ in range(25)]
    counts = [Counter(r.tolist()) for r in rests]
    idf = np.zeros(1 << 16)
    for t in range(60):
        df = sum(t in c for c in counts)
        idf[t] = math.log1p((25 - df + 0.5) / (df + 0.5))
    mean = float(np.mean([len(r) for r in rests]))

    def bm25(q, d):
        return sum(idf[t] * counts[d][t] * 2.2 / (counts[d][t] + 1.2 * (0.25 + 0.75 * len(rests[d]) / mean)) for t in counts[q])

    left = {d: len(r) for d, r in enumerate(rests)}
    for sequence in packing.pack_shard(rests, bags_of(rests), np.array([len(r) for r in rests]), idf, mean):
        seed = sequence[0][0]
        assert seed == min(d for d in left if left[d])
        ranked = [seed, *sorted((d for d in left if left[d] and d != seed), key=lambda d: (-round(bm25(seed, d), 9), d))]
        assert [d for d, _, _ in sequence] == ranked[: len(sequence)]
        for d, _, k in sequence:
            left[d] -= k
    assert not any(left.values())


def test_packing_shards_hold_neighbours_and_split_repeats(spark):
    """Near texts meet in a shard though their ids say nothing; rows of one id and text fill several shards."""
    rng = random.Random(4)
    topics = [[f"{chr(97 + k)}{''.join(rng.choices('bcdfg', k=5))}" for _ in range(60)] for k in range(20)]
    rows = [(i, " ".join(rng.choices(topics[i % 20], k=40)), "en", "s") for i in range(400)]
    docs = documents(spark, rows)
    tokens = packing.tokenized(docs, packing.default_tokenizer()).withColumn("row", F.monotonically_increasing_id()).cache()
    count = packing.frequencies(tokens)
    place = {r["doc_id"]: r["place"] for r in packing.placed(tokens, packing.draws(np.log1p((400 - count + 0.5) / (count + 0.5)), count)).collect()}
    order = sorted(place, key=lambda i: (place[i], i * 7919 % 400))
    same = sum(a % 20 == b % 20 for x in range(0, 400, 40) for k, a in enumerate(order[x : x + 40]) for b in order[x : x + k])
    pairs = 10 * 40 * 39 / 2
    assert same / pairs > 3 * (19 / 399)
    hot = documents(spark, [(None, "one and the same", "en", "s")] * 300 + [(7, "x", "en", "s")] * 300)
    got = packing.pack(hot, shard_docs=20).collect()
    assert len(got) >= 600 and sum(r["length"] for r in got) == 300 * 5 + 300 * 2
    assert len({r["sequence_id"] >> 36 for r in got}) > 1


def test_encoder_is_the_tokenizer():
    import pyarrow as pa

    encoder = packing.Encoder(packing.default_tokenizer())
    rng, letters = random.Random(1), list("abzABZ éÉñß'stredvlm019.,!?<|>\t\n\x0b\x1c\x1f\x85\xa0 ª²½µÿŸİıſKǅ́Å中あ😀\x00\x7f$%_-")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(3000)]
    texts += [f"x <|endoftext|> {t}I'll don't WE'VE 'S's" for t in texts[:100]] + [None, "", "a" * 20_000]
    for t, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert encoder.tokenizer.encode(t or "", add_special_tokens=False).ids == ids.tolist()


def test_runs_are_encoded_once_a_worker(monkeypatch):
    texts = pa.array(["Some words, some more words: élève 12a", None, "words élève"])
    want = [i.tolist() for i in packing.Encoder(packing.default_tokenizer()).encode(texts)]
    kept = packing.encoder(packing.default_tokenizer())
    assert [i.tolist() for i in kept.encode(texts)] == want
    monkeypatch.setattr(kept, "model", None)  # the next task of the worker asks nothing
    assert [i.tolist() for i in packing.encoder(packing.default_tokenizer()).encode(texts)] == want
    packing.encoder.cache_clear()
    monkeypatch.setattr(packing, "CACHE", 2)
    few = packing.Encoder(packing.default_tokenizer())
    assert [i.tolist() for i in few.encode(texts)] == want and len(few) == 2


# 3 ---------------------------------------------------------------------------------------------------------------
def test_toxicity_learns_held_out_words():
    rng = random.Random(5)
    bad, words = ["vilefoo", "vilebar", "vilequx"], [f"w{i}" for i in range(300)]

    def text(toxic):
        w = [rng.choice(words) for _ in range(60)]
        if toxic:
            w[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "x", "y"])
        return " ".join(w)

    labels = [i % 4 == 0 for i in range(600)]
    texts = [text(t) for t in labels]
    m = toxicity.train(texts[:480], [int(x) for x in labels[:480]], ["en"] * 480)
    z, lang = toxicity.logits(m, *toxicity.Vocabulary(m["hashes"]).index(texts[480:]))
    assert ((z >= m["threshold"][lang]) == np.array(labels[480:])).mean() > 0.95
    assert toxicity.train(texts, [0] * 600, ["en"] * 600) is None


def test_toxicity_is_a_plain_convolution():
    """Logits against embeddings, filters and maxima written out word by word."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["vile", "kind", "thing", "words", "people", "bad"], k=rng.randint(0, 9))) for _ in range(60)]
    m = toxicity.train(texts, [int("vile" in t) for t in texts], ["en"] * 60)
    vocabulary = toxicity.Vocabulary(m["hashes"])
    z, _ = toxicity.logits(m, *vocabulary.index(texts))
    for t, got in zip(texts, z, strict=True):
        x = [m["E"][list(vocabulary[w])].sum(axis=0) for w in toxicity.words(t)] + [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
        n, features = len(x) - max(toxicity.WIDTHS) + 1, []
        for w in toxicity.WIDTHS:
            windows = [np.concatenate(x[i : i + w]) @ m[f"W{w}"] + m[f"b{w}"] for i in range(n)]
            features.append(np.max(windows, axis=0))
        assert got == pytest.approx(float(np.maximum(np.concatenate(features), 0) @ m["u"] + m["c"][0]), abs=1e-4)


def test_toxicity_finds_held_out_documents(spark):
    """Of the labelled documents that it doesn't learn from, most toxic ones are found and few others."""
    sf = "/root/testdata/sf0.1"
    got = queries.op3_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic"), "doc_id").select("toxic", "predicted").collect()
    toxic = [r["predicted"] for r in got if r["toxic"] == 1]
    clean = [r["predicted"] for r in got if r["toxic"] == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_toxicity_chunks_do_not_change_scores(monkeypatch):
    m = toxicity.train(["a b c", "a b d", "x y z", "x y w"] * 20, [1, 1, 0, 0] * 20, ["en", "de"] * 40)
    docs = toxicity.Vocabulary(m["hashes"]).index(["a b c " * 50, "", None, "x y z a"])
    whole = toxicity.logits(m, *docs)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    parts = toxicity.logits(m, *docs)
    assert np.allclose(whole[0], parts[0])


# 4, 5 ------------------------------------------------------------------------------------------------------------
def test_neardup_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [centres[i % 40] + rng.normal(size=16) * (0.02 if i % 3 else 0.4) for i in range(400)] + [centres[0]] * 30
    labels = [i % 40 % 3 for i in range(400)] + [0] * 30
    ids = list(range(len(rows)))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, [float(x) for x in np.float32(r)], l) for i, r, l in zip(ids, rows, labels, strict=True)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df).collect()}
    u = np.array(rows, dtype=np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)) & ~np.eye(len(rows), dtype=bool)
    best = np.array(ids)
    while True:
        following = np.minimum(best, np.where(linked, best[None, :], 1 << 40).min(axis=1))
        if (following == best).all():
            break
        best = following
    right = sum(got[i]["n_links"] == linked[k].sum() and got[i]["component_id"] == best[k] and got[i]["kept"] == (best[k] == i) for k, i in enumerate(ids))
    assert right >= 0.99 * len(ids)
    assert all(got[i]["n_links"] <= linked[k].sum() for k, i in enumerate(ids))


def test_neardup_is_its_sql_for_labels_of_any_type(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 8))
    vectors = [(i, [float(x) for x in base[i % 12] + rng.normal(size=8) * (0.02 + 0.03 * (i % 5))]) for i in range(150)]
    for kind, label in (("double", lambda i: [1.2, 1.4, 1.0, 2.0][i % 4]), ("string", lambda i: ["a", "b", "1"][i % 3])):
        v = spark.createDataFrame([(i, e, None if i % 50 == 7 else label(i // 12)) for i, e in vectors], f"vec_id long, embedding array<float>, label {kind}")
        v.write.parquet(f"{tmp_path}/{kind}")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/{kind}/*.parquet'")
        want = sorted(con.sql(queries.OP4_SQL).fetchall())
        assert sorted(tuple(r) for r in neardup.near_duplicates(spark.read.parquet(f"{tmp_path}/{kind}")).collect()) == want
        assert any(n for _, n, _, _ in want) and len({c for _, _, c, _ in want}) < 150


def test_neardup_links_tight_clumps(spark):
    rng = np.random.default_rng(6)
    rows, centre = [], rng.normal(size=16)
    centre /= np.linalg.norm(centre)
    side = rng.normal(size=16)
    side -= side @ centre * centre
    side *= 0.15 / np.linalg.norm(side)
    for k in range(80):  # 40 and 40, at cosine 0.989 across, one label; each list of 12 is full of its own clump
        rows.append((k, [float(x) for x in centre + (k % 2) * side + rng.normal(size=16) * 0.001], 0))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(79, 0)}


def test_neardup_compares_all_where_the_search_misses(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(60, 16))
    v[30:] = v[:30] + rng.normal(size=(30, 16)) * 0.01
    nothing = lambda nodes, *_: nodes.sparkSession.createDataFrame([], "a long, b long, sim float")
    monkeypatch.setattr(neardup, "first_graph", nothing)
    df = spark.createDataFrame([(i, [float(x) for x in r], 0) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == {i: (1, i % 30) for i in range(60)}


def test_neardup_audit_counts_nodes(spark, monkeypatch):
    """A clump of 300 whose links are all found, and 300 pairs, which are lost: most nodes with links are not whole."""
    monkeypatch.setattr(neardup, "SEEN", 100)
    rng = np.random.default_rng(8)
    clump = rng.normal(size=32) + rng.normal(size=(300, 32)) * 0.01
    base = rng.normal(size=(300, 32))
    v = np.concatenate([clump, base, base + rng.normal(size=(300, 32)) * 0.01, rng.normal(size=(900, 32))])
    rows = [(i, i % 300 % 3 + 1 if i >= 300 else 0, [float(x) for x in r], 1) for i, r in enumerate(v)]
    nodes = spark.createDataFrame(rows, "node long, label long, e array<double>, copies long")
    counts = nodes.filter("node < 300").select("node", F.lit(299).cast("long").alias("links"))
    inside = nodes.filter("node < 300").select("node")
    share, short = neardup.audit(nodes, inside, counts, 0.98, 1)
    assert 0.2 < share < 0.5 and short == [1, 2, 3]
    every = counts.unionAll(nodes.filter("node between 300 and 899").select("node", F.lit(1).cast("long")))
    assert neardup.audit(nodes, inside, every, 0.98, 1) == (1.0, [])


def test_neardup_compares_short_labels_only(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(60, 16))
    v[30:] = v[:30] + rng.normal(size=(30, 16)) * 0.01
    real, seen = neardup.strong, []
    # edges of one label are lost
    monkeypatch.setattr(neardup, "first_graph", lambda nodes, *a, f=neardup.first_graph: f(nodes.filter("label = 0"), *a))
    monkeypatch.setattr(neardup, "compare", lambda members, t, f=neardup.compare: seen.append({r[0] for r in members.select("label").distinct().collect()}) or f(members, t))
    df = spark.createDataFrame([(i, [float(x) for x in r], i % 30 // 15) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int")
    report = {}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df, report=report).collect()}
    assert got == {i: (1, i % 30) for i in range(60)}
    assert seen[-1] == {1} and report["compared"] == 1 and report["recall"] < 0.9 and real is neardup.strong


def test_neardup_rare_pairs_end_by_descent(spark):
    """One pair in a hundred vectors: the audit can tell, and nothing is compared whole."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(3000, 24))
    v[:30] = v[30:60] + rng.normal(size=(30, 24)) * 0.02
    df = spark.createDataFrame([(i, [float(x) for x in r], 0) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int")
    report = {}
    got = {r["vec_id"]: r["component_id"] for r in neardup.near_duplicates(df, report=report).filter("n_links > 0").collect()}
    assert got == {i: i % 30 for i in range(60)} and report == {"recall": 1.0, "compared": 0}


def test_topk_odd_vectors(spark, folder):
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in queries.op5_topk(spark, f"{folder}/rows").collect()}
    assert {v for q, v in got if q == 0} == {1, 3, 6, 100} and got[0, 100] == 1024 * 512
    assert sum(1 for r in queries.op5_topk(spark, f"{folder}/rows").collect() if (r["query_id"], r["vec_id"]) == (0, 1)) == 2


def test_topk_refuses_what_would_wrap(spark):
    made = lambda x: topk.search(spark.createDataFrame([(0, [x, 1.0]), (1, [x, 2.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert [r["score"] for r in made(1e6).collect()] == [1024 * 1024 * (10**12 + 2)]
    with pytest.raises(Exception, match="too large"):
        made(1e17).collect()


def test_topk_stops_only_on_proof():
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(2000, 12)) * 300).astype(np.int64)
    block = topk.Block(np.arange(2000), v)
    for q in range(0, 2000, 100):
        ids, score = block.search(q, v[q], 10, -np.inf)
        want = np.lexsort((np.arange(2000), -(v @ v[q])))
        assert list(ids[np.lexsort((ids, -score))[:10]]) == [x for x in want if x != q][:10]
    big = topk.Block(np.arange(3), np.array([[1 << 27], [2], [-(1 << 27)]]))
    assert dict(zip(*[x.tolist() for x in big.search(0, np.array([1 << 27]), 10, -np.inf)], strict=True)) == {1: 1 << 28, 2: -(1 << 54)}


# 6 ---------------------------------------------------------------------------------------------------------------
def test_lm_counts(spark, small, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 2e-3)
    docs = documents(spark, [(i, t, "en", "s") for i, t in small] + [(900, None, "en", "s"), (901, "ÀA a b", "en", "s")])
    rows = {r["doc_id"]: r for r in lm.score(docs, F.col("doc_id") % 7 != 2, ["doc_id"]).collect()}
    counts = Counter()
    texts = dict(small) | {900: None, 901: "ÀA a b"}
    for i, t in texts.items():
        if i % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        w = [*(t or "").encode().lower().split(), None]
        assert rows[i]["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert rows[i]["score"] < 0


def test_lm_scores_do_not_depend_on_tasks_and_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = None
    for parts in (1, 4, 16):
        rows = {r["doc_id"]: r for r in lm.score(docs.repartition(parts, "n_chars"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2, ["doc_id"]).collect()}
        if seen:
            assert all(abs(rows[i]["score"] - r["score"]) <= 1e-6 * abs(r["score"]) for i, r in seen.items())
        seen = rows
    held = [r for i, r in seen.items() if zlib.crc32(str(i).encode()) % 7 == 2]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.1


def test_lm_is_the_plain_model(spark, monkeypatch):
    """Scores against sums over all words, written out, and probabilities that add up to one."""
    monkeypatch.setattr(lm, "LEAST", 3)
    rng = random.Random(2)
    words = ["aa", "ba", "ca", "ab", "bb", "cb", "ccc", "d"]
    docs = documents(spark, [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))), "en", "s") for i in range(60)] + [(60, "once twice", "en", "s")])
    kept = {}
    for name in ("train_classes", "train_words", "Symbols"):
        def keep(*args, name=name, real=getattr(lm, name)):
            kept[name] = real(*args)
            return kept[name]
        monkeypatch.setattr(lm, name, keep)
    rows = lm.score(docs, F.lit(True), ["doc_id", "text"]).collect()
    w, symbols = kept["train_classes"] | kept["train_words"], kept["Symbols"]
    counts = Counter(x for r in rows for x in r["text"].split())
    common = [x.decode() for x in symbols.common.to_pylist()]
    c_all = symbols.classes + 1

    def chances(before, skipped):
        z = np.array([w["bias"][c] + w["before"][before, c] + w["skip"][skipped, c] + w["pair"][before * lm.PAIRS + int(lm.pair_of(np.array([skipped]))[0]), c] for c in range(c_all)])
        of_class, out = np.exp(z) / np.exp(z).sum(), {}
        for c in range(c_all):
            own = np.flatnonzero(symbols.of_class == c)
            cell = lm.cell_of(np.array(before), symbols.place[own], w["cells"][c])
            e = np.exp(w["word"][own] + w["u"][w["at"][c] + cell])
            out |= dict(zip(own.tolist(), of_class[c] * e / e.sum()))
        return out

    assert sum(chances(3, 5).values()) == pytest.approx(1)
    for r in rows[:8] + rows[-1:]:
        total, before, skipped = 0.0, symbols.classes, symbols.classes
        for x in [*r["text"].split(), None]:
            c = symbols.classes if x is None else zlib.crc32(x[-2:].encode()) % symbols.classes
            s = 0 if x is None else 1 + common.index(x) if x in common else 1 + len(common) + c
            p = chances(before, skipped)[s]
            if s > len(common):
                tail = [k for k in counts if k not in common and zlib.crc32(k[-2:].encode()) % symbols.classes == c]
                p *= (counts[x] + 1) / (sum(counts[k] for k in tail) + len(tail) + 1)
            total, before, skipped = total + math.log10(p), c, before
        assert r["score"] == pytest.approx(total, rel=1e-5)


# 7 ---------------------------------------------------------------------------------------------------------------
def test_langid_held_out_accuracy(spark):
    got = queries.op7_langid(spark, DATA).toPandas().merge(duckdb.sql(f"SELECT doc_id, lang, n_chars FROM '{DATA}/documents.parquet'").df(), on="doc_id")
    held = got[got.held_out & (got.n_chars > 100)]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_langid_is_plain_compression(spark):
    """Dictionaries, sizes and the choice, written out with zstandard alone."""
    import zstandard

    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 40").select("doc_id", "text", "lang")
    raw = langid.learn(docs.filter("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in langid.predict(docs, raw, ["doc_id"]).collect()}
    for r in docs.collect():
        data = f" {r['text'].lower()} ".encode()
        sizes = {}
        for lang, d in raw.items():
            book = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(data[i : i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK))
        ranked = sorted(sizes, key=lambda x: (sizes[x], list(raw).index(x)))
        margin = sizes[ranked[1]] - sizes[ranked[0]]
        assert got[r["doc_id"]]["lang_pred"] == ranked[0]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - math.exp(-margin / langid.SCORE_SCALE))
        assert got[r["doc_id"]]["rejected"] == (margin < langid.MIN_MARGIN * sizes[ranked[1]])


def test_langid_dictionaries_hold_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "BYTES", 3200)
    rng = random.Random(4)
    texts = {i: "".join(rng.choice("abcdé ") for _ in range(rng.choice([20, 60, 80, 2000]))) for i in range(300)}
    lang = lambda i: "long" if len(texts[i]) > 1000 and i % 2 else "xy"[i % 2]
    rows = [(i, t, lang(i), "s") for i, t in texts.items()] + [(500, "z" * 5000, "huge", "s"), (501, None, "x", "s")]
    made = langid.learn(documents(spark, rows))
    assert set(made) == {"x", "y", "long", "huge"} and made["huge"] == b""
    for name, raw in made.items():
        assert len(raw) <= 3200 and all(t in {x.lower() for x in texts.values()} for t in raw.decode().split("\n") if t)
    assert all(len(made[x]) > 3000 and max(map(len, made[x].decode().split("\n"))) <= 100 for x in "xy")
    assert len(made["long"]) >= 2000


def test_langid_und_and_ties():
    c = langid.Classifier({"en": b"the and with from " * 20, "de": b"der die und nicht " * 20})
    assert c.predict(None) == c.predict("123 !!") == c.predict("") == ("und", 0.0, True)
    assert c.predict("der die und nicht der die und nicht der")[0] == "de"
    assert c.predict("zq") == ("en", 0.0, True)
    assert langid.Classifier({}).predict("the")[0] == "und"


# 8, 9, 10 --------------------------------------------------------------------------------------------------------
def test_water_filling_is_the_iteration(spark):
    rng = random.Random(7)
    sizes = {f"s{k:02d}": rng.choice([0, 1, 10, 1000, 50_000]) for k in range(9)} | {None: 70}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df).collect()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate([*sorted(x for x in sizes if x), None])}
    target, left, open_ = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    for _ in range(100):
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - 2 * sizes[s]) for s in sizes)
        target = {s: min(t, 2 * sizes[s]) for s, t in target.items()}
        open_ = {s for s in sizes if target[s] < 2 * sizes[s]}
        if left <= 0 or not open_:
            break
    assert got == pytest.approx(target)


def test_mix_takes_its_targets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mixing.mix(docs).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    assert (got.taken <= 2 * got["size"]).all()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).toPandas()
    assert dict(zip(words.source, words.n, strict=True)) == got.groupby("source").taken.sum().to_dict()


def test_sharding_balances_and_numbers(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.unionByName(docs.limit(1).crossJoin(spark.range(150)).withColumn("doc_id", F.col("id") + 10_000).drop("id"))  # a hot group
    got = sharding.shard(docs).toPandas()
    assert got.law.unique().tolist() == ["bytes"] and got.grown_shard.isna().all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(zlib.crc32(texts[i].encode()) == c and len(texts[i].encode()) + 1 == s for i, c, s in zip(got.doc_id, got.text_crc32, got["size"], strict=True))
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() < 1.2 * sizes.mean()
    v = np.random.default_rng(0).integers(1, 100, (500, 3)).astype(float)
    load = np.zeros((8, 3))
    np.add.at(load, sharding.place(v, 8), v)
    assert (load.max(axis=0) < 1.03 * load.mean(axis=0)).all()


def test_sharding_tears_only_what_no_shard_can_hold(spark):
    rows = [(i, "hot text", "en", "s") for i in range(200)] + [(1000 + i, f"text {i % 30:03d}", "en", "s") for i in range(90)] + [(2000 + i, f"lone text {i}", "en", "s") for i in range(60)]
    got = sharding.shard(documents(spark, rows), units=64).collect()
    shards, sizes = defaultdict(set), Counter()
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert len(got) == 350 and len(shards[zlib.crc32(b"hot text")]) > 1
    assert all(len(shards[zlib.crc32(f"text {i:03d}".encode())]) == 1 for i in range(30))
    assert max(sizes.values()) <= 1.05 * sum(sizes.values()) / 8


def test_sharding_splits_one_row_that_repeats(spark):
    rows = [(7, "again and again", "en", "s")] * 3000 + [(None, None, "en", "s")] * 500 + [(i, f"text {i}", "en", "s") for i in range(2500)]
    got = sharding.shard(documents(spark, rows)).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(sizes.values()) <= 1.05 * sum(sizes.values()) / 8
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_places_by_the_plain_rule():
    rng = np.random.default_rng(3)
    v = rng.integers(1, 60, (80, 3)).astype(float)
    share = v / v.sum(axis=0)
    room, want = [[1 / 8] * 3 for _ in range(8)], {}
    for i in sorted(range(80), key=lambda i: (-max(share[i]), i)):
        dot = [sum(a * b for a, b in zip(room[k], share[i])) for k in range(8)]
        fit = [k for k in range(8) if all(a >= b - 1e-12 for a, b in zip(room[k], share[i]))] or range(8)
        k = max(fit, key=lambda k: (dot[k], -k))
        want[i] = k
        room[k] = [a - b for a, b in zip(room[k], share[i])]
    assert sharding.place(v, 8).tolist() == [want[i] for i in range(80)]


def plain_print(text, n=3):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark, small, odd):
    extra = [(50_000 + i, small[3][1].replace(" the ", " The ", 1) + (" z" * (i % 3)), "en", "s") for i in range(6)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in small] + extra).unionByName(odd.filter("doc_id <> 5").withColumn("doc_id", F.col("doc_id") + 90_000))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {r["doc_id"]: plain_print(r["text"]) for r in docs.collect()}
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: r["fingerprint"] for i, r in got.items()}
    ids = sorted(prints)
    root = {i: i for i in ids}
    for _ in range(5):
        for i in ids:
            root[i] = min(root[j] for j in ids if (prints[i] ^ prints[j]).bit_count() <= 2)
    assert {i: r["component_id"] for i, r in got.items()} == root
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root.values()))


def test_index_finds_every_pair():
    rng = np.random.default_rng(9)
    tails = np.unique(np.concatenate([rng.integers(0, 1 << 32, 300, dtype=np.uint64), (rng.integers(0, 1 << 32, 5, dtype=np.uint64)[:, None] ^ (np.uint64(1) << rng.integers(0, 32, (5, 40), dtype=np.uint64))).ravel()])).astype(np.uint32)
    group = np.arange(len(tails)) % 3
    order = np.lexsort((simhash.gray_rank(tails), group))
    group, tails = group[order], tails[order]
    found = {(i, j) for a, b in simhash.linked_pairs(group, tails, 2) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(len(tails)) for j in range(i + 1, len(tails)) if group[i] == group[j] and (int(tails[i]) ^ int(tails[j])).bit_count() <= 2}
    assert found == want


def test_links_across_all_blocks(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(40)}
    prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in list(prints) for _ in range(5)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert set(got) == want and len(got) == len(want)


def test_components_on_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    random.Random(3).shuffle(edges)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# pipeline --------------------------------------------------------------------------------------------------------
def test_pipeline_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/rows/documents.parquet")
    columns = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, f"{folder}/rows")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    first = corpus_pipeline.identify_language(spark, real, DATA)
    assert first.count() >= 0.95 * real.count()
    second = corpus_pipeline.near_dedup(spark, first, DATA)
    prints = [plain_print(r["text"]) for r in second.collect()]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
    third = corpus_pipeline.redact(spark, second, DATA)
    assert all(not base_spans(r["text"]) for r in third.collect())


def test_pipeline_keeps_odd_columns_and_long_texts(spark, tmp_path):
    """Names with dots and case, names that stages use themselves, null and repeated ids, and a text of megabytes."""
    rng = random.Random(6)
    text = lambda k: " ".join(rng.choices("the of and to in that is was for with alpha beta gamma delta".split(), k=k))
    rows = [(i, text(30), "en", "s") for i in range(20)] + [(None, text(20), "en", "s"), (None, None, "en", None), (3, text(25), "en", "s"), (30, text(600_000), "en", "t")]
    docs = documents(spark, rows).drop("size", "score", "label")
    for k, name in enumerate(["meta.url", "SCORE", "__spans", "__size", "__bucket", "__key", "__head", "__nth", "__least", "first_id", "box", "nth", "head", "Rejected", "a`b"]):
        docs = docs.withColumn(name, F.lit(k))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        got = docs.collect()
        assert all([*r][5:] == list(range(15)) for r in got)
        assert {30, None} <= {r["doc_id"] for r in got}
    assert max(len(r["text"] or "") for r in got) > 2_000_000
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_drops_planted_near_copies(spark):
    rng = random.Random(8)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    words = [f"word{i}" for i in range(3000)]
    rows = {}
    for k in range(40):
        text = [rng.choice(words) for _ in range(200)]
        for copy in range(6):
            t = list(text)
            for _ in range(copy * (1 + k % 2)):
                t[rng.randrange(200)] = rng.choice(words)
            rows[100 * k + copy] = " ".join(t)
    root = {i: i for i in rows}
    sets = {i: shingles(t) for i, t in rows.items()}
    pairs = [(i, j) for i in rows for j in rows if i < j and i // 100 == j // 100 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(6):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    got = corpus_pipeline.near_dedup(spark, documents(spark, [(i, t, "en", "s") for i, t in rows.items()]), DATA)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root.values()))
    assert len(set(root.values())) < 0.6 * len(rows)


def test_pipeline_sends_texts_to_python_in_small_batches(spark):
    docs = spark.range(1500, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat("id", F.lit(" word ")), 1000).alias("text"), F.lit("en").alias("lang"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    try:
        corpus_pipeline.identify_language(spark, docs, "")
        got = [r["n"] for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
        assert len(got) > 1 and max(got) < 2 * common.BATCH and sum(got) > 2 * common.BATCH
        spark.conf.set(common.BATCH_SETTING, "1m")  # a session's own setting stays
        common.small_batches(spark)
        assert spark.conf.get(common.BATCH_SETTING) == "1m"
    finally:
        spark.conf.unset(common.BATCH_SETTING)
