"""Operators 11 to 13 against plain versions: the filter audit, best-fit packing and fill-in-middle."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evigraph.llm import bestfit, filters, fim, queries, units

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, part string, words int, form string, output string, piece int"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def documents(spark, rows):
    """rows: (doc_id, text, source); other columns clash with names that the operators use."""
    return spark.createDataFrame([(i, t, None, s, None, 1, "x", 2, "f", "o", 3) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(11)
    pool = "alpha Beta GAMMA delta é 日本 x#y <P> don't 12.5 -- a\x1cb".split(" ")
    text = lambda k: "".join(rng.choice([" ", "\n", "  ", "\t \r"]) + rng.choice(pool) for _ in range(k))
    rows = [(1, None, "a"), (2, "", ""), (3, " \t\n", None), (4, "one", "a"), (4, "one", "a"), (None, "one", "b"), (None, None, None), (9, "<S>", "b"), (10, "nb  　\n  sp<|endoftext|> end ", "b")]
    rows += [(20 + k, text(rng.randrange(1, 500)), rng.choice("abc")) for k in range(60)]
    rows += [(200 + k, rows[12][1], "hot") for k in range(40)]  # copies
    return rows + [(300, text(200_000), "long"), (301, "w" * 3_000_000, "long"), (302, " " * 1_000_000, "long")]


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2 if i % 3 else None, int(i % 5 == 0)) for i in range(0, 320, 2)] + [(20, 1, 1), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# 11 -------------------------------------------------------------------------------------------------------------
def plain_audit(rows, marks):
    rows = [(i, t or "", s or "") for i, t, s in rows]
    least = defaultdict(lambda: None)
    for i, t, _ in rows:
        if i is not None and (least[t] is None or i < least[t]):
            least[t] = i
    fails = []
    for i, t, part in rows:
        words = re.findall(f"[^{SPACE}]+", t)
        fails.append((part, i, {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i,
        }))
    good, toxic = ({i for i, *m in marks if i is not None and m[k] == 1} for k in (0, 1))
    out, shapley = defaultdict(Counter), Counter()
    for part in {p for p, _, _ in fails}:
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for k, f in enumerate(order):
                gone = [x for x in left if x[2][f]]
                left = [x for x in left if not x[2][f]]
                shapley[part, f] += len(gone)
                here = [x for x in fails if x[0] == part and x[2][f]]
                out[part, "".join(order), k + 1] = (
                    len(left), len(gone), len(here) - len(gone), sum(sum(x[2].values()) == 1 for x in here), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone)
                )
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_audit_is_the_plain_one(spark, odd, labels):
    got = filters.audit(documents(spark, odd), labels).collect()
    want = plain_audit(odd, [tuple(r) for r in labels.collect()])
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want and len(got) == len(want)
    assert filters.audit(documents(spark, []), labels).count() == 0
    unlabelled = filters.audit(documents(spark, odd), labels.filter("false"))
    assert unlabelled.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_copies_are_joined_alike_when_common(spark, odd, labels, monkeypatch):
    """A text in many rows goes by broadcast, the others by shuffle; where the line lies makes no difference."""
    counts = []
    for share in (0.0, 0.02, 1.0):
        monkeypatch.setattr(filters, "COMMON", share)
        rows = filters.with_originals(filters.flagged(documents(spark, odd)).drop("text"))
        counts.append(sorted((r["doc_id"] or -1, r["digest"], r["e"]) for r in rows.collect()))
    assert counts[0] == counts[1] == counts[2]


# 12 -------------------------------------------------------------------------------------------------------------
def one_by_one(sizes, window):
    """Best-fit decreasing, a piece at a time."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in bins if window - sum(b) >= s]
        if fit:
            max(fit, key=sum).append(s)
        else:
            bins.append([s])
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_runs_are_best_fit_decreasing(sizes):
    runs, used = bestfit.best_fit(Counter(sizes), 32)
    bins, seen = defaultdict(list), Counter()
    for s in sorted(sizes, reverse=True):
        of = [r for r in runs.tolist() if r[0] == s and r[1] <= seen[s]][-1]
        t = seen[s] - of[1]
        bins[of[2] + t // of[3]].append((of[4] + t % of[3] * s, s))
        seen[s] += 1
    want = one_by_one(sizes, 32)
    assert used == len(bins) == len(want)
    # equal capacities are ties, so which sequence holds a piece is free; how full they are is not
    assert sorted(sum(s for _, s in b) for b in bins.values()) == sorted(sum(b) for b in want)
    for b in bins.values():
        at = 0
        for offset, s in sorted(b):
            assert offset == at
            at += s
        assert at <= 32


def test_tightest_is_a_search():
    rng = random.Random(4)
    tree, held = bestfit.Capacities(1024), Counter()
    for _ in range(3000):
        c = rng.randrange(1, 1025)
        n = rng.choice([1, -1]) if held[c] else 1
        tree.add(c, n)
        held[c] += n
        s = rng.randrange(1, 1025)
        assert tree.tightest(s) == min((c for c in held if held[c] and c >= s), default=None)


def test_plan_does_not_grow_with_the_corpus():
    rng = random.Random(5)
    few = Counter({s: rng.randrange(1, 50) for s in range(1, 1025)})
    many = Counter({s: 10**7 * n + rng.randrange(10**6) for s, n in few.items()})
    small, large = (bestfit.best_fit(h) for h in (few, many))
    total = sum(s * n for s, n in many.items())
    assert len(large[0]) < 20_000 and large[1] >= -(-total // 1024) and large[1] < 1.01 * total / 1024
    assert len(small[0]) < 20_000


def test_best_fit_pieces(spark, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bestfit.default_tokenizer())
    got = bestfit.pack(documents(spark, odd).repartition(3), with_ids=True).collect()
    want = Counter()
    for i, t, _ in odd:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        at, n = 0, 0
        for end in range(len(ids) % 1024 or 1024, len(ids) + 1, 1024):
            want[i, n, at, end - at, zlib.crc32(np.array(ids[at:end], dtype="<u4")), len(ids)] += 1
            at, n = end, n + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for b in bins.values():
        at = 0
        for offset, length, _ in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) == len(one_by_one([r["length"] for r in got], 1024))
    rows = spark.createDataFrame(got, bestfit.pack(documents(spark, []), with_ids=True).schema)
    made = {r["sequence_id"]: (r["tokens"], bytes(r["ids"])) for r in bestfit.sequences(rows).collect()}
    assert made == {k: (sum(x[1] for x in b), b"".join(x[2] for x in sorted(b))) for k, b in bins.items()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sé日1.,- \n\t\x0b#<|>\x00\x85A"), max_size=30), max_size=6))
def test_units_encode_like_texts(texts):
    e = bestfit.Encoder(bestfit.default_tokenizer())
    texts = [t.replace("\x85", "") for t in texts]  # texts with such white space are encoded whole
    ids, places = e.encode(pa.array(texts, pa.string()))
    plain = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(places, places[1:], strict=False)] == plain


# 13 -------------------------------------------------------------------------------------------------------------
def plain_fim(doc_id, text):
    text = text or ""
    cut = re.findall(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(cut) + 1), h[1] % (len(cut) + 1)))
    p, m, s = "".join(cut[:a]), "".join(cut[a:b]), "".join(cut[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(cut), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(cut), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(cut), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_is_the_plain_one(spark, odd):
    made = fim.transform(documents(spark, odd), keep=["doc_id", "row", "form"])
    assert made.columns == ["doc_id", "row", "form", "n", "form", "prefix_chars", "middle_chars", "output"]
    made = fim.transform(documents(spark, odd))
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r["doc_id"], *tuple(r)[1:6]) for r in got) == Counter((i, *plain_fim(i, t)) for i, t, _ in odd)
    assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((i, t or "") for i, t, _ in odd)
    assert {"plain", "spm", "psm"} == {r["form"] for r in got}
    assert fim.transform(documents(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("ab é日 \n\t"), max_size=12), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=8))
def test_cuts_of_all_rows_together(rows):
    texts = pa.array([t for t, _, _ in rows])
    data, places = units.raw(texts)
    n, a, b = fim.cuts(data, places, *(np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2)))
    for i, (t, one, two) in enumerate(rows):
        cut = re.findall(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+", t)
        low, high = sorted((one % (len(cut) + 1), two % (len(cut) + 1)))
        raw = t.encode()
        assert n[i] == len(cut) and raw[: a[i] - places[i]].decode() == "".join(cut[:low]) and raw[: b[i] - places[i]].decode() == "".join(cut[:high])


def test_stretches_are_whole_texts():
    texts = pa.array(["", "abc", None, "é" * 20, "", "x"]).slice(1)
    assert [s.to_pylist() for s in units.stretches(texts, 5)] == [["abc", ""], ["é" * 20], ["", "x"]]
    for s in units.stretches(texts, 5):
        data, places = units.raw(s)
        assert [bytes(data[a:b]).decode() for a, b in zip(places, places[1:], strict=False)] == s.to_pylist()


def test_new_queries_are_registered():
    assert {"op11_filter_audit", "op12_best_fit", "op13_fim"} <= set(queries.QUERIES)
