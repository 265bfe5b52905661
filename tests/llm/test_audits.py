"""Digest index, filter audit and source divergence beyond their SQL."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotweave.llm import digest_index, filter_audit, hot, source_divergence as sd, term_pointers as tp
from plotweave.llm.textarrays import Texts
from plotweave.session import scratch_path, scratch_scope, shared_dir


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _index(spark):
    place = scratch_path(spark, "index")
    return digest_index.DigestIndex(spark, f"t_{place[-32:]}", buckets=4, location=place)


def _added(index, docs, batch):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["kept"]) for r in index.add(digest_index.digested(docs), batch).collect())


def test_digest_index_over_batches(spark):
    index = _index(spark)
    first = _docs(spark, [(5, "a  b"), (3, "a\tb"), (None, "a b"), (7, ""), (8, None), (8, None), (9, "x")])
    assert _added(index, first, "one") == [(False, 3, True), (False, 5, False), (False, 7, True), (False, 8, False), (False, 8, False), (False, 9, True), (True, 0, False)]
    # what is known stays away, whatever its id; what is new comes once
    second = _docs(spark, [(1, "a b"), (2, "new"), (2, "new"), (None, "nobody"), (None, "nobody")])
    want = [(False, 1, False), (False, 2, False), (False, 2, True), (True, 0, False), (True, 0, True)]
    assert _added(index, second, "two") == want
    # a batch that is added again, as after a failure, changes nothing
    assert _added(index, second, "two") == want
    assert _added(index, second.limit(0), "none") == []
    sizes = {(r["keep_id"], r["group_size"]) for r in index.groups().collect()}
    assert sizes == {(3, 4), (7, 3), (9, 1), (2, 2), (None, 2)}
    small = index.compact(f"{index.name}_c", scratch_path(spark, "index"))
    assert {tuple(r) for r in small.groups().collect()} == {tuple(r) for r in index.groups().collect()}
    assert _added(small, second, "three") == [(a, b, False) for a, b, _ in want]
    small.drop()
    index.drop()


def test_digest_index_is_not_shuffled_for_a_batch(spark):
    index = _index(spark)
    index.add(digest_index.digested(_docs(spark, [(k, f"t{k}") for k in range(50)])), "one")
    plan = index.groups()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    index.drop()


def test_rows_of_large_groups_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(hot, "HOT_KEYS", 4)
    rows = spark.createDataFrame([("h" if k % 2 else f"k{k}", k) for k in range(400)], "key string, v long")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    got = hot.join_groups(rows, groups, "key", "n", 400).collect()
    assert sorted(r["v"] for r in got) == list(range(400))
    assert all(r["least"] == (1 if r["key"] == "h" else r["v"]) for r in got)


def test_prefix_counts_against_sets(spark):
    r = random.Random(4)
    rows = [(k, r.choice("xyz"), r.randrange(2), r.randrange(2)) for k in range(300)]
    fails = {n: {k for k in range(300) if r.random() < p} for n, p in (("P", 0.5), ("Q", 0.1), ("R", 0.0))}
    marked = spark.createDataFrame(rows, "_row long, part string, good int, toxic int")
    tables = {n: spark.createDataFrame([(k,) for k in sorted(ks)], "_row long") for n, ks in fails.items()}
    counts = filter_audit.prefix_counts(marked, tables, 300)
    got = {(x["part"], x["filter_order"], x["step"]): x for x in filter_audit.order_table(counts, list(fails)).collect()}
    assert len(got) == 3 * 6 * 3
    total = Counter()
    for part, order in itertools.product("xyz", itertools.permutations("PQR")):
        alive = {row[0]: row for row in rows if row[1] == part}
        for step, name in enumerate(order, 1):
            mine = {row[0] for row in rows if row[1] == part} & fails[name]
            out = mine & alive.keys()
            x = got[part, "".join(order), step]
            alone = mine - set().union(*[fails[n] for n in fails if n != name])
            want = (len(alive) - len(out), len(out), len(mine - alive.keys()), len(alone), sum(alive[k][2] for k in out), sum(alive[k][3] for k in out))
            assert tuple(x[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")) == want
            total[part, name] += len(out)
            alive = {k: v for k, v in alive.items() if k not in out}
    assert all(x["shapley"] == total[p, o[s - 1]] for (p, o, s), x in got.items())


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_sorted_pointers(seed):
    r = random.Random(seed)
    pool = ["", "a", "aB", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefgh" * 3, "abcdefgh" * 3 + "z", "É", "é", "ß" * 9, "\U0001f600", "Zz", "x" * 500, " y"]
    texts = ["".join(r.choice(pool) + r.choice([" ", "-", "\n", "", "7"]) for _ in range(r.randrange(40))) for _ in range(r.randrange(1, 30))] + ["", "tail"]
    raw = [t.encode() for t in texts]
    border = np.cumsum([0, *map(len, raw)])
    terms = tp.Terms(Texts(np.frombuffer(b"".join(raw), np.uint8), border))
    group = np.array([r.randrange(3) for _ in texts])
    pointer, of, n, docs = tp.counted(terms, group)
    got = {(t, g): (a, b) for t, g, a, b in zip(terms.spelled(pointer).to_pylist(), of.tolist(), n.tolist(), docs.tolist())}
    want = defaultdict(lambda: [0, 0])
    for t, g in zip(texts, group.tolist()):
        for w, k in Counter(_terms(t)).items():
            want[w, g][0] += k
            want[w, g][1] += 1
    assert got == {k: tuple(v) for k, v in want.items()} and len(pointer) == len(want)
    order, run = terms.runs()
    spelled = [s.encode() for s in terms.spelled(order).to_pylist()]
    assert spelled == sorted(spelled)
    assert np.array_equal(np.diff(run) > 0, [a != b for a, b in zip(spelled, spelled[1:])])


@pytest.mark.parametrize("few", [False, True])
def test_divergence_against_plain_sums(spark, monkeypatch, few):
    if few:
        # many shards, and joins by shuffle, give the same
        for name, value in (("SHARD_CELLS", 4), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(sd, name, value)
    r = random.Random(8)
    words = ["the", "THE", "of", "été", "Été", "longishword", "longishwords", "z"] + [f"q{chr(97 + k)}" for k in range(12)]
    rows = [(r.choice(["en", "fr", None]), r.choice(["s1", "s2", "é", None]), " ".join(r.choices(words, k=r.randrange(12)))) for _ in range(80)]
    rows += [("de", "s1", "12 34"), ("de", "s9", None), ("it", "only", "la la"), ("en", "s1", "x" * 3000)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    with scratch_scope(spark):
        terms = sd.term_counts(docs, 5)
        groups, langs = sd.source_groups(docs, terms)
        pairs = {(x["lang"], x["source"], x["item"]): (x["value"], x["rank"]) for x in sd.pair_divergence(terms, groups, langs).collect()}
        top = {(x["lang"], x["source"], x["item"]): (x["value"], x["rank"]) for x in sd.top_terms(terms, groups, langs, 3).collect()}
    count, df, met = Counter(), defaultdict(set), defaultdict(set)
    for k, (lang, source, text) in enumerate(rows):
        met[lang or ""].add(source or "")
        for w in _terms(text or ""):
            count[lang or "", source or "", w] += 1
            df[lang or "", w].add(k)
    want_pairs, want_top = {}, {}
    for lang, sources in met.items():
        kept = sorted(w for (g, w), ds in df.items() if g == lang and len(ds) >= 5)
        n = {s: sum(count[lang, s, w] for w in kept) for s in sources}
        p = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept))
        q = {w: p(sum(count[lang, s, w] for s in sources), sum(n.values())) for w in kept}
        own = {s: {w: p(count[lang, s, w], n[s]) for w in kept} for s in sources}
        for s in sources:
            others = sorted((-sum(abs(own[s][w] - own[o][w]) for w in kept), o.encode()) for o in sources if o != s)
            want_pairs |= {(lang, s, o.decode()): (-v, k) for k, (v, o) in enumerate(others, 1)}
            terms_of = sorted((q[w] - own[s][w], w.encode()) for w in kept if count[lang, s, w] and own[s][w] > q[w])[:3]
            want_top |= {(lang, s, w.decode()): (-v, k) for k, (v, w) in enumerate(terms_of, 1)}
    assert pairs == want_pairs
    assert top == want_top


def test_flushes_and_steps_of_a_task_add_up(monkeypatch):
    r = random.Random(3)
    rows = [(r.choice(["en", None]), r.choice(["s1", "s2"]), " ".join(r.choices(["a", "bb", "ccc", "É"], k=9)) if k % 7 else None) for k in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[k : k + 25])], ["lang", "source", "text"]) for k in (0, 25, 50)]

    def totals():
        out = Counter()
        for b in sd._count_terms(iter(batches)):
            for x in b.to_pylist():
                out[x["lang"], x["term"], "docs"] += x["docs"]
                out[x["lang"], x["term"], "total"] += x["total"]
                for c in x["of"]:
                    out[x["lang"], x["term"], c["source"]] += c["n"]
        return out

    whole = totals()
    assert whole["", "É", "docs"] == sum(1 for lang, _, t in rows if lang is None and "É" in (t or ""))
    groups = pa.table({"lang": ["en"] * 3, "source": ["b", "a", "c"], "bottom": pa.array([50, 70, 40], pa.int64())})
    terms = pa.table({"lang": ["en"] * 4, "of": [[{"source": "a", "n": 3}], [{"source": "c", "n": 9}, {"source": "b", "n": 1}], [], [{"source": "a", "n": 1}]]})
    pairs = sd._pair_sums(groups, terms).to_pylist()
    for name, value in (("GATHERED", 8), ("SLICE", 64), ("CELLS", 3)):
        monkeypatch.setattr(sd, name, value)
    assert totals() == whole
    assert sd._pair_sums(groups, terms).to_pylist() == pairs


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 10), (5, 10), (10**14 + 7, 8 * 10**15 + 3), (123456789012, 9 * 10**14), (0, 9 * 10**15 - 1)]
    want = [1 + 10**9 * (c + 5) // b for c, b in cases]
    assert sd._shares(*(np.array(x, np.int64) for x in zip(*cases))).tolist() == want
    frame = spark.createDataFrame(cases, "c long, b long").coalesce(1).select(sd._share("c", "b").alias("p"))
    assert [r["p"] for r in frame.collect()] == want


def test_queries_leave_only_their_result(spark, tmp_path):
    from plotweave.llm import queries
    from tests.llm import tables

    folder = tables.write(str(tmp_path / "t"))
    import os

    for name in ("op11_exact_dedup", "op12_filter_audit", "op13_source_divergence"):
        before = set(os.listdir(shared_dir(spark)))
        queries.QUERIES[name](spark, folder)
        assert len(set(os.listdir(shared_dir(spark))) - before) == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("plotweave_")]
    assert hashlib.sha256(b"").hexdigest() in {r["text_sha256"] for r in queries.QUERIES["op11_exact_dedup"](spark, folder).collect()}
