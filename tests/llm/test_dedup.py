"""Exact and near deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import check
from tidewater.llm import components, exact_dedup, near_dedup, shingles
from tidewater.llm.base import shared_dir, tasks_for

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = max(known) if known else None, True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out[i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def test_exact_sql(spark, sf_dir, duck):
    check(exact_dedup.op7_exact_dedup(spark, sf_dir), duck, exact_dedup.OP7_SQL)


@pytest.mark.parametrize("rounds", [1, 3])
def test_exact_odd(odd, none, rounds):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = Counter(tuple(r) for r in exact_dedup.exact_groups(odd, rounds).collect())
    assert found == brute_exact(rows)
    assert exact_dedup.exact_groups(none).collect() == []


def test_exact_stage_keeps_one_row_each(odd):
    left = exact_dedup.drop_exact_copies(odd)
    assert left.columns == odd.columns
    texts = [(r.text or "").translate(LOWER) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({(r.text or "").translate(LOWER) for r in odd.collect()})


def test_exact_merges_sorted_runs_in_binomial_rounds(spark):
    """Every round sorts by owner and digest, and hands an entry to the partner that differs in that round's bit."""
    rng = random.Random(2)
    entries = [(p, bytes([d]), rng.randrange(99), 0, 100 * p + d, 1, 7, 7, d % 8) for p in range(8) for d in rng.sample(range(60), 25)]
    runs = spark.createDataFrame(entries, "owner int, digest binary, top_id bigint, top_mark bigint, top_row bigint, members bigint, n_bytes bigint, check bigint, home int")
    for rounds in range(4):
        level = exact_dedup.merged_runs(runs, rounds, 4)
        plan = level._jdf.queryExecution().executedPlan().toString()
        assert len([x for x in plan.split("Initial Plan")[-1].split("\n") if "Sort [owner#" in x and "digest#" in x]) == rounds
        want = defaultdict(lambda: [0, (-1, -1)])
        for p, d, i, _, row, n, _, _, home in entries:
            low = (1 << rounds) - 1
            entry = want[(p & ~low) | (home & low), d]
            entry[0] += n
            entry[1] = max(entry[1], (i, row))
        found = {(r.owner, bytes(r.digest)): [r.members, (r.top_id, r.top_row)] for r in level.collect()}
        assert found == dict(want)
    assert len(found) == len({d for _, d, *_ in entries})


def test_exact_stage_is_repeatable(spark):
    """Rows that repeat an id and differ in case or other columns: the same one stays whatever the partitioning."""
    rows = [(1, "Same text", "a"), (1, "same text", "b"), (1, "same text", "c"), (2, "x", "d"), (None, "x", "e"), (None, None, "f"), (None, "", "g"), (3, "", "h"), (3, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, size string")
    kept = [sorted(map(tuple, exact_dedup.drop_exact_copies(docs.repartition(n)).collect()), key=str) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 3


def test_exact_different_texts_raise(spark):
    """Entries that share a digest but not the other checks are an error."""
    from pyspark.sql import functions as F

    entries = spark.createDataFrame(
        [(0, b"d", 1, 0, 0, 1, 5, 7, 0), (1, b"d", 2, 0, 1, 1, 6, 7, 0)],
        "owner int, digest binary, top_id bigint, top_mark bigint, top_row bigint, members bigint, n_bytes bigint, check bigint, home int",
    )
    with pytest.raises(Exception, match="different texts"):
        exact_dedup._merge(entries, F.lit(0), 2).collect()


# -- near ---------------------------------------------------------------------------


def shingle_set(text):
    w = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)]) if w else frozenset()


def brute_near(rows):
    """doc_id to (set size, smallest reachable id), by a prefix-filtered join of all sets."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    often = Counter(g for s in sets.values() for g in s)
    index = defaultdict(list)
    for i in sorted(sets, key=lambda i: len(sets[i])):
        s = sorted(sets[i], key=lambda g: (often[g], g))
        near = set()
        for g in s[: len(s) - -(-8 * len(s) // 10) + 1]:
            near.update(index[g])
            index[g].append(i)
        for k in near:
            both = len(sets[i] & sets[k])
            if 100 * both >= 80 * (len(s) + len(sets[k]) - both):
                a, b = find(i), find(k)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_brute(documents):
    want = brute_near([(r.doc_id, r.text) for r in documents.collect()])
    found = near_dedup.near_components(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_hot_groups(spark):
    """A large group of near copies of one text, with borderline members, and one of exact copies."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    base = rng.sample(words, 160)
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(rng.randrange(12)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((1000 + i, " ".join(t)))
    rows += [(5000 + i, " ".join(base[:80])) for i in range(300)]
    passage = rng.sample(words, 60)
    rows += [(9000 + i, " ".join(passage + rng.sample(words, 60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(docs).collect()}
    assert found == brute_near(rows)


def stock_families(seed, n, families=1, pool=40, own_words=40):
    """Documents of shared stock paragraphs and own words, and copies of some at a similarity just above the threshold."""
    rng = random.Random(seed)
    rows, planted = [], []
    for f in range(families):
        paragraphs = [[f"s{f}p{k}w{rng.randrange(3000)}" for _ in range(20)] for k in range(pool)]
        for i in range(n):
            words = [w for p in rng.sample(paragraphs, 3) for w in p] + [f"o{f}d{i}x{rng.randrange(10**6)}" for _ in range(own_words)]
            rows.append((f * 10**6 + i, " ".join(words)))
            if i % 6 == 0:  # 88 of 97 + 11 shingles are shared: 0.815
                copy = [*words[:-9], *(f"c{f}d{i}x{rng.randrange(10**6)}" for _ in range(9))]
                rows.append((f * 10**6 + 500_000 + i, " ".join(copy)))
                planted.append((rows[-2][0], rows[-1][0]))
    return rows, planted


def test_near_stock_paragraphs(spark):
    """Buckets whose centre resembles neither of two similar members."""
    rows, planted = stock_families(5, 500, families=2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(docs).collect()}
    assert len(planted) == 168 and all(found[a][1] == found[b][1] for a, b in planted)
    assert found == brute_near(rows)


@pytest.mark.parametrize("depth", [0, 1])
def test_near_crowded_buckets(spark, monkeypatch, depth):
    """Buckets of many documents that are alike but unlinked are dealt anew, or compared in blocks."""
    monkeypatch.setattr(near_dedup, "FEW", 2)
    monkeypatch.setattr(near_dedup, "DEPTH", depth)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(6)
    stock = [f"w{k}" for k in range(140)]
    rows = []
    for i in range(60):
        words = stock + [f"d{i}x{k}" for k in range(24)]
        rows.append((i, " ".join(words)))
        if i % 5 == 0:
            rows.append((1000 + i, " ".join([*words[:-3], *(f"c{i}x{k}" for k in range(3))])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(docs).collect()}
    assert found == brute_near(rows)


def test_near_rows_that_share_an_id(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (7, b + " more"), (9, c), (9, None)]
    found = near_dedup.near_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True), (9, 9, True)]


def test_shingle_hashes_have_no_algebraic_collisions():
    """Thue-Morse words collide under every polynomial hash modulo a power of two."""
    for n in (512, 1024, 2048, 4096):
        word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
        other = word.translate(str.maketrans("ab", "ba"))
        one, two = shingles.shingle_sets(pa.array([f"x {word} y z", f"x {other} y z"]))
        assert one.tolist() != two.tolist()


def test_near_odd(odd, none):
    found = near_dedup.near_components(odd).collect()
    assert len(found) == odd.count()
    by = {(r.doc_id, r.n_shingles): r for r in found if r.doc_id is not None}
    assert by[1, 17].component_id == by[2, 17].component_id == by[3, 18].component_id == 1
    assert by[4, 0].kept and by[5, 0].kept and by[6, 0].kept and by[7, 1].kept
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)
    assert near_dedup.near_components(none).collect() == []
    left = near_dedup.drop_near_copies(odd)
    assert left.columns == odd.columns and [r.doc_id for r in left.collect()].count(1) == 1


def test_near_copies_of_texts_that_share_an_id(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(5, a), (5, b), (3, b + " more"), (7, c), (7, d), (7, c), (9, d + " more"), (10, c + " more"), (None, a), (None, a)]
    left = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter([(5, a), (3, b + " more"), (7, c), (7, d), (None, a), (None, a)])


def test_near_tables_are_written_by_few_tasks(spark):
    """However many partitions a shuffle has, a small table isn't written by all of them; links are the same."""
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(120)]
    rows = [(3 * k + j, " ".join([*base[: 60 - j], *["tail"] * j])) for k, base in enumerate(bases) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    folder = Path(shared_dir(spark).removeprefix("file://")) / "tidewater"
    before = set(folder.glob("near-*"))
    settings = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = {r.doc_id: r.component_id for r in near_dedup.near_components(docs).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = {p.name.rpartition("-")[0]: len(list(p.glob("part-*"))) for p in folder.glob("near-*") if p not in before}
    assert {"near-members", "near-links", "near-torn", "near-parts-least", "near-nodes"} <= set(files)
    assert max(files.values()) <= tasks_for(spark, len(rows), near_dedup.DOCS_A_TASK) == 4
    assert found == {3 * k + j: 3 * k for k in range(len(bases)) for j in range(3)}
    assert tasks_for(spark, 100_001, 10_000) == 11  # grows with the rows


def test_components_chain(spark):
    edges = [(0, k, k + 1) for k in range(60)] + [(1, k, k + 2) for k in range(0, 40, 2)] + [(1, 101, 100)]
    found = components.connected(spark.createDataFrame(edges, "kind int, a bigint, b bigint")).collect()
    assert {(r.kind, r.node): r.root for r in found} == {(0, k): 0 for k in range(61)} | {(1, k): 0 for k in range(0, 41, 2)} | {(1, 100): 100, (1, 101): 100}


def test_shingles_equal_brute_force(documents):
    texts = [r.text for r in documents.collect()] + ["", " ", "a", "A b", "a b c d", "a  b\tc\nd e", "x y z w x y z w x", "É é É é"]
    for text, found in zip(texts, shingles.shingle_sets(pa.array(texts)), strict=True):
        assert len(found) == len(shingle_set(text))


def test_estimates_and_merging():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**64, 3000, np.uint64)
    for shared in (0.5, 0.8, 0.95):
        a, b = np.sort(pool[:1000]), np.sort(np.concatenate([pool[: int(1000 * shared)], pool[2000 : 3000 - int(1000 * shared)]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ra, rb = (np.frombuffer(shingles.registers(x), "<u2")[None] for x in (a, b))
        est = shingles.estimate(ra, rb, np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(est - true) < 4.5 * (true * (1 - true) / shingles.REGISTERS) ** 0.5 + 0.01
        union = np.frombuffer(shingles.registers(np.union1d(a, b)), "<u2")
        assert (union == np.maximum(ra[0], rb[0])).all()
