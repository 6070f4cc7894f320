from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docengine.llm import components, embedding_lsh, minhash, suffix_dedup
from docengine.llm.common import shingle_hashes


def words(text):
    return (text or "").encode().lower().split()


def sets_of(rows, k):
    out = {}
    for i, text in rows:
        w = words(text)
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(sets, percent):
    names = sorted(sets)
    return classes(names, [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])])


@pytest.mark.parametrize("k", [4, 5])
def test_minhash_is_brute_force(spark, docs, k):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(sets_of(rows, k), 80)
    got = minhash.near_duplicates(docs, k=k).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets_of(rows, k).items()}


def test_crowds_of_near_copies(spark):
    """Copies near their original but not near one another, with and without the original: stars and blocks."""
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(90):
        copy = list(base)
        for at in rng.choice(120, 3 if n % 2 else 5, replace=False):
            copy[at] = f"new{n}x{at}"
        rows.append((n, " ".join(copy)))
    for more in ([], [(500, " ".join(base))]):
        got = minhash.near_duplicates(spark.createDataFrame(rows + more, "doc_id long, text string"), k=4).collect()
        assert {r.doc_id: r.component_id for r in got} == brute(sets_of(rows + more, 4), 80)


def test_minhash_odd_rows(odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert by[8] == {1} and by[6] == {5} and by[2] == {2} and by[None] == {None}
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (6, 8)").count() == 0


def test_densified_bins_agree_with_similarity():
    a = shingle_hashes([b"%d" % i for i in range(400)], 1)
    b = shingle_hashes([b"%d" % i for i in range(40, 440)], 1)
    same = np.mean([minhash.one_permutation(a, 9) == minhash.one_permutation(b, 9)])
    assert abs(same - 360 / 440) < 0.08
    assert (minhash.one_permutation(a[:1]) == a[0]).all()


def test_vectors_are_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    near = base[rng.integers(0, 60, 60)] + rng.standard_normal((60, 16)) * 0.12
    v = np.concatenate([base, near, base[:5], base[:3] * 2]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15), (905, [1.0, None]), (None, v[0].tolist()), (906, [1.0, 2.0])]
    got = embedding_lsh.near_duplicate_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    want = classes(range(len(v)), zip(*np.nonzero(np.triu(link, 1)), strict=True))
    found = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id < 900}
    recall = sum(r.n_links for r in found.values()) / (link.sum() - len(v))
    assert 0.97 <= recall <= 1
    assert sum(found[i].component_id == want[i] for i in found) >= 0.97 * len(found)
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id is None or r.vec_id >= 900)
    assert len(got) == len(rows) + len(odd)


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = classes({x for l in links for x in l}, links)
    assert got == {n: c for n, c in want.items() if n != c}


def brute_repeats(texts, least=50):
    seen = defaultdict(list)
    for i, text in sorted(texts.items()):
        w = (text or "").encode().split()
        for j in range(len(w) - least + 1):
            seen[tuple(w[j : j + least])].append((i, j))
    spans, later = defaultdict(set), defaultdict(set)
    for places in seen.values():
        for n, (i, j) in enumerate(places):
            if len(places) > 1:
                spans[i].update(range(j, j + least))
                if n:
                    later[i].update(range(j, j + least))
    return spans, later


def flat(ranges):
    return {x for r in ranges for x in range(r["start"], r["end"])}


def test_repeats_are_brute_force(spark, docs):
    rng = np.random.default_rng(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    passage = " ".join(f"p{i}" for i in range(70)).split()
    for n in range(60):  # the passage, or a part of it, in many places
        own = [f"d{n}w{i}" for i in range(rng.integers(5, 60))]
        a = int(rng.integers(0, 15))
        texts[10_000 + n] = " ".join(own + passage[a : a + int(rng.integers(45, 70))] + own[::-1])
    texts[20_000] = " ".join(passage * 3)
    spans, later = brute_repeats(texts)
    got = {r.doc_id: r for r in suffix_dedup.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)).collect()}
    assert set(got) == set(spans)
    assert all(flat(got[i].spans) == spans[i] and flat(got[i].later) == later[i] for i in got)


@pytest.mark.parametrize("batch", [1, 2, 100])
def test_runs_are_whole_wherever_partitions_end(batch):
    runs = [(1, 1, 1), (1, 2, 3), (1, 3, 1), (2, 1, 2), (3, 1, 4)]  # first, whole, rows
    rows = [(f, w, 10 * f + w, p, 0, 0) for f, w, n in runs for p in range(n)]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16())
    names = ["first", "whole", "key", "p", "before", "after"]

    def batches(part):
        for i in range(0, len(part), batch):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part[i : i + batch], strict=True), types, strict=True)], names=names)

    for a in range(len(rows) + 1):
        for b in range(a, len(rows) + 1):
            seen = [x for part in (rows[:a], rows[a:b], rows[b:]) for x in suffix_dedup._neighbours(batches(part))]
            edges = {}
            for r in (r for x in seen for r in x.to_pylist() if r["role"] == suffix_dedup.ROLE_EDGE):
                n, *lead = edges.get((r["first"], r["whole"]), (0, 99, 99))
                edges[r["first"], r["whole"]] = (n + 1, *min(tuple(lead), (r["first_key"], r["first_p"])))
            found = [r for x in suffix_dedup._resolve(iter(seen), edges, 50) for r in x.to_pylist()]
            whole = {(r["key"], r["a"], r["later"]) for r in found if not r["extend"]}
            assert whole == {(10 * f + w, p, p > 0) for f, w, n in runs if n > 1 for p in range(n)}
            assert {10 * f + w for f, w, _ in runs if f == 1} <= {r["key"] for r in found if r["extend"]}


def test_repeats_cut_and_odd_rows(odd, empty):
    got = suffix_dedup.drop_repeats(odd)
    assert got.columns == odd.columns
    ids = [r.doc_id for r in got.collect()]
    assert 5 in ids and 6 not in ids  # the later copy has nothing left
    assert suffix_dedup.repeated_passages(empty).count() == 0
    assert suffix_dedup.cut_words(b" a  b\nc d ", [(1, 3)]) == b" a  d "


def test_columns_named_like_those_of_the_operator(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, f"a {passage} b", 7, True), (2, f"c {passage} d", 8, None), (3, None, 9, False)], "doc_id long, text string, spans long, later boolean")
    got = {r.doc_id: tuple(r) for r in suffix_dedup.drop_repeats(rows).collect()}
    assert got == {1: (1, f"a {passage} b", 7, True), 2: (2, "c d", 8, None), 3: (3, None, 9, False)}
