import numpy as np

from docengine.llm import components, media


def candidates(spark, monkeypatch, codes):
    """Number of pairs that match_recordings() aligns, and its classes."""
    pairs, align = [], media.align_pairs
    monkeypatch.setattr(media, "align_pairs", lambda p, *a: (pairs.append(p.count()), align(p, *a))[1])
    prints = spark.createDataFrame([(i, x.view(np.int32).tolist()) for i, x in enumerate(codes)], "rec_id long, codes array<int>")
    return {r.rec_id: r.component_id for r in media.match_recordings(prints).collect()}, sum(pairs)


def codes_of(spark, vectors):
    songs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    return [np.array(r.codes, np.int32).view(np.uint32) for r in media.fingerprints(media.render_vectors(songs)).orderBy("rec_id").collect()]


def flipped(rng, x, share=0.06):
    return x ^ np.bitwise_or.reduce((rng.random((len(x), 32)) < share).astype(np.uint32) << np.arange(32, dtype=np.uint32), axis=1)


def test_unrelated_recordings_are_seldom_compared(spark, monkeypatch):
    got, n = candidates(spark, monkeypatch, codes_of(spark, np.random.default_rng(21).standard_normal((500, 64))))
    assert n <= 75 and len(got) == 500


def test_a_group_of_near_copies_is_not_compared_by_all_its_buckets(spark, monkeypatch):
    rng = np.random.default_rng(22)
    song = codes_of(spark, rng.standard_normal((1, 64)))[0]
    got, n = candidates(spark, monkeypatch, [flipped(rng, song, 0.02) for _ in range(150)])
    assert set(got.values()) == {0} and n <= 3 * 150


def members(monkeypatch, *runs):
    """Members of all shared buckets in each of the runs."""
    made, build = [], media.shared_buckets
    monkeypatch.setattr(media, "shared_buckets", lambda *a: (out := build(*a), made.append(out.count()))[0])
    return [(made.clear(), run(), sum(made))[2] for run in runs]


def test_near_copies_and_strangers_share_few_buckets(spark, monkeypatch):
    rng = np.random.default_rng(25)
    songs = codes_of(spark, rng.standard_normal((500, 64)))
    copies = [flipped(rng, songs[0], 0.02) for _ in range(150)]
    near, strange = members(monkeypatch, lambda: candidates(spark, monkeypatch, copies), lambda: candidates(spark, monkeypatch, songs))
    assert near <= 40 * 150 and strange <= 75


def test_noisy_copies_of_short_recordings_are_found(spark, monkeypatch):
    rng = np.random.default_rng(23)
    songs = codes_of(spark, rng.standard_normal((60, 64)))
    long, short = songs, [flipped(rng, x[12:32]) for x in songs]
    got, _ = candidates(spark, monkeypatch, [*long, *short])
    planted = [i for i in range(60) if media.matches(long[i], short[i], media.align(long[i], short[i]))]
    assert len(planted) >= 50 and np.mean([got[60 + i] == got[i] for i in planted]) >= 0.8


def test_joined_components(spark):
    rng = np.random.default_rng(24)
    links = [tuple(map(int, x)) for x in rng.integers(0, 80, (60, 2))]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(components.connected_components(frame(links), "a", "b"))
    assert rows(components.joined_components(components.connected_components(frame(links[:30]), "a", "b"), frame(links[30:]))) == want
