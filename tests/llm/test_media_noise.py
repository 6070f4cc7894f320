import numpy as np

from docengine.llm import media

N = 80


def test_noisy_copies_are_found(spark):
    """Against align() over all pairs, with no regard to keys."""
    rng = np.random.default_rng(8)
    songs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.standard_normal((N, 64)))], "vec_id long, embedding array<double>")
    codes = {r.rec_id: np.array(r.codes, np.int32).view(np.uint32) for r in media.fingerprints(media.render_vectors(songs)).collect()}
    for i in range(N):
        flips = (rng.random((len(codes[i]), 32)) < 0.06).astype(np.uint32) << np.arange(32, dtype=np.uint32)
        codes[100 + i] = codes[i] ^ np.bitwise_or.reduce(flips, axis=1)
    prints = spark.createDataFrame([(k, v.view(np.int32).tolist()) for k, v in codes.items()], "rec_id long, codes array<int>")
    got = {r.rec_id: r.component_id for r in media.match_recordings(prints).collect()}
    planted = [i for i in range(N) if (found := media.align(codes[i], codes[100 + i])) and found[1] <= media.MAX_BIT_ERROR]
    assert len(planted) >= 0.9 * N and np.mean([got[100 + i] == got[i] for i in planted]) >= 0.9
    assert sum(got[i] == i for i in range(N)) >= 0.95 * N  # and unrelated recordings, which may align by chance, stay apart
