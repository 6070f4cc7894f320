import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docengine.llm import media, mixing, packing, token_files, tokens
from docengine.llm.common import scratch
from docengine.llm.queries import QUERIES

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids_of(path, texts, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ATOMS = [*"                \n\n\n\t\t", "  ", "\r\n", "\x85", "\u00a0", "\x1c", "\x0b", *"aBcéÉßİΣ²3½日́.,-_<>|×÷🙂#@ªº≠가\u200b\ufeff\x00\x7f\u3000", "x", "42", "'s", "'t", "'LL", "!?", "%%%", "***", "<|endoftext|>", "ﬁ", "Ã\u0097"]


@pytest.mark.parametrize(("path", "byte_level"), [(BYTES, True), (WORDS, False)])
def test_pieces_are_the_library(path, byte_level, docs, monkeypatch):
    odd = ["a  b", "don't  's x", " lead", "trail ", "\n\n a\n", "é́ x", "x²y 3½", "日本 語\t\ttab", "<|endoftext|> z", "ß.ẞ İx", "x.'s y,'t", "name\tage\tcity\n\n Bob", "a\tb\n\n\tc", "", None]
    rng = random.Random(3)
    mixed = ["".join(rng.choices(ATOMS, k=rng.randint(0, 14))) for _ in range(4000)]
    texts = odd + mixed + [r.text for r in docs.limit(60).collect()]
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 500)
    own = tokens.Encoder(path, byte_level, 9)
    for s in range(0, len(texts), 300):  # forgets on the way; slices of a larger array keep their places
        flat, at = own.encode(pa.array(["before", *texts[s : s + 300]]).slice(1))
        want = ids_of(path, texts[s : s + 300], 9)
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.tolist() for x in want]
    flat, at = own.encode(pa.array([], pa.string()))
    assert not len(flat) and at.tolist() == [0]


def test_slices_keep_rows():
    texts = ["x" * n for n in (10, 0, 3_000_000, 5, 2_000_000, 2_000_000)] + [None]
    parts = list(tokens.slices(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]), 0))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts and len(parts) > 2


def test_token_files(spark, sf_dir, docs, odd, empty):
    got = sorted(QUERIES["op10_token_files"](spark, sf_dir).collect())
    rows = docs.orderBy("doc_id").collect()
    ids = ids_of(BYTES, [r.text for r in rows], 0)
    starts = np.cumsum([0, *map(len, ids)])[:-1]
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [(r.doc_id, s, len(i), zlib.crc32(i.tobytes())) for r, s, i in zip(rows, starts, ids, strict=True)]
    for table in (odd, empty):
        token_files.write_token_files(table, path := scratch(spark, "t"), BYTES, end=0)
        assert token_files.read_token_files(spark, path).count() == table.count()


def test_selective_reads(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(token_files, "ROW_GROUP_BYTES", 64 << 10)
    monkeypatch.setattr(token_files, "PAGE_BYTES", 8 << 10)
    many = docs.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(9000), F.lit(1000)), lambda x: F.col("doc_id") + x)).alias("doc_id"), "text")
    token_files.write_token_files(many, path := scratch(spark, "selective"), BYTES, end=0, partitions=2)
    whole = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    stream = np.concatenate([r.ids for r in whole])
    bare = token_files.read_token_files(spark, path, columns=())
    assert "ids" not in "".join(line for line in bare._jdf.queryExecution().toString().splitlines() if "ReadSchema" in line)
    assert sorted(map(tuple, bare.collect())) == sorted((r.doc_id, r.start, r.n_tokens) for r in whole)
    one = token_files.read_token_files(spark, path, where=F.col("doc_id") == whole[7].doc_id)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in one._jdf.queryExecution().toString() and one.collect() == [whole[7]]
    got = sorted(token_files.read_token_range(spark, path, 1000, 9001).collect(), key=lambda r: r.start)
    assert np.concatenate([r.ids for r in got]).tolist() == stream[1000:9001].tolist() and got[0].start == 1000
    files = spark.read.parquet(path).inputFiles()
    groups = 0
    for file in files:
        meta = pq.ParquetFile(file.removeprefix("file://").removeprefix("file:")).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            by_name = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            ids, n = by_name["ids.list.element"], by_name["n_tokens"]
            assert ids.has_dictionary_page and "DELTA_BINARY_PACKED" in n.encodings and not n.has_dictionary_page
            assert all(c.has_column_index and c.has_offset_index for c in (n, by_name["doc_id"])) and by_name["doc_id"].statistics.has_min_max
    assert len(files) == 2 and groups > 4
    # one id in most rows: its rows fill several files, order and starts hold
    hot = docs.select(F.when(F.col("doc_id") % 4 > 0, 5).otherwise(F.col("doc_id")).alias("doc_id"), "text")
    token_files.write_token_files(hot, path := scratch(spark, "hot"), BYTES, end=0, partitions=4)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in hot.collect()) and spark.read.parquet(path).where("doc_id = 5").select("part").distinct().count() > 1
    assert rows[-1].start + rows[-1].n_tokens == len(stream) // 10


def check_pieces(pieces, ids):
    """ids: the tokens of each document, in any order."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert np.concatenate([p.ids for p in own]).tolist() == ids[doc].tolist() and own[0].doc_tokens == len(ids[doc])
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        total = sum(p.length for p in own)
        assert total <= packing.WINDOW and total & (total - 1) == 0
    return by_sequence


def test_packing(spark, docs, odd, empty):
    rows = docs.collect()
    pieces = packing.pack_documents(docs, WORDS, end=2).collect()
    sequences = check_pieces(pieces, dict(zip([r.doc_id for r in rows], ids_of(WORDS, [r.text for r in rows], 2), strict=True)))
    lengths = [sum(p.length for p in s) for s in sequences.values()]
    assert sum(n in packing.TIERS for n in lengths) >= len(lengths) - 13 * docs.rdd.getNumPartitions()
    own = odd.where("doc_id in (2, 3, 5, 8)")
    check_pieces(packing.pack_documents(own, WORDS, end=2).collect(), {r.doc_id: i for r, i in zip(own.collect(), ids_of(WORDS, [r.text for r in own.collect()], 2), strict=True)})
    assert sum(r.length for r in packing.pack_documents(odd, WORDS, end=2).collect()) == sum(map(len, ids_of(WORDS, [r.text for r in odd.collect()], 2)))
    assert packing.pack_documents(empty, WORDS, end=2).count() == 0


def test_tiers_pack_their_own():
    rng = np.random.default_rng(8)
    packer, want = packing.Packer(3, 4096, packing.TIERS), {}
    for doc in range(3000):
        want[doc] = rng.integers(0, 50_000, int(rng.choice([20, 300, 700, 1500, 3000, 9000]) * rng.uniform(0.7, 1.3))).astype(np.uint32)
        packer.add(doc, want[doc])
    packer.finish()
    rows = [Row(**r) for r in packer.rows().to_pylist()]
    sequences = check_pieces([Row(**(r.asDict() | {"ids": np.array(r.ids, np.int32).view(np.uint32)})) for r in rows], want)
    tail = 13
    for tier in packing.TIERS[1:]:  # the shortest pieces fill the gaps of the longer tiers
        own = [s for s in sequences.values() if s[0].tier == tier and sum(p.length for p in s) == tier]
        # each holds a piece that no shorter tier could hold
        assert len(own) > 20 and sum(max(p.length for p in s) > tier // 2 for s in own) >= len(own) - tail
    assert [r.before for r in rows] == sorted(r.before for r in rows)


def test_step_groups(spark, docs):
    packed = packing.pack_documents(docs.repartition(3), WORDS, end=2)
    rows = packing.with_step_groups(packed, 8192).collect()
    tokens_of, groups = {}, {}
    for r in rows:
        tokens_of[r.step_group] = tokens_of.get(r.step_group, 0) + r.length
        groups.setdefault(r.sequence_id, set()).add(r.step_group)
    assert sorted(tokens_of) == list(range(len(tokens_of))) and all(len(g) == 1 for g in groups.values())
    assert all(abs(n - 8192) <= 4096 for g, n in tokens_of.items() if g < max(tokens_of))


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, due = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        share = {s: due * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        due, open_ = due - sum(2 * sizes[s] for s in over), open_ - over
    return target


def test_mixing(spark, docs, odd, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)  # several levels
    first, again = (sorted(map(tuple, mixing.mix(docs.repartition(n)).collect())) for n in (3, 5))
    assert first == again
    rows = mixing.mix(docs).collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    want = brute_targets(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 for s in want)
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], 60) for s in want)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    # take(): each row as often as its source's rate says, rounded down or up, sources near their targets, reruns alike
    held = [Counter((r.doc_id, r.source) for r in mixing.take(docs).collect()) for _ in range(2)]
    assert held[0] == held[1]
    words, rates = dict.fromkeys(sizes, 0), {s: want[s] / sizes[s] for s in sizes}
    for r in rows:
        n = held[0][r.doc_id, r.source]
        assert np.floor(rates[r.source] + 1e-9) <= n <= np.ceil(rates[r.source] - 1e-9)
        words[r.source] += n * r.size
    assert all(abs(words[s] - want[s]) <= max(0.02 * want[s], 60) for s in want)
    assert mixing.take(odd).columns == odd.columns and mixing.take(empty).count() == 0
    taken = Counter(r.doc_id for r in mixing.take(odd).collect())
    assert set(taken) <= {r.doc_id for r in odd.collect()} and taken.total() <= 2 * odd.count()


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    size, pi = rng.integers(1, 2000, 500).astype(float), np.full(500, 0.37)
    out = mixing.flight(size, pi.copy(), rng)
    assert ((out > 0) & (out < 1)).sum() <= 3
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out * size).sum() - (pi * size).sum()) < 1e-3


def test_media(spark):
    rng = np.random.default_rng(5)
    songs = rng.standard_normal((12, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(songs)] + [(100 + i, (x + rng.standard_normal(64) * 0.01).tolist()) for i, x in enumerate(songs[:8])] + [(200, songs[0].tolist()), (201, songs[1][10:].tolist())]
    prints = media.fingerprints(media.render_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    more = spark.createDataFrame([(300, None), (301, bytearray(10)), (None, bytearray(b"\1\2" * 9000))], "rec_id long, pcm binary").selectExpr("*", "4000 as rate")
    everything = prints.unionByName(media.fingerprints(more))
    got = {r.rec_id: r for r in media.match_recordings(everything).collect()}
    codes = {r.rec_id: np.array(r.codes, np.int32).view(np.uint32) for r in prints.collect()}
    names, links = sorted(codes), []
    keys = {n: set(zip(c.tolist(), c[media.LAG :].tolist(), strict=False)) for n, c in codes.items()}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            found = media.align(codes[a], codes[b])
            if found and found[1] <= media.MAX_BIT_ERROR and keys[a] & keys[b]:
                links.append((a, b))
    assert sum((i, 100 + i) in links for i in range(8)) >= 7 and (0, 200) in links and all(b % 100 == a for a, b in links if b < 200)
    from tests.llm.test_dedup import classes

    want = classes(names, links)
    assert all(got[i].component_id == want[i] for i in names)
    assert got[200].offset == 0 and got[200].bit_error == 0 and got[201].offset is not None
    assert got[300].n_codes == 0 and got[300].kept and got[None].component_id is None
    assert media.match_recordings(everything.limit(0)).count() == 0


def brute_classes(texts, k, percent):
    """Smallest id of each class of texts whose k-word shingle sets link."""
    from tests.llm.test_dedup import brute, sets_of

    return brute(sets_of(texts.items(), k), percent)


def test_pipeline_is_brute_force(spark, sf_dir, tmp_path):
    """run() on whole tables, each stage redone in plain Python on what the one before kept; the model's scores are given."""
    from tests.llm.test_dedup import brute_repeats

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(150)
    passage = " ".join(f"common{i}" for i in range(60))
    more = spark.createDataFrame([(90_000 + i, f"Start {i} of this text. {passage} and its end {i}.", "en", "extra") for i in range(3)], "doc_id long, text string, lang string, source string")
    rows = rows.unionByName(more.withColumn("n_chars", F.length("text")), allowMissingColumns=True)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    documents = {r.doc_id: r for r in rows.collect()}
    scores = {r.doc_id: r.predicted for r in QUERIES["op1_quality"](spark, str(tmp_path)).collect()}
    texts = {i: r.text for i, r in documents.items() if scores[i]}
    texts = {i: texts[i] for i, c in brute_classes(texts, 5, 80).items() if i == c}
    spans, later = brute_repeats(texts)
    for i, ranges in later.items():
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", texts[i].encode())]
        gone, held = ranges, texts[i].encode()
        starts = [a for a, _ in words] + [len(held)]
        texts[i] = (held[: starts[0]] + b"".join(held[starts[n] : starts[n + 1]] for n in range(len(words)) if n not in gone)).decode()
    texts = {i: t for i, t in texts.items() if t is None or t.split() or i not in later}
    assert later and any(not s for s in scores.values())
    sizes, taken, words_of = {}, {}, {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    for i, n in words_of.items():
        sizes[documents[i].source] = sizes.get(documents[i].source, 0) + n
    want = brute_targets(sizes)
    whole = dict(zip(texts, ids_of(WORDS, list(texts.values()), 2), strict=True))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({p.sequence_id for p in pieces}) == len({(p.sequence_id, p.step_group) for p in pieces})
    tokens_of = Counter()
    for p in pieces:
        assert list(p.ids) == whole[p.doc_id][p.start : p.start + p.length].tolist() and p.doc_tokens == len(whole[p.doc_id])
        tokens_of[p.doc_id] += p.length
    for i, ids in whole.items():
        copies, rest = divmod(tokens_of[i], len(ids))
        rate = want[documents[i].source] / max(1, sizes[documents[i].source])
        assert not rest and np.floor(rate + 1e-9) <= copies <= np.ceil(rate - 1e-9)
        taken[documents[i].source] = taken.get(documents[i].source, 0) + copies * words_of[i]
    assert set(tokens_of) <= set(whole) and all(abs(taken[s] - want[s]) <= max(0.03 * want[s], 0.6 * max(n for i, n in words_of.items() if documents[i].source == s)) for s in want)
