import hashlib
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.helpers import AWKWARD, documents
from wayline.llm import media as M
from wayline.llm import packing as P


def padded(text):
    data = (text or "").encode()
    return len(data), data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")


def test_round_trip_and_slow_decoder():
    payload = np.random.default_rng(0).integers(0, 256, 192 * 7, dtype=np.uint8).tobytes()
    stored = M.encode_avi(payload)
    fps, samples = M.read_samples(stored)
    assert samples.tobytes() == payload and fps == 25
    _, frames = M.avi_frames(stored)
    assert len(frames) == 7
    for i in (0, 6):
        picture = M.decode_frame(frames[i])
        assert picture.shape == (96, 128) and (picture[::8, ::8].ravel() == samples[i]).all() and (picture == np.kron(samples[i].reshape(12, 16), np.ones((8, 8)))).all()
    without = stored.replace(b"idx1", b"JUNK")
    assert [bytes(f) for f in M.avi_frames(without)[1]] == [bytes(f) for f in frames]
    assert struct.unpack("<I", stored[4:8])[0] == len(stored) - 8
    for bad in (b"", b"x" * 191):
        with pytest.raises(ValueError):
            M.encode_avi(bad)
    with pytest.raises(ValueError):
        M.avi_frames(b"RIFF....WAVE")


def test_shots():
    dark, light = np.full((6, 192), 20, np.uint8), np.full((5, 192), 200, np.uint8)
    starts, away = M.shot_starts(np.r_[dark, light, dark])
    assert starts.tolist() == [0, 6, 11] and away[6] == 1.0 and away[3] == 0
    payload, clips = M.clips_of(M.encode_avi(np.r_[dark, light].tobytes()))
    assert [(c["first_frame"], c["frames"], c["start_s"], c["level"]) for c in clips] == [(0, 6, 0.0, 20.0), (6, 5, 6 / 25, 200.0)]
    assert M.shot_starts(np.zeros((1, 192), np.uint8))[0].tolist() == [0]


def test_media_query(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = M.op6_media(spark, data).collect()
    assert len(found) == len(texts)
    for r in found:
        n, payload = padded(texts[r["doc_id"]])
        stored = M.encode_avi(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_bytes"] == len(stored) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_media(spark, extra):
    read = M.read_media(M.encode_media(documents(spark, AWKWARD, extra)))
    rows = read.collect()
    assert len(rows) == len(AWKWARD) and {r["payload_bytes"] for r in rows if r["doc_id"] in (1, 2)} == {192}
    assert M.clip_rows(read).count() == sum(len(r["clips"]) for r in rows)
    assert M.read_media(M.encode_media(documents(spark, []))).count() == 0


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*ids_of.t.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("text", [None, "", "plain words", " \n\t  spaces  \r\n", "Ünï 漢字 \U0001f600", "a" * 3000, "x<|endoftext|>y <|other|>", "don't 12345 !!!"])
def test_ids_are_the_tokenizers(text):
    assert P.token_ids(text).tolist() == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("<|> '\n\t\r\u00a0\u2028\u0301\u200d\u0130sStT019"))), max_size=60))
def test_ids_are_the_tokenizers_for_any_text(text):
    assert P.token_ids(text).tolist() == ids_of(text)


def checked(rows, texts, capacity=1024):
    """Every document's ids come back from its pieces; sequences are gapless and within capacity."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in texts.items():
        ids, own = np.array(ids_of(text), "<u4"), sorted(pieces[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            assert r["length"] == capacity or r["piece"] == 0
        assert len(own) == -(-len(ids) // capacity)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_query(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = P.op9_packing(spark, data).collect()
    used = checked(rows, texts)
    lengths = [r["length"] for r in rows]
    simple = len(P.best_fit(lengths, sorted(range(len(lengths)), key=lambda i: -lengths[i]), 1024).bins)
    assert used <= simple and used <= 1.02 * -(-sum(lengths) // 1024) + 1


def decreasing(lengths, capacity=1024):
    """Bins of best-fit decreasing, on its own."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        insort(rooms, room - n)
    return len(rooms)


def test_fewer_sequences_than_best_fit(spark):
    """On the 15,000 pieces of a larger table: fewer than best-fit decreasing in the same groups, and no more than
    best-fit decreasing over all pieces at once."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = P.pack_documents(docs).select("length", "sequence_id", "offset").collect()
    lengths = [r["length"] for r in rows if r["length"] < 1024]
    used = len({r["sequence_id"] for r in rows if r["length"] < 1024})
    held = defaultdict(int)
    for r in rows:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 1024 and sum(held.values()) == sum(r["length"] for r in rows)
    rng = np.random.default_rng(0)
    mixed = rng.permutation(lengths).tolist()
    grouped = sum(decreasing(mixed[g : g + P.GROUP]) for g in range(0, len(mixed), P.GROUP))
    assert -(-sum(lengths) // 1024) <= used <= decreasing(lengths) and used < grouped


def test_evolution_beats_best_fit():
    """Groups of the pieces' usual lengths: the algorithm saves bins, and never has more."""
    saved = 0
    for seed in range(4):
        rng = np.random.default_rng(seed)
        lengths = np.clip(np.r_[rng.normal(480, 210, 1800), rng.gamma(2, 30, 60)], 1, 1023).astype(int).tolist()
        found = len(P.evolved(lengths, [], 1024, rng, 60)[0].bins)
        saved += decreasing(lengths) - found
        assert -(-sum(lengths) // 1024) <= found <= decreasing(lengths)
    assert saved > 0


def test_genetic_steps(monkeypatch):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 700, 400).tolist()
    everything = list(range(400))
    a = P.best_fit(lengths, everything, 1024)
    b = P.best_fit(lengths, everything[::-1], 1024)
    child = P.crossed(lengths, a, b, 1024, rng)
    for found in (a, b, child, *P.evolved(lengths, [a, b], 1024, rng)):
        assert sorted(i for x in found.bins for i in x) == everything and all(sum(lengths[i] for i in x) <= 1024 for x in found.bins)
        assert found.fills == [sum(lengths[i] for i in x) for x in found.bins]
        assert found.genome.tolist() == P._packing(found.genome.tolist(), lengths).genome.tolist()
    monkeypatch.setattr(P, "WELL_FILLED", 1.0)  # only full bins are injected, which no exchange can better
    full = [set(x) for x, n in zip(b.bins, b.fills, strict=True) if n == 1024 and set(x) not in map(set, a.bins)]
    child = P.crossed(lengths, a, b, 1024, rng)
    assert full and any(set(x) in full for x in child.bins)
    best = P.evolved(lengths, [], 1024, rng)[0]
    assert best.score(1024) <= P.best_fit(lengths, sorted(everything, key=lambda i: -lengths[i]), 1024).score(1024)


def test_second_packing_starts_from_the_first(spark, monkeypatch):
    """Many small groups: their loose bins are packed once more, and every piece still has its place."""
    monkeypatch.setattr(P, "GROUP", 50)
    monkeypatch.setattr(P, "SPAN", 4)
    rng = np.random.default_rng(8)
    lengths = np.r_[rng.integers(1, 1024, 700), np.full(60, 600), np.full(20, 1024)].tolist()
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(3)
    rows = P.pack(pieces).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in map(sorted, sequences.values()):
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(n for _, n in places) <= 1024


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_packing(spark, extra):
    rows = P.pack_documents(documents(spark, AWKWARD, extra)).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(AWKWARD) and {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0, *(n for _, n in sorted(places))])[:-1].tolist()
    assert P.pack_documents(documents(spark, [])).count() == 0


def test_pipeline(spark):
    """Each stage's decisions take effect, and the stages are what their operators give."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts, rows = [], docs
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf).cache()
        counts.append(rows.count())
        if stage is not corpus_pipeline.packing:
            assert rows.columns == docs.columns
    assert docs.count() > counts[0] >= counts[1] > counts[2] and counts[3] > 0
    run = corpus_pipeline.run(spark, sf)
    assert sorted(run.columns) == sorted(rows.columns)
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, run.collect())) == sorted(map(key, rows.collect()))
    found = __spark_entry__.queries()
    assert "pipeline" in found and {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in found}


def test_empty_pipeline(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_read_what_the_stage_before_wrote(spark, data, monkeypatch):
    """Each stage but the first reads Parquet files of the shared folder, not the plan of the stage before."""
    read = []

    def stage(spark, docs, sf_dir):
        read.append(docs.inputFiles())
        return docs.limit(7).withColumn("source", F.lit("changed"))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", stage), ("second", stage), ("third", stage)])
    assert corpus_pipeline.run(spark, data).count() == 7
    shared = spark.sparkContext.getCheckpointDir().split("/")[-1]
    assert not any(shared in f for f in read[0]) and all(files and all(shared in f for f in files) for files in read[1:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1'é漢!  \n\t  \x1c<|")), max_size=30), max_size=6))
def test_ids_of_many_texts_are_those_of_each(texts):
    """Words known from other texts, white space of every kind around them, and texts that can't be cut."""
    assert [x.tolist() for x in P.ids_of_texts([*texts, None])] == [ids_of(t) for t in [*texts, None]]


def test_a_known_word_is_not_encoded_again(monkeypatch):
    words, asked = P.Words(P.VOCABULARY), []
    encoded = words.encoded
    monkeypatch.setattr(words, "encoded", lambda text: asked.append(text) or encoded(text))
    found = words.ids(["one two three two", "one two  cut", ""])
    assert [x.tolist() for x in found] == [ids_of(t)[:-1] for t in ("one two three two", "one two  cut", "")]
    asked.clear()
    assert words.ids(["three two three two"])[0].tolist() == ids_of("three two three two")[:-1]
    assert asked == ["", "three"]


def test_words_beyond_what_is_kept(monkeypatch):
    monkeypatch.setattr(P, "KNOWN", 40)
    words, texts = P.Words(P.VOCABULARY), [f"word{i} other{i} text{i % 3}" for i in range(60)]
    for a in range(0, 60, 5):
        assert [x.tolist() for x in words.ids(texts[a : a + 5])] == [ids_of(t)[:-1] for t in texts[a : a + 5]]
    assert len(words.kept) < 20
    assert [x.tolist() for x in P.ids_of_texts([*texts, "x " * 50])] == [ids_of(t) for t in [*texts, "x " * 50]]
