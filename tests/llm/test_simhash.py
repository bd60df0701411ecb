import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.helpers import AWKWARD, documents
from wayline.llm import simhash as S
from wayline.llm.components import star_components


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fingerprint) -> component id of each row."""
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if bin(a ^ b).count("1") <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    ids = {}
    for (d, _), x in zip(rows, label, strict=True):
        ids[x] = d if ids.get(x) is None else ids[x] if d is None else min(d, ids[x])
    return [ids[x] for x in label]


def test_golay_keys_miss_nothing():
    _, _, counts = S.golay_tables()
    assert (counts == 1).sum() == 277 and (counts == 6).sum() == 1771
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 23, 4000)
    for flips in (0, 1, 2):
        b = a.copy()
        for _ in range(flips):
            b ^= 1 << rng.integers(0, 23, len(a))
        (ka, na), (kb, nb) = S.segment_keys(a), S.segment_keys(b)
        assert all(set(x[:n]) & set(y[:m]) for x, n, y, m in zip(ka, na, kb, nb, strict=True))


def test_linked_fingerprints_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
    (ia, ka), (ib, kb) = S.fingerprint_keys(a.view(np.int64)), S.fingerprint_keys(b.view(np.int64))
    assert set(range(1500)) == {i for i, _ in set(zip(ia.tolist(), ka.tolist(), strict=True)) & set(zip(ib.tolist(), kb.tolist(), strict=True))}


@pytest.mark.parametrize("run", [8192, 3])
def test_matches_brute_force(spark, data, run):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: r for r in S.near_duplicates(docs, run).collect()}
    rows = [(d, brute_print(t)) for d, t in texts.items()]
    for (d, fp), component in zip(rows, brute_components(rows), strict=True):
        assert found[d]["fingerprint"] == f"{fp:016x}" and found[d]["component_id"] == component


def test_dense_balls_in_blocks(spark):
    """Keys with far more members than a run holds, cut in blocks."""
    values = [0] + [1 << i for i in range(64)] + [(1 << i) | (1 << (i + 1)) for i in range(63)] + [0xFFFFFFFF << 20, (0xFFFFFFFF << 20) ^ 31]
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    edges = S.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 16)
    roots = {r["node"]: r["root"] for r in star_components(edges).collect()}
    ball = {roots.get(v, v) for v in signed[:-2]}
    assert len(ball) == 1 and roots.get(signed[-2], signed[-2]) != roots.get(signed[-1], signed[-1])


@pytest.mark.parametrize("sizes", [(4, 4, 2), (4, 4, 4, 1), (6, 2, 3), (3, 5, 4, 4), (4, 4), (10,)])
def test_a_key_goes_on_after_a_full_block(sizes):
    """Runs that fill the last block exactly at the end of a batch, then the same key or another one."""
    total = sum(sizes)
    for later in (0, 1, 3, 9):
        keys, fps = [5] * total + [8] * later, list(range(total)) + [1000 + i for i in range(later)]
        ends = [sum(sizes[:i]) for i in range(len(sizes) + 1)] + ([total + later] if later else [])
        batches = [pa.RecordBatch.from_pydict({"key": pa.array(keys[a:b], pa.int32()), "fp": pa.array(fps[a:b], pa.int64())}) for a, b in zip(ends, ends[1:])]
        rows = [r for batch in S._links(4)(iter(batches)) for r in batch.to_pylist()]
        got = [(r["key"], r["block"], r["a"]) for r in rows if r["key"] is not None]
        wanted = [(5, i // 4, i) for i in range(total)] + [(8, i // 4, 1000 + i) for i in range(later) if later >= 4]
        assert sorted(got) == sorted(wanted)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    roots = {r["node"]: r["root"] for r in star_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(1, 41)) and roots[101] == roots[103] == 100 and 0 not in roots
    assert star_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_awkward(spark, extra):
    docs = documents(spark, AWKWARD, extra)
    found = S.near_duplicates(docs).collect()
    assert len(found) == len(AWKWARD)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert by[1] == by[2] == by[3] == {("0" * 16, 1)} and by[4] == by[5] and len(by[4]) == 1 and by[None] == {(by[None].copy().pop()[0], None)}
    kept = S.drop_near_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] in (1, 2, 3, 4, 5)) == [1, 4]
    assert S.drop_near_duplicates(docs).columns == docs.columns
    assert S.near_duplicates(documents(spark, [])).count() == 0 and S.drop_near_duplicates(documents(spark, [])).count() == 0


def test_the_same_repeat_stays_in_any_order(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", s) for s in ("c", "a", None, "b")] + [(2, "", "en", "x"), (2, None, "en", "x"), (2, None, "en", "w")]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        kept = S.drop_near_duplicates(documents(spark, order).coalesce(1)).collect()
        assert sorted((r["doc_id"], r["text"], r["source"]) for r in kept) == [(1, text, "a"), (2, "", "x")]
