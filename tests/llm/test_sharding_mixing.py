import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, documents
from wayline.llm import mixing, sharding
from wayline.llm.prefix import running_totals


def test_running_totals(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.lit(3).alias("v"))
    found = running_totals(rows.repartition(9), [F.col("k")], "v").orderBy("_row").collect()
    assert [r["_row"] for r in found] == list(range(1000)) and [r["_start"] for r in found] == [3 * i for i in range(1000)]
    assert [r["k"] for r in found] == sorted(r["k"] for r in found)


def test_shards_are_contiguous_balanced_and_gapless(spark, data):
    found = sharding.op7_sharding(spark, data).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(found) == len(docs)
    slots, sizes = defaultdict(list), Counter()
    for r in found:
        text = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
        sizes[r["shard"]] += r["size"]
    for rows in slots.values():
        assert [s for s, _ in sorted(rows)] == list(range(len(rows)))
    order = [d for s in sorted(slots) for _, d in sorted(slots[s])]
    assert order == sorted(order)
    target, largest = sum(sizes.values()) / 40, max(r["size"] for r in found)
    assert all(abs(sizes[s] - target) <= largest for s in range(40))


def test_shards_match_the_oracle(spark, data):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    rel = con.sql(sharding.ORACLE)
    assert sorted(tuple(r) for r in sharding.op7_sharding(spark, data).select(*rel.columns).collect()) == sorted(rel.fetchall())


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_shards(spark, extra):
    found = sharding.shard_by_bytes(documents(spark, AWKWARD, extra), 4).collect()
    assert len(found) == len(AWKWARD) and {r["text_crc32"] for r in found if r["doc_id"] == 1} == {0}
    assert sharding.shard_by_bytes(documents(spark, []), 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(documents(spark, []), 0)


def filled(sizes, share=1.5):
    """Targets by resharing the excess until none is above twice its source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
    return target


def test_mix_meets_targets(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = mixing.mix_report(docs).collect()
    sizes = Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
    wanted, taken = filled(sizes), Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - wanted[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 2 * mixing.BLOCK for s in sizes)
    again = mixing.mix_report(docs.repartition(3, "lang")).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_mix(spark, extra):
    docs = documents(spark, AWKWARD, extra)
    found = mixing.mix_report(docs).collect()
    assert len(found) == len(AWKWARD)
    assert sum(r["taken"] for r in found) == sum(len(r["text"].split()) for r in mixing.mix_documents(docs).collect())
    assert {r["size"] for r in found if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_report(documents(spark, [])).count() == 0 and mixing.mix_documents(documents(spark, [])).count() == 0
    assert mixing.mix_report(documents(spark, [(1, None), (2, "")])).count() == 2


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 64, 1000):
        rows = spark.range(n).select(mixing.permuted("id", f"{n}L", "5", "1").alias("p")).collect()
        assert sorted(r["p"] for r in rows) == list(range(n))


def test_shards_draw_all_sources(spark, data):
    _, targets = mixing.placed_documents(spark.read.parquet(f"{data}/documents.parquet"))
    drawn = mixing.shard_counts(targets, shard_slots=100)
    counts = drawn.groupBy("shard").agg(F.sum("slots").alias("n"), F.count(F.lit(1)).alias("sources")).orderBy("shard").collect()
    assert all(r["n"] == 100 for r in counts[:-1]) and min(r["sources"] for r in counts[:-1]) > 5
    slots = mixing.draw_slots(targets, shard_slots=100)
    assert slots.groupBy("shard", "place").count().where("count > 1").count() == 0
    filled_by = slots.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("slots"))
    assert sorted(map(tuple, filled_by.collect())) == sorted(map(tuple, drawn.collect()))


def spark_hash(*values):
    """xxhash64 of longs ("q"), ints ("i") and texts, chained; nulls leave it."""
    found = 42
    for kind, v in values:
        if v is not None:
            data = v.encode() if kind == "s" else struct.pack("<" + kind, v)
            found = xxhash.xxh64_intdigest(data, found)
    return found - (1 << 64) if found >> 63 else found


def permuted(x, size, *key):
    for k in [spark_hash(*key, ("i", mixing.SEED), ("i", r)) % size for r in range(mixing.ROUNDS)]:
        if spark_hash(("q", max(x, (k - x) % size)), ("q", k), *key) & 1:
            x = (k - x) % size
    return x


def brute_mix(rows, block, shard_slots):
    """rows: (doc_id, text, source), none repeated. Runs of every document, each word placed on its own."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    targets, firsts, run = filled(sizes), [], 0.0
    blocks = [-(-sizes[s] // block) for s in names]
    for s, n in zip(names, blocks, strict=True):
        run += n * targets[s] / sizes[s] if sizes[s] else 0.0
        firsts.append(round(run))
    slots = [min(b - a, 2 * n) for a, b, n in zip([0, *firsts], firsts, blocks, strict=False)]
    total, mix = sum(slots), defaultdict(list)
    dealt = [Counter() for _ in range(-(-total // shard_slots))]
    for no, n in enumerate(slots):
        for k in range(n):
            dealt[permuted(sum(slots[:no]) + k, total, ("i", -1)) // shard_slots][no] += 1
    upto = Counter()
    for shard, counts in enumerate(dealt):
        at = 0
        for no in sorted(counts):
            for _ in range(counts[no]):
                k = upto[no]
                upto[no] += 1
                key = (("i", no), ("i", k // blocks[no]))
                place = permuted(at, min(shard_slots, total - shard * shard_slots), ("q", shard), ("i", -2))
                mix[no, permuted(k % blocks[no], blocks[no], *key)].append((shard, place, k // blocks[no]))
                at += 1
    found = {}
    for no, name in enumerate(names):
        own = sorted((r for r in rows if r[2] == name), key=lambda r: spark_hash(("i", mixing.SEED), ("q", r[0]), ("q", spark_hash(("s", r[1] or "")))))
        at = 0
        for doc_id, text, _ in own:
            runs = defaultdict(list)
            for w in range(len(words(text))):
                for shard, place, again in mix[no, (at + w) // block]:
                    runs[shard, place, again].append((w, (at + w) % block))
            at += len(words(text))
            found[doc_id] = sorted((s, p, x[0][1], a, x[0][0], len(x)) for (s, p, a), x in runs.items())
    return found


def test_mix_matches_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    wanted = brute_mix(rows, mixing.BLOCK, 100)
    found = mixing.mix_report(docs, shard_slots=100).collect()
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in found} == wanted
    assert all(r["taken"] == sum(x[-1] for x in wanted[r["doc_id"]]) for r in found)


LAYOUT = "  def f(x):\n\treturn x\n\n| a | b |\r\n| - | - |\n  \u00a0nbsp\u00a0stays  \n"


@pytest.mark.parametrize("extra", [False, True])
def test_mix_keeps_the_layout(spark, extra):
    """What is taken of a document is its own characters; runs that follow one another keep what is between them."""
    rows = [(i, LAYOUT * (1 + i % 5), "en", f"s{i % 4}") for i in range(40)] + [(None, LAYOUT, "en", None), (77, None, "en", "s1"), (78, " \n ", "en", "s1")]
    rows += [(79, LAYOUT, "en", "s1"), (79, LAYOUT, "en", "s1"), (79, LAYOUT, "de", "s1")]  # repeats, and one of another language
    docs = documents(spark, rows, extra)
    found = mixing.mix_documents(docs, block=16, pass_column="again").collect()
    texts = {r[0]: r[1] for r in rows}
    words = Counter()
    for r in found:
        parts = re.split(r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", r["text"])
        at, whole = 0, texts[r["doc_id"]]
        for part in parts:  # each word with the white space after it, in order
            at = whole.index(part, at) + len(part)
        assert r["n_chars"] == len(r["text"]) and r["again"] in (0, 1)
        words[r["doc_id"]] += len(r["text"].encode().split())
    complete = [r for r in found if len(r["text"].encode().split()) == len(texts[r["doc_id"]].encode().split())]
    assert len(complete) > 10 and all(r["text"] == texts[r["doc_id"]] for r in complete)
    taken = Counter()
    for r in mixing.mix_report(docs, block=16).collect():
        taken[r["doc_id"]] += r["taken"]
    assert +words == +taken and {r["lang"] for r in found if r["doc_id"] == 79} == {"en", "de"}


def test_report_deals_the_mix_over_shards(spark, data):
    """The runs of all documents are the whole mix: every slot of every shard once, with the drawn counts of its sources."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = mixing.mix_report(docs, shard_slots=100).collect()
    _, targets = mixing.placed_documents(docs)
    wanted = {(r["shard"], r["place"]): (r["source_no"], r["pass"]) for r in mixing.draw_slots(targets, shard_slots=100).collect()}
    number = {r["source"]: r["source_no"] for r in targets.collect()}
    got, words = {}, Counter()
    for r in found:
        assert sum(x["words"] for x in r["runs"]) == r["taken"]
        assert [(x["shard"], x["place"]) for x in r["runs"]] == sorted((x["shard"], x["place"]) for x in r["runs"])
        for x in r["runs"]:
            at = x["shard"], x["place"]
            assert got.setdefault(at, (number[r["source"]], x["pass"])) == (number[r["source"]], x["pass"])
            words[at] += x["words"]
    assert got == wanted and max(words.values()) <= mixing.BLOCK
    starts = sorted((x["shard"], x["place"], x["at"], x["words"]) for r in found for x in r["runs"])
    assert all(b[2] == (a[2] + a[3] if a[:2] == b[:2] else 0) for a, b in zip([(-1, -1, 0, 0), *starts], starts))
    assert "runs" in mixing.op3_mixing(spark, data).columns
