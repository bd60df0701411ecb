import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, documents
from wayline.llm import minhash as M
from wayline.llm.components import star_components


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)} if len(words) > 1 else {tuple(words)} if words else set()


def brute(rows):
    """rows: (doc_id, text) -> sorted (doc_id, n_shingles, component_id, kept), by comparing all with all."""
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                label[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    least = {r: min((d for d in all_of if d is not None), default=None) for r, all_of in ids.items()}
    return sorted(((d, len(s), least[root(i)], d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def families(seed, groups, members, words=60):
    """Copies with a few words changed: similarities from about 0.5 to 1, so that groups hang together by chains."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 3000, words)]
        for _ in range(members):
            own = list(base)
            for at in rng.integers(0, words, rng.integers(0, 9)):
                own[at] = f"z{rng.integers(0, 100000)}"
            rows.append((len(rows) * 7 % 1009 + 1009 * len(rows), " ".join(own)))
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("small, targets, pivots", [(8, 1 << 20, 1 << 18), (2, 500, 150), (100, 1 << 20, 1 << 18)])
def test_families_match_brute_force(spark, small, targets, pivots):
    rows = families(1, 6, 45)
    wanted = brute(rows)
    assert 1 < len({r[2] for r in wanted}) < len(rows) and sum(r[3] for r in wanted) > 12
    assert got(M.minhash_groups(documents(spark, rows), small, targets, pivots)) == wanted


def test_the_table_matches_brute_force_and_duckdb(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    sql = sorted(db.sql(f"SELECT doc_id, n_shingles, component_id, kept FROM ({M.ORACLE})").fetchall(), key=repr)
    assert got(M.op12_minhash(spark, data)) == brute(rows) == sql


def test_pairs_at_the_threshold(spark):
    """Four of five shingles, and 79 of 100."""
    a = "a b c d e f"
    rows = [(1, a), (2, "b c d e f"), (3, "c d e f"), (4, "x " + " ".join(f"n{i}" for i in range(90)))]
    words = [f"m{i}" for i in range(90)]  # 89 shingles; two words changed in the middle leave 85 of 93, in eight places 73 of 105
    rows += [(10, " ".join(words)), (11, " ".join(words[:20] + ["q"] + words[21:])), (12, " ".join(w if i % 11 else "q" for i, w in enumerate(words)))]
    assert got(M.minhash_groups(documents(spark, rows))) == brute(rows)


def test_bands_miss_no_similar_pair():
    """300 pairs of sets at 0.8 share a band; pairs at 0.2 mostly don't."""
    rng = np.random.default_rng(2)
    far = 0
    for n in [5, 9, 18, 90, 900] * 60:
        x = rng.integers(0, 1 << 63, n + n // 4 + 4 * n, dtype=np.uint64)
        both = round(n * 8 / 9)
        a, b = x[:n], np.r_[x[:both], x[n : n + (n - both)]]
        if M.linked(np.sort(a), np.sort(b)):
            ka, kb = M.band_keys([a, b])
            assert (ka == kb).any()
        ka, kb = M.band_keys([a, np.r_[x[: n // 3], x[n : 2 * n - n // 3]]])
        far += int((ka == kb).any())
    assert far < 60


@pytest.mark.parametrize("extra", [False, True])
def test_awkward(spark, extra):
    rows = [*AWKWARD, (20, "One"), (None, "one"), (None, "nothing like it at all")]
    assert got(M.minhash_groups(documents(spark, rows, extra))) == sorted(((d, n, c, d == c) for d, n, c, _ in brute([r[:2] for r in rows])), key=repr)
    assert M.minhash_groups(documents(spark, [])).count() == 0 and got(M.minhash_groups(documents(spark, [(3, ""), (4, None)]))) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_a_hub_above_its_leaves(spark):
    """A star under its largest id: its edges are dealt over the tasks of each join."""
    edges = spark.range(20000).select(F.lit(1 << 40).alias("a"), F.col("id").alias("b"))
    roots = star_components(edges)
    assert roots.count() == 20000 and roots.where("root <> 0").count() == 0
