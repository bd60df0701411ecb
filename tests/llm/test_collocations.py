import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, documents
from wayline.llm import collocations as C


def brute(rows, most, least, top, share):
    """rows: (lang, text) -> (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    longer = {}
    candidates = {p: a for p, a in f.items() if len(p[1]) >= 2 and a >= least}
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(a, longer.get((lang, w[i : i + k]), 0))
    found = {}
    for (lang, w), a in candidates.items():
        if 100 * longer.get((lang, w), -1) >= share * a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, all_of in found.items() for i, (s, a, p, left, right) in enumerate(sorted(all_of)[:top]))


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


TEXTS = [
    (1, "New York is big. New York city, new york City; the the the the the the!", "en", "s"),
    (2, "in New York city\x0bnew york\tcity the end", "en", "s"),
    (3, "new york city new york city new\nyork the the", "de", "s"),
    (4, "new york city", None, None), (5, "new york city", "und", "s"), (6, "a b c d e f a b c d e f a b c d e", "en", "s"),
    (7, "É é new york É é new york É é", "en", "s"), (8, "é É:é É", "", "s"),
]


@pytest.mark.parametrize("most, least, top, share", [(5, 2, 2000, 100), (5, 1, 2000, 100), (3, 2, 3, 100), (2, 3, 2000, 100), (5, 2, 2000, 60), (6, 2, 2000, 100), (1, 1, 5, 100)])
def test_matches_brute_force(spark, most, least, top, share):
    rows = [*TEXTS, *AWKWARD]
    found = got(C.collocations(documents(spark, rows, True), most, least, top, share))
    assert found == brute([(*r, "en", "s")[2:3] + (r[1],) if len(r) == 2 else (r[2], r[1]) for r in rows], most, least, top, share)


def test_random_words(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        words = [f"w{min(int(z), 30)}" for z in rng.zipf(1.6, 80)]
        for at in rng.integers(0, 70, 3):
            words[at : at + 5] = ["once", "upon", "a", "long", "time"]
        rows.append((i, " ".join(w + ("." if rng.random() < 0.1 else "") for w in words), ["en", "de", None][i % 3], "s"))
    wanted = brute([(r[2], r[1]) for r in rows], 5, 8, 2000, 100)
    assert len(wanted) > 60 and got(C.collocations(documents(spark, rows), 5, 8)) == wanted


def test_small_pieces_of_work(spark, monkeypatch):
    """Tasks that put out and forget all the time, and a filter that lets nearly everything pass."""
    monkeypatch.setattr(C, "HELD", 3)
    monkeypatch.setattr(C, "HELD_HASHES", 5)
    monkeypatch.setattr(C, "KNOWN", 4)
    wanted = got(C.collocations(documents(spark, TEXTS), 5, 2))
    monkeypatch.setattr(C, "MOST", 3)
    assert wanted == brute([(r[2], r[1]) for r in TEXTS], 5, 2, 2000, 100) == got(C.collocations(documents(spark, TEXTS), 5, 2))


def test_rare_words_are_no_rows(spark, monkeypatch):
    """Words seen once stay numbers: 5,000 of them make no row of a phrase."""
    made, real = [], C._counted
    monkeypatch.setattr(C, "_counted", lambda *a: made.append(real(*a)) or made[-1])
    rows = [(i, "the end " + " ".join(f"w{i}x{j}" for j in range(100)), "en", "s") for i in range(50)]
    phrases, totals = C.phrase_counts(documents(spark, rows), 5, 10)
    assert sorted((r["phrase"], r["k"], r["f"]) for r in phrases.collect()) == [("end", 1, 50), ("the", 1, 50), ("the end", 2, 50)]
    assert [tuple(r) for r in totals.collect()] == [("en", 5100)] and sum(df.count() for df in made) < 100


def test_words_remembered_do_not_grow_with_the_languages(monkeypatch):
    monkeypatch.setattr(C, "KNOWN", 20)
    memo = C.Memo()
    for i in range(200):
        words = [b"a", b"b%d" % i, C.END]
        assert memo.hashes(f"l{i}", words).tolist() == [*(C.word_hash(w, f"l{i}") for w in words[:2]), 0]
        assert sum(map(len, memo.values())) <= 2 * 20


def test_products_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("cast(90000000000 as decimal(19,0)) as a", "cast(8000000000000000001 as decimal(19,0)) as n", "cast(91000000000 as decimal(19,0)) as l")
    assert row.selectExpr("(a * n * cast(1000 as decimal(4,0))) div (l * l) as s").first()["s"] == 1000 * 90000000000 * 8000000000000000001 // 91000000000**2


def test_the_table_against_duckdb(spark, data):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    wanted = sorted(db.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({C.ORACLE})").fetchall())
    assert wanted and got(C.op13_collocations(spark, data)) == wanted


def test_empty(spark):
    assert C.collocations(documents(spark, [])).count() == 0 and C.collocations(documents(spark, [(1, None), (2, " \n")])).count() == 0
