import re

import pytest

from tests.llm.helpers import AWKWARD, documents
from wayline.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, phrases=L.PHRASES, notices=L.NOTICES, threshold=L.THRESHOLD):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts, base = [], set()
    for phrase, label in phrases.items():
        parts = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        starts += here
        base |= {label} if here else set()
    labels, score = set(base), 1.0 if base else 0.0
    for notice, label in notices.items():
        parts = set(notice.split())
        for at in range(0, len(words), L.STEP):
            share = len(parts & set(words[at : at + L.BLOCK])) / len(parts)
            if share >= threshold - 1e-12:
                labels.add(label)
                score = max(score, share)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)


def flat(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)


def test_matches_brute_force(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = L.op1_licenses(spark, data).collect()
    assert len(found) == len(texts) and any(r["n_base"] for r in found)
    assert all(flat(r) == brute(texts[r["doc_id"]]) for r in found)


def test_notices_with_changes_and_borders(spark):
    mit = next(n for n, label in L.NOTICES.items() if label == "mit")
    words = mit.split()
    filler = [f"x{i}" for i in range(300)]
    rows = [(0, mit.upper()), (1, " ".join(w for i, w in enumerate(words) if i % 6)), (2, " ".join(w for i, w in enumerate(words) if i % 3))]
    for i, at in enumerate((0, 1, 60, 63, 64, 65, 127, 128, 190, 299)):
        rows.append((10 + i, " ".join([*filler[:at], *words, *filler[at:]])))
        rows.append((30 + i, " ".join([*filler[:at], "MIT License,", "(Apache-License)", "gnu general public license cc-by", *filler[at:]])))
    rows += [(60, "mit mit license license mit license"), (61, "license mit general gnu")]
    found = {r["doc_id"]: r for r in L.scan_licenses(documents(spark, rows)).collect()}
    assert all(flat(found[i]) == brute(t) for i, t in rows)
    assert found[0]["labels"] == "mit" and found[0]["n_base"] == 0 and found[2]["labels"] == "" and found[34]["base_labels"] == "apache,cc-by,gpl,mit"


@pytest.mark.parametrize("extra", [False, True])
def test_awkward(spark, extra):
    found = L.scan_licenses(documents(spark, AWKWARD, extra)).collect()
    texts = {r[0]: r[1] for r in AWKWARD}
    assert len(found) == len(AWKWARD) and all(flat(r) == brute(texts[r["doc_id"]]) for r in found)
    assert L.scan_licenses(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        L.template_rows({}, {" ".join(["w"] * 65): "x"}, 0.8)


def test_oracle(spark, data):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    rel = con.sql(L.ORACLE)
    at = [rel.columns.index(c) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")]
    wanted = sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    assert wanted == sorted((r["doc_id"], *flat(r)[:-1]) for r in L.op1_licenses(spark, data).collect())
