"""Phrase collocations: phrases counted per language, scored by their weakest cut, without those a longer phrase stands for."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.common import cut, small, table
from wayline.llm.components import spread_join
from wayline.operators.prefix import running_totals

#: Words of the longest phrase, occurrences of a candidate, phrases returned for a language; a phrase goes if a longer
#: one has at least SHARE percent of its occurrences.
WORDS, LEAST, TOP, SHARE = 5, 100, 2000, 100
#: Ends of pieces become a line feed, A-Z lower case; what is left between white space within a line is a word.
_BYTES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b"\n"
#: Phrases and hashes a task counts, and words of all languages that it remembers, before it starts afresh.
HELD, HELD_HASHES, KNOWN = 400_000, 4_000_000, 500_000
#: Words and pairs are counted by this much of their hash (5 bytes a row); those that share it pass together or not at all.
SHORT = np.uint64((1 << 40) - 1)
#: Bits of the filter of frequent phrases: so many for each, at most 2^MOST in all (32 MB), in pieces of 2^PIECE.
BITS_EACH, MOST, PIECE = 16, 28, 20


def text_words(text: bytes | None) -> list[bytes]:
    """The words of a text, with END after each piece that has any."""
    words: list[bytes] = []
    for piece in (text or b"").translate(_BYTES).split(END):
        own = piece.split()
        if own:
            words += own
            words.append(END)
    return words


def word_hash(word: bytes, lang: str) -> int:
    """The filter's hash of a word of a language: never 0, which END has."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang)) | 1


def chained(hashes: np.ndarray, k: int) -> np.ndarray:
    """The filter's hashes of every k words in a row."""
    n = len(hashes) - k + 1
    found = hashes[:n].copy()
    for j in range(1, k):
        found = (found ^ (found >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return found ^ (found >> np.uint64(29))


class Filter:
    """Bits of the hashes of frequent phrases: none of them is ever missed, a rare one may pass."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(bits.size * 8 - 1)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class _Hashes(dict):
    """Hashes of the words of a language, remembered; END has 0. One text's words never hold more than KNOWN of them."""

    def __init__(self, lang: str):
        super().__init__({END: 0})
        self.lang = lang

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
            self[END] = 0
        h = self[word] = word_hash(word, self.lang)
        return h


class Memo(dict):
    """Each language's hashes; all are forgotten when they are more than KNOWN together, however many languages there are."""

    size = 0

    def hashes(self, lang: str, words: list[bytes]) -> np.ndarray:
        if self.size > KNOWN:
            self.clear()
            self.size = 0
        if lang not in self:
            self[lang] = _Hashes(lang)
            self.size += 1
        seen = self[lang]
        before = len(seen)
        found = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        self.size += max(0, len(seen) - before)
        return found


def _rows(count: Callable[[str, list[bytes], Counter], None]):
    """Rows lang, phrase, f of what `count` adds for each text, put out whenever a task holds HELD phrases."""

    def put_out(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            phrases, f = list(counts.keys()), list(counts.values())
            for i in range(0, len(phrases), 20_000):
                part = phrases[i : i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array(f[i : i + 20_000], pa.int64())], ["lang", "phrase", "f"]
                )
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        for batch in small(batches, 200):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("_text"), strict=True):
                count(lang, text_words(text.as_py()), held[lang])
            if sum(map(len, held.values())) > HELD:
                yield from put_out(held)
        yield from put_out(held)

    return run


def _counted(texts: DataFrame, count: Callable[[str, list[bytes], Counter], None]) -> DataFrame:
    rows = texts.mapInArrow(_rows(count), "lang string, phrase binary, f long")
    return rows.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))


def frequent_filter(hashes: DataFrame) -> Filter:
    """The filter of the hashes of frequent phrases. Its size follows their number up to 2^MOST bits; beyond that more rare
    phrases pass, which costs rows and changes nothing else."""
    power = min(MOST, (max(hashes.count() * BITS_EACH, 1 << 16) - 1).bit_length())
    piece = min(PIECE, power)

    def packed(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << piece, bool)
        bits[group.column("bit").to_numpy()] = True
        return pa.table({"piece": group.column("piece")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    at = F.col("hash").bitwiseAND((1 << power) - 1)
    rows = hashes.select(F.shiftright(at, piece).alias("piece"), at.bitwiseAND((1 << piece) - 1).alias("bit")).distinct()
    bits = [bytes((1 << piece) // 8)] * (1 << (power - piece))
    for row in rows.groupBy("piece").applyInArrow(packed, "piece long, bits binary").toLocalIterator():  # 2^MOST bits at most
        bits[row["piece"]] = bytes(row["bits"])
    return Filter(np.frombuffer(b"".join(bits), np.uint8))


def _hash_counts(k: int, known=None):
    """Rows hash, f of all words (k: 1) or of the pairs of words that both pass the filter (k: 2): numbers, as nearly all of
    them are seen once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        memo, size = Memo(), 0

        def put_out() -> pa.RecordBatch:
            hashes, f = np.unique(np.concatenate(held or [np.empty(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(f)], ["hash", "f"])

        for batch in small(batches, 200):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("_text"), strict=True):
                hashes = memo.hashes(lang, text_words(text.as_py()))
                if hashes.size >= k:
                    good = hashes != 0
                    if known is not None:
                        good &= known.value.passes(chained(hashes, 1))
                    held.append(chained(hashes, k)[good[: len(good) - k + 1] & good[k - 1 :]] & SHORT)
                    size += held[-1].size
            if size > HELD_HASHES:
                yield put_out()
                held, size = [], 0
        yield put_out()

    return run


def _phrases(often, known, most: int):
    """Counts words that pass the filter `often`, phrases of 2 to `most` words of which every pair also passes `known`, and as
    the empty phrase all words."""
    memo = Memo()

    def count(lang: str, words: list[bytes], counts: Counter) -> None:
        if not words:
            return
        hashes = memo.hashes(lang, words)
        counts[b""] += int(np.count_nonzero(hashes))
        run = (hashes != 0) & often.value.passes(chained(hashes, 1))
        counts.update([words[i] for i in np.flatnonzero(run).tolist()])
        if most < 2:
            return
        good = run = run[:-1] & run[1:] & known.value.passes(chained(hashes, 2))
        for k in range(2, most + 1):
            at = np.flatnonzero(run).tolist()
            if not at:
                break
            counts.update([b" ".join(words[i : i + k]) for i in at])
            run = run[:-1] & good[k - 1 :]

    return count


def phrase_counts(docs: DataFrame, most: int = WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, phrase, k, f of every phrase of 1 to `most` words with f >= least; lang and its n.

    Each word starts a row of a phrase of every length, counted by hash aggregation after a count within the task. A
    phrase can only be frequent if every part of it is, and most words and pairs of words are seen once or twice. So words
    are counted by their hashes first, then pairs by theirs, where both words pass the filter of frequent words; words and
    phrases become rows where they and all their pairs pass the filters of frequent hashes. Rows that could not reach
    `least` are not made, and no count of the others changes; what passes by chance is counted like any other and falls
    short.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.col("text").cast("binary").alias("_text"))

    def frequent(k: int, known=None):
        counts = texts.mapInArrow(_hash_counts(k, known), "hash long, f long").groupBy("hash").agg(F.sum("f").alias("f"))
        return spark.sparkContext.broadcast(frequent_filter(cut(counts.where(F.col("f") >= least).select("hash"))))

    often = frequent(1)
    counted = _counted(texts, _phrases(often, frequent(2, often) if most >= 2 else None, most))
    counted = cut(counted.where((F.col("f") >= least) | (F.col("phrase") == "")))
    totals = counted.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return counted.where("phrase <> ''").withColumn("k", F.size(F.split("phrase", " "))), totals


def _key(lang: str | Column, phrase: str | Column) -> Column:
    """One text for a language and phrase: a phrase has no line feed, so the two can't run together."""
    return F.concat_ws("\n", phrase, lang)


def _first(n: int | Column) -> Column:
    return F.array_join(F.slice("_words", 1, n), " ")


def collocations(docs: DataFrame, most: int = WORDS, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is 2 to `most` words in a row within a piece of a text, counted a >= least times in its language; n counts
    the language's words. Cut after some word it has the counts l and r, and scores floor(1000*a*n/(l*r)); its lowest cut
    counts, of equal ones the first. Products are decimals of 38 digits. A phrase that stands in a longer one of at most
    `most` words with at least `share` percent of its count goes; as counts only fall with length, one word more at
    either end tells. Ranks go by score and a, falling, then by the phrase's bytes.

    A null text is empty, a null language `und`; repeated rows count each; texts of any length are read whole; a text
    without words, or an empty table, gives nothing; other columns are ignored.
    """
    phrases, totals = phrase_counts(docs, most, least)
    phrases = cut(phrases.withColumn("_key", _key("lang", "phrase")))
    candidates = phrases.where("k >= 2")
    # Anti-join of one-word extensions: a row for either end of each longer phrase, the larger count of each inner one.
    ends = F.array(F.array_join(F.slice("_words", 1, F.col("k") - 1), " "), F.array_join(F.slice("_words", 2, F.col("k") - 1), " "))
    inner = phrases.where("k >= 3").withColumn("_words", F.split("phrase", " ")).select("lang", "f", F.explode(ends).alias("_part"))
    inner = inner.groupBy(_key("lang", "_part").alias("_inner")).agg(F.max("f").alias("_longest"))
    gone = (F.col("_key") == F.col("_inner")) & (100 * F.col("_longest") >= share * F.col("f"))
    kept = candidates.join(inner, gone, "left_anti")
    # A row for each cut; the counts of first parts, then of rests. Parts such as "the" belong to very many phrases.
    cuts = kept.withColumn("_words", F.split("phrase", " ")).withColumn("_cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    rest = F.array_join(F.slice("_words", F.col("_cut") + 1, F.col("k")), " ")
    cuts = cut(cuts.select("lang", "phrase", "_key", F.col("f").alias("a"), "_cut", _key("lang", _first(F.col("_cut"))).alias("_left"), _key("lang", rest).alias("_right")))
    counts = phrases.where(F.col("k") < most)
    met = spread_join(cuts, "_left", "_key", counts.select(F.col("_key").alias("_l"), F.col("f").alias("l")), "_l").drop("_l", "_left")
    met = spread_join(cut(met), "_right", "_key", counts.select(F.col("_key").alias("_r"), F.col("f").alias("r")), "_r").drop("_r", "_right")
    met = spread_join(cut(met), "lang", "_key", totals.select(F.col("lang").alias("_of"), "n"), "_of").drop("_of")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    met = met.withColumn("_over", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("_under", wide("l") * wide("r"))
    met = met.withColumn("score", F.expr("_over div _under"))
    best = F.min(F.struct("score", "_cut", "l", "r")).alias("_best")
    scored = met.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "_best.l", "_best.r", "n", "_best.score")
    # Ranks within parts leave out what can't be among the first; ranks over all come from prefix sums over ranges.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    placed = cut(running_totals(dealt.drop("_part", "rank"), [F.asc("lang"), *order], "a"))
    firsts = placed.groupBy(F.col("lang").alias("_of")).agg(F.min("_row").alias("_first"))
    ranked = spread_join(placed, "lang", "phrase", firsts, "_of").withColumn("rank", F.col("_row") - F.col("_first") + 1).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of `op13_collocations`: every phrase at every word, every longer phrase against its parts.
ORACLE = f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
  g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
  p AS (SELECT lang, w[i : i + k - 1] AS ws FROM g, range(1, {WORDS + 1}) r(k) WHERE i + k - 1 <= len(w)),
  f AS (SELECT lang, array_to_string(ws, ' ') AS phrase, any_value(ws) AS ws, count(*) AS f FROM p GROUP BY 1, 2),
  n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
  c AS (SELECT * FROM f WHERE len(ws) >= 2 AND f >= {LEAST}),
  gone AS (SELECT DISTINCT c.lang, c.phrase FROM c, (SELECT lang, ws, f, unnest(range(1, len(ws))) AS k FROM c) q, range(1, {WORDS}) s(i)
    WHERE c.lang = q.lang AND len(c.ws) = k AND i + k - 1 <= len(q.ws) AND c.ws = q.ws[i : i + k - 1] AND 100 * q.f >= {SHARE} * c.f),
  cuts AS (SELECT c.lang, c.phrase, c.f AS a, unnest(range(1, len(ws))) AS k, ws FROM c ANTI JOIN gone USING (lang, phrase)),
  s AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, n, CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM cuts
    JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.ws[1 : k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.ws[k + 1 :], ' ') JOIN n ON n.lang = cuts.lang),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= {TOP}""".replace("\\\\", "\\")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
