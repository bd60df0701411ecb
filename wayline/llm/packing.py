"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.common import cut, small, table
from wayline.llm.prefix import running_totals

#: The public vocabulary, the id after each document, tokens in a sequence.
VOCABULARY, END_ID, CAPACITY = "byte_bpe_50k", 2, 1024
#: Pieces packed together, islands and epochs of each such group, individuals on an island, offspring in an epoch,
#: individuals that migrate.
GROUP, ISLANDS, EPOCHS, POPULATION, OFFSPRING, ELITES = 16384, 2, 3, 4, 22, 2
#: A bin filled to this share is well filled: crossover may inject it whole, at most this share of them at once.
WELL_FILLED, INJECTED = 0.98, 0.02
#: The most bins that an offspring opens beside those that hold duplicates: emptiest ones, and ones of most pieces; orders
#: in which the displaced pieces are fitted; times that the emptiest bin is exchanged away afterwards.
EMPTIEST, FINEST, ORDERS, POLISHED = 300, 300, 6, 2
#: Groups that are packed once more together in part; each gives so many of its emptiest bins and of its bins of most pieces.
SPAN, LOOSE_BINS = 16, 64
SEED = 71
#: Bytes of words whose ids a worker keeps, and characters of texts that it encodes at once; longer texts are encoded alone.
KNOWN = 1 << 22


@cache
def _encoder(vocabulary: str):
    """The vocabulary as ranks: the same ids as its JSON file gives, at over three times the speed."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _tokenizer(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


class Words:
    """A vocabulary's ids of words, each encoded once while it is kept.

    The pattern never matches beyond a word into white space, so a text can be cut before any space that follows no white
    space: a word with the space before it has the same ids in every text. New words are encoded as one text, whose ids
    are told apart by the bytes they stand for.
    """

    def __init__(self, vocabulary: str):
        self.encoder = _encoder(vocabulary)
        self.bytes_of = np.zeros(self.encoder.max_token_value + 1, np.int64)
        for token in self.encoder.token_byte_values():
            self.bytes_of[self.encoder.encode_single_token(token)] = len(token)
        self.kept, self.pool, self.ends, self.size = pa.array([], pa.string()), np.empty(0, np.uint32), np.zeros(1, np.int64), 0

    def encoded(self, text: str) -> np.ndarray:
        return self.encoder.encode_to_numpy(text).astype(np.uint32)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        first = np.r_[0, np.cumsum(pc.list_value_length(cut).to_numpy())]
        coded = cut.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        # An empty word or one that ends in white space is no place to cut after.
        last = pc.utf8_slice_codeunits(words, -1)
        blank = pa.array([c for c in last.unique().to_pylist() if not c or c.isspace()], pa.string())
        uncut = pc.is_in(last, value_set=blank).to_numpy(zero_copy_only=False)
        known = pc.fill_null(pc.index_in(words, value_set=self.kept), -1).to_numpy().astype(np.int64)
        fresh = (known < 0) & ~uncut
        new = words.filter(pa.array(fresh))
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(new)], new), " ")[0].as_py()
        ids = self.encoded(f" {joined}" if len(new) else "")
        stand = np.cumsum(pc.binary_length(new).to_numpy().astype(np.int64) + 1)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), stand) + 1
        known[fresh] = len(self.kept) + np.arange(len(new))
        known[uncut] = len(self.kept) + len(new)
        kept, pool, bounds = pa.concat_arrays([self.kept, new]), np.concatenate([self.pool, ids]), np.concatenate([self.ends, len(self.pool) + ends])
        # The first word has no space before it, and its ids are its text's own.
        heads = [self.encoded(cut[i].values[0].as_py()) for i in range(len(texts))]
        uncut, known = uncut[codes], known[codes]
        place, taken = bounds[known], np.diff(bounds, append=bounds[-1])[known]
        at = len(pool) + np.r_[0, np.cumsum(list(map(len, heads)), dtype=np.int64)]
        place[first[:-1]], taken[first[:-1]] = at[:-1], np.diff(at)
        whole = np.concatenate([pool, *heads])
        out = np.r_[0, np.cumsum(taken)]
        ids = whole[np.arange(out[-1]) + np.repeat(place - out[:-1], taken)]
        direct = np.add.reduceat(uncut, first[:-1], dtype=np.int64) > 0 if len(texts) else []
        if self.size <= KNOWN:
            self.kept, self.pool, self.ends, self.size = kept, pool, bounds, self.size + int(stand[-1] if len(stand) else 0)
        return [self.encoded(text) if d else ids[out[a] : out[b]] for text, d, a, b in zip(texts, direct, first[:-1], first[1:], strict=True)]


_words = cache(Words)


def ids_of_texts(texts: list[str | None], vocabulary: str = VOCABULARY) -> Iterator[np.ndarray]:
    """Ids of each whole text without special tokens, then END_ID. Texts that spell a special token go to the JSON file's
    own tokenizer, which alone knows how to read them."""
    at, some, end = 0, [t or "" for t in texts], np.array([END_ID], "<u4")
    while at < len(some):
        last, size = at, 0
        while last < len(some) and (last == at or size + len(some[last]) <= KNOWN):
            size += len(some[last])
            last += 1
        group = some[at:last]
        plain = _words(vocabulary).ids(["" if "<|" in t or size > KNOWN else t for t in group])
        for text, ids in zip(group, plain, strict=True):
            if "<|" in text:
                ids = np.array(_tokenizer(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)
            elif size > KNOWN:
                ids = _words(vocabulary).encoded(text)
            yield np.append(ids.astype("<u4"), end)
        at = last


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids of one text."""
    return next(ids_of_texts([text], vocabulary))


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences after a first piece that may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(vocabulary: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            found = ids_of_texts(batch.column("text").to_pylist(), vocabulary)
            for doc_id, row, ids in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), found, strict=True):
                rows += [(doc_id, p, s, n, zlib.crc32(ids[s : s + n].tobytes()), row) for p, (s, n) in enumerate(cuts(len(ids), capacity))]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
            )

    return run


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, row (the same for the pieces of one
    input row only, so that rows which repeat a doc_id can be told apart)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(_pieces(vocabulary, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


@dataclass
class Packing:
    """An individual: bins of pieces and how full each is."""

    bins: list[list[int]]
    fills: list[int]

    def score(self, capacity: int) -> tuple[int, float]:
        """Smaller is better: bins, then less of the sum of squared fills."""
        full = np.array(self.fills, float) / capacity
        return len(self.bins), -float(full @ full)

    @cached_property
    def genome(self) -> np.ndarray:
        """Each piece's bin."""
        out = np.empty(sum(map(len, self.bins)), np.int64)
        out[list(chain.from_iterable(self.bins))] = np.repeat(np.arange(len(self.bins)), list(map(len, self.bins)))
        return out


def _with_room(fills: list[int], capacity: int) -> list[int]:
    return np.flatnonzero(np.array(fills, np.int64) < capacity).tolist()


def rooms_of(fills: list[int], capacity: int) -> dict[int, list[int]]:
    """The bins that have each room left."""
    by_room: dict[int, list[int]] = {}
    for b in _with_room(fills, capacity):
        by_room.setdefault(capacity - fills[b], []).append(b)
    return by_room


def best_fit(lengths: list[int], order: Iterable[int], capacity: int, kept: Packing | None = None, by_room: dict[int, list[int]] | None = None) -> Packing:
    """Each piece in turn into the fullest bin that takes it, or a new one. `by_room`: that of the kept bins, if known.
    Neither is changed."""
    bins, fills = ([], []) if kept is None else (list(kept.bins), list(kept.fills))
    by_room = {room: list(held) for room, held in (rooms_of(fills, capacity) if by_room is None else by_room).items()}
    rooms = sorted(by_room)
    for item in order:
        n = lengths[item]
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            held = by_room[room]
            b = held.pop()
            if not held:
                del rooms[at]
            bins[b] = [*bins[b], item]
            fills[b] += n
        else:
            room, b = capacity, len(bins)
            bins.append([item])
            fills.append(n)
        if room := room - n:
            held = by_room.setdefault(room, [])
            if not held:
                insort(rooms, room)
            held.append(b)
    return Packing(bins, fills)


def exchange(lengths: list[int], kept: Packing, loose: list[int], capacity: int) -> list[int]:
    """Fill the kept bins' gaps: a displaced piece takes the place of a shorter one of the bin, as much longer as the gap
    allows. Returns the pieces displaced then; together they are shorter by what the bins gained."""
    free = sorted((lengths[i], i) for i in loose)
    for k in _with_room(kept.fills, capacity):
        gap = capacity - kept.fills[k]
        items = kept.bins[k] = list(kept.bins[k])
        while gap:
            most, place, taken = 0, -1, -1
            for j, i in enumerate(items):
                at = bisect_right(free, (lengths[i] + gap, len(lengths))) - 1
                if at >= 0 and free[at][0] - lengths[i] > most:
                    most, place, taken = free[at][0] - lengths[i], j, at
            if not most:
                break
            out, items[place] = items[place], free.pop(taken)[1]
            insort(free, (lengths[out], out))
            gap -= most
        kept.fills[k] = capacity - gap
    return [i for _, i in free]


def crossed(lengths: list[int], a: Packing, b: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """Inject some of b's well-filled bins whole into a. a's bins that then hold duplicates are opened, as are its
    emptiest and some of its bins of most pieces; what they held otherwise is exchanged for shorter pieces where bins
    have gaps, and best-fitted again in several orders, longest first, with more noise each time."""
    good = np.flatnonzero(np.array(b.fills) >= WELL_FILLED * capacity)
    share = int(rng.integers(0, max(1, int(INJECTED * len(good))))) + 1
    injected = rng.choice(good, min(share, len(good)), replace=False).tolist()
    inside = {i for k in injected for i in b.bins[k]}
    emptiest = np.argsort(a.fills, kind="stable")[: int(EMPTIEST ** rng.random())]
    finest = np.argsort(-np.array(list(map(len, a.bins))) - rng.random(len(a.bins)) * 3, kind="stable")[: int(rng.integers(0, FINEST + 1))]
    opened = np.zeros(len(a.bins), bool)
    opened[[*emptiest, *finest, *a.genome[list(inside)]]] = True
    loose = [i for k in np.flatnonzero(opened).tolist() for i in a.bins[k] if i not in inside]
    stay = (~opened).tolist()
    kept = Packing([*compress(a.bins, stay), *(b.bins[k] for k in injected)], [*compress(a.fills, stay), *(b.fills[k] for k in injected)])
    loose = exchange(lengths, kept, loose, capacity)
    by_room, found = rooms_of(kept.fills, capacity), []
    for i in range(ORDERS):
        noise = rng.random(len(loose)) * 0.2 * i
        order = [x for _, x in sorted(zip((-np.array([lengths[x] for x in loose]) * (1 - noise)).tolist(), loose, strict=True))]
        found.append(best_fit(lengths, order, capacity, kept, by_room))
    return emptied(lengths, min(found, key=lambda p: p.score(capacity)), capacity)


def emptied(lengths: list[int], packing: Packing, capacity: int) -> Packing:
    """The emptiest bin's pieces exchanged for shorter ones wherever other bins have gaps, as often as it gains."""
    for _ in range(POLISHED):
        least = int(np.argmin(packing.fills))
        others = Packing([*packing.bins[:least], *packing.bins[least + 1 :]], [*packing.fills[:least], *packing.fills[least + 1 :]])
        loose = exchange(lengths, others, packing.bins[least], capacity)
        better = best_fit(lengths, sorted(loose, key=lambda i: (-lengths[i], i)), capacity, others)
        if better.score(capacity) >= packing.score(capacity):
            break
        packing = better
    return packing


def evolved(lengths: list[int], population: list[Packing], capacity: int, rng: np.random.Generator, offspring: int = OFFSPRING) -> list[Packing]:
    """One epoch on one island, best first. A new island starts from best-fit decreasing and from orders with noise; each
    offspring replaces the worst individual if it is better. It ends early at the least number of bins that could do."""
    n = len(lengths)
    population = list(population)
    for k in range(POPULATION - len(population)):
        noise = rng.random(n) * (0.05 * k)
        population.append(best_fit(lengths, sorted(range(n), key=lambda i: (-lengths[i] * (1 - noise[i]), i)), capacity))
    scored = sorted(((p.score(capacity), p) for p in population), key=lambda x: x[0])
    floor = -(-sum(lengths) // capacity)
    for _ in range(offspring):
        if scored[0][0][0] <= floor:
            break
        i, j = sorted(rng.choice(len(scored), 2, replace=False))
        child = crossed(lengths, scored[i][1], scored[j][1], capacity, rng)
        rated = (child.score(capacity), child)
        if rated[0] < scored[-1][0]:
            scored = sorted([*scored[:-1], rated], key=lambda x: x[0])
    return [p for _, p in scored]


def _packing(genome: list[int], lengths: list[int]) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(genome, default=-1) + 1)]
    for i, b in enumerate(genome):
        bins[b].append(i)
    return Packing(bins, [sum(lengths[i] for i in b) for b in bins])


def _epoch(capacity: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = row["lengths"]
                rng = np.random.default_rng([SEED, epoch, row["chunk"], row["island"]])
                found = evolved(lengths, [_packing(g, lengths) for g in row["population"] or []], capacity, rng)
                row["population"] = [p.genome.tolist() for p in found[: POPULATION if epoch < EPOCHS - 1 else 1]]
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

    return run


def _migrated(islands: DataFrame) -> DataFrame:
    """Each island's best ELITES also go to the next island, in place of its worst."""
    own = islands.select("chunk", "island", "lengths", F.slice("population", 1, POPULATION - ELITES).alias("_own"))
    gone = islands.select(
        F.col("chunk").alias("_c"), ((F.col("island") + 1) % ISLANDS).cast("int").alias("_i"), F.slice("population", 1, ELITES).alias("_elite")
    )
    met = own.join(gone, F.expr("chunk = _c and island = _i"))
    return met.select("chunk", "island", "lengths", F.concat("_own", "_elite").alias("population"))


def pack_groups(groups: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """groups: chunk, lengths, start (a packing to start from as each piece's bin from 0 without gaps, or null). One row
    per piece: _chunk, _at (its place in `lengths`), _n, _bin. No group gets more bins than it starts with.

    A group is one row with its lengths and the populations of one island, and epochs exchange elites between its islands.
    """
    kind = "chunk long, island int, lengths array<int>, population array<array<int>>"
    islands = groups.select(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths",
        F.expr("if(start is null, null, array(start))").cast("array<array<int>>").alias("population"),
    )
    # Islands are slow to evolve but small to move: dealt to a given number of partitions, they aren't coalesced by bytes.
    partitions = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for epoch in range(EPOCHS):
        if epoch:
            islands = _migrated(islands)
        islands = cut(islands.repartition(partitions, "chunk", "island").mapInArrow(_epoch(capacity, epoch), kind))
    best = islands.withColumn("_g", F.col("population")[0])
    size = F.struct(F.array_max("_g").alias("bins"), "island")
    best = best.groupBy("chunk").agg(F.min_by(F.struct("_g", "lengths"), size).alias("_b"))
    items = best.select("chunk", F.posexplode(F.arrays_zip("_b._g", "_b.lengths")).alias("_at", "_z"))
    return items.select(F.col("chunk").alias("_chunk"), "_at", F.col("_z.lengths").alias("_n"), F.col("_z._g").alias("_bin"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset; no sequence holds more than `capacity` tokens.

    A piece of full length is a sequence by itself. The others are numbered in a pseudorandom order and packed in groups
    of GROUP, so a task holds a few groups whatever the input's size. What a group can't fill well isn't left so:
    LOOSE_BINS of each group's emptiest bins and as many of its bins of most pieces, of SPAN groups together, are packed
    once more by the same algorithm from where they stand.
    """
    held = cut(pieces.withColumn("_id", F.monotonically_increasing_id()))
    whole = held.where(F.col("length") >= capacity)
    alone = whole.select("*", (F.col("_id") * 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = running_totals(held.where(F.col("length") < capacity), [F.xxhash64(F.col("_id"), F.lit(SEED))], "length")
    short = short.withColumn("chunk", F.expr(f"_row div {GROUP}")).withColumn("_item", F.expr(f"cast(_row % {GROUP} as int)"))
    short = cut(short.drop("_start", "_row"))
    groups = short.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("_item", F.col("length").cast("int").alias("n")))).alias("_g"))
    first = pack_groups(groups.select("chunk", F.col("_g.n").alias("lengths"), F.lit(None).cast("array<int>").alias("start")), capacity)
    fills = first.groupBy("_chunk", "_bin").agg(F.sum("_n").alias("_fill"), F.count(F.lit(1)).alias("_pieces"))
    emptiest = F.row_number().over(Window.partitionBy("_chunk").orderBy("_fill", "_bin"))
    finest = F.row_number().over(Window.partitionBy("_chunk").orderBy(F.desc("_pieces"), "_bin"))
    chosen = fills.withColumn("_k", F.least(emptiest, finest)).where(F.col("_k") <= LOOSE_BINS).select("_chunk", "_bin", "_k")
    first = cut(first.join(chosen, ["_chunk", "_bin"], "left"))
    loose = first.where("_k is not null").withColumn("_span", F.expr(f"_chunk div {SPAN}"))
    stands = F.dense_rank().over(Window.partitionBy("_span").orderBy("_chunk", "_bin")) - 1
    piece = F.struct("_chunk", "_at", F.col("_n").cast("int").alias("n"), "_stands")
    loose = loose.withColumn("_stands", stands.cast("int")).groupBy(F.col("_span").alias("chunk")).agg(F.array_sort(F.collect_list(piece)).alias("_g"))
    loose = cut(loose.select("chunk", F.col("_g.n").alias("lengths"), F.col("_g._stands").alias("start"), "_g"))
    second = pack_groups(loose.drop("_g"), capacity).select(F.col("_chunk").alias("_c"), F.col("_at").alias("_a"), F.col("_bin").alias("_b"))
    members = loose.select("chunk", F.posexplode("_g").alias("_p", "_x")).join(second, F.expr("chunk = _c and _p = _a"))
    placed = first.where("_k is null").select("_chunk", "_at", "_n", (F.expr(f"_chunk * {GROUP} + _bin") * 3 + 1).alias("sequence_id"))
    placed = placed.unionByName(
        members.select("_x._chunk", "_x._at", F.col("_x.n").alias("_n"), (F.expr(f"chunk * {GROUP * SPAN} + _b") * 3 + 2).alias("sequence_id"))
    )
    before = Window.partitionBy("sequence_id").orderBy("_chunk", "_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long"))
    packed = short.join(placed, F.expr("chunk = _chunk and _item = _at"))
    columns = [*pieces.columns, "sequence_id", "offset"]
    return packed.select(*columns).unionByName(alone.select(*columns))


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, row, sequence_id, offset.

    A null or empty text is one piece of one id. Repeated rows are packed each. Only documents longer than a sequence are
    cut. Other columns are ignored; an empty table gives no rows.
    """
    return pack(token_pieces(docs, vocabulary, capacity), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
