"""Mixing sources to target weights: word blocks, multinomial source counts of each shard, index permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.common import SPACE, SPACE_WORD, cut, table, whole
from wayline.llm.prefix import running_totals

#: Weights dealt to the sources in code-point order, repeating; the share of all words that the mix has; the most that
#: a source may be repeated.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Words in a block, blocks in an output shard, rounds of the index permutation, slots made by one row.
BLOCK, SHARD_SLOTS, ROUNDS, CHUNK = 64, 4096, 8, 16384
SEED = 20240229
#: Up to so many sources (under 10 MB) are broadcast; beyond that Spark joins them by shuffle.
FEW_SOURCES = 100_000


def source_targets(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per source: source, source_no, source_size, target, blocks, slots.

    Targets share SHARE of all words by weight; where that is above REPEATS times the source, the source stops there and
    the rest is shared again. With the sources sorted by size over weight, a source stops exactly when the level that
    the remaining ones would reach is at least its own, so one pass of running sums finds the final level. The null
    source comes last. Slots are the target in blocks of the source's mean block length, rounded on the running sum, so
    that each source is within one block of its target and never above REPEATS times its blocks.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    whole = Window.partitionBy(F.lit(0))
    level = Window.orderBy("_ratio", "source_no")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    weight_left = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    target = F.when(F.col("_stops"), F.col("_most")).otherwise(
        F.col("_weight") * (F.col("_all") * SHARE - F.col("_stopped")) / F.col("_open")
    )
    running = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        sources.withColumn("source_no", (F.row_number().over(by_name) - 1).cast("int"))
        .withColumn("_weight", weight)
        .withColumn("_most", F.col("source_size") * float(REPEATS))
        .withColumn("_ratio", F.col("_most") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(whole))
        .withColumn("_left", F.col("_all") * SHARE - F.coalesce(F.sum("_most").over(before), F.lit(0.0)))
        .withColumn("_stops", F.col("_left") / weight_left >= F.col("_ratio"))
        .withColumn("_stopped", F.sum(F.when(F.col("_stops"), F.col("_most")).otherwise(0.0)).over(whole))
        .withColumn("_open", F.sum(F.when(~F.col("_stops"), F.col("_weight")).otherwise(0.0)).over(whole))
        .withColumn("target", target)
        .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("_want", F.when(F.col("source_size") > 0, F.col("blocks") * F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("_upto", F.round(F.sum("_want").over(running)).cast("long"))
        .withColumn("slots", F.col("_upto") - F.coalesce(F.lag("_upto").over(Window.orderBy("source_no")), F.lit(0)))
        .withColumn("slots", F.least(F.col("slots"), F.col("blocks") * REPEATS))
        .select("source", "source_no", "source_size", "target", "blocks", "slots")
    )


def permuted(index: str, size: str, *key: str, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..size-1 under the key: swap-or-not rounds, a bijection for any size."""
    keys = ", ".join(f"pmod(xxhash64({', '.join(key)}, {SEED}, {r}), {size})" for r in range(rounds))
    step = (
        f"(x, k) -> if(xxhash64(greatest(x, pmod(k - x, {size})), k, {', '.join(key)}) & 1 = 0, x, pmod(k - x, {size}))"
    )
    return F.expr(f"aggregate(array({keys}), {index}, {step})")


def _with_firsts(targets: DataFrame) -> DataFrame:
    """The sources that fill slots, each with the number of slots before its own."""
    first = F.coalesce(F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return targets.withColumn("_first", first).where("slots > 0").select("source_no", "blocks", "slots", "_first")


def _total(targets: DataFrame) -> int:
    """Slots of the whole mix; 1 where there are none, so that a remainder by it is defined."""
    return targets.agg(F.sum("slots")).first()[0] or 1


def shard_counts(targets: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, source_no, slots: how many of each output shard's slots each source fills.

    One pseudorandom permutation deals all sources' slots over all places of all shards: a shard's counts are a
    multinomial draw by the targets, conditioned on each source's total, which independent draws would miss. The counts
    are summed where the slots are made, so a row for each shard and source is all that moves.
    """
    total = _total(targets)
    chunks = (
        _with_firsts(targets)
        .select("source_no", "slots", "_first", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})")).alias("_chunk"))
        .repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_no", "_chunk")
    )
    places = chunks.select("source_no", F.explode(F.expr(f"sequence(_first + _chunk * {CHUNK}, _first + least(slots, (_chunk + 1) * {CHUNK}) - 1)")).alias("_p"))
    dealt = places.select(permuted("_p", f"{total}L", "-1").alias("_place"), "source_no")
    return dealt.groupBy(F.expr(f"_place div {shard_slots}").alias("shard"), "source_no").agg(F.count(F.lit(1)).alias("slots"))


def draw_slots(targets: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per slot of the mix: shard, place, source_no, pass, block.

    The drawn counts say which slots are whose: shard by shard, each source goes on where its count in the shards before
    left it (prefix sums over shards), and slot k of a source takes block perm(k mod blocks) of pass k div blocks; a
    block is thus taken at most once in each pass. Within its shard the slots' places are permuted.
    """
    total = _total(targets)
    counts = running_totals(shard_counts(targets, shard_slots), [F.col("source_no"), F.col("shard")], "slots")
    firsts = _with_firsts(targets).select(F.col("source_no").alias("_no"), "blocks", "_first")
    if targets.count() <= FEW_SOURCES:
        firsts = F.broadcast(firsts)
    before = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.join(firsts, F.expr("source_no = _no")).withColumn("_at", F.coalesce(F.sum("slots").over(before), F.lit(0)))
    # Few small rows stand for many slots: dealt to a given number of partitions, they aren't coalesced by bytes.
    counts = counts.repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "source_no")
    slots = counts.select("shard", "source_no", "blocks", "_at", (F.col("_start") - F.col("_first")).alias("_k0"), F.explode(F.expr("sequence(0L, slots - 1)")).alias("_j"))
    slots = slots.select(
        "shard", "source_no", "blocks", (F.col("_k0") + F.col("_j")).alias("_k"), (F.col("_at") + F.col("_j")).alias("_p"),
        F.least(F.lit(shard_slots).cast("long"), F.lit(total) - F.col("shard") * shard_slots).alias("_slots"),
    )
    taken = slots.withColumn("pass", F.expr("cast(_k div blocks as int)")).withColumn("_i", F.expr("_k % blocks"))
    return taken.select(
        "shard", permuted("_p", "_slots", "shard", "-2").alias("place"), "source_no", "pass", permuted("_i", "blocks", "source_no", "pass").alias("block")
    )


def document_key(docs: DataFrame) -> Column:
    """A text that rows share only if they repeat one another in every column; never null, so plain equality joins on it
    and rows dealt by it for one purpose need not move for the next."""
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]), {"ignoreNullFields": "false"})
    part = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00"))
    return F.concat_ws(":", part, F.xxhash64("text").cast("string"), F.xxhash64(others).cast("string"), F.col("text").isNull().cast("string")).alias("doc_key")


def placed_documents(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The documents on their sources' word lines, and the sources.

    A document's size is its number of words (null text: 0). Each source's documents follow one another in a
    pseudorandom order that depends on their ids and texts, then on their other columns; equal rows are interchangeable.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(SPACE_WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_key"), document_key(docs),
        )
    )
    targets = cut(source_targets(sized, block))
    order = [F.col("source").asc_nulls_last(), F.xxhash64(F.lit(SEED), "doc_id", "text_key"), F.col("doc_id"), F.col("text_key"), F.col("doc_key")]
    lined = running_totals(sized, order, "size")
    starts = lined.groupBy(F.col("source").alias("_of")).agg(F.min("_start").alias("_source_start"))
    sources = targets.withColumnRenamed("source", "_name").join(starts, F.expr("_name <=> _of")).drop("_of")
    sources = cut(sources)
    if sources.count() <= FEW_SOURCES:
        sources = F.broadcast(sources)
    found = lined.join(sources, F.expr("source <=> _name")).drop("_name")
    return found.withColumn("offset", F.col("_start") - F.col("_source_start")).drop("_start", "_source_start"), targets


def taken_runs(placed: DataFrame, targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Each document once for every block that it has words in, with the passes that take the block.

    Slots and document parts meet on (source_no, block): a block has a few documents' words and at most one slot in each
    pass, so no key is hot. Columns: those of `placed`, block, from (word in the document), words, passes: a bit for each
    pass that takes the block, and slots: shard, place and pass of each slot that takes it.
    """
    placed = placed.drop("slots")  # the source's number of them
    last = f"(offset + size - 1) div {block}"
    parts = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(offset div {block}, {last})")))
    begin, end = F.greatest(F.col("block") * block, F.col("offset")), F.least((F.col("block") + 1) * block, F.col("offset") + F.col("size"))
    parts = parts.withColumn("from", begin - F.col("offset")).withColumn("words", end - begin)
    drawn = draw_slots(targets, shard_slots).groupBy("source_no", "block")
    drawn = drawn.agg(F.sum(F.expr("1L << pass")).alias("passes"), F.collect_list(F.struct("shard", "place", "pass")).alias("slots"))
    met = parts.join(drawn.hint("merge"), ["source_no", "block"], "left")  # its size can't be told from its plan
    # Documents without words have no block to meet on: they are put beside the join.
    none = placed.where("size = 0").withColumn("from", F.lit(0).cast("long")).withColumn("words", F.lit(0).cast("long"))
    return met.unionByName(none, allowMissingColumns=True).withColumn("passes", F.coalesce("passes", F.lit(0)))


def mix_report(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, runs.

    `runs` is where the mix has the document's words: shard and place of each slot that takes some of them, the word of
    the slot's block that they start at, in that order, the pass, the document's first word and the number of words. Read
    by shard, place and start over all documents, the runs are the mix.

    Null texts and texts without words have size 0 and nothing taken; a null source is a source of its own; repeated rows
    are documents of their own; other columns are ignored; an empty table gives no rows. The same rows always give the
    same mix, whatever their order or partitioning.
    """
    runs = taken_runs(*placed_documents(docs, block), block, shard_slots)
    taken = F.sum(F.col("words") * F.bit_count("passes"))
    run = lambda s: F.struct(s["shard"].alias("shard"), s["place"].alias("place"), F.expr(f"offset + from - block * {block}").alias("at"), s["pass"].alias("pass"), F.col("from"), F.col("words"))
    dealt = F.sort_array(F.flatten(F.collect_list(F.transform("slots", run))))
    return (
        runs.groupBy("_row", "doc_id", "source", "size", "source_size", "target")
        .agg(taken.cast("long").alias("taken"), dealt.alias("runs"))
        .drop("_row")
    )


def mix_documents(docs: DataFrame, block: int = BLOCK, pass_column: str | None = None) -> DataFrame:
    """The mix as documents: for each document and pass, what the mix takes of it, in order, as it stands in the text.

    A word goes with the white space after it, the first one also with that before it, so runs that follow one another
    keep lines and indents, and a document that is taken whole is unchanged. A document appears once for each pass that
    takes some of it (at most REPEATS times) and not at all if none does, as is the case for null texts and texts without
    words. Repeated rows are documents of their own; a null id, source or other column stays as it is; ties of the order
    are broken by all columns; an empty table gives no rows. The columns are those of `docs`, and `pass_column`, if named,
    with the number of the pass; n_chars, where it exists, follows the new text.
    """
    runs = taken_runs(*placed_documents(docs, block), block).where("passes <> 0 and words > 0")
    picked = (
        runs.withColumn("_pass", F.explode(F.expr(f"filter(sequence(0, {REPEATS - 1}), p -> passes >> p & 1 = 1)")))
        .groupBy("_row", "doc_key", "_pass")
        .agg(F.sort_array(F.collect_list(F.struct("from", "words"))).alias("_runs"))
    )
    texts = docs.select(document_key(docs).alias("_key"), whole(docs)).dropDuplicates(["_key"])
    met = picked.join(texts, F.expr("doc_key = _key"))
    # The words are a lambda's variable, so that they are found once a row and not once a run.
    words = F.array(F.regexp_extract_all("_doc.text", F.lit(f"(?:^{SPACE}+)?{SPACE_WORD}{SPACE}*"), F.lit(0)))
    run = lambda w: F.transform("_runs", lambda r: F.array_join(F.slice(w, r["from"].cast("int") + 1, r["words"].cast("int")), ""))
    mixed = met.withColumn("_text", F.transform(words, lambda w: F.array_join(run(w), ""))[0])
    cols = {c: F.col(f"_doc.`{c}`") for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("_text").cast("long")
    if pass_column:
        cols[pass_column] = F.col("_pass")
    return mixed.select(*[v.alias(c) for c, v in cols.items()])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "runs")
