"""Mixing sources to target weights: fixed-length blocks of words, dealt out to shards.

Each source's documents are packed one behind the other, in a fixed order spread over buckets, and cut into blocks of equally many words. Output shards draw how many
blocks they take of each source: every block that a source owes falls into a shard by an independent uniform draw, so a shard's counts are multinomial draws given
the sources' totals, and the mix meets every target to one word. A shard's slots are numbered through over the shards; slot j of a source is place j mod n of pass j div n over
its n blocks, and a pseudorandom permutation of that pass (swap-or-not, whose rounds are their own inverses) says which block stands there. Blocks are then joined by
their index. Whole passes take all blocks once; of the last, unfinished pass the first places are taken, so a block, and a document, is never taken more than twice as often.

Everything is DataFrame expressions. Sums over a source run over buckets and then within them, so no source is sorted as a whole; only tables with a row for each source, or source and shard or
bucket, are summed in one go. All draws are arithmetic, so reruns agree, whatever the partitions.

A null text has no words, like an empty one: such documents are rows of the result with nothing taken. A null source is a source like others, the last. Null doc_ids are documents; repeated rows
are documents of their own. A text of any length is as many pieces as it fills blocks. A table without words has targets of zero; an empty table gives no rows. Further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import checkpoint

#: Weights by rank of the source, over and over; the mix's size as a share of all words; how often a source may be taken at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words of a block, output shards, buckets of a source's documents, rounds of a permutation.
BLOCK, SHARDS, BUCKETS, ROUNDS = 512, 64, 256, 24
WORD, BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
_P = 2147483647
_CHUNK = 1 << 16


def mix(x: str) -> str:
    """SQL of a number below 2**31 that looks random, from a number from 0 on: a product, a square and a product modulo a prime."""
    first = f"(({x}) % {_P} * 1103515245 + 12345) % {_P}"
    second = f"(({first}) * ({first}) + 40503) % {_P}"
    return f"((({second}) * 1664525 + 1013904223) % {_P})"


def key(source: str, pass_: str, n: str) -> str:
    """SQL of the key of round r of a source's pass: 0..n-1."""
    return f"(({mix(f'{source} * 1009 + {pass_} * 101 + r')} * 2147483648 + {mix(f'{source} * 2003 + {pass_} * 103 + r + 500000')}) % {n})"


def turn(n: str) -> str:
    """SQL of what a round with the key k makes of y: y and its mirror image about the key trade places if a bit says so that depends on the larger one and the key."""
    mirror = f"((k + {n} - y) % {n})"
    return f"case when {mix(f'greatest(y, {mirror}) % {_P} + k % {_P}')} % 131072 >= 65536 then {mirror} else y end"


def _keys(pass_: int) -> Column:
    return F.expr(f"transform(sequence(1L, {ROUNDS}L), r -> {key('nr', str(pass_), 'n')})")


def permuted(x: str, keys: str) -> Column:
    """Where x of 0..n-1 goes by the rounds' keys; by the reversed keys: what goes to x."""
    return F.expr(f"aggregate({keys}, cast({x} as bigint), (y, k) -> {turn('n')})")


def beside(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df, stored, with a row for each source: sent to all tasks if it has so many rows at most, else joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the words of each of docs (doc_id, source, text)."""
    words = F.length(F.regexp_replace(F.regexp_replace("text", f"^{BLANK}+", ""), f"{WORD}{BLANK}*", "x"))  # one letter a word, and no list of words
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """source, nr (its rank from 0), source_size, target: shares by weight, none above MOST times the source; what is above goes to the others by weight.

    A source is capped if the common rate, with all sources capped that reach their cap earlier, still reaches its own. One row a source, and one row of sums.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.col("nr") % len(WEIGHTS) + 1).cast("int"))
    ranked = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("nr", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).cast("long")).withColumn("w", w)
    by = Window.orderBy((F.col("cap") / F.col("w")).asc(), "nr")
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    sums = ranked.withColumn("cap", F.col("source_size") * MOST).withColumns({"share": F.sum("source_size").over(everything) * SHARE, "gone": F.coalesce(F.sum("cap").over(before), F.lit(0)), "left": F.sum("w").over(rest)})
    capped = (F.col("share") - F.col("gone")) / F.col("left") * F.col("w") >= F.col("cap")
    marked = sums.withColumn("capped", capped)
    gone, left = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything), F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0)).over(everything)
    return marked.select("source", "nr", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("share") - gone) / left * F.col("w")).alias("target"))


def plan(sums: DataFrame, block: int = BLOCK) -> DataFrame:
    """sums with what each source owes: n (blocks), last (words of the last one), whole (passes), over (words of the pass after them), place (of the short block in that pass), slots."""
    taken = F.floor("target").cast("long")
    some = sums.where("source_size > 0").withColumns({"n": F.expr(f"(source_size + {block - 1}) div {block}"), "whole": F.expr("cast(floor(target) as bigint) div source_size")})
    some = some.withColumns({"last": F.expr(f"source_size - {block} * (n - 1)"), "over": taken - F.col("whole") * F.col("source_size")})
    some = some.withColumn("keys", F.array(*[_keys(p) for p in range(MOST + 1)]))
    some = some.withColumn("place", permuted("n - 1", "reverse(keys[whole])"))
    ceil = lambda x: f"({x} + {block - 1}) div {block}"
    part = f"case when over <= {block} * place then {ceil('over')} when over <= {block} * place + last then place + 1 else place + 1 + {ceil(f'(over - {block} * place - last)')} end"
    return some.withColumn("slots", F.expr(f"whole * n + {part}"))


def _dealt(owed: DataFrame, shards: int) -> DataFrame:
    """nr, shard, first (the source's slots in earlier shards), count: how many slots of each source a shard draws."""
    pieces = owed.where("slots > 0").select("nr", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {_CHUNK})")).alias("piece"))
    draws = pieces.repartition("nr", "piece").select("nr", F.explode(F.expr(f"sequence(piece * {_CHUNK}, least(slots, (piece + 1) * {_CHUNK}) - 1)")).alias("j"))
    drawn = draws.select("nr", F.expr(f"{mix('j % 1000003 * 31 + j div 1000003 * 17 + nr * 7919')} % {shards}").alias("shard"))
    counts = drawn.groupBy("nr", "shard").agg(F.count("*").alias("count"))
    return counts.withColumn("first", F.coalesce(F.sum("count").over(Window.partitionBy("nr").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def slots(owed: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """nr, shard, slot (from 0 in its shard and source), index (of the block), take (its first words): every slot of the mix."""
    with_source = _dealt(owed, shards).join(beside(owed), "nr")
    each = with_source.select("*", F.explode(F.expr(f"sequence(0L, (count - 1) div {_CHUNK})")).alias("piece")).repartition("nr", "shard", "piece")
    each = each.select("*", F.explode(F.expr(f"sequence(piece * {_CHUNK}, least(count, (piece + 1) * {_CHUNK}) - 1)")).alias("slot"))
    at = each.withColumns({"pass": F.expr("(first + slot) div n"), "rank": F.expr("(first + slot) % n")}).withColumn("index", permuted("rank", "keys[pass]"))
    length = f"case when index = n - 1 then last else {block} end"
    upto = f"case when rank <= place then {block} * rank else {block} * (rank - 1) + last end"
    return at.select("nr", "shard", "slot", "index", F.expr(f"case when pass < whole then {length} else greatest(0L, least({length}, over - ({upto}))) end").alias("take"))


def packed(sized: DataFrame, sums: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """sized with nr, bucket, seat (its number there) and start: the words of its source before it."""
    at = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(1000003)) * 31 + F.col("size"), F.lit(buckets)).cast("long")
    rows = sized.withColumn("bucket", at).join(beside(sums.select(F.col("source").alias("s"), "nr", "source_size", "target")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    of = rows.groupBy("nr", "bucket").agg(F.sum("size").alias("words"))
    ahead = of.select("nr", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("nr").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    by = Window.partitionBy("nr", "bucket").orderBy(F.asc_nulls_first("doc_id"), "size")
    seated = rows.withColumns({"seat": F.row_number().over(by), "within": F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return seated.join(ahead, ["nr", "bucket"]).withColumn("start", F.col("ahead") + F.col("within")).drop("ahead", "within")


def pieces(seated: DataFrame, block: int = BLOCK) -> DataFrame:
    """seated rows cut at the ends of blocks: index (null where there are no words), at (first word in the block), offset (first word in the document), length."""
    cut = seated.withColumn("index", F.explode_outer(F.when(F.col("size") > 0, F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"))))
    lo = F.greatest(F.col("start"), F.col("index") * block)
    return cut.withColumns({"at": lo - F.col("index") * block, "offset": lo - F.col("start"), "length": F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block) - lo})


def spans(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """shard, source, slot, at, doc_id, offset, length: which words of which documents make up each block of the mix; slot and at order a shard's blocks of a source."""
    sized = checkpoint(sizes(docs))
    sums = checkpoint(targets(sized))
    owed = checkpoint(plan(sums, block))
    taken = slots(owed, shards, block).where("take > 0").join(pieces(packed(sized, sums, buckets), block), ["nr", "index"])
    length = F.least(F.col("length"), F.col("take") - F.col("at"))
    return taken.select("shard", "source", "slot", "at", "doc_id", "offset", length.alias("length")).where("length > 0")


def texts(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """shard, source, slot, text: the blocks of the mix, words joined by a space. docs have no doc_id twice. A block has ``block`` words at most, so gathering its pieces is bounded."""
    words = docs.select("doc_id", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"))
    cut = spans(docs, block, shards, buckets).join(words, "doc_id").select("shard", "source", "slot", "at", F.array_join(F.slice("words", F.col("offset").cast("int") + 1, F.col("length").cast("int")), " ").alias("part"))
    joined = cut.groupBy("shard", "source", "slot").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    return joined.select("shard", "source", "slot", F.array_join("parts.part", " ").alias("text"))


def digests(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target, taken for each of docs: the words that the mix takes of it, repeats counted."""
    sized = checkpoint(sizes(docs))
    sums = checkpoint(targets(sized))
    owed = checkpoint(plan(sums, block))
    uses = slots(owed, shards, block).where("take > 0").groupBy("nr", "index").agg(F.collect_list("take").alias("takes"))  # as many as MOST
    cut = pieces(packed(sized, sums, buckets), block).join(uses, ["nr", "index"], "left")
    of_piece = F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + F.greatest(F.lit(0).cast("long"), F.least(F.col("length"), t - F.col("at"))))
    whole = cut.groupBy("nr", "bucket", "seat", "doc_id", "size", "source_size", "target").agg(F.sum(F.coalesce(of_piece, F.lit(0))).cast("long").alias("taken"))
    return whole.select("doc_id", "size", "source_size", "target", "taken")
