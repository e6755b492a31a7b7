"""Mixing sources to target weights (operator 8), in DataFrame and SQL functions only.

The words of each source make a stream that is cut into blocks of fixed length.
A source's target gives it a number of slots, and all slots of the mix are dealt
to output shards of ``SHARD_SLOTS`` slots each (the last may have fewer) like
balls from an urn: a pseudorandom permutation of all slots says which shard each
falls into.  How many a shard gets of each source is so a multinomial draw on
condition of the sources' totals; no source can pass three times its size by
chance, and every shard has its fixed size.

These counts are the table that ``draw`` makes.  A shard takes so many of each
source's slots, which are numbered shard after shard; a permutation of the
source's block numbers maps slot to block (going round again when all blocks are
used), and slots and blocks are joined by number.  So the counts say which words
go to which shard.  ``mixed`` arranges the rows of each partition by shard, and what reads them in
order, as packing does, finds in every stretch the sources in their shares.

Running sums go by runs of bounded length and then over the runs, so not even a
source with a third of all rows is summed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
#: Slots of an output shard.
SHARD_SLOTS = 4096
#: Documents that one task puts in order at most, about.
ORDERED = 5000
#: Rows of a running sum that are summed together.
RUN = 1024
#: Elements that one row is exploded to at most (as long as a source has less than the cube of them).
STEP = 4096
MOST = 3
#: Rounds of the permutation of blocks, and of that which deals slots to shards.
ROUNDS, DRAW_ROUNDS = 4, 12
_P = 2147483647  # a prime; products with factors below 2**17 stay in 64 bits


def scatter(x: str) -> str:
    """A spread number in 0 .. 2**31 - 2."""
    return f"((abs(({x}) % {_P}) * 48271 + 11) % {_P})"


def first_place(k: str, n: str, key: str) -> str:
    """The permutation of 0 .. n - 1 that all begins with: a multiplier without a common factor with n."""
    return f"((({k}) * (CASE WHEN ({n}) % 16777213 = 0 THEN 8388593 ELSE 16777213 END) + {key}) % ({n}))"


def partner(x: str, n: str, key: str, i: int) -> str:
    """Where x would go in round i: place and partner are swapped or not together."""
    wide = f"({scatter(f'({key}) * 31 + {i}')} * 131071 + {scatter(f'({key}) * 37 + {i} + 5')})"
    return f"((({wide} % ({n})) - {x} + ({n})) % ({n}))"


def mark(x: str, other: str, key: str, i: int) -> str:
    """A number that a pair of places shares in round i."""
    return scatter(f"greatest({x}, {other}) + ({key}) * 7919 + {i} * 104729")


def permute(df: DataFrame, to: str, k: str, n: str, key: str, rounds: int = ROUNDS) -> DataFrame:
    """Add the place that a permutation of 0 .. n - 1, one for each key, gives k; a pair is swapped where the square of its mark is odd."""
    df = df.withColumn(to, F.expr(first_place(k, n, key)))
    for i in range(rounds):
        df = df.withColumn("_other", F.expr(partner(to, n, key, i))).withColumn("_mark", F.expr(mark(to, "_other", key, i)))
        df = df.withColumn(to, F.expr(f"CASE WHEN (_mark * _mark + _mark) % {_P} % 2 = 1 THEN _other ELSE {to} END"))
    return df.drop("_other", "_mark").withColumn(to, F.coalesce(to, F.lit(-1).cast("long")))  # never null: no filter is derived that repeats all this


def running(df: DataFrame, by: list[str], number: str, value: str, to: str) -> DataFrame:
    """df with the sum of value over rows of the same keys with a smaller number: inside runs of RUN numbers, and over the runs before."""
    earlier = lambda order, *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    df = df.withColumn("_run", F.expr(f"{number} div {RUN}"))
    runs = df.groupBy(*by, "_run").agg(F.sum(value).alias("_sum"))
    # One more level, so that a window over runs has few of them.
    high = runs.groupBy(*by, F.expr(f"_run div {RUN}").alias("_high")).agg(F.sum("_sum").alias("_all"))
    high = high.withColumn("_lead", F.coalesce(F.sum("_all").over(earlier("_high", *by)), none)).drop("_all")
    runs = runs.withColumn("_high", F.expr(f"_run div {RUN}")).withColumn("_in", F.coalesce(F.sum("_sum").over(earlier("_run", *by, "_high")), none))
    same = lambda a, b, *more: F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in [*by, *more]))
    runs = runs.alias("r").join(high.alias("h"), same("r", "h", "_high")).select(*(F.col(f"r.{c}") for c in [*by, "_run"]), (F.col("_in") + F.col("_lead")).alias("_before"))
    df = df.withColumn("_in", F.coalesce(F.sum(value).over(earlier(number, *by, "_run")), none))
    rest = [c for c in df.columns if c not in ("_run", "_in")]
    return df.alias("d").join(runs.alias("r"), same("d", "r", "_run")).select(*(F.col(f"d.{c}") for c in rest), (F.col("_in") + F.col("_before")).alias(to))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, rank, target from source, source_size; one row a source.

    Ranks go by code point, null last; weights 1, 2, 3 in turn share the sum of
    sizes.  Sources in order of size / weight fill up first; the first that has
    room at the level of the rest ends the resharing.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    ranked = ranked.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank").asc()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    level = ranked.withColumn("level", left.cast("double") / weights).withColumn("room", F.col("level") * F.col("weight") <= F.col("cap"))
    level = level.withColumn("at", F.min(F.when(F.col("room"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight")))
    return level.select("source", "source_size", "rank", target.alias("target"))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS, row_col: str | None = None) -> DataFrame:
    """One row for each document: doc_id, size, its source's figures, and where its words begin in the source's stream.

    A stream is ordered by a hash of the id.  Hashes are cut into ranges, each
    summed and ordered for itself, so a source of any size is spread out.
    row_col is the number of a row, which is passed on as row.
    """
    row = [] if row_col is None else ["row"]
    base = common.written(docs.select(*(F.col(row_col).alias(r) for r in row), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size")), "sizes")
    step = -(-_P // max(1, -(-base.count() // ORDERED)))
    base = base.withColumn("h", F.expr(scatter("coalesce(doc_id, 0)"))).withColumn("part", F.expr(f"h div {step}"))
    parts = common.written(base.groupBy("source", "part").agg(F.sum("size").alias("words")), "parts")
    goal = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")))
    goal = goal.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    goal = goal.withColumn("slots", F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("long"))
    lead = running(parts, ["source"], "part", "words", "before").alias("p").join(goal.alias("g"), F.expr("p.source <=> g.source")).select("p.source", "p.part", "before", "rank", "source_size", "target", "blocks", "slots")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = base.withColumn("inside", inside).alias("b").join(lead.alias("l").hint("merge"), F.expr("b.source <=> l.source AND b.part = l.part"))
    return placed.select(*row, "doc_id", "size", "b.source", "rank", "source_size", "target", "blocks", "slots", (F.col("before") + F.col("inside")).alias("start"))


def _numbers(df: DataFrame, n: str, to: str) -> DataFrame:
    """A row for each number 0 .. n - 1, by three small steps, spread out again after each."""
    far = F.expr(f"sequence(0L, ({n} - 1) div {STEP * STEP})")
    df = df.where(f"{n} > 0").withColumn("_far", F.explode(far)).repartition("rank", "_far")
    df = df.withColumn("_near", F.explode(F.expr(f"sequence(_far * {STEP}, least(_far * {STEP} + {STEP - 1}, ({n} - 1) div {STEP}))"))).repartition("rank", "_near")
    return df.withColumn(to, F.explode(F.expr(f"sequence(_near * {STEP}, least(_near * {STEP} + {STEP - 1}, {n} - 1))"))).drop("_far", "_near")


def draw(goal: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(rank, blocks, shard, n): how many slots each shard takes of each source; goal has rank, blocks and slots of each source.

    Slots lie in the urn source by source.  The place that the permutation gives
    a slot is its place in the mix, and shard_slots places make a shard.
    """
    order = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    urn = goal.withColumn("all", F.sum("slots").over(Window.partitionBy())).withColumn("lead", F.coalesce(F.sum("slots").over(order), F.lit(0)))
    each = _numbers(urn, "slots", "k").withColumn("u", F.expr("lead + k"))
    each = permute(each, "place", "u", "all", "7L", DRAW_ROUNDS)
    return each.groupBy("rank", "blocks", F.expr(f"place div {shard_slots}").alias("shard")).agg(F.count("*").alias("n"))


def slots(drawn: DataFrame) -> DataFrame:
    """(shard, rank, block, round): every slot of the mix and the block that fills it, from the counts of draw(), which should be a written table."""
    numbered = running(drawn, ["rank"], "shard", "n", "first")
    each = numbered.repartition("rank", "shard").withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    each = permute(each.withColumn("k", F.expr("slot % blocks")), "block", "k", "blocks", "rank")
    return each.select("shard", "rank", "block", F.expr("slot div blocks").alias("round"))


def mix(placed: DataFrame, *, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: shard, round, and which words (from, n) of which document it takes there.

    placed comes from place().  Blocks are joined with their slots by number;
    each block is one key of at most three slots, so no key is hot.  Both sides
    grow with the data and the size of exploded rows is guessed too low, so a
    merge join is asked for.
    """
    goal = placed.where("size > 0").groupBy("rank").agg(F.max("blocks").alias("blocks"), F.max("slots").alias("slots"))
    cut = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    cut = cut.withColumn("from", F.greatest(F.col("block") * block - F.col("start"), F.lit(0)))
    cut = cut.withColumn("n", F.least((F.col("block") + 1) * block - F.col("start"), F.col("size")) - F.col("from"))
    drawn = common.written(draw(goal, shard_slots), "drawn")
    return cut.select(*(c for c in ("row",) if c in placed.columns), "rank", "block", "doc_id", "start", "size", "from", "n").join(slots(drawn).hint("merge"), ["rank", "block"])


def taken(docs: DataFrame, *, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, **columns) -> DataFrame:
    """Of each document: doc_id, size, source_size, target, taken (words that the mix takes of it), n_shards that take some, and the first_shard of these (-1 if none).

    A null or wordless text has size 0 and is never taken.  Repeated rows are
    documents of their own.  A null id counts as 0 in the order of its stream.
    """
    placed = common.written(place(docs, block=block, **columns), "placed")
    pieces = mix(placed, block=block, shard_slots=shard_slots).select("rank", "start", "shard", "n").repartition("rank", "start")
    used = pieces.groupBy("rank", "start", "shard").agg(F.sum("n").alias("n")).groupBy("rank", "start").agg(F.sum("n").alias("taken"), F.count("*").alias("n_shards"), F.min("shard").alias("first_shard"))
    none = F.lit(0).cast("long")
    figures = ["doc_id", "size", "source_size", "target"]
    full = placed.where("size > 0").join(used.hint("merge"), ["rank", "start"], "left").select(*figures, F.coalesce("taken", none).alias("taken"), F.coalesce("n_shards", none).alias("n_shards"), F.coalesce("first_shard", F.lit(-1)).cast("long").alias("first_shard"))
    return full.union(placed.where("size = 0").select(*figures, none, none, F.lit(-1).cast("long")))


def mixed(docs: DataFrame, *, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", shard_col: str | None = None) -> DataFrame:
    """The rows of docs as the mix takes them, one for each round that takes some of their words, arranged by shard.

    A round that takes all words of a document repeats its text; otherwise the
    text is the words taken, each with the white space after it, in order.  A
    row belongs to the shard that takes the first of its words.  Each partition
    has its part of every shard, one shard after another, and inside a shard
    rows go by a hash; shard_col names a column for the shard, so that whoever
    wants whole shards can repartition by it, which moves all texts once more.
    Rows are numbered once, as they are written, so ids may be null or repeated.
    Names of columns that are needed on the way are such as docs does not have.
    """
    row, size, n, parts, words_, shard = (common.free(docs, c) for c in ("_row", "_size", "_n", "_parts", "_words", "_shard"))
    rows = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    placed = common.written(place(rows, block=block, id_col=id_col, text_col=text_col, source_col=source_col, row_col=row), "placed")
    rounds = mix(placed, block=block, shard_slots=shard_slots).groupBy("row", "size", "round").agg(F.array_sort(F.collect_list(F.struct("from", "n"))).alias("parts"), F.sum("n").alias("n"), F.min_by("shard", "from").alias("shard"))
    rounds = rounds.select(F.col("row").alias(row), F.col("size").alias(size), F.col("parts").alias(parts), F.col("n").alias(n), F.col("shard").alias(shard))
    both = rows.join(rounds.hint("merge"), row)
    both = both.sortWithinPartitions(shard, F.xxhash64(row, n), row)  # texts are moved once, by the join
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    piece = F.array_join(F.flatten(F.transform(parts, lambda p: F.slice(F.col(words_), (p["from"] + 1).cast("int"), p["n"].cast("int")))), "")
    both = both.withColumn(words_, F.when(F.col(n) < F.col(size), tokens))
    both = both.withColumn(text_col, F.when(F.col(n) < F.col(size), piece).otherwise(F.col(text_col)))
    if length_col in docs.columns:
        both = both.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return both.select(*docs.columns, *([] if shard_col is None else [F.col(shard).alias(shard_col)]))


def _permuted(name: str, start: str, n: str, key: str, rounds: int) -> str:
    """SQL: the tables of a permutation; start is the one that has k, and the last one has its place as x."""
    spread = lambda x: f"((abs(({x}) % 2147483647) * 48271 + 11) % 2147483647)"
    out = [f"{name}0 AS (SELECT *, (k * (CASE WHEN {n} % 16777213 = 0 THEN 8388593 ELSE 16777213 END) + {key}) % {n} AS x FROM {start})"]
    for i in range(rounds):
        wide = f"({spread(f'{key} * 31 + {i}')} * 131071 + {spread(f'{key} * 37 + {i} + 5')})"
        out.append(f"{name}q{i} AS (SELECT *, ({wide} % {n} - x + {n}) % {n} AS y FROM {name}{i})")
        out.append(f"{name}r{i} AS (SELECT *, {spread(f'greatest(x, y) + {key} * 7919 + {i} * 104729')} AS z FROM {name}q{i})")
        out.append(f"{name}{i + 1} AS (SELECT * EXCLUDE (x, y, z), CASE WHEN (z * z + z) % 2147483647 % 2 = 1 THEN y ELSE x END AS x FROM {name}r{i})")
    return ",\n    ".join(out)


def sql(documents: str = "documents") -> str:
    """What taken() gives, for DuckDB: all slots are dealt to places, those of a source take its blocks in order of these, and both permutations are written out."""
    return f"""
    WITH base AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, (abs(coalesce(doc_id, 0) % 2147483647) * 48271 + 11) % 2147483647 AS spread
        FROM {documents}),
    sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM base GROUP BY source),
    ranked AS (SELECT source, words, row_number() OVER (ORDER BY source NULLS LAST) AS rank, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
    ordered AS (SELECT *, row_number() OVER (ORDER BY 3 * words / CAST(weight AS DOUBLE), rank) AS turn FROM ranked),
    levels AS (
        SELECT a.turn, ((SELECT sum(words) FROM ranked) - coalesce((SELECT sum(3 * words) FROM ordered b WHERE b.turn < a.turn), 0)) / CAST((SELECT sum(weight) FROM ordered b WHERE b.turn >= a.turn) AS DOUBLE) AS level, 3 * words AS most, weight
        FROM ordered a),
    water AS (SELECT min_by(level, turn) AS level FROM levels WHERE level * weight <= most),
    goal AS (SELECT source, rank, words, least(CAST(3 * words AS DOUBLE), coalesce(level * weight, CAST(3 * words AS DOUBLE))) AS target, CAST(ceil(words / 64.0) AS BIGINT) AS n FROM ranked, water),
    dealt AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(target * n / words + 0.5) AS BIGINT) END AS slots FROM goal),
    blocks AS (SELECT rank, n, unnest(range(n)) AS k FROM dealt),
    {_permuted("p", "blocks", "n", "rank", ROUNDS)},
    lead AS (SELECT rank, n, slots, CAST(sum(slots) OVER () AS BIGINT) AS every, CAST(coalesce(sum(slots) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM dealt),
    urn AS (SELECT rank, n, every, before + i AS k FROM (SELECT *, unnest(range(slots)) AS i FROM lead)),
    {_permuted("u", "urn", "every", "CAST(7 AS BIGINT)", DRAW_ROUNDS)},
    slots AS (SELECT rank, n, x // {SHARD_SLOTS} AS shard, row_number() OVER (PARTITION BY rank ORDER BY x) - 1 AS slot FROM u{DRAW_ROUNDS}),
    uses AS (SELECT s.rank, p.x AS block, s.shard FROM slots s JOIN p{ROUNDS} p ON s.rank = p.rank AND s.slot % s.n = p.k),
    placed AS (
        SELECT b.doc_id, b.size, d.rank, d.words, d.target, coalesce(sum(b.size) OVER (PARTITION BY d.rank ORDER BY b.spread, b.doc_id NULLS FIRST, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM base b JOIN dealt d ON b.source IS NOT DISTINCT FROM d.source),
    pieces AS (SELECT rank, start, size, unnest(range(CAST(start // 64 AS BIGINT), CAST((start + size - 1) // 64 + 1 AS BIGINT))) AS block FROM placed WHERE size > 0),
    took AS (
        SELECT p.rank, p.start, sum(least(64 * (p.block + 1), p.start + p.size) - greatest(64 * p.block, p.start)) AS taken, count(DISTINCT u.shard) AS n_shards, min(u.shard) AS first_shard
        FROM pieces p JOIN uses u ON p.rank = u.rank AND p.block = u.block GROUP BY p.rank, p.start)
    SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, p.words AS source_size, p.target, CAST(CASE WHEN p.size > 0 THEN coalesce(t.taken, 0) ELSE 0 END AS BIGINT) AS taken,
        CASE WHEN p.size > 0 THEN coalesce(t.n_shards, 0) ELSE 0 END AS n_shards, CAST(CASE WHEN p.size > 0 THEN coalesce(t.first_shard, -1) ELSE -1 END AS BIGINT) AS first_shard
    FROM placed p LEFT JOIN took t ON p.rank = t.rank AND p.start = t.start"""
