"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents, in order of their ids, are cut into blocks of eight rows, and a block into quanta of two rows;
a slot of the mix holds one quantum. With weight w, quantum k (from 0) of a source is released at slot floor(k / w) and
due by ceil((k + 1) / w); the earliest-deadline-first rule fills the slots.

One fold over all slots would be one task's work, so the same rule is applied level by level. The root deals frames of
many slots: each frame takes, earliest deadline first, as many released quanta as it has slots. Each frame is then dealt
into `FAN` smaller ones with its own whole numbers of quanta as weights, and so on down to single slots; the frames of a
level are independent rows. Every level is a Pfair schedule of its own, in which a source is less than one quantum off
its share, and shares between a frame's ends lie on a line; so with `LEVELS` levels at most a source is at every slot
less than `LEVELS` quanta, one block, off its target weight times the slots, whatever the number of sources and slots.

Target weights are taken as whole multiples of 2^-40 of the largest. A source that has run out leaves its slots idle;
sources without a positive weight follow after all others, by name.

Rows are ranked by range partitions on source and id (their borders come from samples of the data, so a hot source or
one far id spreads), from the row's place in its partition and the counts of the partitions before.

Defined results: null sources are a source of their own; a null id ranks after all others by the hash of its text; rows
with the same id and text are interchangeable; weights that are null, negative or not a number are none; an empty table
gives no rows; other columns pass through, under any name: the helper columns of `place_documents` begin with `mix_`,
after as many underscores as it takes to be new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import checkpoint, new_names

BLOCK_ROWS, LEVELS, FAN, UNIT, POWER = 8, 4, 256, 1 << 40, 0.5
QUANTUM_ROWS = BLOCK_ROWS // LEVELS
#: Tables of plans up to this number of bytes are broadcast; larger ones are joined by key.
MAX_BROADCAST_BYTES = 8 << 20
PLACE = ("mix_block", "mix_seq", "mix_slot", "mix_release", "mix_deadline")


def targets(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, source_col: str = "source") -> DataFrame:
    """source, quanta (that it has) and g, its target weight in units of 2^-40 of the largest, at least 1 if positive.

    The weight of a source defaults to its number of documents to the given power; a weight that is not given is 0, and
    the null source's is given as ""."""
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    weight: Column = F.round(F.pow(F.col("rows").cast("double"), F.lit(power)), 6)
    if weights is not None:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 0.0)], "name string, given double")
        sizes = sizes.join(given, F.coalesce("source", F.lit("")) == F.col("name"), "left")
        weight = F.when((F.col("given") > 0) & ~F.isnan("given"), F.col("given")).otherwise(0.0)
    # One row a source in the window.
    g = F.expr(f"CASE WHEN weight > 0 THEN greatest(cast(round(weight / max(weight) over () * {UNIT}) as bigint), 1L) ELSE 0L END")
    return sizes.withColumn("weight", weight).select("source", F.ceil(F.col("rows") / QUANTUM_ROWS).alias("quanta"), g.alias("g"))


def deal(frames: DataFrame, number: int, cap: int, wide: bool = False) -> DataFrame:
    """Deals each frame (start, total and e: an array of source number i, weight b, had and quanta) into `number` frames of
    `cap` quanta. Their weights are whole quanta; sources without any leave a frame, and frames without quanta that
    exist go. `wide` computes in decimals, where products leave 64 bits.

    The fold's state is what each source has had. A source's quanta that are due by a frame's end are `low`; one further
    quantum is a candidate if it is released by then, and those with the earliest deadlines fill the frame."""
    big = "decimal(18, 0)" if wide else "bigint"
    end = f"cast({cap} * (x + 1) as {big})"
    let = lambda name, value, then: f"transform(array({value}), {name} -> {then})[0]"
    low = f"transform(e, (q, i) -> greatest(s.had[i], (cast(q.b as {big}) * {end}) div total))"
    due = f"cast(((cast(low[i] + 1 as {big}) * total + cast(q.b as {big}) * {cap} - 1) div (cast(q.b as {big}) * {cap})) as bigint) * size(e) + i"
    keys = f"transform(e, (q, i) -> CASE WHEN cast(low[i] as {big}) * total < cast(q.b as {big}) * {end} THEN {due} END)"
    last = f"get(array_sort(filter(keys, k -> k is not null)), cast({cap} * (x + 1) - aggregate(low, 0L, (t, l) -> t + l) - 1 as int))"
    had = "transform(low, (l, i) -> l + CASE WHEN keys[i] <= last THEN 1L ELSE 0L END)"
    step = let("low", low, let("keys", keys, let("last", last, had)))
    begin = "transform(e, q -> 0L)"
    fold = f"aggregate(sequence(0L, {number - 1}L), named_struct('had', {begin}, 'out', array({begin})), (s, x) -> {let('h', step, 'named_struct(' + repr('had') + ', h, ' + repr('out') + ', concat(s.out, array(h)))')}, s -> s.out)"
    shares = frames.selectExpr("start", "e", f"cast(total as {big}) as total").selectExpr("start", "e", f"{fold} as out")
    cut = shares.selectExpr("start", "e", "explode(transform(sequence(1, size(out) - 1), x -> struct(x - 1 as nr, out[x - 1] as low, out[x] as high))) as f")
    entry = "named_struct('i', q.i, 'b', f.high[n] - f.low[n], 'had', q.had + f.low[n], 'quanta', q.quanta)"
    small = cut.selectExpr(f"start + f.nr * {cap}L as start", f"{cap}L as total", f"filter(transform(e, (q, n) -> {entry}), q -> q.b > 0) as e")
    return small.where("exists(e, q -> q.had < q.quanta)")


def schedule(sources: DataFrame) -> DataFrame:
    """source, g, total, nth and slot: the slot of each quantum of each source of `targets` with a positive weight."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("source").isNotNull().alias("named"), "source", "quanta", "g")))  # one entry a source
    root = sources.where("g > 0").groupBy().agg(listed.alias("s")).where("size(s) > 0").selectExpr("s", "aggregate(s, 0L, (t, x) -> t + x.g) as total")
    root = checkpoint(root)
    found = root.selectExpr("array_max(transform(s, x -> cast(ceil(cast(x.quanta as decimal(18, 0)) * cast(total as decimal(18, 0)) / x.g) as bigint))) as slots").first()
    slots, levels, fan = (found.slots if found else 1), 2, FAN
    while levels < LEVELS and slots > FAN**levels:
        levels += 1
    while slots > fan**levels:
        fan = max(fan + 1, round(slots ** (1 / levels)))
    cap = fan ** (levels - 1)
    frames = root.selectExpr("0L as start", "total", "transform(s, (x, i) -> named_struct('i', i, 'b', x.g, 'had', 0L, 'quanta', x.quanta)) as e")
    frames = deal(frames, -(-slots // cap), cap, wide=True)
    while cap > 1:
        cap //= fan
        # The frames of a level are few and small but take long: a given number of partitions is not coalesced.
        frames = deal(checkpoint(frames.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "start")), fan, cap, wide=(fan * cap) ** 2 >= 1 << 62)
    plan = frames.selectExpr("start as slot", "e[0].i as i", "e[0].had as nth").where("nth is not null")
    names = root.select("total", F.posexplode("s").alias("i", "x")).selectExpr("i", "x.source", "x.g", "x.quanta", "total")
    return plan.join(names, "i").where("nth < quanta").select("source", "g", "total", "nth", "slot")


def _joined(left: DataFrame, right: DataFrame, on: Column, rows: int, width: int) -> DataFrame:
    """Left join, by broadcast where the right side is proven small."""
    return left.join(F.broadcast(right) if rows * width <= MAX_BROADCAST_BYTES else right, on, "left")


def place_documents(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """The rows with the columns `names` (default: those of `PLACE` that are new): the block of the source, the place in
    the block, the slot, and the ideal times of the block: the slots by which a source with its exact weight would begin
    and have ended it (null without a weight)."""
    block, seq, slot, release, deadline = names or new_names(docs, *PLACE)
    own, place, part = new_names(docs.withColumns({n: F.lit(0) for n in (block, seq, slot, release, deadline)}), "mix_own", "mix_place", "mix_part")
    source, rank = F.col(source_col).cast("string"), F.col(id_col).cast("long")
    order = [F.col(own).isNotNull(), F.col(own), rank.isNull(), rank, F.xxhash64(text_col)]
    ranged = docs.withColumn(own, source).repartitionByRange(*order).sortWithinPartitions(*order)
    # Position in a partition: the low 33 bits of this function; the partition's number: the bits above.
    placed = checkpoint(ranged.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33)))
    counts = placed.groupBy(F.col(own).alias("source"), F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min(place).alias("first"))
    counts = checkpoint(counts.selectExpr("source", "part", "first - coalesce(sum(rows) over (partition by source order by part rows between unbounded preceding and 1 preceding), 0L) as base"))
    aims = checkpoint(targets(placed, weights, power, own))
    plan = schedule(aims).withColumn("chunk", F.expr("nth div 64"))
    chunks = checkpoint(plan.groupBy("source", "g", "total", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("nth", "slot"))).alias("slots"), F.max("slot").alias("last")))
    size = chunks.agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last")).first()
    # Sources without a weight, one after the other behind the last slot.
    behind = aims.where("g = 0").selectExpr("source as behind_source", f"{(size.last if size.last is not None else -1) + 1}L + coalesce(sum(quanta) over (order by source rows between unbounded preceding and 1 preceding), 0L) as behind")

    rows = _joined(placed, counts.toDF("c_source", "c_part", "c_base"), F.col(own).eqNullSafe(F.col("c_source")) & (F.col(part) == F.col("c_part")), counts.count(), 80)
    nth = F.col(place) - F.col("c_base")
    rows = rows.withColumn(place, nth).drop("c_source", "c_part", "c_base")
    quantum = F.expr(f"`{place}` div {QUANTUM_ROWS}")
    sides = chunks.toDF("p_source", "p_g", "p_total", "p_chunk", "p_slots", "p_last").drop("p_last")
    rows = _joined(rows, sides, F.col(own).eqNullSafe(F.col("p_source")) & (F.expr(f"`{place}` div {64 * QUANTUM_ROWS}") == F.col("p_chunk")), size.n, 64 * 16 + 80)
    rows = _joined(rows, behind, F.col(own).eqNullSafe(F.col("behind_source")), behind.count(), 80)
    at = lambda blocks, up: F.expr(f"cast((cast({LEVELS} * ({blocks}) as decimal(18, 0)) * cast(p_total as decimal(18, 0)) + {up}) div p_g as bigint)")
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.expr(f"`{place}` div {BLOCK_ROWS}").alias(block), (F.col(place) % BLOCK_ROWS).cast("int").alias(seq),
        F.coalesce(F.element_at("p_slots", quantum), F.col("behind") + quantum).alias(slot), at(f"`{place}` div {BLOCK_ROWS}", "0").alias(release), at(f"`{place}` div {BLOCK_ROWS} + 1", "p_g - 1").alias(deadline),
    )


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """The same rows and columns, range-partitioned and sorted by their place in the mix."""
    names = new_names(docs, *PLACE)
    order = (names[2], names[0], names[1])
    return place_documents(docs, names=names, **options).repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in docs.columns])
