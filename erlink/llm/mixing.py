"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only.

1. Sizes: words of each text. Sources by code point, null last, weigh 5, 2, 1 and so on; their targets share all words,
   at most EPOCHS times a source's own, what is over being shared again by weight (water filling, in closed form).
2. Blocks: a source's documents are put in the order of a hash of their id and cut into blocks of equal word counts.
3. Schedule: slot t gets the golden-ratio point frac(t / phi), in integers, and falls to the source whose stretch of the
   cumulative weights holds it. A slot's rank within its source names the block it takes; after the last block the
   source starts anew, EPOCHS times at most.
4. A document takes the words that its blocks' slots take.
Ranks and offsets are prefix sums in two levels (sums of chunks, then within a chunk), so that no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erlink.llm.common import WORD, materialize, small

WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Slots aimed at; blocks then hold total / SLOTS words, between 1 and MAX_BLOCK.
SLOTS = 1 << 16
MAX_BLOCK = 4096
#: Fixed value: 2**31 / golden ratio, made odd; points are multiples of 2**-31.
GOLDEN, MODULUS = 1327217885, 1 << 31
UNIT = 1_000_000_000
#: Cells of the points' range, by which slots find the stretches of the sources with an equi-join.
CELL = MODULUS >> 12
#: Rows of a chunk in prefix sums.
CHUNK = 1 << 11


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """From source, source_size (one row a source): also idx, weight and target. One small row per source.

    A source stays at its cap iff, sources sorted by cap / weight, the level that the others would reach is not below
    its own ratio; the sums are of integers and exact.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    s = sources.withColumn("idx", F.row_number().over(by_name).cast("bigint"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("idx") - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "idx")
    before, after, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    cap = F.col("source_size") * epochs
    s = s.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_rest", F.col("_total") - F.coalesce(F.sum(cap).over(before), F.lit(0))).withColumn("_open", F.sum("weight").over(after))
    s = s.withColumn("_full", cap * F.col("_open") <= F.col("_rest") * F.col("weight"))
    level = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_full"), cap)).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(everything)
    return s.select("source", "source_size", "idx", "weight", F.when(F.col("_full"), cap.cast("double")).otherwise((level * F.col("weight")).cast("double") / open_weight).alias("target"))


def _offsets(rows: DataFrame, group: str, chunk: str, order: list, amount: Column, name: str) -> DataFrame:
    """rows with name: the sum of amount over earlier rows of the group, chunks first, then order within a chunk."""
    sums = rows.groupBy(group, chunk).agg(F.sum(amount).alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(group, chunk, start.alias("_start"))
    within = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums, [group, chunk]).withColumn(name, F.col("_start") + F.coalesce(F.sum(amount).over(within), F.lit(0))).drop("_start")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    A null text has size 0, as one without a word: it takes nothing. A null source is a source, the last. Rows that
    repeat an id, or have none, are rows of their own, in order of size; equal rows are alike. No words at all: everything
    is 0. An empty table gives no rows. Very long texts are counted whole. Only the three named columns are read, so
    others may have any name. Reruns agree.

    Rows of equal source, id and size are one row with a count until the last step, so that no number of them, nor any
    number of rows without an id, meets in a window.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size"))
    sized = sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    sized = materialize(sized.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-sizes")
    words_of = F.col("size") * F.col("copies")
    sources = materialize(targets(sized.groupBy("source").agg(F.sum(words_of).alias("source_size"))), "mix-sources")
    head = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(words_of), F.lit(0)).alias("total")).first()
    block = max(1, min(MAX_BLOCK, head["total"] // SLOTS))
    digits = 1
    while 16**digits * CHUNK < head["n"]:
        digits += 1

    # Per source: its blocks, and slots wanted = target / mean words of a block.
    blocks = F.expr(f"(source_size + {block} - 1) div {block}")
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    plan = sources.withColumn("blocks", blocks).withColumn("wanted", wanted).withColumn("all_wanted", F.sum("wanted").over(Window.partitionBy()))
    plan = plan.withColumn("w", F.when(F.col("all_wanted") > 0, F.round(F.col("wanted") / F.col("all_wanted") * UNIT)).otherwise(0).cast("bigint"))
    cum = F.sum("w").over(Window.orderBy("idx"))
    plan = plan.withColumn("hi", cum).withColumn("lo", cum - F.col("w")).withColumn("w_all", F.sum("w").over(Window.partitionBy()))
    plan = plan.withColumn("slots", F.ceil(F.col("all_wanted")))
    plan = materialize(plan, "mix-plan")
    of_plan = plan.agg(F.max("slots").alias("slots"), F.count(F.lit(1)).alias("n")).first()
    n_slots = (of_plan["slots"] or 0) if head["total"] else 0

    # The schedule: each slot's source, its rank there, the block it takes.
    t = F.col("id")
    slots = spark.range(n_slots).select(t.alias("slot"), F.expr(f"id div {CHUNK}").alias("chunk"), (((t % MODULUS) * GOLDEN) % MODULUS).alias("point"))
    cells = F.sequence(F.expr(f"(lo * {MODULUS} div w_all) div {CELL}"), F.expr(f"(hi * {MODULUS} div w_all) div {CELL}"))
    stretches = plan.where("w > 0").select("idx", "lo", "hi", "w_all", "blocks", F.explode(cells).alias("cell"))
    stretches = small(stretches, of_plan["n"] + MODULUS // CELL, 64)
    slots = slots.withColumn("cell", F.expr(f"point div {CELL}")).join(stretches, "cell")
    slots = slots.where((F.col("point") * F.col("w_all") >= F.col("lo") * MODULUS) & (F.col("point") * F.col("w_all") < F.col("hi") * MODULUS))
    ranked = _offsets(slots, "idx", "chunk", ["slot"], F.lit(1), "rank").where(F.col("rank") < F.col("blocks") * EPOCHS)
    times = ranked.groupBy("idx", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))

    # The documents in shuffled order, cut into blocks.
    named = sized.join(small(plan.select(F.col("source").alias("_s"), "idx", "source_size", "target"), of_plan["n"], 256), sized["source"].eqNullSafe(F.col("_s"))).drop("_s")
    placed = _offsets(named.withColumn("part", F.substring("h", 1, digits)), "idx", "part", ["h", "doc_id", "size"], words_of, "first")
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).withColumn("start", F.col("first") + F.col("copy") * F.col("size"))
    spans = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).otherwise(F.array(F.lit(-1).cast("bigint")))
    cut = placed.withColumn("block", F.explode(spans))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    key = ["idx", "doc_id", "size", "copy", "source_size", "target"]
    taken = cut.join(times, ["idx", "block"], "left").groupBy(*key).agg(F.sum(F.when(F.col("size") > 0, words * F.coalesce("times", F.lit(0))).otherwise(0)).alias("taken"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def oracle(weights: tuple[int, ...] = WEIGHTS) -> str:
    """DuckDB SQL of mix() over documents, with single-level prefix sums and targets by levels tried one by one."""
    case = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    return rf"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint size, md5(coalesce(doc_id::varchar, '')) h from documents),
src as (select source, sum(size)::bigint source_size from sized group by source),
named as (select *, row_number() over (order by source is null, encode(source)) idx from src),
weighed as (select *, case (idx - 1) % {len(weights)} {case} end::bigint weight, (select sum(source_size)::bigint from src) total from named),
fullness as (select a.*, coalesce((select sum({EPOCHS} * b.source_size) from weighed b where (b.source_size / b.weight, b.idx) < (a.source_size / a.weight, a.idx)), 0)::bigint cap_before,
    (select sum(b.weight) from weighed b where (b.source_size / b.weight, b.idx) >= (a.source_size / a.weight, a.idx))::bigint open_weight from weighed a),
full_ as (select *, {EPOCHS} * source_size * open_weight <= (total - cap_before) * weight is_full from fullness),
tgt as (select source, source_size, idx, case when is_full then ({EPOCHS} * source_size)::double else
    (((total - coalesce((select sum({EPOCHS} * source_size) from full_ where is_full), 0))::bigint * weight)::double / (select sum(weight) from full_ where not is_full)) end target, total from full_),
par as (select greatest(1, least({MAX_BLOCK}, coalesce(max(total), 0) // {SLOTS}))::bigint block from tgt),
wanted as (select tgt.*, block, (source_size + block - 1) // block blocks, case when source_size > 0 then target * ((source_size + block - 1) // block) / source_size else 0.0 end wanted from tgt, par),
weights as (select *, case when sum(wanted) over () > 0 then round(wanted / sum(wanted) over () * {UNIT}) else 0 end::bigint w, ceil(sum(wanted) over ())::bigint slots from wanted),
plan as (select *, (sum(w) over (order by idx))::bigint hi, (sum(w) over ())::bigint w_all from weights),
points as (select t slot, ((t % {MODULUS}) * {GOLDEN}) % {MODULUS} point from (select unnest(range((select max(slots) from plan))) t)),
given as (select slot, idx, blocks, row_number() over (partition by idx order by slot) - 1 r from points join plan on point * w_all >= (hi - w) * {MODULUS} and point * w_all < hi * {MODULUS}),
times as (select idx, r % blocks b, count(*) times from given where r < {EPOCHS} * blocks group by all),
placed as (select s.*, p.idx, p.block, p.source_size, p.target, coalesce(sum(size) over (partition by p.idx order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint start,
    row_number() over (partition by p.idx order by h, doc_id, size) rn from sized s join plan p on s.source is not distinct from p.source),
cut as (select *, unnest(range(start // block, (start + size - 1) // block + 1)) b from placed where size > 0),
got as (select cut.idx, rn, sum((least(start + size, (cut.b + 1) * block) - greatest(start, cut.b * block)) * coalesce(times, 0)) taken from cut left join times on times.idx = cut.idx and times.b = cut.b group by all)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint taken from placed left join got using (idx, rn)"""
