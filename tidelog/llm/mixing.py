"""Mix sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

1. Each source gets a target: its weight's share of the budget, at most ``MAX_EPOCHS``
   times its own size; what a capped source leaves goes to the others by weight. The
   targets solve sum(min(cap, weight * level)) = budget, whose level follows from the
   running sums of caps and weights in order of cap / weight.
2. The budget is cut into blocks of ``BLOCK_WORDS`` words. Blocks go to the highest
   quotients target / (2 * seats + 1). Two divisors bracket the result: one seats no more
   blocks than there are, one no fewer, so only the quotients between them are listed and
   ranked, about two for each source whatever the budget.
3. A source's documents are dealt over its shards by a seeded hash, and its blocks over the
   shards by the same apportionment with the shard's size as its claim. A source has a
   shard for each ``SHARD_WORDS`` words, at least one and at most ``SHARDS``, so a shard
   holds many blocks and what its last block leaves over is small beside it.
4. In a shard the documents lie in seeded order on a ring of words. The shard's quota is a
   run of blocks on the ring from a seeded block on, so a document gives the words of it
   that the run covers: once around is one repeat of the shard.

Texts are read once for their sizes, and only ids, sizes and hashes are shuffled. ``mixed``
turns each shard's run into the arc of seeded hashes that it covers: a row a shard, which
is broadcast up to ``ARCS`` rows and joined by a shuffle beyond; then each document knows
by its own hash how often it is taken, where it lies.

A source of any size is spread over its shards before anything is sorted. What meets in
one task is a row per source, or per shard of one source; both are bounded.

Defined results: null text has size 0, and a size of 0 takes nothing. Null is a source of
its own, last in order. Ties of quotients go by source order, then seat; rows that tie in
seeded order are equal in id and text, and which of them comes first changes no total.
``mixed`` takes rows that are equal in id and text alike. An empty table gives an empty
result. Other columns, whatever their names, are kept and not read; ``take`` leaves the
text out, and replaces size, source_size, target and taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, boxed, broadcast_up_to, staged, table, unboxed, word_count

#: By source order, repeating.
WEIGHTS = (3, 1, 2)
#: Budget in hundredths of all sizes, and how often a source may repeat.
BUDGET_PERCENT, MAX_EPOCHS = 150, 2
#: Words in a block and in a shard, shards of a source at most, and the seed of orders and of runs.
BLOCK_WORDS, SHARD_WORDS, SHARDS, SEED = 16, 16384, 4096, 20240601
#: Rows of a table of sources or of arcs that are broadcast at most; a row has about 100 bytes.
ARCS = 200_000
#: A word, whose characters are all but these six.
WORD = r"[^\x20\x09-\x0D]"


def digest(*columns: Column) -> Column:
    """Nulls among the columns are left out."""
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), *[c.cast("string") for c in columns]))


def sixty_bits(hexadecimal: Column, first: int = 1) -> Column:
    """A long from 15 digits, ``first`` being 1 or 16."""
    return F.conv(F.substring(hexadecimal, first, 15), 16, 10).cast("long")


def seeded(*columns: Column) -> Column:
    return sixty_bits(digest(*columns))


def targets(sources: DataFrame) -> DataFrame:
    """sources: source, source_size. Adds position, weight and target (double)."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    budget = F.sum("source_size").over(W.partitionBy()) * (BUDGET_PERCENT / 100)
    ranked = (
        sources.withColumn("position", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("position") % len(WEIGHTS) + 1).cast("int")).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(MAX_EPOCHS)))
        .withColumn("budget", budget)
    )
    fill = W.orderBy(F.col("cap") / F.col("weight"), "position")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    # Were this source and all after it in fill order uncapped, they would share what is left at this level.
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("open", F.col("cap") > F.col("weight") * F.col("level"))
    final = F.max(F.when(F.col("open"), F.struct(-F.col("cap") / F.col("weight"), -F.col("position"), F.col("level").alias("level")))).over(W.partitionBy())
    return filled.withColumn("final", final["level"]).withColumn("target", F.coalesce(F.least("cap", F.col("weight") * F.col("final")), "cap")).drop("level", "open", "final", "cap", "budget")


def apportion(claims: DataFrame, within: list[str], claim: str, seats: str, total: str, tie: list[str], most: Column | None = None) -> DataFrame:
    """Sainte-Laguë: adds the long ``seats`` by which the ``total`` of each group is shared out by ``claim``.

    within: the columns of a group; total: a column that is equal in all its rows; tie: the
    order of rows among equal quotients; most: seats that a row can hold.
    """
    group = W.partitionBy(*within)
    n, all_claims = F.count("*").over(group), F.sum(F.col(claim).cast("double")).over(group)
    most = F.lit(2**62) if most is None else most

    def at(divisor: Column) -> Column:
        return F.least(most, F.greatest(F.lit(0), F.floor(F.col(claim) / divisor + 0.5)))

    sized = claims.withColumn("__n", n).withColumn("__all", all_claims).where(F.col("__all") > 0)
    # round(x) lies within a half of x, so these divisors seat at most and at least the total.
    few = F.when(F.col(total) > F.col("__n") / 2, at(F.col("__all") / (F.col(total) - F.col("__n") / 2))).otherwise(0)
    bracketed = sized.withColumn("__low", few.cast("long")).withColumn("__high", at(F.col("__all") / (F.col(total) + F.col("__n") / 2 + 1)).cast("long"))
    bracketed = bracketed.withColumn("__left", F.col(total) - F.sum("__low").over(group))
    keys = [*within, *tie]
    row = bracketed.columns
    listed = bracketed.withColumn("__seat", F.explode(F.sequence(F.col("__low"), F.greatest("__high", "__low"))))
    # Seat number __high is listed too, as a row of its own with no quotient, so that every claim keeps a row.
    quotient = F.when(F.col("__seat") < F.col("__high"), F.col(claim) / (2 * F.col("__seat") + 1))
    best = W.partitionBy(*within).orderBy(F.col("__q").desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tie], "__seat")
    ranked = listed.withColumn("__q", quotient).withColumn("__rank", F.row_number().over(best))
    won = F.count(F.when((F.col("__rank") <= F.col("__left")) & F.col("__q").isNotNull(), 1))
    held = ranked.groupBy(*keys).agg(*[F.first(c).alias(c) for c in row if c not in keys], won.alias("__won"))
    return held.withColumn(seats, F.col("__low") + F.col("__won")).drop("__n", "__all", "__low", "__high", "__left", "__won")


# Of a document: its source's key (the source behind a mark, so that null sources meet in
# joins too), the hash that deals it to a shard, and its place in the seeded order.


def key_of(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def deal_of(id_: Column, text: Column) -> Column:
    return sixty_bits(digest(id_, text))


def place_of(id_: Column, text: Column) -> Column:
    return sixty_bits(digest(id_, text), 16)


def shard_of() -> Column:
    return F.pmod("deal", F.col("shards")).cast("int").alias("shard")


class Plan:
    """sources: key, source_size, target, shards. laid: the given rows with shard, the first word ``from`` on its ring, the ring's ``ring`` words, ``run`` and ``start``."""

    def __init__(self, rows: DataFrame, scratch: Scratch):
        """rows, staged: key, deal, place and size, and others."""
        sums = staged(rows.groupBy("key").agg(F.sum("size").alias("source_size")), scratch)
        named = sums.withColumn("source", F.when(F.col("key").startswith("s"), F.substring("key", 2, 2**31 - 1)))
        # What the targets add up to, by whole numbers, whose sum is the same in any order.
        budget = F.sum("source_size").over(W.partitionBy()) * min(BUDGET_PERCENT / 100, float(MAX_EPOCHS))
        known = targets(named).withColumn("blocks", F.round(budget / BLOCK_WORDS).cast("long"))
        # A source without words has no seats, but a size and a target.
        seated = apportion(known, [], "target", "seats", "blocks", ["position"]).select("key", "seats")
        shards = F.least(F.lit(SHARDS), F.greatest(F.lit(1), F.floor(F.col("source_size") / SHARD_WORDS)))
        self.sources = staged(known.join(seated, "key", "left").select("key", "source_size", "target", shards.alias("shards"), F.coalesce("seats", F.lit(0)).alias("seats")), scratch)
        dealt = rows.join(broadcast_up_to(self.sources.select("key", "shards"), ARCS), "key").withColumn("shard", shard_of())
        words = dealt.groupBy("key", "shard").agg(F.sum("size").alias("ring")).where("ring > 0").join(self.sources.select("key", "seats"), "key")
        quotas = apportion(words, ["key"], "ring", "quota", "seats", ["shard"], F.ceil(F.col("ring") * MAX_EPOCHS / BLOCK_WORDS))
        run = F.least(F.col("quota") * BLOCK_WORDS, F.col("ring") * MAX_EPOCHS)
        start = F.pmod(seeded(F.lit("run"), F.col("key"), F.col("shard")), F.ceil(F.col("ring") / BLOCK_WORDS)) * BLOCK_WORDS
        self.runs = staged(quotas.select("key", "shard", "ring", run.alias("run"), start.alias("start")), scratch)
        along = W.partitionBy("key", "shard").orderBy("place", "size").rowsBetween(W.unboundedPreceding, 0)
        self.laid = dealt.withColumn("from", F.sum("size").over(along) - F.col("size")).join(broadcast_up_to(self.runs, ARCS), ["key", "shard"], "left")


def take(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``df`` without its text, with size, source_size, target and taken in place of columns so named."""
    text, id_ = F.col(text_col).cast("string"), F.col(id_col)
    slim = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("row")
    rows = staged(df.select(slim, key_of(F.col(source_col)).alias("key"), deal_of(id_, text).alias("deal"), place_of(id_, text).alias("place"), word_count(text).alias("size")))
    plan = Plan(rows, Scratch())

    # Words of [0, x) on the endless ring that lie in the document: whole rounds, then a part.
    def upto(x: Column) -> Column:
        return F.floor(x / F.col("ring")) * F.col("size") + F.least("size", F.greatest(F.lit(0), x % F.col("ring") - F.col("from")))

    taken = F.coalesce(upto(F.col("start") + F.col("run")) - upto(F.col("start")), F.lit(0)).cast("long").alias("taken")
    laid = plan.laid.select("row", "key", "size", taken).join(broadcast_up_to(plan.sources.select("key", "source_size", "target"), ARCS), "key")
    return unboxed(laid, "size", "source_size", "target", "taken", without=("size", "source_size", "target", "taken"))


def arcs(plan: Plan) -> DataFrame:
    """A row a shard: key, shard, ``rounds``, and which places the run covers once more: from low_0 to high_0, from low_1 to high_1, and ``also``."""
    rest = F.pmod("run", F.col("ring"))
    begin, end = F.pmod("start", F.col("ring")), F.pmod("start", F.col("ring")) + rest
    # A run that goes past the ring's end has a second part at its beginning.
    parts = [(begin, F.least(end, "ring")), (F.lit(0), end - F.col("ring"))]
    upto = F.col("from") + F.col("size")
    whole = [(F.col("size") > 0) & (F.col("from") >= a) & (upto <= b) for a, b in parts]
    covered = sum(F.greatest(F.lit(0), F.least(b, upto) - F.greatest(a, F.col("from"))) for a, b in parts)
    # Of a document that is covered in part, the part is the chance of one more copy.
    chance = F.pmod(seeded(F.lit("copy"), F.col("place")), F.lit(1 << 20)) / (1 << 20)
    cut = (F.col("size") > 0) & (covered > 0) & ~whole[0] & ~whole[1] & (covered / F.col("size") > chance)
    found = [f(F.when(w, F.col("place"))).alias(f"{name}_{i}") for i, w in enumerate(whole) for f, name in ((F.min, "low"), (F.max, "high"))]
    own = plan.laid.where("run is not null")
    return own.groupBy("key", "shard").agg(F.first(F.floor(F.col("run") / F.col("ring"))).alias("rounds"), *found, F.collect_set(F.when(cut, F.col("place"))).alias("also"))


def mixed(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mix as whole documents, with the columns of ``df``: each row as often as the mix takes it, which is at most ``MAX_EPOCHS`` times. Texts aren't shuffled."""
    scratch = Scratch()
    text, id_ = F.col(text_col).cast("string"), F.col(id_col)
    own = {"key": key_of(F.col(source_col)), "deal": deal_of(id_, text), "place": place_of(id_, text)}
    plan = Plan(staged(df.select(*[c.alias(n) for n, c in own.items()], word_count(text).alias("size")), scratch), scratch)
    taken, sources = staged(arcs(plan)), staged(plan.sources.select("key", "shards"))
    scratch.drop()
    rows = boxed(df, some=F.coalesce(text.rlike(WORD), F.lit(False)), **own)
    rows = rows.join(broadcast_up_to(sources, ARCS), "key").withColumn("shard", shard_of()).join(broadcast_up_to(taken, ARCS), ["key", "shard"])
    inside = [F.coalesce(F.col("place").between(F.col(f"low_{i}"), F.col(f"high_{i}")), F.lit(False)) for i in (0, 1)]
    once_more = inside[0] | inside[1] | F.array_contains("also", F.col("place"))
    copies = F.when(F.col("some"), F.least(F.lit(MAX_EPOCHS), F.col("rounds") + once_more.cast("int"))).otherwise(0).cast("int")
    return unboxed(rows.select("row", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


#: Lists every quotient that could win a seat; the query lists two or so for each claim.
SQL = rf"""
with d as (select doc_id, coalesce('s' || source, 'n') as key, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}+')) as size, md5(concat_ws('|', '{SEED}', doc_id::varchar, text)) as h from documents),
sized as (select source, key, sum(size)::bigint as source_size from d group by source, key),
placed as (select *, row_number() over (order by source nulls last) - 1 as position from sized),
weighed as (select *, [{", ".join(map(str, WEIGHTS))}][position % {len(WEIGHTS)} + 1]::double as weight, source_size * {MAX_EPOCHS}::double as cap, sum(source_size) over () * ({BUDGET_PERCENT} / 100::double) as budget from placed),
filled as (select *, (budget - coalesce(sum(cap) over (order by cap / weight, position rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, position rows between current row and unbounded following) as level from weighed),
aimed as (select *, least(cap, weight * (select level from filled where cap > weight * level order by cap / weight, position limit 1)) as target from filled),
bids as (select key, position, target, budget, unnest(range(ceil(target / {BLOCK_WORDS})::bigint + (select count(*) from aimed))) as seat from aimed where target > 0),
won as (select key, count(*) as seats from (select key, row_number() over (order by target / (2 * seat + 1) desc, position, seat) as n, round(budget / {BLOCK_WORDS}) as blocks from bids) where n <= blocks group by key),
sources as (select key, source_size, target, coalesce(seats, 0) as seats, least({SHARDS}, greatest(1, source_size // {SHARD_WORDS})) as shards from aimed left join won using (key)),
dealt as (select doc_id, key, size, source_size, target, seats, ('0x' || h[1:15])::bigint % shards as shard, ('0x' || h[16:30])::bigint as place from d join sources using (key)),
rings as (select key, shard, any_value(seats) as seats, sum(size)::bigint as ring from dealt group by key, shard having sum(size) > 0),
claims as (select *, unnest(range(ceil(ring * {MAX_EPOCHS} / {BLOCK_WORDS})::bigint)) as seat from rings),
held as (select key, shard, count(*) filter (where n <= seats) as quota from (select key, shard, seats, row_number() over (partition by key order by ring / (2 * seat + 1) desc, shard, seat) as n from claims) group by key, shard),
runs as (select key, shard, ring, least(quota * {BLOCK_WORDS}, ring * {MAX_EPOCHS}) as run, ('0x' || md5(concat_ws('|', '{SEED}', 'run', key, shard::varchar))[1:15])::bigint % ceil(ring / {BLOCK_WORDS})::bigint * {BLOCK_WORDS} as start from rings join held using (key, shard)),
laid as (select dealt.*, ring, start, start + run as stop, (sum(size) over (partition by dealt.key, dealt.shard order by place, size rows unbounded preceding) - size)::bigint as behind from dealt left join runs on dealt.key = runs.key and dealt.shard = runs.shard)
select doc_id, size, source_size, target, coalesce(stop // ring * size + least(size, greatest(0, stop % ring - behind)) - start // ring * size - least(size, greatest(0, start % ring - behind)), 0)::bigint as taken from laid
"""
