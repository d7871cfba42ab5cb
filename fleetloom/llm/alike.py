"""Links between texts that share a band and whose shingle sets are alike."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.durable import discard, durable
from fleetloom.llm.components import components

# Bands in which more texts are left than this are a crowd: there, only those that can be alike by what sets them off are compared.
CROWD = 16
# Words of 64 bits of the marks of what sets a text off, and texts of a crowd that are matched with all others in one task.
WORDS, CELL = 16, 1024


def _verified(pairs: DataFrame, texts: DataFrame, sets: Callable[[Column], Column], similar: tuple[int, int], most: int | None) -> DataFrame:
    """Pairs ``a, b`` of short ids whose texts' shingle sets have at least the similarity, with their units.

    Texts are cut after they have met: they are an eighth of their hashes.
    """
    over, under = similar
    rest = [c for c in texts.columns if c != "short"]
    of = lambda side: texts.select(F.col("short").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in rest])
    met = pairs.join(of("a"), "a").join(of("b"), "b").where(F.col("a_unit") != F.col("b_unit"))
    if most is not None:
        met = met.where(F.bit_count(F.col("a_mark").bitwiseXOR(F.col("b_mark"))) <= most)

    def alike(both: Column) -> Column:
        # shared / (a + b - shared) >= over / under, with each set once.
        shared = F.size(F.array_intersect(both["a"], both["b"]))
        return shared * (over + under) >= (F.size(both["a"]) + F.size(both["b"])) * over

    cut = F.struct(sets(F.col("a_text")).alias("a"), sets(F.col("b_text")).alias("b"))
    return met.where(F.get(F.transform(F.array(cut), alike), F.lit(0))).select("a", "b", "a_unit", "b_unit")


def _most_met(members: DataFrame) -> DataFrame:
    """``band, lead``: the text of each band that meets most others over all its bands. Copies with edits meet their original."""
    held = members.groupBy("band").agg(F.count(F.lit(1)).alias("held"))
    met = members.join(held, "band").groupBy("short").agg(F.sum("held").alias("met"))
    return members.join(met, "short").groupBy("band").agg(F.max(F.struct("met", "short"))["short"].alias("lead"))


def _led(
    members: DataFrame, texts: DataFrame, sets: Callable[[Column], Column], similar: tuple[int, int], most: int | None
) -> tuple[DataFrame, list[DataFrame]]:
    """The first text that all of a band are compared with, ``band, lead``, and links found by such comparisons.

    Crowds are compared with further texts for as long as each round spares an eighth of the rows that are left, so the
    comparisons are at most eight times the rows.
    """
    first = lead = durable(_most_met(members))
    seeking, found = members, []
    while True:
        apart = durable(seeking.join(lead, "band").where(F.col("short") != F.col("lead")))
        pairs = apart.select(F.col("short").alias("a"), F.col("lead").alias("b")).distinct()
        found.append(durable(_verified(pairs, texts, sets, similar, most)))
        linked = found[-1].select(F.col("a").alias("short"), F.col("b").alias("lead")).distinct()
        left = apart.join(linked, ["short", "lead"], "left_anti").select("band", "short")
        crowds = left.groupBy("band").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > CROWD).select("band")
        following = durable(left.join(crowds, "band", "left_semi"))
        rows, before = following.count(), None if seeking is members else seeking.count()
        discard(apart)
        if seeking is not members:
            discard(seeking)
        if not rows or (before is not None and 8 * rows > 7 * before):
            discard(following)
            return first, found
        seeking = following
        lead = durable(seeking.groupBy("band").agg(F.min(F.struct(F.xxhash64("short", F.lit(len(found))), "short"))["short"].alias("lead")))


def _set_off(crowd: DataFrame, texts: DataFrame, sets: Callable[[Column], Column]) -> DataFrame:
    """``crowd`` with ``n``, the size of the text's set, ``off``, by how many shingles it differs from its lead's, and marks of these.

    Each such shingle sets one bit of the marks ``m0``, ``m1``, ...; ``lost`` is by how many bits fewer are set than there are shingles.
    """
    of = lambda side: texts.select(F.col("short").alias(side), F.col("text").alias(f"{side}_text"))
    met = crowd.join(of("short"), "short").join(of("lead"), "lead")

    def differing(both: Column) -> Column:
        apart = F.concat(F.array_except(both["a"], both["b"]), F.array_except(both["b"], both["a"]))
        return F.struct(F.size(both["a"]).alias("n"), apart.alias("off"))

    cut = F.struct(sets(F.col("short_text")).alias("a"), sets(F.col("lead_text")).alias("b"))
    found = met.select("lead", "short", "group", "main", F.get(F.transform(F.array(cut), differing), F.lit(0)).alias("found"))
    pieces = found.select("lead", "short", "group", "main", "found.n", F.size("found.off").alias("off"), F.explode("found.off").alias("piece"))
    at = pieces.withColumn("at", F.xxhash64("piece").bitwiseAND(F.lit(64 * WORDS - 1)))
    word, bit = F.shiftright("at", 6), F.expr("shiftleft(1L, int(at & 63))")
    marks = [F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0).cast("long")).alias(f"m{i}") for i in range(WORDS)]
    marked = at.groupBy("lead", "short", "group", "main", "n", "off").agg(*marks)
    return marked.withColumn("lost", F.col("off") - reduce(Column.__add__, [F.bit_count(f"m{i}") for i in range(WORDS)]))


def _possible(crowd: DataFrame, texts: DataFrame, sets: Callable[[Column], Column], similar: tuple[int, int]) -> DataFrame:
    """Pairs ``a, b`` of crowded texts of one lead and several groups that may be alike: no pair that is goes missing.

    ``crowd`` has ``lead, short, group, main``, the last being whether the text is of its lead's group. Copies with edits have most
    shingles in common, whether alike or not; what they differ by from their lead tells them apart. Two texts differ by what sets the one off
    from the lead and not the other: by the number of both, less twice what is in both, which is no more than the bits that
    both marks have and those that were lost. All pairs of a crowd are matched, a few instructions each, and only possible ones become rows.
    """
    over, under = similar
    held = durable(_set_off(crowd, texts, sets))
    # Of a pair one at least is not of the lead's group. These are dealt out, and each part meets the whole crowd.
    parts = held.where(~F.col("main")).groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    whole = held.join(parts, "lead").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    part = F.pmod(F.xxhash64(F.lit(5), F.col("short")), F.col("parts")).cast("int")
    names = ["short", "group", "n", "off", "lost", *[f"m{i}" for i in range(WORDS)]]
    dealt = held.where(~F.col("main")).join(parts, "lead").select("lead", part.alias("part"), *[F.col(c).alias(f"_{c}") for c in names])
    both = reduce(Column.__add__, [F.bit_count(F.col(f"m{i}").bitwiseAND(F.col(f"_m{i}"))) for i in range(WORDS)])
    shared = F.least(both + F.least("lost", "_lost"), "off", "_off")
    near = (F.col("off") + F.col("_off") - 2 * shared) * (over + under) <= (F.col("n") + F.col("_n")) * (under - over)
    once = F.col("main") | (F.col("_short") < F.col("short"))
    met = dealt.join(whole, ["lead", "part"]).where(once & (F.col("_group") != F.col("group")) & near)
    pairs = durable(met.select(F.least("short", "_short").alias("a"), F.greatest("short", "_short").alias("b")).distinct())
    discard(held)
    return pairs


def alike_links(
    members: DataFrame, texts: DataFrame, sets: Callable[[Column], Column], similar: tuple[int, int] = (4, 5), most: int | None = None
) -> DataFrame:
    """``a, b``: links between units that are alike, such that all that are alike and share a band are connected.

    ``members`` has ``band, short``, only bands of several; ``texts`` has ``short, unit, text`` of these, once each. First all
    texts of a band are compared with one, so that a group of copies, however large, takes a comparison a text. Texts linked so are
    groups; a link between texts of one group would add nothing. Of texts that share a band and are of several groups, each pair is
    compared; in crowds each pair that :func:`_possible` does not rule out. With ``most``, pairs whose ``mark`` differs in more
    bits are not compared.
    """
    lead, found = _led(members, texts, sets, similar, most)
    shorts = reduce(DataFrame.unionByName, [f.select("a", "b") for f in found])
    grouped = durable(components(shorts).withColumnRenamed("node", "short"))
    group = F.coalesce("root", F.col("short")).alias("group")
    # The text that all have been compared with has no pair left.
    rest = members.join(lead, "band").where(F.col("short") != F.col("lead")).join(grouped, "short", "left").select("band", "short", group)
    rest = durable(rest)
    several = rest.groupBy("band").agg(F.count(F.lit(1)).alias("held"), F.min("group").alias("least"), F.max("group").alias("most"))
    several = durable(several.where(F.col("least") != F.col("most")).select("band", "held"))
    few = rest.join(several.where(F.col("held") <= CROWD), "band")
    other = few.select("band", F.col("short").alias("a"), F.col("group").alias("_group"))
    pairs = few.join(other, "band").where((F.col("a") < F.col("short")) & (F.col("group") != F.col("_group"))).select("a", F.col("short").alias("b"))
    # Crowds whose leads are of one group are one, matched by what sets texts off from the group's root.
    crowded = rest.join(several.where(F.col("held") > CROWD), "band", "left_semi").join(lead, "band")
    of_lead = grouped.select(F.col("short").alias("lead"), F.col("root").alias("of_lead"))
    root = F.coalesce("of_lead", "lead")
    crowd = durable(crowded.join(of_lead, "lead", "left").select(root.alias("lead"), "short", "group", (F.col("group") == root).alias("main")).distinct())
    rare = None if crowd.isEmpty() else _possible(crowd, texts, sets, similar)
    pairs = (pairs if rare is None else pairs.unionByName(rare)).distinct()
    found.append(durable(_verified(pairs, texts, sets, similar, most)))
    for table in (lead, grouped, rest, several, crowd, rare):
        if table is not None:
            discard(table)
    return reduce(DataFrame.unionByName, [f.select(F.col("a_unit").alias("a"), F.col("b_unit").alias("b")) for f in found])
