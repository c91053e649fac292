"""Entity resolution: identifiers, exact links by PIN, fuzzy links and duplicate taxpayers.

Fuzzy joins are set-similarity joins on trigrams. Two names reach a similarity only if they share one
of the rarest trigrams of each (as many as the threshold leaves room to miss), so pairs come from an
equality join on those, not from comparing everyone with everyone; the similarity is then exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assurelake.functions.scalar import clamp, similarity_of, trigrams
from assurelake.sources.catalog import insert_if_absent, written

# The similarity from which a permit is linked, and from which names are duplicates
LINK_AT, DUPLICATE_AT = 0.55, 0.90


def identifiers(taxpayers: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Identifier rows that aren't there yet: PINs and registration numbers. Of taxpayers that share a
    value the one with the smallest id has it."""
    parts = [
        taxpayers.filter(F.col(c).isNotNull() & (F.col(c) != "")).select(F.lit(kind).alias("identifier_type"), F.col(c).alias("identifier_value"), F.col("id").alias("taxpayer_id"))
        for kind, c in (("KRA_PIN", "kra_pin"), ("REGISTRATION_NUMBER", "registration_number"))
    ]
    rows = parts[0].unionByName(parts[1])
    if existing is None:
        return rows.groupBy("identifier_type", "identifier_value").agg(F.min("taxpayer_id").alias("taxpayer_id"))
    return insert_if_absent(existing, rows, ["identifier_type", "identifier_value"]).select("identifier_type", "identifier_value", "taxpayer_id")


def link_by_pin(rows: DataFrame, taxpayers: DataFrame, pin: str, link: str) -> DataFrame:
    """rows with the null links filled in from the registry by the PIN, whatever its case."""
    registry = taxpayers.filter("kra_pin IS NOT NULL").groupBy(F.upper("kra_pin").alias("_pin")).agg(F.min("id").alias("_id"))
    # rows without a link meet the registry by their PIN; the others meet nobody, and the hash that stands for their PIN
    # spreads them over the tasks, where nulls would all go to one
    is_open = F.col(link).isNull() & F.col(pin).isNotNull()
    keyed_rows = rows.withColumns({"_open": is_open, "_key": F.when(is_open, F.upper(pin)).otherwise(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("string"))})
    registry = registry.withColumn("_yes", F.lit(True))
    joined = keyed_rows.join(registry, (F.col("_key") == F.col("_pin")) & (F.col("_open") == F.col("_yes")), "left")
    return joined.withColumn(link, F.coalesce(link, "_id")).select(*rows.columns)


def named(rows: DataFrame, key: str, name: Column, place: Column | None = None) -> DataFrame:
    """(key, place, trigrams) of the rows whose name has any."""
    place = F.lit(None).cast("string") if place is None else place
    return rows.select(F.col(key).alias("key"), place.alias("place"), trigrams(name).alias("g")).filter(F.size("g") > 0)


#: Trigrams that make a key together, from the threshold FEW_DIFFER on; below it a key is one trigram.
TOGETHER, FEW_DIFFER = 3, 0.75
_THREES = "flatten(transform(p, (x, i) -> flatten(transform(slice(p, i + 2, size(p)), (y, j) -> transform(slice(p, i + j + 3, size(p)), z -> xxhash64(array(x, y, z)))))))"


def coded(t: Column) -> Column:
    """A trigram as a number: three code points of 21 bits."""
    point = lambda i: F.ascii(F.substring(t, i, 1)).cast("long")
    return F.shiftleft(point(1), 42) + F.shiftleft(point(2), 21) + point(3)


def with_prefix(sets: DataFrame, counts: DataFrame, at: float) -> DataFrame:
    """Every set, its trigrams as numbers with the rarest first, once for each key `t` that a similar set shares one of.
    A similar set shares TOGETHER of the rarest trigrams p, as many as the threshold leaves room to miss and TOGETHER
    more; each such choice is a key, by its hash. Two sets so small that similar ones may share fewer have single
    trigrams as keys too. Sets of which too few trigrams are `met` on the other side are similar to none."""
    few = TOGETHER if at >= FEW_DIFFER else 1
    size = F.size("g")
    # the epsilon keeps a bound that is whole from being rounded up
    least = F.ceil(size * at - 1e-9).cast("int")
    each = sets.select("key", "place", F.explode("g").alias("t")).join(counts, "t")
    o = F.sort_array(F.collect_list(F.struct("n", "code")))  # a name's trigrams
    rarest = each.groupBy("key").agg(F.first("place").alias("place"), o.alias("o"), F.count_if("met").alias("met"))
    rows = rarest.select("key", "place", F.col("o.code").alias("g"), "met").filter(F.col("met") >= least)
    rows = rows.select("key", "place", "g", F.slice("g", F.lit(1), F.least(size, size - least + few)).alias("p"))
    one = F.transform("p", lambda x: F.xxhash64(F.array(x)))
    keys = F.expr(_THREES) if few > 1 else one
    if few > 1:
        keys = F.concat(keys, F.when(least < few, one).otherwise(F.array().cast("array<long>")))
    return rows.select("key", "place", "g", F.explode(F.array_distinct(keys)).alias("t"))


def similar_pairs(left: DataFrame, right: DataFrame, at: float) -> DataFrame:
    """(a, b, similarity) of keys whose trigram sets are at least `at` similar. Both are named(). Keys with two
    different places aren't compared; an unknown place fits all. Of a table with itself each two keys come once,
    a < b. The keys of either side are made once and written."""
    alone = right is left
    sides = [left] if alone else [left, right]
    counts = None
    for i, side in enumerate(sides):
        one = side.select(F.explode("g").alias("t"), *[F.lit(int(i == k)).alias(f"n{k}") for k in range(len(sides))])
        counts = one if counts is None else counts.unionByName(one)
    counts = counts.groupBy("t").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(sides))])
    seen = [F.col(f"n{k}") for k in range(len(sides))]
    counts = written(counts.select("t", coded(F.col("t")).alias("code"), (seen[0] + seen[1] if len(seen) > 1 else seen[0]).alias("n"), *[(s > 0).alias(f"met{k}") for k, s in enumerate(seen)]), "trigrams")
    made = [written(with_prefix(side, counts.select("t", "code", "n", F.col(f"met{len(sides) - 1 - k}").alias("met")), at), "name-keys") for k, side in enumerate(sides)]
    a, b = ((made[0], made[-1])[k].select(F.col("key").alias(n), "place", F.col("g").alias(f"g{n}"), "t") for k, n in enumerate("ab"))
    sizes, shared = F.size("ga") + F.size("gb"), F.size(F.array_intersect("ga", "gb"))
    fits = (F.size("ga") >= F.size("gb") * at - 1e-9) & (F.size("gb") >= F.size("ga") * at - 1e-9)
    here, anywhere = (F.col("place").isNotNull(), F.col("place").isNull())
    met = a.filter(here).join(b.filter(here), ["t", "place"]).drop("place")
    met = met.unionByName(a.filter(anywhere).drop("place").join(b.drop("place"), "t"))
    met = met.unionByName(a.filter(here).drop("place").join(b.filter(anywhere).drop("place"), "t"))
    if alone:
        met = met.filter("a < b")
    # one intersection for each meeting; the few pairs that are similar may have met at several keys
    met = met.filter(fits).filter(shared * (1 + at) >= sizes * at - 1e-9).select("a", "b", sizes.alias("n"), shared.alias("i"))
    return met.select("a", "b", (F.col("i") / (F.col("n") - F.col("i"))).alias("similarity")).filter(F.col("similarity") >= at).distinct()


#: Similarity from which links are sought first; what finds none is compared down to the threshold.
SURE = 0.8


def link_permits(permits: DataFrame, taxpayers: DataFrame, at: float = LINK_AT) -> DataFrame:
    """(permit_number, taxpayer_id, similarity): for each unlinked permit the taxpayer of its county whose
    legal or trading name its activity resembles most, if it does enough. An unknown county fits all.

    Equal names of a county are compared once, and stand for the smallest id that has them. A permit that finds a
    name at SURE has its best one there; only the others are compared with less similar names."""
    county = F.lower("county")
    group = F.sha2(F.concat_ws("\x00", F.coalesce(F.concat(F.lit("in "), "place"), F.lit("")), F.sort_array("g")), 256)
    asked = written(named(permits.filter("taxpayer_id IS NULL AND business_activity IS NOT NULL"), "permit_number", F.col("business_activity"), county).withColumn("a", group), "permit-names")
    legal, trading = (named(taxpayers, "id", F.col(n), county) for n in ("legal_name", "trading_name"))
    names = legal.unionByName(trading).withColumn("b", group).groupBy("b").agg(F.first("place").alias("place"), F.first("g").alias("g"), F.min("key").alias("id"))
    names = written(names, "taxpayer-names")
    have = names.select(F.col("b").alias("key"), "place", "g")
    rest, best = asked.groupBy("a").agg(F.first("place").alias("place"), F.first("g").alias("g")).withColumnRenamed("a", "key"), None
    for least in sorted({max(at, SURE), at}, reverse=True):
        found = similar_pairs(rest, have, least).join(names.select("b", "id"), "b").groupBy("a").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "id")).alias("v"))
        found = written(found.select("a", F.col("v.id").alias("taxpayer_id"), (-F.col("v.s")).alias("similarity")), "permit-links")
        best = found if best is None else best.unionByName(found)
        if least > at:
            rest = written(rest.join(found, rest["key"] == found["a"], "left_anti"), "permit-rest")
            if rest.isEmpty():
                break
    return asked.select(F.col("key").alias("permit_number"), "a").join(best, "a").select("permit_number", "taxpayer_id", "similarity")


#: Members of a group that a task pairs with others at once.
BLOCK = 1000


def _c2(n: str) -> Column:
    return F.floor(F.col(n) * (F.col(n) - 1) / 2).cast("long")


class Duplicates:
    """Pairs of taxpayers with equal registration numbers, or names that resemble each other.

    Equal names are one group and are compared once. Kinds are taken in order - equal numbers, equal legal names, equal trading names, similar names -
    and a pair is made for the first that it has, which its two rows tell, so that only pairs of similar names are
    brought together."""

    def __init__(self, taxpayers: DataFrame, at: float = DUPLICATE_AT):
        number = F.when(F.col("registration_number") != "", F.lower("registration_number"))
        sets = {f"g{k}": F.sort_array(trigrams(F.col(c))) for k, c in (("l", "legal_name"), ("t", "trading_name"))}
        rows = taxpayers.select("id", "legal_name", number.alias("r"), *[x.alias(n) for n, x in sets.items()])
        name = lambda g: F.when(F.size(g) > 0, F.sha2(F.concat_ws("\x00", g), 256))
        self.who = written(rows.select("id", "legal_name", "r", "gl", "gt", name("gl").alias("l"), name("gt").alias("t")), "names")
        self.near = {}
        for k in ("l", "t"):
            groups = written(self.who.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias("key")).agg(F.first(f"g{k}").alias("g")).withColumn("place", F.lit("*")), "name-groups")
            near = written(similar_pairs(groups, groups, at), "near-names")
            self.near[k] = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
        self.who = self.who.drop("gl", "gt")

    def _met(self, k: str, links: DataFrame | None = None) -> DataFrame:
        """Pairs x, y with x.id < y.id whose groups of a kind are equal, or linked by (a, b, similarity). Groups are
        paired a block of members at a time."""
        parts = int(self.who.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        mine = F.struct(*self.who.columns)
        rows = self.who.filter(F.col(k).isNotNull()).withColumn("_k", F.col(k))
        blocks = rows.groupBy(F.col("_k").alias("b")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"))
        if links is None:
            links = blocks.filter("n > 1").select(F.col("b").alias("a"), "b", F.lit(1.0).alias("similarity"))
        links = links.join(blocks.drop("n"), "b")
        left = rows.select(mine.alias("x"), F.col("_k").alias("a")).join(links, "a").select("x", "b", "similarity", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = rows.select(mine.alias("y"), F.col("_k").alias("b")).join(blocks.drop("n"), "b").select("y", "b", F.pmod(F.xxhash64("y.id"), F.col("blocks")).cast("int").alias("block"))
        # so many tasks whatever the size of the groups: it is the pairs that take the time
        return left.repartition(parts, "b", "block").join(right, ["b", "block"]).filter("x.id < y.id")

    def _near(self) -> DataFrame:
        """Pairs of similar names that share neither number nor name: each once, with its largest similarity."""
        out = None
        for k in ("l", "t"):
            rows = self._met(k, self.near[k])
            for same in ("r", "l", "t"):
                rows = rows.filter(~F.coalesce(F.col(f"x.{same}") == F.col(f"y.{same}"), F.lit(False)))
            out = rows if out is None else out.unionByName(rows)
        return out.groupBy(F.col("x.id").alias("_a"), F.col("y.id").alias("_b")).agg(F.max("similarity").alias("confidence"), F.first("x.legal_name").alias("_an"), F.first("y.legal_name").alias("_bn"))

    def pairs(self) -> DataFrame:
        """(source_id, source_name, target_id, target_name, confidence, basis)."""
        kinds, out = ("r", "l", "t"), None
        for i, k in enumerate(kinds):
            rows = self._met(k)
            for before in kinds[:i]:
                rows = rows.filter(~F.coalesce(F.col(f"x.{before}") == F.col(f"y.{before}"), F.lit(False)))
            rows = rows.select(F.col("x.id").alias("_a"), F.col("x.legal_name").alias("_an"), F.col("y.id").alias("_b"), F.col("y.legal_name").alias("_bn"), F.lit(1.0).alias("confidence"), F.lit("FUZZY_NAME" if i else "REGISTRATION_NUMBER").alias("basis"))
            out = rows if out is None else out.unionByName(rows)
        out = out.unionByName(self._near().withColumn("basis", F.lit("FUZZY_NAME")))
        return out.select(F.col("_a").alias("source_id"), F.col("_an").alias("source_name"), F.col("_b").alias("target_id"), F.col("_bn").alias("target_name"), "confidence", "basis")

    def count(self) -> DataFrame:
        """(n): how many pairs there are. Those with something equal are counted from the sizes of groups, without a
        pair being made."""
        out = None
        for sign, keys in ((1, "r"), (1, "l"), (-1, "rl"), (1, "t"), (-1, "rt"), (-1, "lt"), (1, "rlt")):
            rows = self.who.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(_c2("n")), F.lit(0)).alias("n"))
            rows = rows.select((F.col("n") * sign).alias("n"))
            out = rows if out is None else out.unionByName(rows)
        return out.unionByName(self._near().agg(F.count("*").alias("n"))).agg(F.sum("n").alias("n"))


def duplicate_pairs(taxpayers: DataFrame, at: float = DUPLICATE_AT) -> DataFrame:
    """(source_id, target_id, confidence, basis): taxpayers that share a registration number (confidence
    1) or resemble each other by legal or trading name."""
    return Duplicates(taxpayers, at).pairs().select("source_id", "target_id", "confidence", "basis")


def new_relationships(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """POSSIBLE_DUPLICATE relationships of pairs that have none yet."""
    have = existing.filter("relationship_type = 'POSSIBLE_DUPLICATE'").select(F.col("source_taxpayer_id").alias("source_id"), F.col("target_taxpayer_id").alias("target_id"))
    fresh = pairs.join(have, ["source_id", "target_id"], "left_anti")
    return fresh.select(
        F.col("source_id").alias("source_taxpayer_id"), F.col("target_id").alias("target_taxpayer_id"), F.lit("POSSIBLE_DUPLICATE").alias("relationship_type"),
        F.lit("ENTITY_RESOLUTION").alias("source"), (F.col("confidence") * 100).cast("decimal(5,2)").alias("confidence_score"),
    )


def duplicate_candidates(taxpayers: DataFrame) -> DataFrame:
    """All pairs with their names, the surest first."""
    rows = Duplicates(taxpayers).pairs().select("source_id", "target_id", "confidence", "basis", "source_name", "target_name")
    return rows.orderBy(F.desc("confidence"), F.asc_nulls_last("source_name"), "source_id", "target_id")


def match_candidates(taxpayers: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Taxpayers by their resemblance to a name."""
    g = trigrams(F.lit(name))
    legal, trading = similarity_of(trigrams(F.col("legal_name")), g), similarity_of(trigrams(F.col("trading_name")), g)
    rows = taxpayers.select("id", "kra_pin", "legal_name", legal.alias("_l"), trading.alias("_t"))
    rows = rows.withColumn("confidence", F.greatest("_l", "_t")).filter("confidence > 0")
    basis = F.when(F.col("_l") >= F.col("_t"), "LEGAL_NAME").otherwise("TRADING_NAME")
    rows = rows.select("id", "kra_pin", "legal_name", "confidence", basis.alias("basis"), (F.col("confidence") >= LINK_AT).alias("auto_link_eligible"))
    return rows.orderBy(F.desc("confidence"), F.asc_nulls_last("legal_name"), "id").limit(clamp(limit, 50))


#: Tables with a PIN, and the link that it fills.
PIN_LINKS = [
    ("invoices", "supplier_pin", "supplier_taxpayer_id"),
    ("invoices", "buyer_pin", "buyer_taxpayer_id"),
    ("customs_declarations", "importer_pin", "taxpayer_id"),
    ("withholding_certificates", "payer_pin", "payer_taxpayer_id"),
    ("withholding_certificates", "payee_pin", "payee_taxpayer_id"),
    ("properties", "owner_pin", "owner_taxpayer_id"),
    ("payment_transactions", "payer_pin", "payer_taxpayer_id"),
]


def run_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """How many links of each kind a run makes, with their total; identifiers and duplicates stay out of it."""
    t, out = tables["taxpayers"], None
    for table, pin, link in PIN_LINKS:
        if table not in tables or pin not in tables[table].columns:
            continue
        before, after = tables[table], link_by_pin(tables[table], t, pin, link)
        made = after.filter(F.col(link).isNotNull()).agg(F.count("*").alias("n")).crossJoin(before.agg(F.count(link).alias("m")))
        made = made.select(F.lit(f"{table}.{link}").alias("step"), (F.col("n") - F.col("m")).alias("links"))
        out = made if out is None else out.unionByName(made)
    if "business_permits" in tables:
        fuzzy = link_permits(tables["business_permits"], t).agg(F.count("*").alias("links")).select(F.lit("business_permits.taxpayer_id").alias("step"), "links")
        out = fuzzy if out is None else out.unionByName(fuzzy)
    return out.unionByName(out.agg(F.sum("links").alias("links")).select(F.lit("total").alias("step"), "links"))


def run_counters(tables: dict[str, DataFrame], identifiers_there: DataFrame | None = None, relationships: DataFrame | None = None) -> DataFrame:
    """(step, created): all counters of a run - identifiers by kind, links by kind, duplicate relationships - and the
    total of the links alone."""
    t = tables["taxpayers"]
    ids = identifiers(t, identifiers_there).groupBy(F.concat(F.lit("identifiers."), "identifier_type").alias("step")).agg(F.count("*").alias("created"))
    made = Duplicates(t).count() if relationships is None else new_relationships(duplicate_pairs(t), relationships).agg(F.count("*").alias("n"))
    made = made.withColumnRenamed("n", "created").select(F.lit("relationships.POSSIBLE_DUPLICATE").alias("step"), "created")
    return ids.unionByName(run_summary(tables).withColumnRenamed("links", "created")).unionByName(made)
