"""A catalogue of entities: kept up to date, found in texts, and resolved from names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Everyday words that are company names too, and what must stand near them to mean the company.
EVERYDAY = ("我爱我家", "老百姓", "机器人")
FINANCE = "股票|上市公司|股份|持仓|分红|估值|业绩|买入|卖出"
FINANCE_VERB = "(?:买|卖|持有|看好).{0,6}"
# Code beginnings of stocks, and routes of categories to boards.
STOCK_CODES = ("600", "601", "603", "605", "688", "689", "900")
GENERIC = ("CONCEPT:个股",)
SECURITIES = ("STOCK", "ETF", "REIT")
BOARDS = {"ASSET": "assets", "INDEX": "assets", "ETF": "assets", "REIT": "assets", "SECTOR": "sectors", "STOCK": "unbound_companies"}
SPECIFIC_FUND, FUND_CONCEPT = "具体基金", "基金概念（未指定产品）"

#: Lengths of name beginnings under which names and texts meet.
STEMS = (1, 2, 4, 8, 16)
#: So many distinct names are sent to every task; more are met by a shuffle join.
_FEW_NAMES = 100_000


def grounded(alias: Column, text: Column) -> Column:
    """Whether the text holds the alias, in any case; an ASCII alias not inside a longer word or number."""
    low, name = F.lower(text), F.lower(alias)
    bounded = F.regexp_like(low, F.concat(F.lit(r"(?<![a-z0-9])\Q"), name, F.lit(r"\E(?![a-z0-9])")))
    return F.coalesce(F.when(name == "", False).when(name.rlike(r"^[\x00-\x7F]*$"), bounded).otherwise(F.contains(low, name)), F.lit(False))


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, entity_id, alias, at) of the entities that texts (id, text) name, by names (alias, entity_id); one row for each.

    Reading from the left, the longest alias that begins at a place is taken, and reading goes on behind it. An ASCII
    alias must not stand inside a longer word. An alias of several entities yields each; of an entity's aliases the last
    one met is given, at its first character (from 0). Case is ignored.

    Every place of a text is hashed with the next 1, 2, 4, 8 and 16 characters, and meets the names that begin so: names
    by their longest such beginning. Any number of names is joined, and only a text's own hits are ever gathered.
    """
    known = names.select(F.lower("alias").alias("name"), "entity_id").where("name <> ''").distinct()
    stem = F.greatest(*(F.when(F.length("name") >= s, s) for s in STEMS))
    distinct = known.select("name").distinct().withColumn("stem", stem).withColumn("key", F.xxhash64("stem", F.substring("name", F.lit(1), F.col("stem"))))
    low = texts.select("id", F.lower("text").alias("low"))
    edge = lambda c: ~F.coalesce(c.rlike("^[a-z0-9]$"), F.lit(False))
    before = F.substring("low", F.col("at") - 1, F.when(F.col("at") > 1, 1).otherwise(0))
    ascii_ = F.col("name").rlike(r"^[\x00-\x7F]*$")
    few = distinct.limit(_FEW_NAMES + 1).count() <= _FEW_NAMES
    # few names go to every task, only the lengths of their beginnings are probed, and places inside a word where all are ASCII
    facts = distinct.agg(F.collect_set("stem").alias("stems"), F.coalesce(F.bool_and(ascii_), F.lit(True)).alias("ascii")).first() if few else None
    stems, kept = (sorted(facts.stems), ["low"]) if few else (STEMS, [])
    places = low.select("id", "low", F.explode(F.sequence(F.lit(1), F.length("low"))).alias("at")).where("low <> ''")
    if few and facts.ascii:
        places = places.where(edge(before))
    probes = places.select("id", "at", *kept, F.explode(F.array(*(F.struct(F.lit(s).alias("stem"), F.substring("low", F.col("at"), F.lit(s)).alias("part")) for s in stems or STEMS))).alias("x"))
    probes = probes.where(F.length("x.part") == F.col("x.stem")).select("id", "at", *kept, F.col("x.stem").alias("stem"), F.xxhash64("x.stem", "x.part").alias("key"))
    if few:
        met = probes.join(F.broadcast(distinct), ["key", "stem"]).select("id", "at", "name", "low")
    else:
        met = probes.join(distinct, ["key", "stem"]).select("id", "at", "name").join(low, "id")
    size = F.length("name")
    whole = F.substring("low", F.col("at"), size) == F.col("name")
    apart = edge(before) & edge(F.substring("low", F.col("at") + size, F.lit(1)))
    met = met.where(whole & (apart | ~ascii_)).select("id", F.struct("at", (-size).alias("less"), "name").alias("hit"))
    hits = met.groupBy("id").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    none = F.expr("cast(array() as array<struct<at:int,less:int,name:string>>)")

    def read(s: Column, h: Column) -> Column:
        free = h["at"] >= s["end"]
        return F.struct(F.when(free, h["at"] - h["less"]).otherwise(s["end"]).alias("end"), F.when(free, F.array_append(s["taken"], h)).otherwise(s["taken"]).alias("taken"))

    taken = F.aggregate("hits", F.struct(F.lit(1).alias("end"), none.alias("taken")), read)["taken"]
    each = hits.select("id", F.explode(taken).alias("hit")).select("id", (F.col("hit.at") - 1).alias("at"), F.col("hit.name").alias("name")).join(known, "name")
    return each.groupBy("id", "entity_id").agg(F.max_by("name", "at").alias("alias"), F.max("at").alias("at"))


def ordinary(name: Column, text: Column) -> Column:
    """Whether a name that is an everyday word lacks a finance word in the text, or a verb of trade up to 6 characters before."""
    said = text.rlike(FINANCE) | F.regexp_like(text, F.concat(F.lit(FINANCE_VERB), name))
    return name.isin(*EVERYDAY) & ~F.coalesce(said, F.lit(False))


def resolve(mentions_: DataFrame, aliases: DataFrame, key: str = "mention_id") -> DataFrame:
    """(key, entity_id, state, n_candidates, reason): RESOLVED where exactly one entity fits the mention.

    mentions_: key, alias, category, and where they are known day, quote (the alias must stand in it) and text. aliases:
    alias, category, entity_id, and where they are known valid_from, valid_to, name. An entity fits with the alias in any
    case, the category (INDEX and ASSET are one), a day within its validity, both ends included, and evidence.
    """
    has = lambda df, *cs: [c for c in cs if c in df.columns]
    whole = mentions_.select(key, F.lower("alias").alias("_alias"), F.col("category").alias("_category"), *has(mentions_, "day", "quote", "text"))
    # mentions alike in all that decides meet the aliases once: many share a name
    facts = [c for c in whole.columns if c != key]
    left = whole.select(*facts).distinct()
    right = aliases.select(F.lower("alias").alias("_alias"), F.col("category").alias("_of"), "entity_id", *has(aliases, "valid_from", "valid_to", "name")).distinct()
    pair = F.array_sort(F.array("_category", "_of")) == F.array(F.lit("ASSET"), F.lit("INDEX")) if dict(mentions_.dtypes)["category"] == "string" else F.lit(False)
    fits = (F.col("_category") == F.col("_of")) | pair
    for bound, late in (("valid_from", False), ("valid_to", True)):
        if bound in right.columns and "day" in left.columns:
            fits &= F.coalesce(F.col("day") <= F.col(bound) if late else F.col("day") >= F.col(bound), F.lit(True))
    if "quote" in left.columns:
        fits &= grounded(F.col("_alias"), F.col("quote"))
    met = left.join(right, "_alias", "left").withColumn("_fit", F.when(fits, F.col("entity_id")))
    common = ordinary(F.col("name"), F.col("text")) if {"name", "text"} <= set(met.columns) else F.lit(False)
    # one entity: the least and the greatest are the same
    figures = F.min("_fit").alias("lo"), F.max("_fit").alias("hi"), F.count_distinct("_fit").alias("n"), F.coalesce(F.bool_or(F.when(F.col("_fit").isNotNull(), common)), F.lit(False)).alias("common")
    same = lambda df: whole.join(df.select(*(F.col(c).alias(f"_m{c}") for c in facts), *(c for c in df.columns if c not in facts)), [F.col(c).eqNullSafe(F.col(f"_m{c}")) for c in facts])
    each = same(met.groupBy(*facts).agg(*figures)).groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"), F.bool_or("common").alias("common"), F.count("*").alias("rows"))
    # a mention of several rows has the candidates of all of them, each once
    several = same(met.select(*facts, "_fit").where("_fit is not null").distinct()).join(each.where("rows > 1").select(key), key).groupBy(key).agg(F.count_distinct("_fit").alias("all"))
    hit = each.join(several, key, "left").withColumn("n_candidates", F.coalesce("all", "n"))
    one = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    reason = F.when(~one, "AMBIGUOUS_OR_MISSING_OR_UNGROUNDED").when(F.col("common"), "ORDINARY_PHRASE_REQUIRES_DISAMBIGUATION")
    return hit.select(key, F.when(one & ~F.col("common"), F.col("lo")).alias("entity_id"), F.when(one & ~F.col("common"), "RESOLVED").otherwise("UNRESOLVED").alias("state"), "n_candidates", reason.alias("reason"))


def route(code: Column, name: Column) -> Column:
    """What a listed (code, name) is: a stock by its code, a fund by its name, else null: not taken over."""
    stock = code.rlike("^(" + "|".join(STOCK_CODES) + ")")
    return F.when(stock, "STOCK").when(F.upper(name).contains("ETF"), "ETF").when(F.upper(name).contains("REIT"), "REIT")


def upsert(*sources: DataFrame) -> DataFrame:
    """Entities (id, ...) of several sources of like columns; of one id the row of the last source that has it."""
    rest = [c for c in sources[0].columns if c != "id"]
    rows = None
    for i, source in enumerate(sources):
        one = source.select("id", *rest).withColumn("_source", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("_source", *(F.col(c).cast("string") for c in rest))).alias("_row"))
    return best.select("id", *(F.col(f"_row.{c}").alias(c) for c in rest))


def fold_concepts(entities: DataFrame) -> DataFrame:
    """Entities (id, name, category, layer, code, aliases), with concept stocks folded into the one security that they mean.

    A concept stock is folded where exactly one security stock has its name or its code: that security takes over its
    aliases, and the concept goes.
    """
    security = entities.where("layer = 'SECURITY' and category = 'STOCK'").select(F.col("id").alias("_into"), F.col("name").alias("_name"), F.col("code").alias("_code"))
    concept = entities.where("layer <> 'SECURITY' and category = 'STOCK'").select(F.col("id").alias("_id"), "name", "code", "aliases")
    by_name = concept.join(security, F.col("name") == F.col("_name")).select("_id", "_into", "aliases")
    by_code = concept.join(security, F.col("code") == F.col("_code")).select("_id", "_into", "aliases")
    found = by_name.unionByName(by_code).distinct().withColumn("_n", F.count("*").over(Window.partitionBy("_id"))).where("_n = 1")
    added = found.groupBy("_into").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("_more"))
    left = entities.join(found.select("_id"), F.col("id") == F.col("_id"), "left_anti").join(added, F.col("id") == F.col("_into"), "left")
    return left.withColumn("aliases", F.array_union(F.coalesce("aliases", F.array()), F.coalesce("_more", F.array()))).drop("_into", "_more")


def insert_missing(entities: DataFrame, concepts: DataFrame) -> DataFrame:
    """entities, and the rows of concepts (of like columns) whose name no entity has."""
    return entities.unionByName(concepts.join(entities.select("name").distinct(), "name", "left_anti"))


def patch_aliases(entities: DataFrame, patches: DataFrame) -> DataFrame:
    """entities with the aliases of patches (id, add, remove) put in and taken out; the list is sorted and has each once."""
    one = patches.groupBy("id").agg(F.flatten(F.collect_list(F.coalesce("add", F.array()))).alias("_add"), F.flatten(F.collect_list(F.coalesce("remove", F.array()))).alias("_remove"))
    kept = F.array_except(F.array_union(F.coalesce("aliases", F.array()), F.coalesce("_add", F.array())), F.coalesce("_remove", F.array()))
    return entities.join(one, "id", "left").withColumn("aliases", F.sort_array(kept)).drop("_add", "_remove")


def board(entity_id: Column, layer: Column, category: Column) -> Column:
    """The board of the report that shows an entity."""
    routes = F.create_map(*(F.lit(x) for pair in BOARDS.items() for x in pair))
    return F.when(entity_id.isin(*GENERIC), "other").when((layer == "SECURITY") & category.isin(*SECURITIES), "securities").otherwise(F.coalesce(routes[category], F.lit("other")))


def product(category: Column, code: Column) -> Column:
    """What is shown as an entity's kind: funds are told apart by whether a code names them."""
    named = F.coalesce(code, F.lit("")) != ""
    return F.when(category.isin("ETF", "REIT"), F.when(named, SPECIFIC_FUND).otherwise(FUND_CONCEPT)).otherwise(F.coalesce(category, F.lit("UNKNOWN")))


def coverage(entities: DataFrame) -> DataFrame:
    return entities.groupBy("category").agg(F.count("*").alias("n"))
