"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, units and names become typed placeholders, so a re-parameterised question keeps its template. Windows of
template words are hash-joined; where enough of an item is covered, its slots must map to the document's consistently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Stages

WIDTH, WIDEST = 8, 16
# Unit words and signs, recognised after a number.
UNITS = "mm cm m km kg g mg lb lbs oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years % € $ £ usd eur dollars euros cents kmh mph hz khz mhz ghz w kw v a c f".split()
NUMBER, UNIT, NAME = "#", "@", "&"


def tokens(text: Column) -> Column:
    """White-space separated pieces that hold a letter or digit, or are a unit sign."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda x: x.rlike(r"[\p{L}\p{N}%€$£]"))


def bare(token: Column) -> Column:
    """The token in lower case without punctuation; a lone unit sign stays."""
    return F.lower(F.regexp_replace(token, r"[^\p{L}\p{N}%€$£]", ""))


def slot(token: Column) -> Column:
    """What a placeholder stands for: the bare token, without a possessive ending."""
    return bare(F.regexp_replace(token, r"['’][sS](?=[^\p{L}\p{N}]*$)", ""))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once for each row: the optimiser would copy it into every lambda's body."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def template(raw: Column, narrow: bool = False) -> Column:
    """For each token a typed placeholder (numbers, units after numbers, capitalised words), or else its bare word.

    A capitalised word that opens a sentence may be a name or not. It is taken for one, so that a text's templates do
    not depend on what stands before it; the `narrow` reading keeps its bare word.
    """

    def one(token: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at(raw, i))
        number = token.rlike(r"^[^\p{L}\p{N}]*\p{N}")
        name = token.rlike(r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}")
        if narrow:
            name &= before.isNotNull() & ~before.rlike(r"[.!?:;][^\p{L}\p{N}]*$")
        unit = bare(token).isin(UNITS) & before.rlike(r"^[^\p{L}\p{N}]*\p{N}")
        return F.when(number, NUMBER).when(F.coalesce(unit, F.lit(False)), UNIT).when(F.coalesce(name, F.lit(False)), NAME).otherwise(bare(token))

    return F.transform(raw, one)


def windows(words: Column, width: int) -> Column:
    """Hashes of each `width` adjacent template words, at their places."""
    at = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= width, at(h)))


def _all_placeholders(words: Column) -> Column:
    return F.forall(words, lambda x: x.isin(NUMBER, UNIT, NAME))


def _verbatim(part: Column) -> Column:
    """The key of a window of placeholders alone, which tells no template apart: its bare words."""
    return F.xxhash64(F.lit("="), F.transform(part, bare))


def _item_keys(items: DataFrame) -> DataFrame:
    """(w, key, item_id, item, n_words, item_at, item_part, item_kind, literal) of each window of items, in each reading.

    The items carry the readings, so that a document's window needs one only: capitalised words that open a sentence as
    names and as words, and a first word in lower case also as the name that it looks like where it opens a sentence.
    """
    opened = F.transform("wide", lambda x, i: F.when((i == 0) & ~x.isin(NUMBER, UNIT), NAME).otherwise(x))
    readings = F.explode(F.array_distinct(F.array("wide", "narrow", opened))).alias("words")
    items = items.select("item_id", "w", "raw", "narrow", readings)
    part = lambda c: F.slice(c, F.col("at") + 1, F.col("w"))
    at = items.select("*", F.explode(F.sequence(F.lit(0), F.size("raw") - F.col("w"))).alias("at"))
    at = at.select("*", part("raw").alias("item_part"), part("narrow").alias("item_kind"), part("words").alias("form"))
    literal = _all_placeholders(F.col("form"))
    hashes = F.transform("form", lambda x: F.xxhash64(x))
    key = F.when(literal, _verbatim(F.col("item_part")))
    for w in range(1, WIDEST + 1):
        key = key.when(F.col("w") == w, F.xxhash64(*(F.get(hashes, F.lit(k)) for k in range(w))))
    return at.select("w", key.alias("key"), "item_id", F.xxhash64("raw").alias("item"), F.size("raw").alias("n_words"), F.col("at").alias("item_at"), "item_part", "item_kind", literal.alias("literal")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = 0.5, most_broadcast: int = 500_000) -> DataFrame:
    """Pairs of a document of docs (doc_id, text) and an item of benchmark (item_id, text) that it holds, re-parameterised or not.

    An item counts as held where windows of `width` template words that it shares with the document cover at least the
    share `coverage` of its words, and every slot value of the item stands for one value of the document throughout:
    in all places of the document together, or else in one place of it (see _aligned), whose figures then are returned.
    A slot is a number, unit or name of either side; a word that opens a sentence on both sides may be any word and is
    none. Windows of placeholders alone are matched by their words. Items shorter than `width` are sought as one window
    of their own length. Returns doc_id, item_id, n_words (of the item), n_covered, n_slots (distinct slot values met),
    n_changed (of these, with another value in the document).

    Benchmark windows are broadcast up to `most_broadcast` of them (about 20 MB). Beyond that the keys of the documents'
    windows are shuffled alone, and tokens are made anew for the documents that hit.
    Null or empty texts, on either side: never a pair. Null ids: kept as null. Repeated rows, items or documents: one
    pair. Rows that share a doc_id are one document. Very long texts: all their windows. Empty tables: no rows. Other
    columns are ignored, whatever their names.
    """
    if not 1 <= width <= WIDEST:
        raise ValueError(f"width must be 1 to {WIDEST}, not {width}")
    text = F.col("text").cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(text).alias("raw")).where(F.size("raw") > 0).distinct()
    items = items.select("*", F.least(F.lit(width), F.size("raw")).alias("w"), template(F.col("raw")).alias("wide"), template(F.col("raw"), narrow=True).alias("narrow"))
    keys = _item_keys(items)
    stats = keys.agg(F.count("*").alias("n"), F.collect_set("w").alias("w"), F.max("literal").alias("literal")).first()  # at most `width` widths
    if not stats.n:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_words int, n_covered int, n_slots int, n_changed int")
    widths, keys = sorted(stats.w), keys.drop("literal")

    def keyed(raw: Column, words: Column, w: int) -> Column:
        keys = windows(words, w)
        if stats.literal:  # some item has a window of placeholders alone: such windows are told apart by their words
            keys = F.transform(keys, lambda key, at: F.when(_all_placeholders(F.slice(words, at + 1, w)), _verbatim(F.slice(raw, at + 1, w))).otherwise(key))
        return F.struct(F.lit(w).alias("w"), keys.alias("keys"))

    seen = lambda r: _let(template(r), lambda t: F.struct(r.alias("raw"), F.array(*(keyed(r, t, w) for w in widths)).alias("widths")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _let(tokens(text), seen).alias("x")).select("doc_id", F.xxhash64("x.raw").alias("row"), "x")
    found = texts.select("doc_id", "row", "x.raw", F.explode("x.widths").alias("of")).select("doc_id", "row", "raw", "of.w", F.posexplode("of.keys").alias("at", "key"))
    if stats.n <= most_broadcast:
        hits = found.join(F.broadcast(keys), ["w", "key"])
    else:
        hits = found.drop("raw").join(keys, ["w", "key"])
        again = texts.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("x.raw").alias("raw")).dropDuplicates(["_doc", "_row"])
        hits = hits.join(again, hits.doc_id.eqNullSafe(F.col("_doc")) & (hits.row == F.col("_row")))
    # the window with the token before it, which the narrow reading looks at; slots are made from the written hits
    led = F.when(F.col("at") > 0, 1).otherwise(0)
    hits = hits.select("doc_id", "row", "at", "item_id", "item", "n_words", "item_at", "w", "item_part", "item_kind", F.slice("raw", F.col("at") + 1 - led, F.col("w") + led).alias("part"))
    hits = Stages(docs.sparkSession, "decontaminate").put(hits, "hits")
    own = lambda c: F.slice(c, led + 1, F.col("w"))
    slots = F.arrays_zip(own(template(F.col("part"), narrow=True)).alias("kind"), "item_kind", "item_part", own("part").alias("part"))
    slots = F.filter(slots, lambda x: x["kind"].isin(NUMBER, UNIT, NAME) | x["item_kind"].isin(NUMBER, UNIT, NAME))
    slots = F.transform(slots, lambda x: F.struct(slot(x["item_part"]).alias("item"), slot(x["part"]).alias("doc")))
    found = hits.select("doc_id", "row", "at", "item_id", "item", "n_words", "item_at", "w", slots.alias("slots"))
    held = found.groupBy(*_PAIR).agg(F.array_sort(F.collect_set("item_at")).alias("ats"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    held = held.select(*_PAIR, *_figures(F.col("ats"), F.col("slots"), F.col("w"))).where(F.col("n_covered") >= F.lit(coverage) * F.col("n_words"))
    mixed = held.where("n_pairs <> n_slots").select(*(F.col(c).alias(f"_{c}") for c in _PAIR))
    places = found.join(mixed, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _PAIR], "left_semi")
    return held.where("n_pairs = n_slots").unionByName(_aligned(places, coverage)).drop("n_pairs", "w")


_PAIR = ["doc_id", "item_id", "n_words", "w"]


def _figures(ats: Column, slots: Column, w: Column) -> list[Column]:
    """n_covered, n_pairs, n_slots and n_changed of windows of an item, by their sorted places, and distinct slot pairs."""
    step = lambda s, at: F.struct((s["n"] + at + w - F.greatest(s["end"], at)).alias("n"), (at + w).alias("end"))
    covered = F.aggregate(ats, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]
    changed = F.size(F.filter(slots, lambda x: x["item"] != x["doc"]))
    return [covered.alias("n_covered"), F.size(slots).alias("n_pairs"), _n_items(slots).alias("n_slots"), changed.alias("n_changed")]


def _n_items(slots: Column) -> Column:
    return F.size(F.array_distinct(F.transform(slots, lambda x: x["item"])))


def _aligned(found: DataFrame, coverage: float) -> DataFrame:
    """The best place of a document for each item, of those that cover enough of the item and map its slots consistently.

    Windows with one difference of document and item place lie on one diagonal; adjacent ones form a run. A place is
    the runs of one diagonal, or a chain of runs that go on in both texts over diagonals at most `w` apart (words put in
    or left out); a run of another diagonal is chained only if its slots agree. Diagonals are dealt into two overlapping
    blocks of n_words, so that a chain, which drifts by less, lies within one whatever the document's length.
    """
    text = ["doc_id", "row", "item_id", "item", "n_words", "w"]
    found = found.withColumn("diagonal", F.col("at") - F.col("item_at")).distinct()
    order = Window.partitionBy(*text, "diagonal").orderBy("item_at")
    runs = found.withColumn("run", F.col("item_at") - F.row_number().over(order)).groupBy(*text, "diagonal", "run")
    runs = runs.agg(F.array_sort(F.collect_set("item_at")).alias("ats"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    block = F.floor(F.col("diagonal") / F.col("n_words"))
    runs = runs.withColumn("block", F.explode(F.array(block, block + 1)))
    run = F.struct(F.element_at("ats", 1).alias("first"), F.element_at("ats", -1).alias("last"), "diagonal", "ats", "slots")
    blocks = runs.groupBy(*text, "block").agg(F.array_sort(F.collect_list(run)).alias("runs"))

    def chain(start: Column, reach: Column) -> Column:
        def step(s: Column, r: Column) -> Column:
            on = (r["first"] > s["last"]) & (r["first"] + r["diagonal"] > s["last"] + s["diagonal"]) & (F.abs(r["diagonal"] - s["diagonal"]) <= reach)
            both = F.array_union(s["slots"], r["slots"])
            on = on & ((r["diagonal"] == s["diagonal"]) | (F.size(both) == _n_items(both)))
            new = F.struct(r["first"].alias("first"), r["last"].alias("last"), r["diagonal"].alias("diagonal"), F.concat(s["ats"], r["ats"]).alias("ats"), both.alias("slots"))
            return F.when(on, new).otherwise(s)

        return F.aggregate("runs", start, step)

    chains = F.flatten(F.transform("runs", lambda r: F.array(chain(r, F.lit(0)), chain(r, F.col("w")))))
    places = blocks.select(*_PAIR, F.explode(chains).alias("place"))
    places = places.select(*_PAIR, *_figures(F.col("place.ats"), F.col("place.slots"), F.col("w")))
    places = places.where((F.col("n_covered") >= F.lit(coverage) * F.col("n_words")) & (F.col("n_pairs") == F.col("n_slots")))
    best = F.max(F.struct("n_covered", "n_slots", (-F.col("n_changed")).alias("same"), "n_pairs")).alias("best")
    best = places.groupBy(*_PAIR).agg(best)
    return best.select(*_PAIR, "best.n_covered", "best.n_pairs", "best.n_slots", (-F.col("best.same")).alias("n_changed"))


_UNIT_LIST = ", ".join(f"'{u}'" for u in UNITS)
_SURE = rf"""WHEN regexp_matches(x, '^[^\p{{L}}\p{{N}}]*\p{{N}}') THEN '#'
      WHEN i > 1 AND b[i] IN ({_UNIT_LIST}) AND regexp_matches(r[i - 1], '^[^\p{{L}}\p{{N}}]*\p{{N}}') THEN '@'"""
_CAPITAL = r"regexp_matches(x, '^[^\p{L}\p{N}]*\p{Lu}\p{Ll}')"


def _canon(id: str, table: str) -> str:
    """Tokens r, bare words b, slot values s, and the wide and narrow readings t and u of the texts of a table."""
    return rf"""
  SELECT *, list_transform(r, lambda x, i: CASE {_SURE} WHEN {_CAPITAL} THEN '&' ELSE b[i] END) AS t,
    list_transform(r, lambda x, i: CASE {_SURE}
      WHEN {_CAPITAL} AND i > 1 AND NOT regexp_matches(r[i - 1], '[.!?:;][^\p{{L}}\p{{N}}]*$') THEN '&' ELSE b[i] END) AS u
  FROM (SELECT *, list_transform(r, lambda x: lower(regexp_replace(x, '[^\p{{L}}\p{{N}}%€$£]', '', 'g'))) AS b,
      list_transform(r, lambda x: lower(regexp_replace(regexp_replace(x, '[''’][sS]([^\p{{L}}\p{{N}}]*)$', '\1'), '[^\p{{L}}\p{{N}}%€$£]', '', 'g'))) AS s
    FROM (SELECT {id}, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}%€$£]')) AS r FROM {table}))
"""


_FORM = "array_to_string({f}[pos + 1 : pos + w], ' ')"
_LITERAL = "len(list_filter({f}[pos + 1 : pos + w], lambda x: x NOT IN ('#', '@', '&'))) = 0"
_WORDS = "'= ' || array_to_string(b[pos + 1 : pos + w], ' ')"
_READINGS = ", ".join(f"CASE WHEN {_LITERAL.format(f=f)} THEN {_WORDS} ELSE {_FORM.format(f=f)} END" for f in "tuo")
ORACLE = f"""
WITH d AS ({_canon("doc_id", "documents")}),
i AS (SELECT DISTINCT item_id, t, u, b, s, list_transform(t, lambda x, j: CASE WHEN j = 1 AND x NOT IN ('#', '@') THEN '&' ELSE x END) AS o, least({WIDTH}, len(t)) AS w FROM ({_canon("item_id", "benchmark")}) WHERE len(r) > 0),
iw AS (SELECT item_id, len(t) AS n_words, w, pos, unnest(list_distinct([{_READINGS}])) AS k, u[pos + 1 : pos + w] AS iu, s[pos + 1 : pos + w] AS ib FROM (SELECT *, unnest(range(0, len(t) - w + 1)) AS pos FROM i)),
dw AS (SELECT doc_id, w, CASE WHEN {_LITERAL.format(f="t")} THEN {_WORDS} ELSE {_FORM.format(f="t")} END AS k, u[pos + 1 : pos + w] AS du, s[pos + 1 : pos + w] AS db FROM (SELECT d.*, s.w, unnest(range(0, greatest(0, len(t) - s.w + 1))) AS pos FROM d, (SELECT DISTINCT w FROM i) s)),
hit AS (SELECT doc_id, item_id, n_words, iw.w, iw.pos, iu, du, ib, db FROM dw JOIN iw ON dw.k = iw.k AND dw.w = iw.w),
cov AS (SELECT doc_id, item_id, n_words, count(DISTINCT p) AS n_covered FROM (SELECT doc_id, item_id, n_words, unnest(range(pos, pos + w)) AS p FROM hit) GROUP BY ALL),
sl AS (SELECT DISTINCT doc_id, item_id, n_words, ib[j] AS item, db[j] AS doc FROM (SELECT *, unnest(range(1, w + 1)) AS j FROM hit) WHERE iu[j] IN ('#', '@', '&') OR du[j] IN ('#', '@', '&')),
sc AS (SELECT doc_id, item_id, n_words, count(*) AS n_pairs, count(DISTINCT item) AS n_slots, count(*) FILTER (WHERE item <> doc) AS n_changed FROM sl GROUP BY ALL)
SELECT cov.doc_id, cov.item_id, CAST(cov.n_words AS INT) AS n_words, CAST(n_covered AS INT) AS n_covered, CAST(coalesce(n_slots, 0) AS INT) AS n_slots, CAST(coalesce(n_changed, 0) AS INT) AS n_changed
FROM cov LEFT JOIN sc ON cov.doc_id IS NOT DISTINCT FROM sc.doc_id AND cov.item_id IS NOT DISTINCT FROM sc.item_id AND cov.n_words = sc.n_words
WHERE n_covered >= 0.5 * cov.n_words AND coalesce(n_pairs, 0) = coalesce(n_slots, 0)
"""
