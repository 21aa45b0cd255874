"""Versioned tables: hashes, bitemporal merges, upserts, policies.

Tables are immutable: each operation gives the new state (or only what changes)
as a DataFrame, which the caller writes beside the old one and then swaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolore.functions.predicates import known_at
from cargolore.functions.text import phrases

GOODS = ("source", "source_record_id", "description", "hs_codes", "restriction_type", "provenance_url", "valid_from", "valid_to")


#: With these the hash also tells routes: see :func:`with_country_rules`.
GOODS_AND_RULES = (*GOODS, "country_rules")
LISTS = ("hs_codes", "country_rules")


def with_country_rules(goods: DataFrame, rules: DataFrame) -> DataFrame:
    """B1: ``goods`` with their active rules' routes as ``country_rules``; none are an empty list."""
    rule = F.struct(F.col("rule_origin").alias("origin"), F.col("rule_destination").alias("destination"), F.col("restriction_type").alias("restriction"))
    own = rules.where("active").groupBy(F.col("id").alias("__id")).agg(F.array_sort(F.collect_set(rule)).alias("country_rules"))
    none = F.array().cast("array<struct<origin:string,destination:string,restriction:string>>")
    joined = goods.join(own, goods["id"] == own["__id"], "left").drop("__id")
    return joined.withColumn("country_rules", F.coalesce("country_rules", none))


def content_hash(columns: tuple[str, ...] = GOODS, lists: tuple[str, ...] = LISTS) -> Column:
    """B1: SHA-256 of a canonical JSON of the columns; lists count as sets."""
    own = [(F.array_sort(F.array_distinct(F.col(c))) if c in lists else F.col(c)).alias(c) for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256)


def _keyed(rows: DataFrame, key: tuple[str, ...], content: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``__hash``, the hash of their content, and ``__own``, which tells
    rows apart whose last key is null: their content; null for the others."""
    hashed = rows.withColumn("__hash", content_hash(content))
    return hashed.withColumn("__own", F.when(F.col(key[-1]).isNull(), F.col("__hash")))


def _delivered(feed: DataFrame, key: tuple[str, ...], content: tuple[str, ...]) -> DataFrame:
    """A feed with each key once, of equal keys the row first by content hash;
    rows whose last key is null are kept, but for those with equal content."""
    first = Window.partitionBy(*key, "__own").orderBy("__hash")
    return _keyed(feed, key, content).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def bitemporal_changes(feed: DataFrame, current: DataFrame, key: tuple[str, ...] = ("source", "source_record_id"), content: tuple[str, ...] = GOODS) -> DataFrame:
    """What a feed does to the current versions: ``action`` for each key:
    ``insert``, ``update`` (close and open), ``keep`` or ``close``.

    Keys are compared null-safe; rows whose last key is null are told apart by
    their content, so such a row is inserted or kept, each on its own.  An empty
    feed, and for rows whose last key is null, closes nothing.
    """
    new = _delivered(feed, key, content).select(*key, "__own", F.col("__hash").alias("new_hash"))
    old = _keyed(current, key, content).select(*(F.col(c).alias(f"__{c}") for c in key), F.col("__own").alias("__old_own"), "id", F.col("__hash").alias("old_hash"))
    sources = feed.select(F.col(key[0]).alias("__fed")).distinct()
    on = [new[c].eqNullSafe(old[f"__{c}"]) for c in key] + [new["__own"].eqNullSafe(old["__old_own"])]
    both = new.join(old, on, "full").join(F.broadcast(sources), F.coalesce(F.col(key[0]), F.col(f"__{key[0]}")) == F.col("__fed"), "left")
    gone = F.col("new_hash").isNull() & F.col("__fed").isNotNull() & F.col(f"__{key[-1]}").isNotNull()
    action = (
        F.when(F.col("old_hash").isNull(), "insert").when(gone, "close").when(F.col("new_hash").isNull(), "keep")
        .when(F.col("new_hash") != F.col("old_hash"), "update").otherwise("keep")
    )
    return both.select(*(F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in key), "id", action.alias("action"), "new_hash", "old_hash")


def bitemporal_upsert(feed: DataFrame, table: DataFrame, at: Column, key: tuple[str, ...] = ("source", "source_record_id"), content: tuple[str, ...] = GOODS) -> DataFrame:
    """B2: the whole new table: history, kept, closed and opened versions.  A
    changed row keeps its ``id``; a new one gets the hash of its key, or of its
    content where the last key is null."""
    current = table.where("sys_to IS NULL")
    plan = bitemporal_changes(feed, current, key, content).select(*(F.col(c).alias(f"__{c}") for c in key), F.col("id").alias("__id"), "action", F.col("new_hash").alias("__new"))
    closing = plan.where(F.col("action").isin("update", "close")).select("__id", F.lit(True).alias("__closed"))
    old = table.join(closing, (table["id"] == closing["__id"]) & table["sys_to"].isNull(), "left")
    old = old.withColumn("sys_to", F.when(F.col("__closed"), at).otherwise(F.col("sys_to"))).select(*table.columns)
    rows = _delivered(feed, key, content)
    opening = plan.where(F.col("action").isin("insert", "update"))
    fresh = rows.join(opening, [*(rows[c].eqNullSafe(F.col(f"__{c}")) for c in key), rows["__hash"] == F.col("__new")])
    made = F.coalesce(F.col("__id"), F.xxhash64(*key, "__own"))
    values = {"id": made, "sys_from": at, "sys_to": F.lit(None).cast("timestamp")} | {c: F.col(c) for c in feed.columns}
    opened = fresh.select(*(values[c].cast(table.schema[c].dataType).alias(c) if c in values else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns))
    return old.unionByName(opened)


def as_of(table: DataFrame, at: Column) -> DataFrame:
    """The versions that were current at an instant."""
    return table.where(known_at(F.col("sys_from"), F.col("sys_to"), at))


def replace_routes(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Country rules after a delivery: goods that ``new`` names get its routes
    only, the routes of others stay."""
    named = new.select(F.col("id").alias("__id")).distinct()
    return rules.join(named, rules["id"] == named["__id"], "left_anti").unionByName(new.select(*rules.columns).distinct())


def set_gates(gates: DataFrame, changes: DataFrame | None, seed: DataFrame) -> DataFrame:
    """Ship gates (``metric, value``): seeded where absent, changed by
    ``changes``, or reset to the seed if there are none."""
    return seed if changes is None else upsert(changes, insert_absent(seed, gates, ["metric"]), ["metric"])


def _one_of(rows: DataFrame, key: list[str], order: str | None, last: bool) -> DataFrame:
    """Each key's first or last row by ``order``, and by all columns where that is
    equal or not given."""
    turn = [F.desc_nulls_last(order) if last else F.asc_nulls_last(order)] if order else []
    place = Window.partitionBy(*key).orderBy(*turn, *(F.asc_nulls_last(c) for c in rows.columns if c != order))
    return rows.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def insert_absent(new: DataFrame, old: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """``old`` and the rows of ``new`` whose key, compared null-safe,
    it does not have; of equal new keys the first written by ``order``."""
    first = _one_of(new, key, order, last=False)
    other = old.select(*(F.col(c).alias(f"__{c}") for c in key))
    return old.unionByName(first.join(other, [first[c].eqNullSafe(other[f"__{c}"]) for c in key], "left_anti").select(*old.columns))


def upsert(new: DataFrame, old: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """K8: ``new``, of equal keys the last written by ``order``, and the rows of
    ``old`` with other keys."""
    last = _one_of(new, key, order, last=True)
    other = last.select(*(F.col(c).alias(f"__{c}") for c in key))
    return last.select(*old.columns).unionByName(old.join(other, [old[c].eqNullSafe(other[f"__{c}"]) for c in key], "left_anti"))


def expand_prefixes(codes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``id, hs_codes`` with each code of 2, 4 or 6 digits replaced by
    all six-digit codes below it; what the taxonomy does not have is dropped.
    The taxonomy's codes are listed under their prefixes, so this is an equi-join.
    Each different set of prefixes is expanded once: its list meets the ids that have the
    set at the very end, so no pair of an id and a code is ever shuffled."""
    six = taxonomy.where("level = 6").select("hs_code").distinct()
    below = six.select("hs_code", F.explode(F.array_distinct(F.array(*(F.substring("hs_code", 1, n) for n in (2, 4, 6))))).alias("prefix"))
    below = below.groupBy("prefix").agg(F.collect_list("hs_code").alias("below"))
    each = codes.select("id", F.explode("hs_codes").alias("prefix"))
    asked = each.groupBy("id").agg(F.array_sort(F.collect_set("prefix")).alias("prefixes"))
    parts = asked.select("prefixes").distinct().select("prefixes", F.explode("prefixes").alias("prefix"))
    lists = parts.join(below, "prefix").groupBy("prefixes").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("below")))).alias("hs_codes"))
    return asked.join(lists, "prefixes").select("id", "hs_codes")


def rollup_codes(lines: DataFrame) -> DataFrame:
    """Codes at levels 2, 4 and 6 of ``hs_code, title, description,
    ordinal`` rows: the longest description, the shortest title, the first on ties."""
    each = lines.select("*", F.explode(F.array(*(F.when(F.length("hs_code") >= n, F.substring("hs_code", 1, n)) for n in (2, 4, 6)))).alias("code")).where("code IS NOT NULL")
    last = -F.col("ordinal")
    return each.groupBy(F.col("code").alias("hs_code")).agg(
        F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), last)).alias("description"),
        F.max_by("title", F.struct(-F.length("title"), last)).alias("title"),
    ).withColumns({
        "level": F.length("hs_code"), "chapter": F.substring("hs_code", 1, 2),
        "parent_code": F.when(F.length("hs_code") > 2, F.expr("substring(hs_code, 1, length(hs_code) - 2)")),
    })


def carry_notes(lines: DataFrame, part: str = "chapter") -> DataFrame:
    """``notes`` of a heading line kept for the lines below it, in file order."""
    own = Window.partitionBy(part).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("notes", F.last("notes", ignorenulls=True).over(own))


def materialized_rules(goods: DataFrame, rules: DataFrame, aliases: DataFrame, config: DataFrame) -> DataFrame:
    """One screening rule for each current good and route.

    Goods without an active route get one that is open at both ends; sources
    that ``config`` (``source, enabled, default_threshold, phrase_strategy``)
    does not enable get none, and neither do goods without a description.  An
    unknown strategy is ``split_lists``.  If ``rules`` have ``conditions``, a route's
    go to its rules; routes that differ in nothing but these take the first.
    """
    conditions = F.col("conditions") if "conditions" in rules.columns else F.lit(None).cast("string")
    routes = rules.where("active").select(F.col("id").alias("__id"), "rule_origin", "rule_destination", conditions.alias("conditions"))
    plain = F.to_json(F.struct("conditions"))
    routes = routes.groupBy("__id", "rule_origin", "rule_destination").agg(F.min_by("conditions", F.when(F.col("conditions").isNotNull(), plain)).alias("conditions"))
    named = aliases.groupBy(F.col("id").alias("__a")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    own = goods.where("sys_to IS NULL").where(F.trim("description") != "").join(F.broadcast(config.where("enabled")), "source")
    own = own.join(routes, own["id"] == routes["__id"], "left").join(named, own["id"] == named["__a"], "left")
    token = F.coalesce(F.col("source_record_id"), F.concat(F.lit("h"), F.substring(F.sha1("description"), 1, 10)))
    route = F.concat(F.coalesce("rule_origin", F.lit("*")), F.lit("->"), F.coalesce("rule_destination", F.lit("*")))
    return own.select(
        F.substring(F.concat(F.col("source"), F.lit(":"), token, F.lit("::"), route), 1, 200).alias("name"),
        F.concat(F.lit("sanctions_source:"), F.col("source")).alias("created_by"),
        F.col("description").alias("phrase"), phrases(F.col("description"), F.col("aliases"), F.col("phrase_strategy")).alias("phrases"),
        "rule_origin", "rule_destination", F.col("default_threshold").alias("threshold"), "id", "conditions",
    )


def merge_rules(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """``created_by, name, action`` of a materialisation: ``create``,
    ``update``, ``deactivate`` (of what is active and no longer wanted)."""
    new = wanted.select("created_by", "name", F.lit(True).alias("w")).distinct()
    old = existing.select("created_by", "name", "active")
    both = new.join(old, ["created_by", "name"], "full")
    action = F.when(F.col("active").isNull(), "create").when(F.col("w"), "update").when(F.col("active"), "deactivate")
    return both.select("created_by", "name", action.alias("action")).where("action IS NOT NULL")


def new_version(rules: DataFrame, changes: DataFrame, key: str = "name") -> DataFrame:
    """Rule versions after edits: the active version of an edited rule is
    closed, a next version with the edited columns opens; a row of ``changes``
    with ``deleted`` only closes."""
    edits = changes.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in changes.columns if c != key))
    hit = rules.where("active").join(edits, rules[key] == edits["__key"])
    latest = rules.groupBy(F.col(key).alias("__k")).agg(F.max("version").alias("__v"))
    opened = hit.where(~F.coalesce(F.col("__deleted"), F.lit(False))).join(latest, F.col(key) == F.col("__k"))
    values = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in rules.columns if f"__{c}" in edits.columns}
    values |= {"version": F.col("__v") + 1, "active": F.lit(True)}
    opened = opened.select(*(values.get(c, F.col(c)).cast(rules.schema[c].dataType).alias(c) for c in rules.columns))
    closed = rules.join(edits.select("__key"), rules[key] == F.col("__key"), "left").withColumn("active", F.col("active") & F.col("__key").isNull())
    return closed.select(*rules.columns).unionByName(opened)


def policy_snapshot(policies: DataFrame, on: Column) -> DataFrame:
    """The value of each key in force on a day; of several the latest start."""
    live = policies.where((F.col("valid_from") <= on) & (F.col("valid_to").isNull() | (F.col("valid_to") > on)))
    first = Window.partitionBy("key").orderBy(F.desc("valid_from"), F.desc("policy_id"))
    return live.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def policy_version(snapshot: DataFrame) -> DataFrame:
    """One row: 16 hex digits of the SHA-1 of the sorted ids, or ``empty``."""
    ids = F.array_sort(F.collect_list("policy_id"))
    joined = F.array_join(F.transform(ids, lambda i: i.cast("string")), "|")
    return snapshot.agg(F.when(F.count("*") == 0, "empty").otherwise(F.substring(F.sha1(joined), 1, 16)).alias("policy_version"))


def apply_recommendations(policies: DataFrame, recommended: DataFrame, on: Column) -> DataFrame:
    """Close the open values of recommended keys on a day and open the new."""
    new = recommended.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    hit = policies.join(new, policies["key"] == F.col("__key"), "left")
    open_now = F.col("valid_to").isNull() & F.col("__key").isNotNull()
    closed = hit.withColumn("valid_to", F.when(open_now, on).otherwise(F.col("valid_to"))).select(*policies.columns)
    values = {"policy_id": F.xxhash64("__key", on.cast("string")), "key": F.col("__key"), "value": F.col("__value"), "valid_from": on, "valid_to": F.lit(None)}
    opened = new.select(*(values.get(c, F.lit(None)).cast(policies.schema[c].dataType).alias(c) for c in policies.columns))
    return closed.unionByName(opened)


def can_cut_over(goods: DataFrame, column: str) -> DataFrame:
    """One row: whether every current good has a vector in the new column."""
    return goods.where("sys_to IS NULL").agg(F.count("*").alias("n_current"), F.count_if(F.col(column).isNull()).alias("n_missing")).withColumn("ready", F.col("n_missing") == 0)


def backfill(goods: DataFrame, column: str, vector: Column) -> DataFrame:
    """``goods`` with a vector in the new column wherever a described row has
    none; rows that have one are left alone, so a backfill may be repeated."""
    missing = F.col(column).isNull() & F.col("description").isNotNull()
    return goods.withColumn(column, F.when(missing, vector).otherwise(F.col(column)))


def cut_over(goods: DataFrame, column: str, live: str = "embedding", kept: str = "embedding_old") -> DataFrame:
    """The new column becomes the live one, the live one is kept aside; raises
    while current goods lack a vector."""
    state = can_cut_over(goods, column).first()
    if not state.ready:
        raise ValueError(f"{state.n_missing} of {state.n_current} current goods have no vector in {column}")
    return goods.drop(kept).withColumnsRenamed({live: kept, column: live})


def roll_back(goods: DataFrame, column: str, live: str = "embedding", kept: str = "embedding_old") -> DataFrame:
    """Undoes :func:`cut_over`: what was kept aside is live again."""
    return goods.withColumnsRenamed({live: column, kept: live})


def drop_list(goods: DataFrame, rules: DataFrame, screening: DataFrame, name: str, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Logical deletion of a keyword list: its goods are closed, their
    routes and screening rules deactivated."""
    source = f"KW:{name}"
    ids = goods.where(F.col("source") == source).select(F.col("id").alias("__id")).distinct()
    new_goods = goods.withColumn("sys_to", F.when((F.col("source") == source) & F.col("sys_to").isNull(), at).otherwise(F.col("sys_to")))
    marked = rules.join(ids, rules["id"] == ids["__id"], "left")
    new_rules = marked.withColumn("active", F.col("active") & F.col("__id").isNull()).select(*rules.columns)
    return new_goods, new_rules, screening.withColumn("active", F.col("active") & ~F.coalesce(F.col("created_by") == f"sanctions_source:{source}", F.lit(False)))
