"""Which cache a restore gets: scopes that a run can see, restore keys, and the one entry that a search selects.

An entry is repository, backend, scope, key, version and time of creation. A restore searches the scopes it can see in
order (its own, the base branch of a pull request, the default branch), and in each its key, then its restore keys as
prefixes in their order; of the entries under one prefix the newest. Entries are not replaced: of several writes
of one key the first made the entry. Whatever is missing on either side is read in the restore's favour; if the search then selects
something that rests on it, the answer is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundarylens.functions.expressions import stripped
from boundarylens.operators.asof import latest_before
from boundarylens.sources.shared import stored

PULL_REQUEST_SCOPE = r"^refs/pull/[^/]+/merge$"
#: Attributes that may be missing, by the letter that stands for each: of entries, and of restores. S is a scope known only not to be a pull request's.
ATTRIBUTES = {"r": "repo", "b": "backend", "v": "version", "s": "scope", "k": "key"}
SLOT = ["missing", "repo", "backend", "version", "scope", "term"]


def restore_keys(argument: Column) -> Column:
    """The restore keys of a step in their order: lines without white space at the ends, empty ones left out; null gives none."""
    lines = F.transform(F.split(F.coalesce(argument, F.lit("")), r"\r\n|\r|\n"), stripped)
    return F.filter(lines, lambda x: x != "")


def _one_row_each(refs: DataFrame) -> DataFrame:
    """A row per ref; kind and base are null where its rows disagree."""
    agreed = lambda c: F.when((F.count_distinct(c) == 1) & (F.count(c) == F.count("*")), F.min(c)).alias(c)
    return refs.where("repo IS NOT NULL AND ref IS NOT NULL").groupBy("repo", "ref").agg(agreed("kind"), agreed("base"))


def default_branches(refs: DataFrame) -> DataFrame:
    """repo, default: null where a repository names several."""
    return _one_row_each(refs).where("kind = 'default'").groupBy("repo").agg(F.when(F.count("*") == 1, F.min("ref")).alias("default"))


def reachable_scopes(refs: DataFrame) -> DataFrame:
    """repo, ref, scopes: what a run on each ref can see, as an array of (rank, scope), own scope first.

    refs: repo, ref, kind (default, branch, pull_request, tag; null if not known), base (of a pull request). A scope that is there but not
    known is null: the base branch of a pull request without one or of a ref of unknown kind, and the default branch of a repository that names
    none or several. Other branches' and pull requests' scopes are not seen. A ref that stands twice counts once if its rows agree, else its kind and base are not known.
    """
    one, default = _one_row_each(refs), default_branches(refs)
    base = F.when(~F.coalesce(F.col("base").rlike(PULL_REQUEST_SCOPE), F.lit(False)), F.struct(F.lit(1).alias("rank"), F.col("base").alias("scope")))
    scopes = F.array(
        F.struct(F.lit(0).alias("rank"), F.col("ref").alias("scope")),
        F.when(F.col("kind") == "pull_request", base).when(F.col("kind").isNull(), F.struct(F.lit(1).alias("rank"), F.lit(None).cast("string").alias("scope"))),
        F.struct(F.lit(2).alias("rank"), F.col("default").alias("scope")),
    )
    # A scope seen already under a smaller rank is not searched again, and a default branch knows that it is the default.
    fresh = lambda x, i: x.isNotNull() & ~((i > 0) & F.coalesce(x["scope"] == F.col("ref"), F.lit(False))) & ~((x["rank"] == 2) & F.coalesce((F.col("kind") == "pull_request") & (F.col("base") == F.col("default")), F.lit(False)))
    return one.join(default, "repo", "left").select("repo", "ref", F.filter(scopes, fresh).alias("scopes"))


def first_writes(writes: DataFrame) -> DataFrame:
    """The writes that made an entry. A key's later writes in the same scope did not; where anything is missing that can't be told, and all stay."""
    known = F.lit(True)
    for c in ("repo", "backend", "version", "scope", "key", "at"):
        known = known & F.col(c).isNotNull()
    same = ["repo", "backend", "version", "scope", "key"]
    made = writes.where(known).groupBy(*same).agg(F.min(F.struct("at", "id")).alias("first")).select("first.id", *same, "first.at")
    return made.unionByName(writes.where(~known).select("id", *same, "at"))


def _letters(columns: dict[str, str]) -> Column:
    """The letters of the attributes that are null."""
    return F.concat(*[F.when(F.col(c).isNull(), x).otherwise("") for x, c in columns.items()])


def _slot(letters: Column, attribute: str, letter: str) -> Column:
    """An attribute's value for comparison; nothing where either side misses it."""
    return F.when(letters.contains(letter), "").otherwise(F.concat(F.lit("+"), F.col(attribute).cast("string")))


#: What is looked up, before and after the attributes that entries miss are known.
ASK = ["shared", "wants", "repo", "backend", "version", "scope", "term"]
PLACE = ["lacks", "shared", "repo", "scope", "term"]


def _of_place(letters: Column) -> Column:
    """Of missing attributes those that tell where to look; backend and version only tell entries of one place apart."""
    return F.translate(letters, "bv", "")


def _standing(entries: DataFrame, needed: DataFrame, lengths: list[int]) -> DataFrame:
    """PLACE, backend, version, at, entry_id: entries under their key, and their prefixes of the lengths that restore keys have."""
    shared = [r.shared for r in needed.select("shared").distinct().collect()] or [""]  # at most 12
    placed = entries.withColumn("shared", F.explode(F.array(*map(F.lit, shared))))
    gone = F.concat("lacks", "shared")
    every = F.array(*map(F.lit, lengths)).cast("array<int>")
    prefixes = F.transform(F.filter(every, lambda n: n <= F.length("key")), lambda n: F.concat(F.lit("^"), F.substring("key", F.lit(1), n)))
    texts = F.when(gone.contains("k"), F.array(F.lit(""))).otherwise(F.concat(F.array(F.concat(F.lit("="), "key")), prefixes))
    scope = F.when(F.lower(gone).contains("s"), "").otherwise(F.concat(F.lit("+"), "scope"))
    return placed.where(~(F.col("shared").contains("S") & F.coalesce(F.col("scope").rlike(PULL_REQUEST_SCOPE), F.lit(False)))).select(
        "lacks", "shared", _slot(gone, "repo", "r").alias("repo"), scope.alias("scope"), F.explode(texts).alias("term"), "backend", "version", "at", F.col("id").alias("entry_id"))


def _dealt(rows: DataFrame) -> DataFrame:
    """For a join with rows made by explode: Spark takes them to be no larger than the file they come of and would send them whole to the driver to broadcast them."""
    return rows.hint("merge")


def _slotted(standing: DataFrame, needed: DataFrame) -> DataFrame:
    """SLOT in place of PLACE, for all that is asked for there. needed: PLACE, wants (an array), one row a place."""
    met = standing.join(_dealt(needed), PLACE).withColumn("wants", F.explode("wants"))
    gone = F.concat("lacks", "wants")
    told = [c for c in standing.columns if c not in (*PLACE, "backend", "version")]
    return met.select(F.concat_ws("|", "lacks", "wants").alias("missing"), "repo", *[_slot(gone, ATTRIBUTES[x], x).alias(ATTRIBUTES[x]) for x in "bv"], "scope", "term", *told, *[c for c in needed.columns if c not in (*PLACE, "wants")])


def resolved(writes: DataFrame, restores: DataFrame, refs: DataFrame) -> DataFrame:
    """restore_id, same ('true', 'false' or 'unknown'), cache_id, open_id, scope_rank, term_rank: one row per restore.

    writes: id, repo, backend, scope, key, version, at. restores: id, repo, backend, ref, key, restore_keys (array), version, at. refs as in
    reachable_scopes. true: the search selects the entry cache_id, in the scope of that rank, by the key (term 0) or the restore key of that
    number. false: nothing that it could select. unknown: what it would select (open_id) if missing values were in its favour. An entry made at the restore's time
    counts as made before it. Ids are taken as unique; rows of one id count as one restore.

    Different lookups are few beside restores times scopes times terms. Each meets once, for each set of attributes that entries miss, the first and the last entry
    under it; that tells in which scope and by which term a restore finds one, and mostly which. Where the time lies between the two, an as-of join
    finds the entry, in that scope and by that term alone. The work is linear in restores and entries.
    """
    entries = stored(first_writes(writes).withColumn("lacks", _letters(ATTRIBUTES)), "cache-entries")
    kinds = [r.lacks for r in entries.select("lacks").distinct().collect()] or [""]  # at most 32
    scopes, default = reachable_scopes(refs), default_branches(refs)
    guess = lambda rank, scope: F.struct(F.lit(rank).alias("rank"), scope.alias("scope"))
    none = F.lit(None).cast("string")
    seen = F.when(F.col("ref").isNull(), F.array(guess(0, none))).otherwise(F.coalesce("scopes", F.array(guess(0, F.col("ref")), guess(1, none), guess(2, F.col("default")))))
    usable = F.filter(F.coalesce("restore_keys", F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False)))
    asked = stored(restores.join(scopes, ["repo", "ref"], "left").join(default, "repo", "left").select("id", "repo", "backend", "version", "key", "at", "ref", usable.alias("prefixes"), seen.alias("scopes")), "cache-restores")
    lengths = [r.n for r in asked.select(F.explode("prefixes").alias("p")).select(F.length("p").alias("n")).distinct().collect()]  # platforms bound the length of keys
    term = lambda rank, text: F.struct(rank.alias("rank"), text.alias("text"))
    terms = F.concat(F.array(term(F.lit(0), F.concat(F.lit("="), "key"))), F.transform("prefixes", lambda x, i: term(i + 1, F.concat(F.lit("^"), x))))
    lookups = asked.withColumn("term", F.explode(terms)).withColumn("seen", F.explode("scopes"))
    # A missing own ref can be any; a missing base or default branch is a branch.
    lookups = lookups.withColumn("wants", F.concat(
        _letters({"r": "repo", "b": "backend", "v": "version"}), F.when(F.col("seen.scope").isNotNull(), "").when(F.col("ref").isNull(), "s").otherwise("S"), F.when(F.col("term.text").isNull(), "k").otherwise("")))
    # What entries may miss of a place; `shared` is that, and what the lookup misses of it.
    of_place = sorted({k.replace("b", "").replace("v", "") for k in kinds})
    first_scope, first_term = F.col("seen.rank") == F.col("scopes")[0]["rank"], F.col("term.rank") == 0
    lookups = lookups.withColumn("lack", F.explode(F.array(*map(F.lit, of_place)))).where(
        (first_scope | ~F.col("lack").contains("s")) & (first_term | ~F.concat("lack", "wants").contains("k")))
    gone = F.concat("lack", "wants")
    scope = F.when(F.lower(gone).contains("s"), "").otherwise(F.concat(F.lit("+"), "seen.scope"))
    lookups = lookups.select(
        F.concat_ws("|", "lack", _of_place(F.col("wants"))).alias("shared"), "wants", *[_slot(gone, ATTRIBUTES[x], x).alias(ATTRIBUTES[x]) for x in "rbv"], scope.alias("scope"),
        F.when(gone.contains("k"), "").otherwise(F.col("term.text")).alias("term"), "at", "id", F.struct(F.col("seen.rank").alias("scope_rank"), F.col("term.rank").alias("term_rank")).alias("cell"),
    )
    asks = stored(lookups.select(*ASK).distinct(), "cache-asks")
    of_kind = F.filter(F.array(*map(F.lit, kinds)), lambda k: _of_place(k) == F.split("shared", r"\|")[0])
    slots = asks.withColumn("lacks", F.explode(of_kind)).withColumn("shared", F.split("shared", r"\|")[1])
    needed = slots.groupBy(*PLACE).agg(F.collect_set("wants").alias("wants"))
    timed = F.col("at").isNotNull()
    under = _standing(entries, needed, lengths).groupBy(*PLACE, "backend", "version").agg(
        F.min("at").alias("low"), F.max(F.when(timed, F.struct("at", "entry_id"))).alias("high"), F.max(F.when(~timed, F.col("entry_id"))).alias("untimed"))
    under = _slotted(under, needed).groupBy(*SLOT).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("untimed").alias("untimed"))
    by_slot = asks.withColumn("lacks", F.explode(of_kind))
    gone = F.concat("lacks", "wants")
    by_slot = by_slot.select(*[F.col(c).alias(f"ask_{c}") for c in ASK], "lacks", F.concat_ws("|", "lacks", "wants").alias("missing"), "repo", *[F.when(gone.contains(x), "").otherwise(F.col(c)).alias(c) for x, c in (("b", "backend"), ("v", "version"))], "scope", "term")
    known = by_slot.join(_dealt(under), SLOT).groupBy(*[F.col(f"ask_{c}").alias(c) for c in ASK]).agg(F.collect_list(F.struct("lacks", "low", "high", "untimed")).alias("kinds"))  # at most 32
    # Of entries without a time the last id counts, before all others; of the others the last in time that a restore's time admits.
    over = F.col("at").isNull()
    reached = F.transform(F.filter("kinds", lambda k: k.high.isNotNull() & (over | (k.high["at"] <= F.col("at")))), lambda k: F.struct(
        k.high["at"].alias("made"), (over | (F.concat(k.lacks, F.col("wants")) != "")).cast("int").alias("open"), k.high.entry_id.alias("entry_id")))
    between = F.transform(F.filter("kinds", lambda k: F.coalesce((k.low <= F.col("at")) & (k.high["at"] > F.col("at")), F.lit(False))), lambda k: k.lacks)
    hits = lookups.join(_dealt(known), ASK).select("id", "cell", F.array_max(F.transform("kinds", lambda k: k.untimed)).alias("untimed"), F.array_max(reached).alias("reached"), between.alias("between"), "at", *ASK)
    hits = hits.where("untimed IS NOT NULL OR reached IS NOT NULL OR size(between) > 0")
    late = F.when(F.col("untimed").isNull() & (F.size("between") > 0), F.struct("between", "at", *ASK)).alias("late")
    found = hits.select("id", F.struct("cell", "untimed", "reached", late).alias("one")).groupBy("id").agg(F.collect_list("one").alias("all")).withColumn("cell", F.array_min(F.transform("all", lambda x: x["cell"])))
    there = F.filter("all", lambda x: x["cell"] == F.col("cell"))
    found = found.withColumn("all", there).select("id", "cell", F.array_max(F.transform("all", lambda x: x["untimed"])).alias("untimed"), F.array_max(F.transform("all", lambda x: x["reached"])).alias("reached"), F.transform("all", lambda x: x["late"]).alias("late"))
    found = stored(found, "cache-found")
    late = found.where("untimed IS NULL").select("id", F.inline(F.filter("late", lambda x: x.isNotNull()))).withColumn("lacks", F.explode("between")).withColumn("shared", F.split("shared", r"\|")[1])
    needed = late.groupBy(*PLACE).agg(F.collect_set("wants").alias("wants"), F.max("at").alias("until"))
    gone = F.concat("lacks", "wants")
    late = late.select("id", "at", F.concat_ws("|", "lacks", "wants").alias("missing"), "repo", *[F.when(gone.contains(x), "").otherwise(F.col(c)).alias(c) for x, c in (("b", "backend"), ("v", "version"))], "scope", "term", F.length(gone).alias("open"))
    # Entries later than all that ask for them at a place need no sorting.
    placed = _slotted(_standing(entries.where("at IS NOT NULL"), needed, lengths), needed).where("at <= until").select(*SLOT, "at", "entry_id", F.col("at").alias("made"))
    last = latest_before(late, placed, SLOT, prefer="entry_id")
    last = last.groupBy("id").agg(F.max(F.struct(F.col("found.made").alias("made"), (F.col("open") > 0).cast("int").alias("open"), F.col("found.entry_id").alias("entry_id"))).alias("last"))
    best = F.when(F.col("untimed").isNull(), F.greatest("reached", "last"))
    picked = asked.select("id").distinct().join(_dealt(found.drop("late")), "id", "left").join(_dealt(last), "id", "left").withColumn("best", best)
    missing = F.col("untimed").isNotNull() | (F.col("best.open") > 0)
    entry = F.coalesce("untimed", "best.entry_id")
    return picked.select(
        F.col("id").alias("restore_id"), F.when(F.col("cell").isNull(), "false").when(missing, "unknown").otherwise("true").alias("same"),
        F.when(~missing, entry).alias("cache_id"), F.when(missing, entry).alias("open_id"), F.col("cell.scope_rank").alias("scope_rank"), F.col("cell.term_rank").alias("term_rank"),
    )
