"""Readers: progress, achievements, assets, and the state of a game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import code


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: an upsert in which the last write wins."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("row")).select(*keys, "row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def first_unlocks(rows: DataFrame) -> DataFrame:
    """user_id, code, ts: each code counts once, when it first occurs."""
    return rows.groupBy("user_id", "code").agg(F.min("ts").alias("ts"))


def profile(users: DataFrame, *children: tuple[str, DataFrame]) -> DataFrame:
    """users with the number of rows of each child table; children are counted before they are joined."""
    out = users
    for name, child in children:
        out = out.join(child.groupBy("user_id").agg(F.count(F.lit(1)).alias(name)), "user_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def cascade_delete(gone: DataFrame, child: DataFrame) -> DataFrame:
    """child without the rows of users that are gone."""
    return child.join(gone.select("user_id"), "user_id", "left_anti")


def progress_percent(complete: Column, section: Column) -> Column:
    """100 if complete, else the share of 400 sections, rounded half up."""
    return F.when(complete, 100).otherwise(F.least(F.lit(100), F.floor(section / 400 * 100 + 0.5).cast("int")))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def combat_rounds(fights: DataFrame) -> DataFrame:
    """fights (id, skill, enemy_skill, round) with both attacks and the damage of each side; dice follow from id and round."""
    die = lambda k: (F.col("id") * 31 + F.col("round") * 17 + k * 7) % 6 + 1
    own, other = die(0) + die(1) + F.col("skill"), die(2) + die(3) + F.col("enemy_skill")
    return fights.select("id", "round", own.alias("attack"), other.alias("enemy_attack"), F.when(own < other, 2).otherwise(0).alias("damage"), F.when(own > other, 2).otherwise(0).alias("enemy_damage"))


def patched(old: Column, new: Column) -> Column:
    """A null request keeps the old value."""
    return F.coalesce(new, old)


def patched_text(old: Column, new: Column) -> Column:
    """A null request keeps the old text, a blank one removes it."""
    return F.when(new.isNull(), old).when(F.trim(new) != "", F.trim(new))


def best_source(candidates: DataFrame, missing: str) -> DataFrame:
    """book_id, pass_id, present: the pass (book_id, pass_id, content) with the most sections; the earliest of equal ones."""
    counts = candidates.groupBy("book_id", "pass_id").agg(F.count_if(F.col("content") != missing).alias("present"))
    best = F.max_by(F.struct("pass_id", "present"), F.struct("present", (-F.col("pass_id")).alias("early")))
    return counts.groupBy("book_id").agg(best.alias("b")).select("book_id", "b.*")


def nested_profile(users: DataFrame, **children: DataFrame) -> DataFrame:
    """users with an array of rows of each child table (by user_id, sorted); children are gathered before they are joined, so they don't multiply."""
    out = users
    for name, child in children.items():
        rest = [c for c in child.columns if c != "user_id"]
        rows = child.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
        empty = F.array().cast(rows.schema[name].dataType)
        out = out.join(rows, "user_id", "left").withColumn(name, F.coalesce(name, empty))
    return out


def medallions(runs: DataFrame, catalog: DataFrame) -> DataFrame:
    """user_id, code, title: one for each user and book (user_id, book_title) that was completed; titles by the catalog (book_title, medallion_title), else by the book."""
    found = runs.select("user_id", "book_title").distinct().join(catalog, "book_title", "left")
    return found.select("user_id", F.concat(F.lit("MEDALLION_"), code(F.trim("book_title"))).alias("code"), F.coalesce("medallion_title", F.concat(F.lit("Medallion of "), F.col("book_title"))).alias("title"))


def rewritten(stored: DataFrame, titles: DataFrame, protected: list[str] | DataFrame) -> DataFrame:
    """stored (name) without the files of the titles (title) that are written again: "title" and "title (*", whatever their case; protected titles (a list, or a table of title) stay."""
    fronts = titles.select(F.lower("title").alias("front")).distinct()
    if isinstance(protected, DataFrame):
        again = fronts.join(protected.select(F.lower("title").alias("front")), "front", "left_anti")
    else:
        again = fronts.where(~F.col("front").isin([p.lower() for p in protected]))
    parts = F.split(F.lower("name"), r" \(")
    fronts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), " ("))
    gone = stored.select("name", F.explode(fronts).alias("front")).join(again, "front", "left_semi").select("name").distinct()
    return stored.join(gone, "name", "left_anti")


def parser_for(title: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The parser of the first rule (parser, words) whose words the title holds, whatever its case; else the default. A null title has the default."""
    out = F.lit(default)
    for parser, words in reversed(rules):
        out = F.when(F.lower(title).contains(words.lower()), parser).otherwise(out)
    return out


# The columns of each kind of response, and the names of a subscription's states by their numbers.
RESPONSES = {
    "item": ["id", "name", "type", "description", "rarity", "book_title", "section_number", "required_level", "required_skill", "required_stamina", "required_luck", "effects"],
    "spell": ["id", "name", "type", "description", "effects", "book_title", "section_number", "required_level", "required_skill", "required_stamina", "required_luck"],
    "command": ["id", "name", "aliases", "description", "usage", "category"],
    "catalog": ["id", "book_title", "section_count", "description", "medallion_title", "medallion_description"],
    "subscription": ["id", "plan", "status", "started_at", "expires_at", "renews_at"],
    "achievement": ["id", "code", "title", "description", "unlocked_at"],
    "asset": ["id", "name", "type", "description", "book_title", "section_number", "acquired_at"],
    "adventure": ["id", "book_title", "current_section", "skill", "stamina", "luck", "updated_at", "is_complete"],
}
STATES = ["Active", "Expired", "Cancelled", "PastDue"]


def response(rows: DataFrame, kind: str) -> DataFrame:
    """The columns of rows that a response of that kind has, in its order; keys of users and the like are left out.

    Columns that rows lack are null. The state of a subscription goes by its name; a number without a name stays a number.
    """
    columns = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in RESPONSES[kind]}
    if kind == "subscription" and "status" in rows.columns:
        number = F.col("status").cast("int")
        name = F.try_element_at(F.array(*map(F.lit, STATES)), F.when(number >= 0, number + 1))
        columns["status"] = F.coalesce(name, F.col("status").cast("string")).alias("status")
    return rows.select(*columns.values())


def excluded(title: Column, words: list[str]) -> Column:
    """Whether a title holds one of the words, whatever their case; a null title holds none."""
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(F.lower(title).contains(w.lower()), F.lit(False))
    return out


def saved_runs(books: DataFrame, runs: DataFrame) -> DataFrame:
    """books (book_title, map_path, sheet_path) with the first saved run (book_title, run_id, current_section, is_complete) of each title, and the cover: the map, else the sheet.

    Books without a run stay; of several runs of a title that with the least run_id counts.
    """
    rest = [c for c in runs.columns if c not in ("book_title", "run_id")]
    first = runs.groupBy("book_title").agg(F.min_by(F.struct("run_id", *rest), "run_id").alias("run"))
    return books.join(first, "book_title", "left").select("book_title", F.coalesce("map_path", "sheet_path").alias("cover"), "run.*")


def session_states(moves: DataFrame) -> DataFrame:
    """user_id, current, history, moves: where each reader is, by their moves (user_id, ts, tie, section; a null section is a reset).

    A reset goes back to section 1 and clears the history; each move adds to it. tie orders moves of one time.
    """
    order = ["ts", "tie"]
    every = moves.withColumn("since", F.sum(F.col("section").isNull().cast("int")).over(Window.partitionBy("user_id").orderBy(*order)))
    last = every.groupBy("user_id", "since").agg(F.array_sort(F.collect_list(F.struct(*order, F.coalesce("section", F.lit(1)).alias("section")))).alias("l"), F.count(F.lit(1)).alias("n"))
    whole = last.groupBy("user_id").agg(F.max_by("l", "since").alias("l"), F.sum("n").alias("moves"))
    history = F.transform("l", lambda x: x["section"])
    return whole.select("user_id", F.element_at(history, -1).alias("current"), history.alias("history"), "moves")


FIGHT = "struct<skill:int,stamina:int,luck:int,foe:int,wounds:int,rounds:int>"


def fights(rows: DataFrame) -> DataFrame:
    """rows (id, skill, stamina, luck, foes: array of (skill, stamina, special)) with the state after the fight: left (skill, stamina, luck), foes slain, rounds, outcome.

    Each round both sides throw two dice and add their skill; the loser gets 2 wounds, equals miss. A foe's wounds last; the
    next one steps forward when it falls. A hit of a special foe throws a die: 1 or 2 wounds, 3 or 4 costs a point of
    skill, else of luck. Dice follow from id and round, and come again after six rounds. So a fight in which six rounds change
    nothing never ends; each other six take a point off skill, stamina, luck or a foe. All are fought to their end by this bound. Outcome:
    won, lost, or endless. A null or empty array of foes is won at once.
    """
    die = lambda i, k: (F.col("id") * 31 + i * 17 + k * 7) % 6 + 1

    def step(s: Column, i: Column) -> Column:
        foe = F.try_element_at("foes", s["foe"] + 1)
        own, other = die(i, 0) + die(i, 1) + s["skill"], die(i, 2) + die(i, 3) + foe["skill"]
        hit, special = own < other, foe["special"]
        kind = F.when(hit & special, F.when(die(i, 4) <= 2, 0).when(die(i, 4) <= 4, 1).otherwise(2)).otherwise(F.when(hit, 0).otherwise(3))
        less = lambda name, k, n: F.greatest(F.lit(0), s[name] - F.when(kind == k, n).otherwise(0)).cast("int").alias(name)
        wounds = s["wounds"] + F.when(own > other, 2).otherwise(0)
        slain = wounds >= foe["stamina"]
        made = F.struct(less("skill", 1, 1), less("stamina", 0, 2), less("luck", 2, 1), F.when(slain, s["foe"] + 1).otherwise(s["foe"]).cast("int").alias("foe"), F.when(slain, 0).otherwise(wounds).cast("int").alias("wounds"), (s["rounds"] + 1).alias("rounds"))
        return F.when((s["stamina"] > 0) & foe.isNotNull(), made).otherwise(s)

    points = F.aggregate("foes", F.col("skill") + F.col("stamina") + F.col("luck"), lambda n, f: n + F.greatest(f["stamina"], F.lit(0)))
    rounds = (F.coalesce(points, F.lit(0)) * 6 + 6).cast("long")
    first = F.struct(*(F.col(c).cast("int").alias(c) for c in ("skill", "stamina", "luck")), F.lit(0).alias("foe"), F.lit(0).alias("wounds"), F.lit(0).alias("rounds"))
    end = rows.withColumn("end", F.aggregate(F.sequence(F.lit(0).cast("long"), rounds), first, step))
    outcome = F.when(F.col("end.stamina") <= 0, "lost").when(F.col("end.foe") >= F.coalesce(F.size("foes"), F.lit(0)), "won").otherwise("endless")
    return end.select("id", F.col("end.skill").alias("skill"), F.col("end.stamina").alias("stamina"), F.col("end.luck").alias("luck"), F.col("end.foe").alias("slain"), F.col("end.rounds").alias("rounds"), outcome.alias("outcome"))
