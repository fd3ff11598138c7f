"""Column functions over section texts; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.sources.corpus import MISSING

#: The tail of a narrative sentence before "turn to N": in lower case, after a blank line and text that does not end a sentence.
CONTINUATION = r"""[^\s.!?:;)\]"”’»]\s*\n[^\S\n]*\n[^\S\n]*\p{Ll}(?:[^\n]*[^\s,;?])?[ \t]*\b(?i:turn\s+to\s+(?:the\s+)?)\d{1,4}\s*[.!]?[^\S\n]*(?:\n|$)"""

# Patterns and words that books and their readers are recognized by.
REFERENCE = r"(?i)\b(?:turn|go)\s+to\s+(?:the\s+)?(\d{1,4})\b"
RAW_CHOICE = r"(?i)turn\s+to\s+(?:the\s+)?(\d{1,4})"
CHOICE_LINE = r"(?im)^([^\n]+?)\bturn\s+to\s+(?:the\s+)?(\d{1,4})\s*[.!]?\s*$"
TURN = r"(?i)\bturn\s+to\s+(?:the\s+)?\d{1,4}\b"
STAT = r"(?i)(lose|gain|add|deduct|restore|increase|decrease|take)\s+(\d+)\s+(?:points?\s+)?(?:of\s+|from\s+|in\s+)?(SKILL|STAMINA|LUCK|CREW\s+(?:STRIKE|STRENGTH))"
LOG = r"(?i)(add|gain|increase|deduct|lose|subtract)\s+(\d+)\s+day[s]?\s+(?:to|onto|into|from)?\s*(?:your\s+)?LOG"
BOOTY = r"(?i)(add|gain|receive|find|deduct|lose|spend)\s+(\d+|one|two|three|four|five)\s+(gold\s+pieces?|gp[s]?|pieces?\s+of\s+gold|slaves?)"
ROLL = r"roll\s+(?:one\s+die|a\s+die|two\s+dice|\d+\s+dice|the\s+dice)"
LUCK_TEST = r"(?i)\btest\s+your\s+luck\b"
MISSING_TEXT = r"(?i)text\s+missing\s+or\s+unreadable"
DEATH = r"(?i)(your\s+(?:adventure|story)\s+ends|you\s+(?:have\s+)?died|your\s+life\s+(?:is\s+)?over|meet\s+your\s+(?:untimely\s+)?end|perish|you\s+are\s+dead\s*[.!]?$|killed\s+you\s*[.!]?$)"
VICTORY = r"(?i)(you\s+have\s+won|you\s+win\s+the|king\s+of\s+the\s+pirates|crowned\s+the\s+new|triumph|victory\s+is\s+yours|you\s+succeed\s*[.!]?$)"
TURN_TO = r"(?i)\b(turnto|turmn\s*to|turm\s*to|tumn\s*to|tum\s*to|furn\s*to|fum\s*to|lurn\s*to|hurmn\s*to|turnin\s*to|on\s*to)\s*(\d{1,3})"
DANGLING = r"(?i)[\(\{\[]?\s*(?:[tfb]u(?:r|m)n?)(?:\s+[tfko]o?)?\s*$"
TURN_TARGET = r"(?i)^(?:[a-z]\s*)?\d{1,3}[.,;:]?$"
ITEM_KINDS = {
    "consumable": ["potion", "chalice", "wine", "provisions"],
    "weapon": ["sword", "dagger", "axe", "spear", "mace", "crossbow", "cutlass", "pistol"],
    "armour": ["shield", "armour", "armor", "helmet", "helm", "cloak", "cape", "mask", "boots"],
    "quest": ["key", "map", "compass", "telescope", "lamp", "lantern"],
}
COMMANDS = [
    (r"\bgo\s+\d+\b|^\s*\d+\s*$", "go"),
    (r"reset|restart|newgame", "reset"),
    (r"logout|log out|sever", "logout"),
    (r"look", "look"),
    (r"help", "help"),
    (r"^(?:battle|fight|attack|strike)\b", "battle"),
    (r"^(?:flee|escape|run)\b", "flee"),
    (r"^(?:roll|dice)\b", "roll"),
    (r"save", "save"),
    (r"inventory", "inventory"),
]
STARTING_STATS = {"Dreadknight": (9, 22, 8), "Abyssal Mage": (8, 18, 12), "Shadow Rogue": (11, 18, 10)}


def references(text: Column) -> Column:
    """Sorted distinct targets of all "turn to" and "go to"."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), lambda x: x.cast("int"))))


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def prose(text: Column) -> Column:
    """Joins words that a line break hyphenates, then one line of text."""
    joined = F.regexp_replace(F.regexp_replace(text, r"-\s*\r?\n", ""), r"\s*\r?\n\s*", " ")
    return F.trim(F.regexp_replace(joined, r"\s{2,}", " "))


def continued(text: Column) -> Column:
    """Whether the text's only choice line is the tail of a narrative sentence."""
    once = lambda pattern: F.regexp_count(text, F.lit(pattern)) == 1
    return once(TURN) & once(CHOICE_LINE) & F.rlike(text, F.lit(CONTINUATION))


def choices(text: Column) -> Column:
    """Array of (label, target): labelled "turn to N" lines; a blank label is null. A bare "Turn to N" line is none, nor is the tail of a sentence."""
    labels, numbers = (F.regexp_extract_all(text, F.lit(CHOICE_LINE), F.lit(k)) for k in (1, 2))
    label = lambda x: F.when(F.trim(x) == "", None).otherwise(F.trim(F.regexp_replace(x, r"[,;:\s]+$", "")))
    found = F.zip_with(labels, numbers, lambda a, b: F.struct(label(a).alias("label"), b.cast("int").alias("target")))
    return F.filter(found, lambda _: ~continued(text))


def clean(text: Column) -> Column:
    """The text without choice lines, on one line; of the tail of a sentence only its "turn to N" goes."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.rlike(x, F.lit(CHOICE_LINE)) | continued(text))
    tail = F.transform(kept, lambda x: F.when(F.rlike(x, F.lit(CHOICE_LINE)), F.regexp_extract(x, CHOICE_LINE, 1)).otherwise(x))
    return normalize(F.array_join(tail, " "))


def raw_choices(text: Column) -> Column:
    """Array of (target, is_dice_roll) of all "turn to N" in order, repeats too; the flag says that the text speaks of a roll or dice."""
    dice_roll = F.rlike(text, F.lit("(?i)roll|dice"))
    return F.transform(F.regexp_extract_all(text, F.lit(RAW_CHOICE), F.lit(1)), lambda x: F.struct(x.cast("int").alias("target"), dice_roll.alias("is_dice_roll")))


def raw_combat(text: Column) -> Column:
    """Both words anywhere in the text: looser than has_combat."""
    return text.contains("SKILL") & text.contains("STAMINA")


def large_scale(text: Column) -> Column:
    """A line that has the strength of a crew."""
    return F.exists(F.split(text, "\n"), lambda x: x.contains("STRIKE") & x.contains("STRENGTH"))


def has_combat(text: Column) -> Column:
    return F.exists(F.split(text, "\n"), lambda x: x.contains("SKILL") & x.contains("STAMINA")) | large_scale(text)


def stat_changes(text: Column) -> Column:
    """Distinct "VERB N STAT", upper-cased, in order."""
    verb, n, stat = (F.regexp_extract_all(text, F.lit(STAT), F.lit(k)) for k in (1, 2, 3))
    pairs = F.zip_with(verb, n, lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.zip_with(pairs, stat, lambda a, b: normalize(F.upper(F.concat_ws(" ", a, b)))))


def log_days(text: Column) -> Column:
    """Signed sum of LOG days; null without any."""
    verb, n = (F.regexp_extract_all(text, F.lit(LOG), F.lit(k)) for k in (1, 2))
    signed = F.zip_with(verb, n, lambda a, b: F.when(F.lower(a).isin("add", "gain", "increase"), b.cast("int")).otherwise(-b.cast("int")))
    return F.when(F.size(signed) > 0, F.aggregate(signed, F.lit(0), lambda s, x: s + x))


def booty(text: Column) -> Column:
    """Distinct "verb n things", as written but on one line, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(BOOTY), F.lit(0)), normalize))


def dice_sentences(text: Column) -> Column:
    """Distinct sentences in which a roll of a number of dice begins, three at most. A sentence ends at a line break, too; the words of the roll may go on behind it."""
    rolls = F.regexp_extract_all(text, F.lit(rf"(?i)[^.!?\n]*(?={ROLL})[^.!?\n]+[.!?]?"), F.lit(0))
    return F.slice(F.array_distinct(F.transform(rolls, normalize)), 1, 3)


def luck_test(text: Column) -> Column:
    return F.rlike(text, F.lit(LUCK_TEST))


def is_missing(text: Column) -> Column:
    return F.rlike(text, F.lit(MISSING_TEXT))


def is_end(text: Column) -> Column:
    return (F.size(references(text)) == 0) & (F.size(choices(text)) == 0) & ~is_missing(text)


def death(text: Column) -> Column:
    return is_end(text) & F.rlike(text, F.lit(DEATH))


def victory(text: Column) -> Column:
    return is_end(text) & F.rlike(text, F.lit(VICTORY))


def repair_turn_to(text: Column) -> Column:
    return F.regexp_replace(text, TURN_TO, "turn to $2")


def section_number(text: Column, most: int = 400) -> Column:
    """1-4 digits with other than word characters around them, 1..most; else null."""
    found = F.regexp_extract(F.trim(text), r"^\W*(\d{1,4})\W*$", 1)
    value = F.when(found != "", found).cast("int")
    return F.when(value.between(1, most), value)


def image_path(slug: Column, page: Column) -> Column:
    """Where the first image of a page is served."""
    return F.concat(F.lit("/assets/game-art/"), slug, F.lit("/p"), page.cast("string"), F.lit("_i0.png"))


def is_noise_line(line: Column) -> Column:
    """Short, without blanks but with a digit, a few capitals alone, or mostly other than letters (of any script)."""
    t = F.trim(line)
    letters = F.length(F.regexp_replace(t, r"\P{L}", ""))
    capitals = (F.length(t) <= 12) & F.rlike(t, F.lit(r"^\p{L}+$")) & (F.upper(t) == t)
    return (F.length(t) <= 6) | (~t.contains(" ") & F.rlike(t, F.lit(r"\p{Nd}"))) | capitals | (letters < F.length(t) * 0.4)


def is_plausible(text: Column) -> Column:
    count = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    return F.length(text).between(60, 1200) & count.between(2, 24) & F.rlike(text, F.lit(r"^\s*\p{Lu}"))


def slug(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit(" "), F.lit("_")))


def code(text: Column) -> Column:
    """Upper case, other than letters and digits as _, one pass of __ to _, no _ at the ends."""
    return F.btrim(F.replace(F.regexp_replace(F.upper(text), r"[^\p{L}\p{Nd}]", "_"), F.lit("__"), F.lit("_")), F.lit("_"))


def classify(phrase: Column) -> Column:
    """The first of ITEM_KINDS of which the phrase holds a word, as a part; else artifact."""
    out = F.lit("artifact")
    for kind, words in reversed(ITEM_KINDS.items()):
        out = F.when(F.rlike(F.lower(phrase), F.lit("|".join(words))), kind).otherwise(out)
    return out


def command(text: Column) -> Column:
    """What a typed command does, by the first test that holds; null for a blank one."""
    t, out = F.lower(text), F.lit("unknown")
    for pattern, name in reversed(COMMANDS):
        out = F.when(F.rlike(t, F.lit(pattern)), name).otherwise(out)
    return F.when(F.trim(text) != "", out)


def starting_stats(name: Column) -> Column:
    """struct(skill, stamina, luck) of a class of characters; null for others."""
    out = F.lit(None).cast("struct<skill:int,stamina:int,luck:int>")
    for known, stats in STARTING_STATS.items():
        out = F.when(name == known, F.struct(*(F.lit(x).alias(n) for n, x in zip(("skill", "stamina", "luck"), stats, strict=True)))).otherwise(out)
    return out


def dice(text: Column) -> Column:
    """struct(count, sides) of "[n]d m"; a bare number is one die of so many sides; else 2d6; clamped to 1..20 and 1..100."""
    both, bare = F.regexp_extract(text, r"^\s*(\d{0,6})\s*[dD]\s*(\d{1,6})\s*$", 2), F.regexp_extract(text, r"^\s*(\d{1,6})\s*$", 1)
    n = F.regexp_extract(text, r"^\s*(\d{0,6})\s*[dD]\s*(\d{1,6})\s*$", 1)
    count = F.when(both != "", F.coalesce(F.nullif(n, F.lit("")).cast("int"), F.lit(1))).when(bare != "", 1).otherwise(2)
    sides = F.coalesce(F.nullif(both, F.lit("")).cast("int"), F.nullif(bare, F.lit("")).cast("int"), F.lit(6))
    clamp = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    return F.struct(clamp(count, 1, 20).alias("count"), clamp(sides, 1, 100).alias("sides"))
