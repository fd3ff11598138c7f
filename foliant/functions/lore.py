"""Column functions that find rules, items, spells and foes in a book's texts; all are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import classify, normalize

# Word lists and patterns that results depend on.
ITEM_WORDS = ["potion", "sword", "dagger", "shield", "armour", "armor", "crossbow", "helmet", "helm", "staff", "ring", "amulet", "key", "scroll", "map", "compass", "skull", "idol", "gem", "jewel", "talisman", "spear", "axe", "mace", "cutlass", "pistol", "telescope", "lamp", "pouch", "gold", "silver", "crystal", "chalice", "goblet", "crown", "cape", "cloak", "mask", "lantern", "provisions", "treasure"]
NO_ITEM = ["swordfish", "sword-billed", "dice", "soup", "bread", "corridor", "door", "tunnel", "chimney", "ship", "boat", "vessel", "crew", "slave", "slaves", "statue is", "the sea", "the sky", "gold pieces (each", "gold pieces each", "booty", "statue", "statues", "shrine", "treasure of", "treasures of"]
BEFORE_ITEM = ["its", "the", "a", "an", "his", "her", "your", "their", "this", "that", "these", "those", "some", "all", "any", "other", "more", "each", "no", "one", "two"]
AFTER_ITEM = ["which", "that", "with", "and", "but", "from", "into", "onto", "towards", "against", "enables", "allows", "gives", "contains", "will", "you", "your", "if", "so", "then", "of", "in", "on", "for", "when", "while", "the", "it", "its", "a", "an"]
ACQUIRE = r"(?i)\b(?:you may take|take its|take the|take a|take an|you take the|you find the|you find a|you find an|you find a small|you obtain the|you obtain a|you receive the|you receive a|you gain the|you gain a|you discover the|you discover a|add the|add a|add to your|give you a|gives you a|hand you a|buy the|buy a|purchase the|purchase a|seize the|capture the|collect the|collect a)\s+([A-Z][A-Za-z''-]*(?:\s+(?:of\s+[A-Z][A-Za-z''-]*|[A-Z][A-Za-z''-]*|a\s+[A-Z][A-Za-z''-]*|the\s+[A-Z][A-Za-z''-]*)){0,3})"
HAVE = r"(?i)\bif you have (?:already )?(?:the|a|an)\s+([A-Z][A-Za-z''-]*(?:\s+(?:of\s+[A-Z][A-Za-z''-]*|[A-Z][A-Za-z''-]*)){0,3})\b"
ARTIFACT = r"\b([A-Z][a-zA-Z''-]*\s+of\s+[A-Z][a-zA-Z''-]*)\b"
ITEM = rf"(?i)\b(?:{'|'.join(ITEM_WORDS)})s?\b"
SPELL = r"(?i)\b(?:spell of|called |known as |incantation of |word of power|cast the spell|the spell|learn the|learned the|teach you|taught you)\s+([A-Z][a-zA-Z''-]*(?:\s+[A-Z][a-zA-Z''-]*){0,2})\b"
MENTION = r"(?i)\b(you\s+(?:find|discover|obtain|receive|acquire)\s+(?:a\s+|an\s+|the\s+)?([a-z][a-z '.-]{2,20}))"
NOTE = r"(?i)(whenever[^.!?\n]{0,160}\.)|(score\s+a\s+hit[^.!?\n]{0,120}\.)|(hits\s+you\s+during\s+the\s+battle[^.!?\n]{0,120}\.)|(roll\s+one\s+die[^.!?\n]{0,120}\.)"
ROLL = r"(?i)roll\s+(one\s+die|two\s+dice|three\s+dice)\s*\.\s*add\s+(\d+)\s+to\s+the\s+result\s*\.\s*[^.]{0,140}\b"
WITHIN = r"(?i)\bwithin\s+(fifty|forty|thirty|twenty|\d+)\s+days?\b"
ONLY = r"(?i)\bonly\s+(\d+)\s+gold\s+pieces?\b"
DAYS = {"fifty": "50", "forty": "40", "thirty": "30", "twenty": "20"}
ESCAPE = "can try to escape|attempt to escape|may escape|escape if|try to flee|try to escape"
NOTICES = ["fighting fantasy", "world-wide sensation", "part story, part game", "you become the hero", "two dice, a pencil and an eraser", "a perilous quest to find the", "warlock's treasure", "warlocks treasure", "route to follow", "elaborate combat", "system given in the book", "you may not survive your first journey", "experience, skill and luck", "nearer to your"]
TURN_END = r"(?i)\b(?:turn\s+to\s+\d{1,4})(?:\s+\w+){0,3}\s*\)?[.!?]?\s*$"
CHOICE_END = r"(?i)\(turn\s+to\s+\d{1,4}\)\s*(?:or\s+[^()]*\(turn\s+to\s+\d{1,4}\))?\s*[.!?]?\s*$"
STAT_LINE = r"SKILL\s*\d+\s+STAMINA\s*\d+"

RULES = "array<struct<stat: string, formula: string>>"
FOES = "array<struct<name: string, skill: int, stamina: int, crew: boolean, has_stats: boolean>>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once."""
    return F.transform(F.array(value), f)[0]


def first_by_name(rows: Column) -> Column:
    """The first of the structs with the same name, upper and lower case taken as equal."""
    return let(rows, lambda a: let(F.transform(a, lambda y: F.lower(y["name"])), lambda names: F.filter(a, lambda x, i: F.array_position(names, F.lower(x["name"])) == i + 1)))


def rules(text: Column) -> Column:
    """Array of (stat, formula): how stats are rolled, the days of the LOG, the gold to start with."""

    def rolled(stat: str, crew: str) -> Column:
        dice, add, name = (F.regexp_extract_all(text, F.lit(rf"{ROLL}{stat}\b"), F.lit(k)) for k in (1, 2, 3))
        count = lambda d: F.when(F.lower(d).startswith("one"), "1").when(F.lower(d).startswith("two"), "2").otherwise("3")
        formula = F.zip_with(dice, add, lambda d, n: F.concat(count(d), F.lit("d6+"), n.cast("int").cast("string")))
        return F.zip_with(name, formula, lambda s, f: F.struct(F.concat(F.lit(crew), s).alias("stat"), f.alias("formula")))

    def single(stat: str, found: Column, formula: Column) -> Column:
        return F.when(found != "", F.array(F.struct(F.lit(stat).alias("stat"), formula.alias("formula")))).otherwise(F.array().cast(RULES))

    days, gold = F.lower(F.regexp_extract(text, WITHIN, 1)), F.regexp_extract(text, ONLY, 1)
    number = days
    for word, n in DAYS.items():
        number = F.when(days == word, n).otherwise(number)
    return F.concat(rolled("(SKILL|STAMINA|LUCK)", ""), rolled(r"CREW\s+(STRIKE|STRENGTH)", "CREW "), single("LOG", days, F.concat(number, F.lit(" days"))), single("BOOTY", gold, F.concat(gold, F.lit(" Gold Pieces"))))


def item_mentions(text: Column) -> Column:
    """Distinct clauses in which the reader finds something, three at most."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MENTION), F.lit(1)), normalize)), 1, 3)


def combat_note(text: Column) -> Column:
    return normalize(F.nullif(F.regexp_extract(text, NOTE, 0), F.lit("")))


def items(prose: Column) -> Column:
    """Array of (name, type, rarity) in a text of one line; of names equal but for case a legendary one stays, else the first."""
    stops = "|".join(w.replace("(", r"\(") for w in NO_ITEM)
    leading = rf"(?i)^(?:(?:{'|'.join(BEFORE_ITEM)}) +)+(?=[^ ])"
    trailing = rf"(?: +(?!(?i:[^ ]*\b(?:{'|'.join(ITEM_WORDS)})s?\b))(?:(?i:{'|'.join(AFTER_ITEM)})(?= |$)|[^\p{{Lu}} ][^ ]*))+$"
    stopped = lambda x: F.rlike(F.lower(x), F.lit(stops))
    found = F.concat(*(F.regexp_extract_all(prose, F.lit(p), F.lit(1)) for p in (ACQUIRE, HAVE, ARTIFACT)))
    named = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), "[,.;:]+$", ""), leading, ""))
    named = F.filter(named, lambda x: F.rlike(x, F.lit(ITEM)) & ~stopped(x))
    named = F.filter(F.transform(named, lambda x: F.regexp_replace(x, trailing, "")), lambda x: ~stopped(x) & (F.size(F.split(x, " ")) <= 5))
    legendary = lambda x: F.rlike(x, F.lit(ARTIFACT)) & F.rlike(F.substring_index(F.lower(x), " of ", 1), F.lit(ITEM))
    rows = F.transform(named, lambda x: F.struct(x.alias("name"), classify(x).alias("type"), F.when(legendary(x), "legendary").otherwise("common").alias("rarity")))
    return let(rows, lambda a: first_by_name(F.concat(F.filter(a, lambda x: x["rarity"] == "legendary"), F.filter(a, lambda x: x["rarity"] != "legendary"))))


def catalog(found: DataFrame) -> DataFrame:
    """book_id, name, type, rarity, section_number: what sections (book_id, section_number, name, type, rarity) have, each name of a book once, whatever its case.

    A legendary mention stays, else that of the earliest section, of one section the first name by letters; combined before the shuffle.
    """
    best = F.struct((F.col("rarity") != "legendary").alias("plain"), "section_number", "name", "type", "rarity")
    held = found.groupBy("book_id", F.lower("name").alias("key")).agg(F.min(best).alias("b"))
    return held.select("book_id", "b.name", "b.type", "b.rarity", "b.section_number")


def spells(prose: Column) -> Column:
    """Array of (name, type) of spells named in a text of one line."""
    rows = F.transform(F.regexp_extract_all(prose, F.lit(SPELL), F.lit(1)), lambda x: F.struct(F.trim(x).alias("name"), F.lit("arcane").alias("type")))
    return first_by_name(F.filter(rows, lambda x: F.size(F.split(x["name"], " ")) <= 4))


def _foes(lines: Column, attack: str, hp: str, crew: bool, client: bool) -> Column:
    name, end = r"[A-Z0-9][A-Z0-9' .\-]", r"(?=[.,;!?]|\s|$)"
    pair = rf"{attack}\s*(\d{{1,2}})\s*{hp}\s*(\d{{1,3}})"
    inline, row, bare = rf"(?i)^({name}{{1,50}}?)\s+{pair}{end}", rf"(?i)^({name}{{1,50}})\s+(\d{{1,2}})\s+(\d{{1,3}})$", rf"(?i)^{pair}$"
    header = rf"(?i)^(?:({name}{{1,{50 if client else 40}}})\s+)?{attack}\s+{hp}$"
    none = F.array().cast(FOES)

    def foe(who: Column, a: Column, b: Column, known: bool = True) -> Column:
        return F.struct(who.alias("name"), a.cast("int").alias("skill"), b.cast("int").alias("stamina"), F.lit(crew).alias("crew"), F.lit(known).alias("has_stats"))

    def of(line: Column, pattern: str) -> Column:
        return foe(F.trim(F.regexp_extract(line, pattern, 1)), F.regexp_extract(line, pattern, 2), F.regexp_extract(line, pattern, 3))

    def box(line: Column, i: Column) -> Column:
        is_row = lambda x: F.rlike(x, F.lit(inline)) | F.rlike(x, F.lit(row))
        tail = F.slice(lines, i + 2, F.size(lines))
        stop = F.array_position(F.transform(tail, is_row), False).cast("int")
        rows = F.transform(F.when(stop == 0, tail).otherwise(F.slice(tail, 1, F.greatest(stop - 1, F.lit(0)))), lambda x: F.when(F.rlike(x, F.lit(inline)), of(x, inline)).otherwise(of(x, row)))
        title = F.trim(F.regexp_extract(line, header, 1))
        if not client:  # a named box counts itself, without stats
            return F.concat(F.when(title != "", F.array(foe(title, F.lit(0), F.lit(0), False))).otherwise(none), rows)
        near = F.array_join(F.slice(lines, i + 1, 4), " ")
        only = foe(F.when(title == "", "The Foe").otherwise(title), F.regexp_extract(near, f"(?i){pair}", 1), F.regexp_extract(near, f"(?i){pair}", 2))
        return F.when(F.size(rows) > 0, rows).when(F.rlike(near, F.lit(f"(?i){pair}")), F.array(only)).otherwise(none)

    def alone(line: Column, i: Column) -> Column:
        before = F.trim(F.regexp_replace(F.element_at(lines, F.greatest(i, F.lit(1))), r"^[-•*]\s*" if client else r"^[-•* ]+", ""))
        named = (F.length(before) >= 2) & ~F.rlike(before, F.lit("(?i)SKILL|STAMINA|STRIKE|STRENGTH" if client else f"(?i){attack}|{hp}"))
        a, b = F.regexp_extract(line, bare, 1), F.regexp_extract(line, bare, 2)
        other = F.array(foe(F.lit("The Foe"), a, b)) if client else none
        return F.when(i == 0, none).when(named, F.array(foe(before, a, b))).otherwise(other)

    each = lambda x, i: F.when(F.rlike(x, F.lit(inline)), F.array(of(x, inline))).when(F.rlike(x, F.lit(header)), box(x, i)).when(F.rlike(x, F.lit(bare)), alone(x, i)).otherwise(none)
    return F.flatten(F.transform(lines, each))


def foes(text: Column, client: bool = False) -> Column:
    """Array of (name, skill, stamina, crew, has_stats): foes of single lines, of boxes with a header, and of stats below a name.

    Rows of a box that hold their own stats are lines as well, so they count twice. The client's reading knows no crews,
    looks for a box's stats in its next lines, and calls a foe without a name "The Foe".
    """
    fixed = F.regexp_replace(text, "(SKILL|STAMINA|STRIKE|STRENGTH)S", "$1")
    trimmed = lambda x: normalize(x) if client else F.btrim(x, F.lit(" \t\r"))
    lines = F.filter(F.transform(F.split(fixed, "\n"), trimmed), lambda x: x != "")
    if client:
        return let(lines, lambda v: _foes(v, "SKILL", "STAMINA", False, True))
    both = lambda v, a, b: F.exists(v, lambda x: x.contains(a) & x.contains(b))
    part = lambda v, a, b, crew: F.when(both(v, a, b), _foes(v, a, b, crew, False)).otherwise(F.array().cast(FOES))
    return let(lines, lambda v: F.concat(part(v, "SKILL", "STAMINA", False), part(v, "STRIKE", "STRENGTH", True)))


def special_hit(text: Column) -> Column:
    """Whether hits in this section roll a die over skill and luck."""
    t = F.lower(text)
    return F.rlike(t, F.lit("roll[^.!?]{0,80}(?:die|dice)")) & t.contains("skill") & t.contains("luck")


def can_flee(text: Column) -> Column:
    return F.rlike(F.lower(text), F.lit(ESCAPE))


def is_junk_line(line: Column) -> Column:
    """Folios, stray letters and symbols, headers merged with text, and notices of the cover."""
    t = F.trim(line)
    alike = F.length(F.regexp_replace(t, r"[^\p{L}\p{Nd}]", ""))
    bare = F.lower(F.regexp_replace(t, r"['`’‘´,.\-]", ""))
    notice = F.exists(F.array(*map(F.lit, NOTICES)), lambda p: F.lower(t).contains(p) | bare.contains(p))
    shape = r"^\d{1,3}[-–—]\d{1,3}$|^[^\w\s]{2,}$|^[A-Za-z]{1,2}$|^\d{1,4}\s+\w|(?i)^cover illustration by|great\s*goal"
    return (t == "") | F.rlike(t, F.lit(shape)) | ((F.length(t) >= 2) & (alike < F.length(t)) & (alike / F.length(t) < 0.55)) | notice


def is_garbled_header(line: Column) -> Column:
    return F.rlike(F.trim(line), F.lit(r"^\d[0-9A-Za-z]?$"))


def is_terminator(line: Column) -> Column:
    """Whether a line ends a section: a turn, a choice in brackets or a foe's stats."""
    return F.rlike(F.trim(line), F.lit(TURN_END)) | F.rlike(F.trim(line), F.lit(CHOICE_END)) | F.rlike(F.trim(line), F.lit(STAT_LINE))


def asset_type(kind: Column) -> Column:
    return F.when(kind.isin("weapon", "consumable", "quest", "artifact"), kind).otherwise("quest")


def asset_rarity(kind: Column) -> Column:
    return F.when(F.rlike(F.lower(kind), F.lit("artifact|rare|legendary")), "rare").otherwise("common")


def is_complete(section: Column, choices: Column) -> Column:
    """A run is complete at section 400 or later, or where no choice is left."""
    return (section >= 400) | (choices == 0)


def resume_at(saved: Column, complete: Column) -> Column:
    """The saved section of a run that is not complete, else the first."""
    return F.when(saved.isNotNull() & ~F.coalesce(complete, F.lit(False)) & (saved > 1), saved).otherwise(1)
