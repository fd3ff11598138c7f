"""Sections from positioned blocks and lines: header fold, manifest slices, merging of candidates, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.lore import is_junk_line, is_terminator
from foliant.functions.text import DANGLING, TURN_TARGET, choices, image_path, is_noise_line, repair_turn_to, section_number
from foliant.operators.folding import folded
from foliant.sources.corpus import MISSING

#: Blocks further up or down than this share of the page are headers or footers.
BAND = 0.05
#: How far ahead of the expected number a header in sequence may be, and a size over the mean that makes one visible.
AHEAD, LARGER = 5, 1.25


def inside_band(blocks: DataFrame, band: float = BAND) -> DataFrame:
    return blocks.where(F.col("top_fraction").between(band, 1 - band))


def page_number_filter(blocks: DataFrame, band: float = 0.9, most: int = 400) -> DataFrame:
    """blocks (text, top_fraction) without the numbers below the band: they number pages, not sections."""
    return blocks.where(~((F.col("top_fraction") > band) & section_number(F.col("text"), most).isNotNull()))


def header_fold(blocks: DataFrame, most: int = 400, settings: DataFrame | None = None) -> DataFrame:
    """book_id, section_number, content, discarded, page: blocks (book_id, seq, page, text, font_size, is_bold) cut at section headers; page: that of the header.

    A number is a header if it is in sequence, set larger or bold, or a plausible restart after a gap of pages; other
    numbers are text. The first section of a number stays, a later one is kept as discarded (the last one). A book's blocks
    are folded by one task, in order of seq. settings (book_id, most, ahead, larger; a row for each book at most): a book's highest
    number, how far ahead a header in sequence may be, and how much larger a visible one is; where null or absent, ``most``, AHEAD and LARGER.
    """
    import re

    def fold(book: list[dict], own: dict | None = None) -> list[tuple]:
        given = lambda name, other: other if own is None or own[name] is None else own[name]
        highest, ahead, larger = given("most", most), given("ahead", AHEAD), given("larger", LARGER)
        sizes = [r["font_size"] if (r["font_size"] or 0) > 0 else 10.0 for r in book]
        mean = sum(sizes) / len(sizes)
        current, expected, last, last_page, buffer = 0, 1, 0, 1, []
        done: dict[int, str] = {}
        dropped: dict[int, str] = {}
        pages: dict[int, int] = {}

        def flush() -> None:
            if current:
                pages.setdefault(current, last_page)
                (dropped if current in done else done)[current] = "\n\n".join(buffer)

        for r in book:
            text = (r["text"] or "").strip()
            hit = re.fullmatch(r"\W*(\d{1,4})\W*", text)
            n = int(hit[1]) if hit else 0
            if hit and 1 <= n <= highest:
                in_turn = expected - 1 <= n <= expected + ahead
                visible = (r["font_size"] or 0) > larger * mean or bool(r["is_bold"])
                again = current > 0 and n > last and n - last <= max(16, (r["page"] - last_page + 1) * 12) and re.fullmatch(r"\d+\.?", text) is not None
                if in_turn or visible or again:
                    flush()
                    current, expected, last, last_page, buffer = n, n + 1, n, r["page"], []
                    continue
            if current:
                buffer.append(text)
        flush()
        return [(n, done[n], dropped.get(n), pages[n]) for n in sorted(done)]

    kept = blocks.select("book_id", "seq", "page", "text", "font_size", "is_bold")
    own = None if settings is None else settings.select("book_id", "most", "ahead", "larger")
    return folded(kept, "book_id", "seq", fold, "section_number int, content string, discarded string, page int", own)


def parse_books(blocks: DataFrame, settings: DataFrame, band: float = BAND, page_number_band: float = 0.9) -> DataFrame:
    """book_id, section_number, content, image_path, has_combat: whole books from their blocks (book_id, seq, page, text, top_fraction, font_size, is_bold).

    settings: book_id, slug, most, ahead, larger (see header_fold), a row for each book; books without are left out. Headers, footers and page numbers
    go, sections are cut at their headers, lost ones recovered from the text before them, shifted ones put back, and the numbers
    that are left get the placeholder. A recovered section has the image of the one it was in, a placeholder none.
    """
    limits = settings.select("book_id", F.col("most").alias("n_sections"))
    number = section_number(F.col("text"), 9999)
    inner = inside_band(blocks, band).join(limits, "book_id")
    body = inner.where(~((F.col("top_fraction") > page_number_band) & F.coalesce(number <= F.col("n_sections"), F.lit(False)))).drop("n_sections")
    cut = header_fold(body, settings=settings)
    recovered = with_junk(split_orphans(cut, limits, "discarded string, page int"), "discarded")
    moved = rebalance_shifted(recovered, carried="page int")
    every = limits.select("book_id", F.explode(F.sequence(F.lit(1), F.col("n_sections").cast("int"))).alias("section_number"))
    held = every.join(moved, ["book_id", "section_number"], "left").withColumn("content", F.coalesce("content", F.lit(MISSING))).join(settings.select("book_id", "slug"), "book_id")
    before = F.last("page", ignorenulls=True).over(Window.partitionBy("book_id").orderBy("section_number").rowsBetween(Window.unboundedPreceding, 0))
    content, real = F.col("content"), F.col("content") != MISSING
    fights = content.contains("SKILL") & content.contains("STAMINA")
    return held.select("book_id", "section_number", "content", F.when(real, image_path(F.col("slug"), before)).alias("image_path"), fights.alias("has_combat"))


def manifest_sections(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """book_id, section_number, content: lines (book_id, n, text) cut at the starts (book_id, section_number, start) of a manifest.

    A section's lines end where the next start is; a range becomes an equi join by a running count of starts.
    """
    starts = manifest.select("book_id", F.col("start").alias("n"), F.lit(None).cast("string").alias("text"), "section_number")
    every = lines.select("book_id", "n", "text", F.lit(None).cast("int").alias("section_number")).unionByName(starts)
    order = Window.partitionBy("book_id").orderBy("n", F.col("section_number").isNull())
    held = every.withColumn("of", F.last("section_number", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = held.where(F.col("section_number").isNull() & F.col("of").isNotNull()).groupBy("book_id", F.col("of").alias("section_number")).agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("l"))
    return text.select("book_id", "section_number", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("content"))


def apply_manifest(lines: DataFrame, manifest: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """book_id, section_number, content, image_path: sections cut from lines (book_id, page, side, n, text; n counts a page's lines) by a manifest (book_id, section_number, page, side, line, end).

    Lines of a page half without a start count only if at least five of the half's lines have three words of four characters or
    more with a letter. A section goes from its line to its ``end`` on the same page (one line, if that is not there), else to
    the start of the next number, else to the end of the book; starts that are not there are left out. Contents are trimmed
    by trim_lines. A slice becomes an equi join by its line numbers.

    settings (book_id, slug, most, repair_turns, patches: array of (section_number, find, put)): a book's name in the paths of images, its
    highest section, whether garbled forms of "turn to" are repaired, and texts to be put in place of others, in order (the
    whole content, where find is null). Books without settings have "book" and their id as slug.
    """
    words = F.filter(F.split("text", " "), lambda w: (F.length(w) >= 4) & F.rlike(w, F.lit(r"\p{L}")))
    wordy = lines.groupBy("book_id", "page", "side").agg(F.count_if(F.size(words) >= 3).alias("wordy"))
    halves = manifest.select("book_id", "page", "side").distinct().withColumn("entry", F.lit(True))
    kept = wordy.join(halves, ["book_id", "page", "side"], "left").where(F.col("entry") | (F.col("wordy") >= 5)).select("book_id", "page", "side")
    order = Window.partitionBy("book_id").orderBy("page", "n")
    placed = lines.join(kept, ["book_id", "page", "side"]).withColumn("at", F.row_number().over(order) - 1)
    where = placed.select("book_id", "page", F.col("n").alias("line"), "at")
    total = placed.groupBy("book_id").agg(F.count(F.lit(1)).alias("total"))
    starts = manifest.join(where, ["book_id", "page", "line"], "left")
    ends = where.select("book_id", "page", F.col("line").alias("end"), F.col("at").alias("end_at"))
    after = F.lead("at").over(Window.partitionBy("book_id").orderBy("section_number"))
    bounds = starts.withColumn("next", after).join(ends, ["book_id", "page", "end"], "left").join(total, "book_id")
    stop = F.when(F.col("end").isNotNull(), F.coalesce("end_at", "at") + 1).otherwise(F.coalesce("next", "total"))
    spans = bounds.where(F.col("at").isNotNull()).select("book_id", "section_number", "page", F.when(stop > F.col("at"), F.sequence(F.col("at"), stop.cast("int") - 1)).alias("own"))
    rows = spans.withColumn("at", F.explode_outer("own")).drop("own").join(placed.select("book_id", "at", "text"), ["book_id", "at"], "left")
    held = rows.groupBy("book_id", "section_number", "page").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))).alias("l"))
    cut = held.select("book_id", "section_number", "page", F.array_join(trim_lines(F.transform("l", lambda x: x["text"])), "\n").alias("content"))
    default = F.concat(F.lit("book"), F.col("book_id").cast("string"))
    if settings is None:
        return cut.select("book_id", "section_number", "content", image_path(default, F.col("page")).alias("image_path"))
    own = cut.join(settings.select("book_id", "slug", "most", "repair_turns", "patches"), "book_id", "left").where(F.col("most").isNull() | F.col("section_number").between(1, F.col("most")))
    content = F.when(F.coalesce("repair_turns", F.lit(False)), repair_turn_to(F.col("content"))).otherwise(F.col("content"))
    return own.withColumn("content", content).select("book_id", "section_number", patched_content(F.col("content"), F.col("section_number"), F.col("patches")).alias("content"), image_path(F.coalesce("slug", default), F.col("page")).alias("image_path"))


def patched_content(content: Column, number: Column, patches: Column) -> Column:
    """content after the patches (array of (section_number, find, put)) for its section, or for all sections where theirs is null."""
    own = F.filter(patches, lambda p: F.coalesce(p["section_number"] == number, F.lit(True)))
    return F.coalesce(F.aggregate(own, content, lambda text, p: F.when(p["find"].isNull(), p["put"]).otherwise(F.replace(text, p["find"], p["put"]))), content)


def introduction(blocks: DataFrame, page_number_band: float = 0.9, most: int = 400) -> DataFrame:
    """book_id, introduction: the blocks (book_id, seq, text, top_fraction) before the first section number, those below the band of page numbers left out."""
    inner = blocks.where(F.col("top_fraction") <= page_number_band)
    first = inner.groupBy("book_id").agg(F.min(F.when(section_number(F.col("text"), most).isNotNull(), F.col("seq"))).alias("first"))
    front = inner.join(first, "book_id").where(F.col("first").isNull() | (F.col("seq") < F.col("first")))
    return _in_order(front, "seq", "\n\n")


def page_introduction(lines: DataFrame, pages: list[int]) -> DataFrame:
    """book_id, introduction: the non-blank lines (book_id, page, n, text) of the given pages, in the order given."""
    wanted = F.array(*map(F.lit, pages)).cast("array<int>")
    front = lines.where(F.col("page").isin(pages) & (F.trim("text") != "")).select("book_id", F.struct(F.array_position(wanted, F.col("page").cast("int")).alias("k"), "n").alias("seq"), F.trim("text").alias("text"))
    return _in_order(front, "seq", "\n")


def _in_order(rows: DataFrame, order: str, between: str) -> DataFrame:
    held = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("l"))
    return held.select("book_id", F.trim(F.array_join(F.transform("l", lambda x: x["text"]), between)).alias("introduction"))


def trim_lines(lines: Column) -> Column:
    """A fold over lines: blank ones go, a dangling "turn to" takes the short number after it, noise goes, and headers at the end."""
    target = lambda x: F.rlike(F.trim(x), F.lit(TURN_TARGET))
    dangling = lambda kept: (F.size(kept) > 0) & F.rlike(F.element_at(kept, -1), F.lit(DANGLING))

    def step(kept: Column, line: Column) -> Column:
        joined = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(F.concat(F.element_at(kept, -1), F.lit(" "), F.trim(line))))
        return F.when(F.trim(line) == "", kept).when(dangling(kept) & target(line), joined).when(is_noise_line(line), kept).otherwise(F.concat(kept, F.array(F.trim(line))))

    folded = F.aggregate(lines, F.array().cast("array<string>"), step)
    header = lambda x: (F.length(x) <= 6) & ~x.contains(" ")
    last = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(folded), F.lit(1))), F.lit(0), lambda a, i: F.when((i <= F.size(folded)) & ~header(F.try_element_at(folded, i)), i).otherwise(a))
    return F.slice(folded, 1, last)


def merge_candidates(candidates: DataFrame, most: DataFrame) -> DataFrame:
    """book_id, section_number, content: of each number in 1..n_sections the best candidate (pass_id, content), or the placeholder.

    A real text beats the placeholder, then the longer one wins, then the earlier pass.
    """
    real = F.col("content") != MISSING
    best = F.max_by("content", F.struct(real.alias("real"), F.length("content").alias("n"), (-F.col("pass_id")).alias("early")))
    found = candidates.groupBy("book_id", "section_number").agg(best.alias("content"))
    return fill_gaps(found, most)


def fill_gaps(sections: DataFrame, most: DataFrame) -> DataFrame:
    """All numbers 1..n_sections of each book (book_id, n_sections); those without a row get the placeholder."""
    every = most.select("book_id", F.explode(F.sequence(F.lit(1), F.col("n_sections").cast("int"))).alias("section_number"))
    return every.join(sections, ["book_id", "section_number"], "left").select("book_id", "section_number", F.coalesce("content", F.lit(MISSING)).alias("content"))


def missing_numbers(sections: DataFrame, most: DataFrame) -> DataFrame:
    every = most.select("book_id", F.explode(F.sequence(F.lit(1), F.col("n_sections").cast("int"))).alias("section_number"))
    return every.join(sections.select("book_id", "section_number"), ["book_id", "section_number"], "left_anti")


def book_quality(sections: DataFrame, most: int = 400, introductions: DataFrame | None = None, least_top: int = 200, least_present: int = 100, lengths: tuple[int, int] = (300, 2500), most_astray: int = 5) -> DataFrame:
    """book_id, present, top, total_chars, mean_chars, combat, needs_attention: a row per book, also for those of placeholders alone.

    needs_attention: the highest number is under ``least_top``, fewer sections than ``least_present`` have text, their mean length is
    not within ``lengths``, a choice leads out of 1..``most``, over ``most_astray`` choices lead to placeholders, or the book has no
    introduction (book_id, introduction; not tested where none are given). Choices are counted one by one; top and sums
    are of sections with text, the highest number is of all.
    """
    real = F.col("content") != MISSING
    size = F.when(real, F.length("content"))
    targets = F.transform(choices(F.col("content")), lambda c: c["target"])
    outside = F.size(F.filter(targets, lambda t: ~t.between(1, most)))
    gone = sections.where(~real).select("book_id", F.col("section_number").alias("target"))
    led = sections.select("book_id", F.explode(targets).alias("target")).join(gone, ["book_id", "target"], "left_semi").groupBy("book_id").agg(F.count(F.lit(1)).alias("astray"))
    mean = F.floor(F.avg(size)).cast("long")
    books = sections.groupBy("book_id").agg(
        F.count(size).alias("present"), F.max(F.when(real, F.col("section_number"))).alias("top"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_chars"), mean.alias("mean_chars"),
        F.count_if(real & F.col("content").contains("SKILL")).alias("combat"), F.max("section_number").alias("highest"), F.sum(outside).alias("outside"))
    bad = (F.col("highest") < least_top) | (F.col("present") < least_present) | (F.col("outside") > 0) | (F.coalesce("astray", F.lit(0)) > most_astray) | F.coalesce(~F.col("mean_chars").between(*lengths), F.lit(False))
    books = books.join(led, "book_id", "left")
    if introductions is not None:
        books = books.join(introductions, "book_id", "left")
        bad |= F.coalesce(F.length("introduction"), F.lit(0)) == 0
    return books.select("book_id", "present", "top", "total_chars", "mean_chars", "combat", bad.alias("needs_attention"))


def split_orphans(sections: DataFrame, most: DataFrame, carried: str | None = None) -> DataFrame:
    """Recovers section n + 1 from the text of n where it is absent, by the first of three signals that gives a plausible text.

    The text after the last garbled number line; after the last folio that starts with n + 1; after the line that closes n (the
    last terminator, or the one before it if the text ends on one). Junk lines go at the ends of both parts, and numbers in
    front of the new one; n keeps some text. Sections of a book are walked in order by one task, so a run of gaps can be recovered in one pass.
    With ``carried``, names and types of other columns, these are handed on (null for a number that had no row), and junk says which lines are junk (see with_junk).
    """
    import re

    def plausible(parts: list[dict]) -> bool:
        text = "\n\n".join(x["line"] for x in parts)
        return 60 <= len(text) <= 1200 and 2 <= len(parts) <= 24 and text[:1].isupper()

    def without_junk(parts: list[dict], front: bool) -> list[dict]:
        a, b = 0, len(parts)
        while front and a < b and (parts[a]["junk"] or re.fullmatch(r"\W*\d{1,4}\W*", parts[a]["line"])):
            a += 1
        while a < b and parts[b - 1]["junk"]:
            b -= 1
        return parts[a:b]

    def split(parts: list[dict], number: int) -> tuple[list[dict], list[dict]] | None:
        if len(parts) < 3:
            return None
        parts = without_junk(parts, False)
        if len(parts) < 3:
            return None
        last = lambda found: [i for i, x in enumerate(parts) if found(x)]
        garbled = last(lambda x: re.fullmatch(r"[0-9][0-9A-Za-z]?", x["line"]))
        folio = last(lambda x: (m := re.fullmatch(r"([0-9]{1,3})[-–—][0-9]{1,3}", x["line"])) and int(m[1]) == number)
        ends = last(lambda x: x["ends"])
        cuts = [(f[-1], f[-1] + 1) for f in (garbled, folio) if f]
        if ends and ends[-1] < len(parts) - 1:
            cuts.append((ends[-1] + 1, ends[-1] + 1))
        elif len(ends) > 1:
            cuts.append((ends[-2] + 1, ends[-2] + 1))
        for a, b in cuts:
            own, orphan = without_junk(parts[:a], False), without_junk(parts[b:], True)
            if own and plausible(orphan):
                return own, orphan
        return None

    def walk(book: list[dict]) -> list[tuple]:
        real = [r for r in book if r["content"] and r["content"] != MISSING]
        have, parts = {r["section_number"]: r["content"] for r in real}, {r["section_number"]: r["parts"] for r in real}
        for n in range(1, book[0]["n_sections"]):
            found = split(parts[n], n + 1) if n in have and n + 1 not in have else None
            if found:
                for k, own in zip((n, n + 1), found, strict=True):
                    parts[k], have[k] = own, "\n\n".join(x["line"] for x in own)
        if carried is None:
            return [(n, have[n]) for n in sorted(have)]
        other = {r["section_number"]: tuple(r[c] for c in others) for r in book}
        return [(n, have[n], [x["junk"] for x in parts[n]], *other.get(n, (None,) * len(others))) for n in sorted(have)]

    others = [c.split()[0] for c in carried.split(",")] if carried else []
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    flagged = F.transform(lines, lambda x: F.struct(x.alias("line"), is_junk_line(x).alias("junk"), is_terminator(x).alias("ends")))
    rows = sections.drop("n_sections").join(most, "book_id").select("book_id", "section_number", "content", flagged.alias("parts"), "n_sections", *others)
    return folded(rows, "book_id", "section_number", walk, "section_number int, content string" + (f", junk array<boolean>, {carried}" if carried else ""))


def choose_passes(candidates: DataFrame, primary: int = 250, enough: int = 400) -> DataFrame:
    """The candidates (book_id, mode, dpi, section_number, content) that are worth merging, with their pass_id.

    The embedded text always is. Where it has fewer than ``enough`` sections, of each resolution the split pass is if it has
    more sections than the flat one, else the flat one; the other resolutions only where the primary one has too few as well.
    """
    real = F.count_if(F.col("content") != MISSING)
    counts = candidates.groupBy("book_id", "mode", "dpi").agg(real.alias("present"))
    better = counts.where(F.col("mode") != "embedded").groupBy("book_id", "dpi").agg(F.max_by(F.struct("mode", "present"), F.struct("present", (F.col("mode") == "flat").alias("flat"))).alias("b")).select("book_id", "dpi", "b.*")
    short = lambda rows: rows.where(F.col("present") < enough).select("book_id")
    embedded, first = counts.where(F.col("mode") == "embedded"), better.where(F.col("dpi") == primary)
    first = first.join(short(embedded), "book_id", "left_semi")
    others = better.where(F.col("dpi") != primary).join(short(first), "book_id", "left_semi")
    chosen = [embedded.withColumn("rank", F.lit(0)), first.withColumn("rank", F.lit(1)), others.withColumn("rank", F.lit(2))]
    every = chosen[0].unionByName(chosen[1]).unionByName(chosen[2])
    numbered = every.withColumn("pass_id", F.row_number().over(Window.partitionBy("book_id").orderBy("rank", "dpi")) - 1)
    return candidates.join(numbered.select("book_id", "mode", "dpi", "pass_id"), ["book_id", "mode", "dpi"])


def with_junk(sections: DataFrame, *only: str) -> DataFrame:
    """sections with junk and spare_junk: for each non-blank trimmed line of content and of discarded (or ``only`` of one of them) whether it is a junk line."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return sections.withColumns({name: F.transform(lines(c), is_junk_line) for name, c in (("junk", "content"), ("spare_junk", "discarded")) if c in (only or sections.columns)})


def rebalance_shifted(sections: DataFrame, most: int = 400, carried: str | None = None) -> DataFrame:
    """Sections (book_id, section_number, content, discarded, junk, spare_junk) where a misread header moved a text up by one number.

    junk, spare_junk: see with_junk. If n is degraded (under 250 characters or
    junk in front), n + 1 is absent and n + 2 has an inner line that is n + 1, the text before that line goes to n and the
    text after it to n + 1; n + 2 keeps the text that was discarded for it, if plausible, else the placeholder; a text put
    back can be split again in its turn. A book
    (at most ``most`` sections) is walked by one task, as each step sees the ones before it. ``carried``: see split_orphans.
    """

    def plausible(parts: list[str]) -> bool:
        text = "\n\n".join(parts)
        return 60 <= len(text) <= 1200 and 2 <= len(parts) <= 24 and text[:1].isupper()

    def without_junk(parts: list[str], junk: list[bool], front: bool) -> list[str]:
        a, b = 0, len(parts)
        while a < b and junk[b - 1]:
            b -= 1
        while front and a < b and junk[a]:
            a += 1
        return parts[a:b]

    def lines_of(text: str) -> list[str]:
        return [x.strip() for x in text.split("\n") if x.strip()]

    def walk(book: list[dict]) -> list[tuple]:
        text, junk, spare, spare_junk = ({r["section_number"]: r[c] for r in book} for c in ("content", "junk", "discarded", "spare_junk"))
        for n in range(1, min(most, max(text)) - 1):
            if text.get(n, MISSING) == MISSING or n + 1 in text or text.get(n + 2, MISSING) == MISSING:
                continue
            parts, flags, own = lines_of(text[n + 2]), list(junk[n + 2]), junk[n]
            at = next((i for i in range(1, len(parts) - 1) if parts[i] in (f"{n + 1}", f"{n + 1}.")), None)
            if at is None or not (len(text[n]) < 250 or len(own) == 0 or own[0]):
                continue
            before, after = without_junk(parts[:at], flags[:at], False), without_junk(parts[at + 1 :], flags[at + 1 :], True)
            if plausible(before) and plausible(after):
                text[n], text[n + 1] = "\n\n".join(before), "\n\n".join(after)
                junk[n], junk[n + 1] = [False] * len(before), [False] * len(after)
                back = spare.get(n + 2)
                usable = back and plausible(lines_of(back))
                text[n + 2], junk[n + 2] = (back, spare_junk[n + 2]) if usable else (MISSING, [])
        other = {r["section_number"]: tuple(r[c] for c in others) for r in book}
        return [(n, text[n], *other.get(n, (None,) * len(others))) for n in sorted(text)]

    others = [c.split()[0] for c in carried.split(",")] if carried else []
    rows = sections.select("book_id", "section_number", "content", "junk", "discarded", "spare_junk", *others)
    return folded(rows, "book_id", "section_number", walk, "section_number int, content string" + (f", {carried}" if carried else ""))
