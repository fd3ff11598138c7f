"""From words to lines and paragraphs, and regions of ink on a page."""

from __future__ import annotations

from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.folding import folded


#: A page or scan wider than this times its height has two pages side by side: of words, of lines read for numbering.
TWO_UP, TWO_UP_SCAN = 1.15, 1.05
#: A line of nothing but a number: a page number or a section's header.
NUMBER_ONLY = r"^\W*\d{1,4}\W*$"
#: Number lines of a scan above and below these shares of the page are folios.
TOP_EDGE, BOTTOM_EDGE = 0.04, 0.95


def gutters(words: DataFrame) -> DataFrame:
    """page_id, gutter: the middle of the widest gap between words in the middle third of a page (page_id, page_width, left, right), by a sweep from left to right.

    A gap is free of all words of the page. Pages without one there have none.
    """
    sweep = Window.partitionBy("page_id").orderBy("left", "right").rowsBetween(Window.unboundedPreceding, -1)
    reached = words.select("page_id", "page_width", "left", F.max("right").over(sweep).alias("reached"))
    third = F.col("page_width") / 3
    start, end = F.greatest("reached", third), F.least("left", third * 2)
    gaps = reached.where("reached IS NOT NULL").select("page_id", (end - start).alias("gap"), ((start + end) / 2).alias("gutter")).where("gap > 0")
    return gaps.groupBy("page_id").agg(F.max_by("gutter", F.struct("gap", -F.col("gutter"))).alias("gutter"))


def page_columns(words: DataFrame, by_gap: bool = False, two_up: float = TWO_UP) -> DataFrame:
    """words (page_id, page_width, page_height, left, right, ...) with logical_page: pages twice as wide are two, 2p - 1 and 2p.

    A word belongs to the half it lies in whole; those across the middle are dropped. With ``by_gap`` the halves meet in the
    page's gutter, if it has one, in place of its middle. Other pages keep words and number; words outside the page are dropped.
    """
    middle = F.col("page_width") / 2
    rows = words
    if by_gap:
        rows = words.join(gutters(words.where(F.col("page_width") > F.col("page_height") * two_up)), "page_id", "left")
        middle = F.coalesce("gutter", middle)
    wide = F.col("page_width") > F.col("page_height") * two_up
    inside = (F.col("left") >= 0) & (F.col("right") <= F.col("page_width"))
    page = F.when(~wide, F.col("page_id")).when(F.col("right") <= middle, F.col("page_id") * 2 - 1).when(F.col("left") >= middle, F.col("page_id") * 2)
    return rows.where(inside).withColumn("logical_page", page).where("logical_page IS NOT NULL").drop("gutter")


def scan_blocks(lines: DataFrame, by_centre: bool = False, two_up: float = TWO_UP) -> DataFrame:
    """page_id, logical_page, top_fraction, font_size, is_bold, text: the lines of a scan (page_id, page_width, page_height, left, right, top, text; top grows downwards) as blocks.

    Blank lines go, and number lines at the very edges; sections' headers low on a page stay. With ``by_centre`` a wide page's lines
    go to the half in which their centre is.
    """
    text = F.trim("text")
    share = F.when(F.col("page_height") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("top") / F.col("page_height")))).otherwise(0.0)
    centre = F.col("left") + F.floor((F.col("right") - F.col("left")) / 2)
    wide = F.lit(by_centre) & (F.col("page_width") >= F.col("page_height") * two_up)
    page = F.when(~wide, F.col("page_id")).when(centre < F.floor(F.col("page_width") / 2), F.col("page_id") * 2 - 1).otherwise(F.col("page_id") * 2)
    blocks = lines.select("page_id", page.alias("logical_page"), share.alias("top_fraction"), F.lit(0.0).alias("font_size"), F.lit(False).alias("is_bold"), text.alias("text"))
    folio = F.rlike("text", F.lit(NUMBER_ONLY)) & ((F.col("top_fraction") > BOTTOM_EDGE) | (F.col("top_fraction") < TOP_EDGE))
    return blocks.where((F.col("text") != "") & ~folio)


def column_centres(lines: DataFrame) -> DataFrame:
    """page_id, split: where the starts of a page's lines (page_id, left) fall apart into two groups of the least spread (two means), found among all cuts of the sorted starts."""
    order = Window.partitionBy("page_id").orderBy("left")
    page = Window.partitionBy("page_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    cuts = lines.select("page_id", F.col("left").cast("double").alias("left"), F.lead("left").over(order).alias("after"), F.sum("left").over(upto).alias("a"), F.count(F.lit(1)).over(upto).alias("k"), F.sum("left").over(page).alias("whole"), F.count(F.lit(1)).over(page).alias("n"))
    # the sum of squares is the same for each cut, so the least spread has the largest sum of squared means by size
    worth = F.col("a") * F.col("a") / F.col("k") + (F.col("whole") - F.col("a")) * (F.col("whole") - F.col("a")) / (F.col("n") - F.col("k"))
    return cuts.where("after > left").groupBy("page_id").agg(F.max_by((F.col("left") + F.col("after")) / 2, F.struct(worth, -F.col("left"))).alias("split"))


def number_lines(lines: DataFrame, by_centres: bool = False, two_up: float = TWO_UP_SCAN) -> DataFrame:
    """page_id, n, side, top, text: the lines of scans (page_id, page_width, page_height, left, top, seq, text) numbered from 0 within a page by side and top.

    Sides: M for a page that isn't wide; else L and R by the half a line starts in, or ``by_centres`` by the page's own two
    columns. top is a share of the page; seq is the order in which lines of one side and top were read. Blank lines go.
    """
    rows, middle = lines.where(F.trim("text") != ""), F.floor(F.col("page_width") / 2)
    wide = F.col("page_width") >= F.col("page_height") * two_up
    if by_centres:
        rows = rows.join(column_centres(rows.where(wide)), "page_id", "left")
        middle = F.coalesce("split", middle)
    side = F.when(~wide, "M").when(F.col("left") < middle, "L").otherwise("R")
    top = F.when(F.col("page_height") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("top") / F.col("page_height")))).otherwise(0.0)
    placed = rows.select("page_id", side.alias("side"), top.alias("top"), "seq", F.trim("text").alias("text"))
    order = Window.partitionBy("page_id").orderBy("side", "top", "seq", "text")
    return placed.select("page_id", (F.row_number().over(order) - 1).alias("n"), "side", "top", "text")


def group_lines(words: DataFrame) -> DataFrame:
    """page_id, line, text, top, bottom, font_total, n_words, is_bold: words (page_id, left, top, bottom, text and perhaps is_bold) as lines from the highest on.

    From the lowest edge that is highest on, a word whose height touches a line's joins it, of several the one whose first word
    stands nearest to its own lower edge. A page's words are folded by one task; many pages share a batch.
    """
    bold = F.col("is_bold") if "is_bold" in words.columns else F.lit(False)

    def fold(page: list[tuple]) -> list[tuple]:
        lines: list[list] = []  # base, top, bottom, words
        line: list = []
        edges = None
        page.sort(key=lambda w: (-w[3], w[1]))
        for w in page:
            _, _, top, bottom, _, _ = w
            if edges == (top, bottom) and top >= bottom:  # as the word before: it joins the same line
                line[3].append(w)
                continue
            edges = top, bottom
            near = [x for x in lines if bottom <= x[1] and top >= x[2]]
            if near:
                line = min(near, key=lambda x: abs(x[0] - bottom))
                line[1], line[2] = max(line[1], top), min(line[2], bottom)
                line[3].append(w)
            else:
                line = [bottom, top, bottom, [w]]
                lines.append(line)
        out = []
        for i, (_, top, bottom, own) in enumerate(lines):
            own.sort(key=itemgetter(1))
            out.append((i, " ".join([w[4] or "" for w in own]), top, bottom, sum([w[2] - w[3] for w in own]), len(own), any([w[5] for w in own])))
        return out

    rows = words.select("page_id", F.monotonically_increasing_id().alias("seq"), *(F.col(c).cast("double").alias(c) for c in ("left", "top", "bottom")), "text", F.coalesce(bold, F.lit(False)).alias("is_bold"))
    return folded(rows, "page_id", "seq", fold, "line int, text string, top double, bottom double, font_total double, n_words int, is_bold boolean", tuples=True)


def paragraphs(lines: DataFrame, factor: float = 1.4) -> DataFrame:
    """page_id, paragraph, text, top_fraction, font_size, is_bold: lines (page_id, n, top, bottom, text) cut where the gap exceeds factor x the mean line height, and around numbers.

    Lines of a paragraph are joined by line breaks; a hyphen at a line's end goes and the next line is glued to it, but for a number,
    which is always a paragraph of its own. With font_total, n_words, is_bold and page_height of the lines (see group_lines) a
    paragraph has its mean font size, whether a word is bold, and how far down it begins (else 0, false, 0). As words are
    counted before a paragraph ends, those of a line that ends one count for it, not for the one that they begin.
    """
    given = lambda name, other: F.col(name) if name in lines.columns else F.lit(other)
    page = Window.partitionBy("page_id").orderBy("n")
    number = F.coalesce(F.rlike(F.trim("text"), F.lit(NUMBER_ONLY)), F.lit(False))
    rows = lines.select("page_id", "n", "top", "bottom", F.coalesce("text", F.lit("")).alias("text"), given("font_total", 0.0).alias("font_total"), given("n_words", 0).alias("n_words"), given("is_bold", False).alias("is_bold"), given("page_height", 0.0).alias("page_height"), number.alias("number"))
    height = F.avg(F.col("top") - F.col("bottom")).over(Window.partitionBy("page_id"))
    before, after = (lambda c: F.lag(c).over(page)), (lambda c: F.lead(c).over(page))
    first, behind_number = before("n").isNull(), F.coalesce(before("number"), F.lit(False))
    rows = rows.withColumns({"wide": (before("bottom") - F.col("top")) > height * factor, "glued": ~first & ~F.col("number") & ~behind_number & F.coalesce(before("text").endswith("-"), F.lit(False)), "first": first, "behind": behind_number, "top_before": before("top")})
    new = F.col("first") | F.col("number") | F.col("behind") | (F.col("wide") & ~F.col("glued"))
    begins = F.when(F.col("behind") & ~F.col("number") & ~F.col("wide"), F.col("top_before")).otherwise(F.col("top"))
    rows = rows.withColumns({"new": new, "begins": begins, "hyphen": F.coalesce(after("glued"), F.lit(False))}).withColumn("paragraph", F.sum(F.col("new").cast("int")).over(page))
    # the first words of a paragraph that a gap begins count for the one before
    moved = F.col("new") & ~F.col("first") & ~F.col("behind")
    counts = {"fonts": (F.sum, "font_total"), "words": (F.sum, "n_words"), "bold": (F.max, "is_bold")}
    own = [f(F.when(~moved, F.col(c))).alias(name) for name, (f, c) in counts.items()] + [f(F.when(moved, F.col(c))).alias(f"{name}_before") for name, (f, c) in counts.items()]
    piece = F.concat(F.when(F.col("glued"), "").otherwise("\n"), F.when(F.col("hyphen"), F.left("text", F.length("text") - 1)).otherwise(F.col("text")))
    held = rows.groupBy("page_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("n", piece.alias("text")))).alias("l"), F.min_by("begins", "n").alias("begins"), F.first("page_height").alias("height"), *own)
    behind = Window.partitionBy("page_id").orderBy("paragraph")
    given_back = lambda name, none: F.coalesce(F.lead(f"{name}_before").over(behind), none)
    held = held.withColumns({"fonts": F.coalesce("fonts", F.lit(0.0)) + given_back("fonts", F.lit(0.0)), "words": F.coalesce("words", F.lit(0)) + given_back("words", F.lit(0)), "bold": F.coalesce("bold", F.lit(False)) | given_back("bold", F.lit(False))})
    blank = " \t\n\r\f\x0b"
    text = F.trim(F.array_join(F.transform("l", lambda x: x["text"]), ""), F.lit(blank))
    down = F.when(F.col("height") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("begins") / F.col("height")))).otherwise(0.0)
    out = held.select("page_id", "paragraph", text.alias("text"), down.alias("top_fraction"), F.when(F.col("words") > 0, F.col("fonts") / F.col("words")).otherwise(0.0).alias("font_size"), F.col("bold").alias("is_bold"))
    return out.where(F.col("text") != "")


def extract_blocks(words: DataFrame) -> DataFrame:
    """book_id, seq, page, logical_page, text, top_fraction, font_size, is_bold: the blocks of books in reading order, from the words of their pages.

    words: book_id, page, page_width, page_height, left, right, top, bottom (both from the page's lower edge), text, is_bold. Wide
    pages are cut in two at their middle (see page_columns), words grouped to lines and lines to paragraphs, each on its own half
    of a page. seq orders a book's blocks by page, half and paragraph.
    """
    halves = page_columns(words.withColumn("page_id", F.col("page").cast("long")))
    half = F.struct("book_id", F.col("page").cast("int").alias("page"), "logical_page", F.col("page_height").cast("double").alias("page_height"))
    lines = group_lines(halves.withColumn("page_id", half)).withColumn("page_height", F.col("page_id.page_height"))
    blocks = paragraphs(lines.withColumnRenamed("line", "n")).select("page_id.*", "paragraph", "text", "top_fraction", "font_size", "is_bold")
    right = (F.col("logical_page") == F.col("page") * 2).cast("int")
    seq = (F.col("page").cast("long") * 2 + right) * 100_000 + F.col("paragraph")
    return blocks.select("book_id", seq.alias("seq"), "page", "logical_page", "text", "top_fraction", "font_size", "is_bold")


def is_double_page(pages: DataFrame) -> DataFrame:
    """book_id, is_double: by the votes of pages 6 to 8 (book_id, page, width, height), of which half or one at least must be more than 1.15 times as wide as high."""
    votes = pages.groupBy("book_id").agg(F.count_if(F.col("page").between(6, 8)).alias("n"), F.count_if(F.col("page").between(6, 8) & (F.col("width") > F.col("height") * 1.15)).alias("wide"))
    return votes.select("book_id", ((F.col("n") > 0) & (F.col("wide") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)))).alias("is_double"))


def ink_runs(bands: DataFrame, least: float, max_gap: int) -> DataFrame:
    """page_id, first, last: runs of bands (page_id, band, density) with ink, joined over gaps of at most max_gap bands without."""
    inked = bands.where(F.col("density") >= least)
    order = Window.partitionBy("page_id").orderBy("band")
    new = F.when(F.col("band") - F.lag("band").over(order) <= max_gap + 1, 0).otherwise(1)
    runs = inked.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    top = bands.groupBy("page_id").agg(F.max("band").alias("top"))
    out = runs.groupBy("page_id", "run").agg(F.min("band").alias("first"), F.max("band").alias("last")).join(top, "page_id")
    return out.select("page_id", "first", F.least(F.col("last") + max_gap, F.col("top")).alias("last"))


def ink_regions(pages: DataFrame, dark: int = 100, band: int = 8, least: float = 0.15, run: int = 96) -> DataFrame:
    """page_id, left, top, width, height: regions of art on pages (page_id, width, height, pixels: one byte of luminance each)."""
    import numpy as np

    def detect(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                mask = np.frombuffer(r.pixels, dtype=np.uint8).reshape(r.height, r.width) < dark
                rows += [(r.page_id, *box) for box in regions(mask, band, least, run)]
            yield pd.DataFrame(rows, columns=["page_id", "left", "top", "width", "height"])

    return pages.mapInPandas(detect, "page_id long, left int, top int, width int, height int")


def blocks(mask, band: int = 8, least: float = 0.15, run: int = 96) -> list[tuple[int, int, int, int]]:
    """left, top, width, height of gap-free rows of bands with strong ink at least ``run`` pixels high, between their columns with ink. A reduced rule: see regions."""
    import numpy as np

    n = mask.shape[0] // band
    density = mask[: n * band].reshape(n, -1).mean(axis=1) if n else np.zeros(0)
    on = np.r_[False, density >= least, False]
    starts, ends = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if (b - a) * band < run:
            continue
        columns = np.flatnonzero(mask[a * band : b * band].mean(axis=0) >= 0.05)
        if len(columns):
            out.append((int(columns[0]), a * band, int(columns[-1] - columns[0] + 1), (b - a) * band))
    return apart(out)


def apart(out: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The boxes of which no more than half is in a larger one, from top to bottom."""
    kept: list[tuple[int, int, int, int]] = []
    for x in sorted(out, key=lambda r: -r[2] * r[3]):
        cross = lambda k, x=x: max(0, min(x[0] + x[2], k[0] + k[2]) - max(x[0], k[0])) * max(0, min(x[1] + x[3], k[1] + k[3]) - max(x[1], k[1]))
        if not any(cross(k) > 0.5 * x[2] * x[3] for k in kept):
            kept.append(x)
    return sorted(kept, key=lambda r: r[1])


#: Share of ink of a dense band, and of a row and a column (in whole percent) that a region grows over; light ones passed while it grows; its margin.
DENSE, ROW, PERCENT, LIGHT, MARGIN = 0.08, 0.03, 1, 3, 6


def regions(mask, band: int = 8, least: float = 0.15, run: int = 96) -> list[tuple[int, int, int, int]]:
    """left, top, width, height of art: runs of dense bands at least ``run`` pixels high with a band of ``least``.

    A page without such a run free of gaps has none. On others the runs may have gaps of one band; each grows up, down and
    sideways over light ink and gets a margin. Every second row and column is looked at.
    """
    import numpy as np

    height, width = mask.shape
    n = height // band
    if not n or not width:
        return []
    density = mask[: n * band].reshape(n, band, width)[:, ::2, ::2].mean(axis=(1, 2))

    def runs(gap: int) -> list[tuple[int, int]]:
        out, i = [], 0
        while i < n:
            if density[i] < DENSE:
                i += 1
                continue
            a, b, light = i, i, 0
            while b + 1 < n and (density[b + 1] >= DENSE or light < gap):
                light = 0 if density[b + 1] >= DENSE else light + 1
                b += 1
            i = b + 1
            if (b - a + 1) * band >= run and density[a : b + 1].max() >= least:
                out.append((a * band, (b + 1) * band))
        return out

    def grown(at: int, step: int, inside, inked) -> int:
        light = 0
        while inside(at):
            light = 0 if inked(at) else light + 1
            at += step
            if light > LIGHT:
                break
        return at

    out = []
    for top, bottom in runs(1) if runs(0) else []:
        columns = np.flatnonzero(mask[top:bottom:2].mean(axis=0) >= 0.05)
        if not len(columns):
            continue
        left, right = int(columns[0]), min(width - 1, int(columns[-1]) + 1)
        row = lambda y, left=left, right=right: mask[y, left : right + 1 : 2].mean() >= ROW
        top = grown(top, -band, lambda y: y >= band, lambda y, row=row: row(y - band))
        bottom = grown(bottom, band, lambda y: y + band <= height, row)
        share = mask[top:bottom:2].sum(axis=0) * 100 // len(range(top, bottom, 2)) >= PERCENT
        left = grown(left, -2, lambda x: x >= 2, lambda x, share=share: share[x - 2])
        right = grown(right, 2, lambda x: x + 2 < width, lambda x, share=share: share[x + 2])
        x, y = max(0, left - MARGIN), max(0, top - MARGIN)
        out.append((x, y, min(width - x, right - left + 1 + 2 * MARGIN), min(height - y, bottom - top + 2 * MARGIN)))
    return apart(out)


def art_crops(pages: DataFrame, dark: int = 100, band: int = 8, least: float = 0.15, run: int = 96, find=regions) -> DataFrame:
    """page_id, name, left, top, width, height, png: the regions of art of each page as grey PNG images, the first named p{page}.png, others p{page}_{i}.png."""
    import struct
    import zlib

    import numpy as np

    def png(pixels) -> bytes:
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        rows = np.concatenate([np.zeros((pixels.shape[0], 1), np.uint8), pixels], axis=1)
        head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")

    def cut(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                page = np.frombuffer(r.pixels, dtype=np.uint8).reshape(r.height, r.width)
                boxes = find(page < dark, band, least, run)
                for i, (x, y, w, h) in enumerate(boxes):
                    name = f"p{r.page_id}_{i}.png" if i else f"p{r.page_id}.png"
                    rows.append((r.page_id, name, x, y, w, h, png(page[y : y + h, x : x + w])))
            yield pd.DataFrame(rows, columns=["page_id", "name", "left", "top", "width", "height", "png"])

    return pages.mapInPandas(cut, "page_id long, name string, left int, top int, width int, height int, png binary")
