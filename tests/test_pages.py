"""Pages, images, transcripts, stores that are written again, and settings as data: small cases and plain walks."""

import json
import os
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import lore
from foliant.operators import graph, layout, players, segment
from foliant.sources import corpus, images, sinks, transcripts

WORD = "page_id long, page_width int, page_height int, left double, right double, text string"


def test_columns_of_wide_pages(spark):
    words = [(3, 200, 100, 0.0, 99.0, "a"), (3, 200, 100, 95.0, 105.0, "across"), (3, 200, 100, 100.0, 200.0, "b"), (3, 200, 100, 150.0, 201.0, "beyond"), (3, 200, 100, -1.0, 5.0, "before"), (4, 114, 100, 50.0, 60.0, "narrow"), (5, 200, 100, 10.0, 90.0, "l"), (5, 200, 100, 112.0, 118.0, "r"), (5, 200, 100, 85.0, 96.0, "m")]
    df = spark.createDataFrame(words, WORD)
    got = {r.text: r.logical_page for r in layout.page_columns(df).collect()}
    assert got == {"a": 5, "b": 6, "narrow": 4, "l": 9, "r": 10, "m": 9}
    # the gutter of page 5 is between 96 and 112; page 3 has a word across all gaps, so it keeps its middle
    assert [tuple(r) for r in layout.gutters(df.where("page_id = 5")).collect()] == [(5, 104.0)]
    off = df.where("page_id = 5").withColumns({"left": F.col("left") + 15, "right": F.col("right") + 15})
    assert {r.text: r.logical_page for r in layout.page_columns(off).collect()} == {"m": 10, "r": 10}
    assert {r.text: r.logical_page for r in layout.page_columns(off, by_gap=True).collect()} == {"l": 9, "m": 9, "r": 10}


def test_lines_are_numbered_by_side(spark):
    lines = [(1, 100, 100, 0, 50, 1, "m2"), (1, 100, 100, 60, 10, 2, "m1"), (2, 210, 100, 120, 5, 1, "r1"), (2, 210, 100, 10, 90, 2, "l2"), (2, 210, 100, 12, 5, 3, "l1"), (2, 210, 100, 10, 7, 4, "  ")]
    df = spark.createDataFrame(lines, "page_id long, page_width int, page_height int, left int, top int, seq int, text string")
    got = [(r.page_id, r.n, r.side, r.text) for r in layout.number_lines(df).orderBy("page_id", "n").collect()]
    assert got == [(1, 0, "M", "m1"), (1, 1, "M", "m2"), (2, 0, "L", "l1"), (2, 1, "L", "l2"), (2, 2, "R", "r1")]
    rng = np.random.default_rng(2)
    starts = [(1, int(x)) for x in [*rng.integers(10, 40, 20), *rng.integers(90, 130, 9)]]
    split = layout.column_centres(spark.createDataFrame(starts, "page_id long, left int")).collect()[0].split
    xs = sorted(x for _, x in starts)
    spread = lambda c: sum((x - np.mean(p)) ** 2 for p in (xs[:c], xs[c:]) for x in p)
    best = min(range(1, len(xs)), key=spread)
    assert split == (xs[best - 1] + xs[best]) / 2
    assert layout.column_centres(spark.createDataFrame([(1, 5), (1, 5)], "page_id long, left int")).count() == 0


def plain_paragraphs(lines, height):
    """The rules of paragraphs as a walk over a page's lines."""
    mean = sum(x["top"] - x["bottom"] for x in lines) / len(lines)
    out, text, top, fonts, words, bold = [], "", lines[0]["top"], 0.0, 0, False

    def flush():
        nonlocal text, fonts, words, bold
        if text.strip():
            out.append((text.strip(), min(1, max(0, 1 - top / height)), fonts / words if words else 0.0, bold))
            text, fonts, words, bold = "", 0.0, 0, False

    for i, x in enumerate(lines):
        fonts, words, bold = fonts + x["font_total"], words + x["n_words"], bold or x["is_bold"]
        if re.fullmatch(r"\W*\d{1,4}\W*", x["text"].strip()):
            flush()
            top, text = x["top"], x["text"]
            flush()
        elif i and text.endswith("-"):
            text = text[:-1] + x["text"]
        elif i and lines[i - 1]["bottom"] - x["top"] > mean * 1.4:
            flush()
            top, text = x["top"], text + x["text"]
        elif i:
            text += "\n" + x["text"]
        else:
            text = x["text"]
    flush()
    return out


def test_paragraphs_against_a_walk(spark):
    rng = np.random.default_rng(8)
    said = ["a broken-", "217", "pages 12 - 14", "well- known", "plain", "- 7 -", "more-", "(12)"]
    pages = {}
    for page in range(60):
        top, rows = 950.0, []
        for n in range(int(rng.integers(1, 12))):
            size = float(rng.integers(8, 13))
            rows.append({"page_id": page, "n": n, "top": top, "bottom": top - size, "text": said[int(rng.integers(len(said)))], "font_total": float(rng.integers(5, 40)), "n_words": int(rng.integers(1, 4)), "is_bold": bool(rng.random() < 0.2), "page_height": 1000.0})
            top -= size + float(rng.choice([2, 2, 5, 25]))
        pages[page] = rows
    df = spark.createDataFrame([tuple(r.values()) for p in pages.values() for r in p], "page_id long, n int, top double, bottom double, text string, font_total double, n_words int, is_bold boolean, page_height double")
    got = {}
    for r in layout.paragraphs(df).orderBy("page_id", "paragraph").collect():
        got.setdefault(r.page_id, []).append((r.text, r.top_fraction, r.font_size, r.is_bold))
    for page, rows in pages.items():
        want = plain_paragraphs(rows, 1000.0)
        assert [g[0] for g in got[page]] == [w[0] for w in want]
        assert [g[3] for g in got[page]] == [w[3] for w in want]
        assert np.allclose([g[1:3] for g in got[page]], [w[1:3] for w in want])


def test_crops_of_two_regions(spark):
    page = np.full((800, 600), 255, np.uint8)
    page[50:300, 60:540] = 0
    page[450:700, 60:540] = 0
    got = layout.art_crops(spark.createDataFrame([(4, 600, 800, bytearray(page.tobytes()))], "page_id long, width int, height int, pixels binary")).collect()
    assert sorted((r.name, r.top < 400) for r in got) == [("p4.png", True), ("p4_1.png", False)]


def png(width, height):
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"\0" * 10)) + chunk(b"IEND", b"")


def jpeg(width, height, notes=0):
    segment_ = lambda kind, data: b"\xff" + bytes([kind]) + struct.pack(">H", len(data) + 2) + data
    return b"\xff\xd8" + segment_(0xE0, b"JFIF\0") + b"".join(segment_(0xFE, b"\xff\xc0" * 30_000) for _ in range(notes)) + b"\xff" + segment_(0xC4, b"\0" * 20) + segment_(0xC2, struct.pack(">BHHB", 8, height, width, 3) + b"\0" * 9) + b"\xff\xda"


def test_images_of_files(spark, tmp_path):
    files = {"one/p3_i0.png": png(401, 60), "one/p3_i1.jpg": jpeg(500, 300), "one/p2_i0.png": png(400, 300), "one/p2_i1.png": png(900, 49), "one/p1_i7.jpg": jpeg(450, 99, notes=3), "two/p20_i0.png": png(800, 800), "two/p5_i0.png": b"no image", "two/p6_i0.jpg": b"\xff\xd8\xff", "two/p7_i0.png": b"", "two/cover.png": png(999, 999)}
    for name, data in files.items():
        path = tmp_path / "art" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    found = images.scan_images(spark, str(tmp_path / "art")).cache()
    assert sorted((r.book, r.page, r.i, r.width, r.height) for r in found.collect()) == [("one", 1, 7, 450, 99), ("one", 2, 0, 400, 300), ("one", 3, 0, 401, 60), ("one", 3, 1, 500, 300), ("two", 20, 0, 800, 800)]
    maps = images.book_maps(found).collect()
    assert [(r.book, r.map.rsplit("/", 1)[1]) for r in maps] == [("one", "p1_i7.jpg")]
    kinds = spark.createDataFrame([(10, 10, 850, 1000), (99, 500, 849, 1000), (100, 100, 100, 100)], "w int, h int, bw int, bh int").select(images.image_kind(F.col("w"), F.col("h"), F.col("bw"), F.col("bh"), F.lit(1000), F.lit(1000)).alias("k")).collect()
    assert [r.k for r in kinds] == ["scan", None, "embedded"]


def test_thousand_transcripts(spark, tmp_path):
    """Dump and scan are inverse; broken files are kept apart; pages are in order of their numbers."""
    path = str(tmp_path / "dump")
    every = [(b, p, n, "LMR"[n % 3], n / 7, f"Zeile {n} „é“\n\t\"") for b in (1, 2) for p in range(1, 501) for n in range(p % 4)]
    rows = spark.createDataFrame(every, "book_id long, page int, n int, side string, top double, text string")
    transcripts.dump(rows, path)
    assert sum(f.endswith(".json") and f.startswith("Page") for _, _, names in os.walk(path) for f in names) == len({r[:2] for r in every})
    back = transcripts.read_transcripts(spark, path, 50)
    assert sorted(map(tuple, back.drop("file", "broken").collect())) == sorted(every)
    assert transcripts.TranscriptReader({"path": path}).partitions()[1].names[0].endswith("1/pages/Page002.json")
    order = [p.names[0] for p in transcripts.TranscriptReader({"path": path}).partitions()]
    assert [int(re.search(r"Page(\d+)", n)[1]) for n in order if "/1/" in n] == sorted({r[1] for r in every if r[0] == 1})
    index = json.loads((tmp_path / "dump/2/index.json").read_text())
    assert index[0] == {"page": 1, "lines": 1, "file": "pages/Page001.json"} and len(index) == 375
    assert (tmp_path / "dump/1/pages/Page002.txt").read_text().startswith("PAGE 2  (2 lines)\n  0 L  0.000  Zeile 0")
    for k, text in enumerate(["no json", "{}", '{"page": 1, "lines": [{"n": 1}]}', "[]"]):
        (tmp_path / f"dump/2/pages/Page{900 + k}.json").write_text(text)
    again = transcripts.read_transcripts(spark, path, 50)
    assert sorted((r.page, r.broken) for r in again.where("broken IS NOT NULL").collect())[0] == (900, "no json") and again.where("broken IS NOT NULL").count() == 4
    assert again.where("broken IS NULL").count() == len(every)
    # a page written again is replaced; with overwrite a book's other pages go, other books stay
    transcripts.dump(spark.createDataFrame([(1, 2, 0, "M", 0.5, "new")], rows.schema), path)
    assert [r.text for r in transcripts.read_transcripts(spark, path, 99).where("book_id = 1 AND page = 2").collect()] == ["new"]
    transcripts.dump(spark.createDataFrame([(1, 3, 0, "M", 0.5, "only")], rows.schema), path, overwrite=True)
    left = transcripts.read_transcripts(spark, path, 99).where("broken IS NULL")
    assert [r.text for r in left.where("book_id = 1").collect()] == ["only"] and left.where("book_id = 2").count() == sum(r[0] == 2 for r in every)


def names(spark, path):
    return sorted((r.name, r.body) for r in sinks.read_cleaned(spark, path).collect())


def test_cleaned_books_again(spark, tmp_path):
    path = str(tmp_path / "cleaned")
    books = lambda *rows: spark.createDataFrame(rows, "title string, body string")
    first = books(("Cave", "1"), ("Cave (deep)", "2"), ("Sea", "3"), ("seas", "4"), (None, "0"))
    sinks.write_cleaned(first, path, [])
    whole = [("Cave", "1"), ("Cave (deep)", "2"), ("Sea", "3"), ("seas", "4")]
    assert names(spark, path) == whole
    sinks.write_cleaned(first, path, [])  # a rerun
    assert names(spark, path) == whole
    before = {f: os.stat(f).st_mtime_ns for f in (os.path.join(d, x) for d, _, n in os.walk(path) for x in n if x.endswith(".parquet"))}
    sinks.write_cleaned(books(("SEA", "5")), path, ["cave"])  # a partial one, in other letters
    assert names(spark, path) == [("Cave", "1"), ("Cave (deep)", "2"), ("SEA", "5"), ("seas", "4")]
    assert sum(os.path.exists(f) for f in before) >= len(before) - 1
    for k in (1, 2):  # a protected title gets further names
        sinks.write_cleaned(books(("Cave", f"new {k}")), path, ["CAVE"])
    assert names(spark, path) == [("Cave", "1"), ("Cave (1)", "new 1"), ("Cave (2)", "new 2"), ("Cave (deep)", "2"), ("SEA", "5"), ("seas", "4")]
    sinks.write_cleaned(books(("cave", "last"), ("cave", "less")), path, [])  # takes all that begin with "cave ("; of one title one is written
    assert names(spark, path) == [("SEA", "5"), ("cave", "less"), ("seas", "4")]


def test_names_fill_the_first_gap(spark):
    stored = spark.createDataFrame([("A",), ("A (2)",), ("A (03)",), ("B (1)",), ("C",), ("C (1)",), ("C (1) (1)",), ("D\nE",)], "name string")
    titles = spark.createDataFrame([("A",), ("B",), ("C",), ("C (1)",), ("new",), ("D\nE",)], "title string")
    assert {r.title: r["name"] for r in sinks.unique_names(titles, stored).collect()} == {"A": "A (1)", "B": "B", "C": "C (2)", "C (1)": "C (1) (2)", "new": "new", "D\nE": "D\nE (1)"}


def test_versions_switch_whole(spark, tmp_path):
    path = str(tmp_path / "v")
    assert sinks.current(spark, path) is None
    first = sinks.publish(spark.range(3), path)
    held = sinks.read_current(spark, path)
    with pytest.raises(Exception, match="(?i)divi"):
        sinks.publish(spark.range(3).select(F.expr("id / (id - 1)")), path)  # fails while it writes: the version before stays
    assert sinks.current(spark, path) == first
    second = sinks.publish(spark.range(5), path)
    assert sinks.read_current(spark, path).count() == 5 and held.count() == 3
    third = sinks.publish(spark.range(7), path)
    sinks.prune_versions(spark, path)
    assert sorted(f for f in os.listdir(path) if f.startswith("v-")) == sorted([second, third]) and sinks.read_current(spark, path).count() == 7


def test_lookup_reads_one_bucket(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(400).select((F.col("id") / 8).cast("long").alias("book_id"), (F.col("id") % 8 + 1).cast("int").alias("section_number"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"))
    sinks.write_sections(rows, path, 16)
    found = sinks.lookup_section(spark, path, 33, 5, 16)
    assert [r.content for r in found.collect()] == ["text 268"]
    plan = found._jdf.queryExecution().executedPlan()
    stack, files = [plan], 0
    while stack:
        node = stack.pop()
        if "Scan" in node.nodeName():
            files += node.metrics().get("numFiles").get().value()
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            stack.append(node.plan())
    assert files == 1
    assert sinks.lookup_section(spark, path, 33, 9, 16).count() == 0 and sinks.lookup_section(spark, path, 999, 1, 16).count() == 0


def test_catalog_keeps_the_earliest(spark):
    rows = [(1, 9, "Skull of Salt", "artifact", "legendary"), (1, 10, "skull of SALT", "artifact", "legendary"), (1, 2, "Skull of Salt", "artifact", "common"), (1, 4, "Rope", "artifact", "common"), (1, 3, "ROPE", "artifact", "common"), (2, 8, "Rope", "artifact", "common")]
    got = lore.catalog(spark.createDataFrame(rows, "book_id long, section_number int, name string, type string, rarity string"))
    assert sorted(map(tuple, got.collect())) == [(1, "ROPE", "artifact", "common", 3), (1, "Skull of Salt", "artifact", "legendary", 9), (2, "Rope", "artifact", "common", 8)]


def test_depth_of_a_book_without_entry(spark):
    rows = [(1, 2, "turn to 3", 3), (1, 3, "", 3), (2, 1, "turn to 2 or turn to 9", 2), (2, 2, "turn to 1", 2), (3, 1, "", 1)]
    s = spark.createDataFrame(rows, "book_id long, section_number int, content string, n_sections int")
    assert sorted(map(tuple, graph.max_depth(s).collect())) == [(1, 0), (2, 1), (3, 0)]
    chain = spark.range(1, 301).select(F.lit(1).cast("long").alias("book_id"), F.col("id").cast("int").alias("section_number"), F.concat(F.lit("turn to "), (F.col("id") + 1).cast("string")).alias("content"), F.lit(300).alias("n_sections"))
    assert graph.depths(chain).agg(F.max("depth"), F.count("depth")).collect()[0][:] == (299, 300)


def test_fights_end(spark):
    """Every fight is fought out: won, lost, or shown never to end."""
    foe = "array<struct<skill: int, stamina: int, special: boolean>>"
    rows = [(i, a, 400, 9, [(b, 300, i % 2 == 0), (b, 2, False)]) for i in range(12) for a in (6, 8) for b in (6, 7, 9)] + [(50, 8, 9, 9, []), (51, 8, 9, 9, None), (52, 8, 0, 9, [(1, 1, False)])]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    got = {r.id: r for r in players.fights(spark.createDataFrame(rows, f"id long, skill int, stamina int, luck int, foes {foe}")).collect()}
    for i, skill, stamina, luck, foes in rows:
        at, wounds, n, still = 0, 0, 0, 0
        while stamina > 0 and at < len(foes or []) and still < 6:
            die = lambda k: (i * 31 + n * 17 + k * 7) % 6 + 1  # noqa: E731, B023
            own, other, before = die(0) + die(1) + skill, die(2) + die(3) + foes[at][0], (skill, stamina, luck, at, wounds)
            if own < other and foes[at][2] and die(4) > 2:
                skill, luck = (max(0, skill - 1), luck) if die(4) <= 4 else (skill, max(0, luck - 1))
            elif own < other:
                stamina = max(0, stamina - 2)
            elif own > other:
                wounds += 2
            if wounds >= foes[at][1]:
                at, wounds = at + 1, 0
            still = still + 1 if before == (skill, stamina, luck, at, wounds) else 0
            n += 1
        outcome = "lost" if stamina <= 0 else "won" if at >= len(foes or []) else "endless"
        assert (got[i].outcome, got[i].skill, got[i].stamina, got[i].luck, got[i].slain) == (outcome, skill, stamina, luck, at)
        assert outcome == "endless" or got[i].rounds == n
    assert max(r.rounds for r in got.values() if r.outcome != "endless") > 60


def test_corpus_follows_its_tables(spark, tmp_path):
    d = str(tmp_path / "tables")
    for name in ("orders", "lineitem", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    before = corpus.sections(spark, d).count()
    assert corpus._once(spark, d, "sections", lambda: 1 / 0).count() == before  # made once
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{d}/orders.parquet")
    assert 0 < corpus.sections(spark, d).count() < before


def test_settings_of_books(spark):
    blocks = [(b, i, 1, t, 10.0, False) for b in (1, 2, 3) for i, t in enumerate(["1", "one", "4", "four", "9", "nine"])]
    df = spark.createDataFrame(blocks, "book_id long, seq long, page int, text string, font_size double, is_bold boolean")
    own = spark.createDataFrame([(1, 3, None, None), (2, None, 1, None)], "book_id long, most int, ahead int, larger double")
    got = {}
    for r in segment.header_fold(df, settings=own).collect():
        got.setdefault(r.book_id, []).append(r.section_number)
    assert {b: sorted(n) for b, n in got.items()} == {1: [1], 2: [1, 4, 9], 3: [1, 4, 9]}
    patched = spark.createDataFrame([(1, "a b", 5)], "k long, t string, n int").select(segment.patched_content(F.col("t"), F.col("n"), F.from_json(F.lit('[{"section_number": 5, "find": "a", "put": "x"}, {"find": "x b", "put": "y"}, {"section_number": 6, "put": "never"}]'), "array<struct<section_number: int, find: string, put: string>>")).alias("t")).collect()
    assert patched[0].t == "y"
    numbers = spark.createDataFrame([("7", 0.95), ("7", 0.9), ("text", 0.99), ("500", 0.99)], "text string, top_fraction double")
    assert sorted(map(tuple, segment.page_number_filter(numbers).collect())) == [("500", 0.99), ("7", 0.9), ("text", 0.99)]
    titles = spark.createDataFrame([("The CAVE",), ("Sea",), (None,)], "t string").select(players.excluded(F.col("t"), ["cave", "x"]).alias("e")).collect()
    assert [r.e for r in titles] == [True, False, False]


def test_restored_text_is_split_again(spark):
    a, b = "The corridor leads on past a rusty gate and more.", "Behind the door you hear a quiet voice that sings."
    rows = [(1, 1, "Short.", None), (1, 3, f"{a}\n{b}\n2\n{a}\n{b}", f"{b}\n{a}\n4\n{b}\n{b}"), (1, 5, f"{b}\n{a}\n4.\n{b}\n{b}", None)]
    df = spark.createDataFrame(rows, "book_id long, section_number int, content string, discarded string")
    got = {r.section_number: r.content for r in segment.rebalance_shifted(segment.with_junk(df)).collect()}
    assert got[1] == f"{a}\n\n{b}" and got[2] == f"{a}\n\n{b}" and got[3] == f"{b}\n\n{a}" and got[4] == f"{b}\n\n{b}" and got[5] == segment.MISSING


def test_orphans_of_all_books_by_a_plain_walk(spark):
    from foliant.plans import QUERIES

    d = "/root/testdata/sf0.001"
    every = corpus.sections(spark, d).collect()
    lines = sorted({x for r in every for x in r.content.split("\n")})
    ends = {r.t for r in spark.createDataFrame([(x,) for x in lines], "t string").where(lore.is_terminator(F.col("t"))).collect()}
    fits = lambda p: 60 <= len("\n\n".join(p)) <= 1200 and 2 <= len(p) <= 24 and p[0][:1].isupper()
    books = {}
    for r in every:
        books.setdefault(r.book_id, {})[r.section_number] = r.content
    want = {}
    for book, true in books.items():
        text = {n: c.split("\n") for n, c in true.items() if c != segment.MISSING and n % 3 != 2}
        for n, c in true.items():
            before = true.get(n - 1, segment.MISSING)
            if n % 3 == 2 and c != segment.MISSING and n - 1 in true:
                mark = [[f"{str(n)[0]}o"], [f"{n}-{n + 2}"], []][book % 3]
                text[n - 1] = [*before.split("\n"), *mark, *c.split("\n")]
        joined = {n: "\n".join(x) for n, x in text.items()}
        for n in range(1, max(true)):
            if n not in joined or n + 1 in joined or joined[n] == segment.MISSING or len(text[n]) < 3:
                continue
            parts = [x.strip() for x in text[n]]
            garbled = [i for i, x in enumerate(parts) if re.fullmatch(r"\d[0-9A-Za-z]?", x)]
            folio = [i for i, x in enumerate(parts) if re.fullmatch(rf"{n + 1}-\d+", x)]
            stop = [i for i, x in enumerate(parts) if x in ends]
            cuts = [(x[-1], x[-1] + 1) for x in (garbled, folio) if x]
            cuts += [(stop[-1] + 1,) * 2] if stop and stop[-1] < len(parts) - 1 else [(stop[-2] + 1,) * 2] if len(stop) > 1 else []
            for i, j in cuts:
                if parts[:i] and parts[j:] and fits(parts[j:]):
                    text[n], text[n + 1] = parts[:i], parts[j:]
                    joined[n], joined[n + 1] = ("\n\n".join(x) for x in (parts[:i], parts[j:]))
                    break
        want |= {(book, n): c for n, c in joined.items()}
    got = {(r.book_id, r.section_number): r.content for r in QUERIES["orphan_sections"](spark, d).collect()}
    differ = [k for k in want.keys() | got.keys() if want.get(k) != got.get(k)]
    assert not differ, (len(differ), len(want), differ[:3], want.get(differ[0]), got.get(differ[0]))


def test_books_parsed_whole(spark):
    a, b = "The room is dark and the way goes on and on without an end.", "You hear a quiet voice that sings behind the door."
    text = [("THE BOOK", 0.01), ("1", 0.5), (a, 0.5), ("1", 0.93), ("If you dare, turn to 4.", 0.5), (b, 0.5), (a, 0.5), ("3", 0.5), ("ORC SKILL 5 STAMINA 6", 0.5), ("9", 0.93), ("end", 0.99)]
    blocks = [(7, k, 2 if k < 7 else 5, t, top, 10.0, False) for k, (t, top) in enumerate(text)] + [(8, 0, 1, "1", 0.5, 10.0, False), (8, 1, 1, "alone", 0.5, 10.0, False), (9, 0, 1, "1", 0.5, 10.0, False)]
    df = spark.createDataFrame(blocks, "book_id long, seq long, page int, text string, top_fraction double, font_size double, is_bold boolean")
    own = spark.createDataFrame([(7, "seven", 4, None, None), (8, "eight", 2, None, None)], "book_id long, slug string, most int, ahead int, larger double")
    got = {(r.book_id, r.section_number): tuple(r)[2:] for r in segment.parse_books(df, own).collect()}
    path = "/assets/game-art/seven/p{}_i0.png".format
    assert got == {
        (7, 1): (f"{a}\n\nIf you dare, turn to 4.", path(2), False),
        (7, 2): (f"{b}\n\n{a}", path(2), False),
        (7, 3): ("ORC SKILL 5 STAMINA 6\n\n9", path(5), True),  # no page number of a book of four sections
        (7, 4): (segment.MISSING, None, False),
        (8, 1): ("alone", "/assets/game-art/eight/p1_i0.png", False),
        (8, 2): (segment.MISSING, None, False),
    }


def test_blocks_of_wide_and_narrow_pages(spark):
    words = [(1, 1, 1400, 1000, x, x + 25.0, 900.0 - y, 890.0 - y, t, bold) for x, y, t, bold in [(10.0, 0.0, "7", True), (10.0, 14.0, "left", False), (40.0, 14.0, "half-", False), (10.0, 28.0, "line", False), (710.0, 0.0, "right", False), (690.0, 50.0, "across", False)]]
    words += [(1, 2, 500, 1000, 10.0, 35.0, 500.0, 490.0, "narrow", False)]
    df = spark.createDataFrame(words, "book_id long, page int, page_width int, page_height int, left double, right double, top double, bottom double, text string, is_bold boolean")
    got = [tuple(r) for r in layout.extract_blocks(df).orderBy("seq").select("page", "logical_page", "text", "top_fraction", "is_bold").collect()]
    assert [g[:3] for g in got] == [(1, 1, "7"), (1, 1, "left halfline"), (1, 2, "right"), (2, 2, "narrow")]
    assert np.allclose([g[3] for g in got], [0.1, 0.1, 0.1, 0.5]) and [g[4] for g in got] == [True, False, False, False]
