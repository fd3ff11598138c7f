"""Column functions, folds and layout on small hand-made rows."""

import numpy as np
from pyspark.sql import functions as F

from foliant.functions import lore
from foliant.functions import text as T
from foliant.operators import graph, layout, players, segment


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).collect()[0][0]


def test_references_and_choices(spark):
    assert one(spark, T.references, "Turn to 7. go to the 3, turn to 7 or turn to 12345") == [3, 7]
    assert one(spark, T.choices, "If you dare, turn to 9.\nTurn to 2.") == [("If you dare", 9)]
    assert one(spark, T.clean, "A wall.\nIf you dare, turn to 9.") == "A wall."
    assert one(spark, T.references, "") == []


def test_tail_of_a_sentence_is_no_choice(spark):
    tail = "You follow the winding passage\n\nuntil it ends, then turn to 9."
    assert one(spark, T.choices, tail) == [] and one(spark, T.clean, tail) == "You follow the winding passage until it ends, then"
    assert one(spark, T.choices, tail.replace("\n\n", "\r\n \r\n")) == []
    options = ["You follow the passage.\n\nuntil it ends, then turn to 9.", "You follow the passage\nuntil it ends, then turn to 9.", "You follow the passage\n\nUntil it ends turn to 9.", "You follow the passage\n\nif it ends, turn to 9.", tail + "\nIf not, turn to 8.", tail + " You may turn to 8 or wait.", "\n\nuntil it ends turn to 9."]
    for text in options:
        assert len(one(spark, T.choices, text)) == len(one(spark, lambda t: F.regexp_extract_all(t, F.lit(T.CHOICE_LINE), F.lit(2)), text)), text
    assert one(spark, T.clean, options[0]) == "You follow the passage." and one(spark, T.clean, options[3]) == "You follow the passage"


def test_features(spark):
    assert one(spark, T.log_days, "Add 3 days to your LOG. Lose 1 day from your log.") == 2
    assert one(spark, T.log_days, "nothing") is None
    assert one(spark, T.stat_changes, "close 2 points of luck; lose 2 LUCK") == ["LOSE 2 LUCK"]
    assert one(spark, T.has_combat, "ORC SKILL 5 STAMINA 6") is True
    assert one(spark, T.dice, "3d8") == (3, 8) and one(spark, T.dice, "20") == (1, 20) and one(spark, T.dice, "?") == (2, 6)
    assert one(spark, T.section_number, " (42). ") == 42 and one(spark, T.section_number, "0") is None
    assert one(spark, T.prose, "a long-\nword  b") == "a longword b"
    assert one(spark, T.command, "look at the map and save") == "look"


def test_trim_lines(spark):
    df = spark.createDataFrame([(["", "You may turn to", "14", "zz9", "The long way goes on here.", "12"],)], "l array<string>")
    assert df.select(segment.trim_lines(F.col("l"))).collect()[0][0] == ["You may turn to 14", "The long way goes on here."]


def test_header_fold(spark):
    rows = [(1, i, 1, t, s, False) for i, (t, s) in enumerate([("intro", 10.0), ("1", 10.0), ("first", 10.0), ("250", 10.0), ("2", 10.0), ("second", 10.0), ("2", 10.0), ("again", 10.0)])]
    got = {r[1]: (r[2], r[3]) for r in segment.header_fold(spark.createDataFrame(rows, "book_id long, seq long, page int, text string, font_size double, is_bold boolean")).collect()}
    assert got == {1: ("first\n\n250", None), 2: ("second", "again")}


def test_split_orphans(spark):
    long = "The room is dark and the way goes on and on without an end in sight."
    rows = [(1, 1, f"{long}\nA door.\n2b\n{long}\nAnother door.", 2)]
    got = {r[1]: r[2] for r in segment.split_orphans(spark.createDataFrame(rows, "book_id long, section_number int, content string, n_sections int"), spark.createDataFrame([(1, 2)], "book_id long, n_sections int")).collect()}
    assert got == {1: f"{long}\n\nA door.", 2: f"{long}\n\nAnother door."}


def test_orphans_by_three_signals(spark):
    a, b, turn = "The room is dark and the way goes on and on without an end.", "You hear a quiet voice that sings behind the door.", "If you dare, turn to 30."
    cases = [
        (f"{a}\n8\n{b}\n2o\n12-14\n2.\n{a}\n{b}\n//.:", f"{a}\n8\n{b}", f"{a}\n{b}"),  # the last garbled number; junk goes
        (f"{a}\nab\n2-4\n{b}\n{a}", a, f"{b}\n{a}"),  # a folio
        (f"{a}\n3-4\n{b}\n{a}", None, None),  # a folio of another section
        (f"{a}\n{turn}\n{b}\n{a}", f"{a}\n{turn}", f"{b}\n{a}"),  # the last terminator
        (f"{a}\n{turn}\n{b}\n{turn}", f"{a}\n{turn}", f"{b}\n{turn}"),  # the text ends on one
        (f"{a}\n{b}\n{turn}", None, None),
        (f"{a}\n{turn}\n{b}\n{a}\n7\nshort", f"{a}\n{turn}", f"{b}\n{a}\n7\nshort"),  # what follows the garbled number is implausible
        (f"{a}\n2-3\n{b}\n{a}\n7\nshort", a, f"{b}\n{a}\n7\nshort"),
    ]
    rows = [(i, 1, t) for i, (t, _, _) in enumerate(cases)] + [(50, 1, f"{a}\n{turn}\n{b}\n{a}\n3o\n{b}\n{a}"), (50, 4, a), (51, 2, segment.MISSING), (51, 1, cases[1][0])]
    most = spark.createDataFrame([(i, 2) for i in range(len(cases))] + [(50, 4), (51, 2)], "book_id long, n_sections int")
    got = {r[:2]: r[2] for r in map(tuple, segment.split_orphans(spark.createDataFrame(rows, "book_id long, section_number int, content string"), most).collect())}
    for i, (text, own, orphan) in enumerate(cases):
        apart = lambda x: x.replace("\n", "\n\n")
        assert (got[i, 1], got.get((i, 2))) == ((apart(own), apart(orphan)) if own else (text, None)), i
    assert got[51, 2] == apart(cases[1][2]) and got[50, 4] == a and (50, 2) in got


def test_book_quality(spark):
    """Each check alone makes a book need attention."""
    fine = lambda n: {k: "x" * 400 for k in range(1, n + 1)}
    gap = segment.MISSING
    choice = lambda *to: "\n".join(f"If so, turn to {t}." for t in to) + "\n" + "x" * 300
    books = [
        (fine(400), False), (fine(199), True), ({k: "x" * 400 if k <= 90 else gap for k in range(1, 401)}, True), (fine(400) | {5: choice(401)}, True), (fine(400) | {5: choice(0)}, True),
        (fine(400) | {5: choice(7, 7, 7), 6: choice(7, 7), 7: gap}, False), (fine(400) | {5: choice(7, 7, 7), 6: choice(7, 7, 7), 7: gap}, True),
        ({k: "x" * 299 for k in range(1, 401)}, True), ({k: gap for k in range(1, 401)}, True), (fine(99) | {k: gap for k in range(100, 401)}, True), (fine(100) | {k: gap for k in range(101, 401)}, False),
    ]
    rows = [(i, k, t) for i, (book, _) in enumerate(books) for k, t in book.items()]
    got = {r["book_id"]: r for r in segment.book_quality(spark.createDataFrame(rows, "book_id long, section_number int, content string")).collect()}
    assert [got[i]["needs_attention"] for i in range(len(books))] == [bad for _, bad in books]
    assert tuple(got[8])[1:6] == (0, None, 0, None, 0) and tuple(got[2])[1:5] == (90, 90, 36000, 400)


def test_graph_with_a_cycle(spark):
    rows = [(1, 1, 3, "turn to 2."), (1, 2, 3, "turn to 1. turn to 9."), (1, 3, 3, "end")]
    s = spark.createDataFrame(rows, "book_id long, section_number int, n_sections int, content string")
    assert sorted(tuple(r)[1:] for r in graph.depths(s).collect()) == [(1, 0), (2, 1)]
    assert [tuple(r) for r in graph.orphan_links(s).collect()] == [(1, 2, 9)]
    assert [r[1] for r in graph.dead_ends(s).collect()] == [3]


def test_ink_regions():
    page = np.zeros((800, 600), dtype=bool)
    assert layout.regions(page) == []
    page[100:600, 80:520] = True
    assert len(layout.regions(page)) == 1
    thin = np.zeros((800, 600), dtype=bool)
    thin[::24] = True
    assert layout.regions(thin) == []


def test_whole_drawings_are_found():
    """Lighter bands and a gap of one band are inside a drawing; light strokes around it are taken in, with a margin."""
    page = np.zeros((800, 600), dtype=bool)
    page[200:280, 100:160] = True  # bands of a tenth
    page[280:344, 100:400] = True  # strong ones
    page[352:400, 100:160] = True  # after a gap of one band
    assert layout.blocks(page) == [] and len(layout.regions(page)) == 1
    x, y, w, h = layout.regions(page)[0]
    assert (x, y, w, h) == (100 - 8 - 6, 200 - 32 - 6, 400 + 8 - (100 - 8) + 1 + 12, 408 + 32 - (200 - 32) + 12)  # the run ends on a band without ink
    page[168:200, 100:130] = True  # light strokes above and to the left
    page[200:208, 60:64] = True
    x2, y2, w2, h2 = layout.regions(page)[0]
    assert y2 == 168 - 32 - 6 and y2 + h2 == y + h and x2 == x  # strokes behind over 3 empty steps of columns stay out
    page[200:208, 94:98] = True
    assert layout.regions(page)[0][0] == 94 - 8 - 6
    page[200:280] = False  # too short without the lighter bands
    assert layout.regions(page) == []


def test_lines_and_paragraphs(spark):
    words = [(1, 10.0, 100.0, 90.0, "b"), (1, 0.0, 101.0, 90.5, "a"), (1, 0.0, 80.0, 70.0, "c")]
    got = [tuple(r)[1:] for r in layout.group_lines(spark.createDataFrame(words, "page_id long, left double, top double, bottom double, text string")).orderBy("line").collect()]
    assert [r[:2] for r in got] == [(0, "a b"), (1, "c")] and got[0][2:] == (101.0, 90.0, 20.5, 2, False)
    rows = [(1, 0, 100.0, 90.0, "one hy-"), (1, 1, 88.0, 78.0, "phen"), (1, 2, 50.0, 40.0, "two"), (1, 3, 38.0, 28.0, "12")]
    got = [r[2] for r in layout.paragraphs(spark.createDataFrame(rows, "page_id long, n int, top double, bottom double, text string")).orderBy("paragraph").collect()]
    assert got == ["one hyphen", "two", "12"]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert sorted(map(tuple, players.upsert(old, spark.createDataFrame([(2, "c")], "k long, v string"), ["k"]).collect())) == [(1, "a"), (2, "c")]


def test_foes(spark):
    assert one(spark, lore.foes, "ORC SKILL 5 STAMINA 6\nno") == [("ORC", 5, 6, False, True)]
    box = "GUARDS SKILL STAMINA\nFIRST GUARD SKILL 7 STAMINA 8\nSECOND GUARD 6 5\nThey shout."
    assert [r[0] for r in one(spark, lore.foes, box)] == ["GUARDS", "FIRST GUARD", "SECOND GUARD", "FIRST GUARD"]
    assert [r[0] for r in one(spark, lambda t: lore.foes(t, client=True), box)] == ["FIRST GUARD", "SECOND GUARD", "FIRST GUARD"]
    assert one(spark, lore.foes, "GHOUL\nSKILL 8 STAMINA 7") == [("GHOUL", 8, 7, False, True)]
    assert one(spark, lore.foes, "SKILL 8 STAMINA 7") == [] and one(spark, lore.foes, "") == []
    near = "The beast\nSKILL STAMINA\nwaits for you\nSKILL 8 STAMINA 7"
    assert [tuple(r)[:3] for r in one(spark, lambda t: lore.foes(t, client=True), near)] == [("The Foe", 8, 7), ("waits for you", 8, 7)]


def test_lore(spark):
    assert one(spark, lore.items, "They give you a Magic Potion which enables you to fly.") == [("Magic Potion", "consumable", "common")]
    assert one(spark, lore.items, "If you have the Helmet of Horns, take the Key.") == [("Helmet of Horns", "armour", "legendary"), ("Key", "quest", "common")]
    assert one(spark, lore.items, "You reach the Port of Crabs and the Valley of Willows.") == []
    assert one(spark, lore.spells, "You learn the spell of Flight and taught you FLIGHT.") == [("spell of Flight", "arcane"), ("FLIGHT", "arcane")]
    assert one(spark, lore.combat_note, "He bites. Whenever you\nare hit. Roll one die for it. Go.") == "Roll one die for it."
    assert one(spark, lore.rules, "nothing") == []
    assert one(spark, lore.can_flee, "You may escape by the door") and not one(spark, lore.can_flee, "You may not")
    junk = {"44-48": True, "ab": True, "84 Seated": True, "//.:a": True, "The way goes on.": False, "VAT": False, "You become the hero!": True, "": True}
    for line, is_junk in junk.items():
        assert one(spark, lore.is_junk_line, line) is is_junk, line
    assert one(spark, lore.is_terminator, "If so, turn to 44.") and one(spark, lore.is_garbled_header, " 8o ")
    assert one(spark, T.death, "You have died.") and one(spark, T.victory, "At last, victory is yours!") and not one(spark, T.death, "You have died. Turn to 4.")
    assert not one(spark, T.is_end, "[Text missing or unreadable in PDF]")


def test_rebalance_keeps_healthy_sections(spark):
    a, b = "The corridor leads on past a rusty gate and more.", "Behind the door you hear a quiet voice that sings."
    rows = [(1, 1, f"{a}\n" * 6, None), (1, 3, f"{a}\n{b}\n2\n{a}\n{b}", None), (2, 1, a, None), (2, 3, f"{a}\n{b}\n2.\n{b}\n{a}", f"{b}\n{a}")]
    df = spark.createDataFrame(rows, "book_id long, section_number int, content string, discarded string")
    got = {r[:2]: r[2] for r in map(tuple, segment.rebalance_shifted(segment.with_junk(df)).collect())}
    assert set(got) == {(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)}
    assert got[2, 1] == f"{a}\n\n{b}" and got[2, 2] == f"{b}\n\n{a}" and got[2, 3] == f"{b}\n{a}" and got[1, 1] == rows[0][2]


def test_shifted_books_get_their_own_texts_back(spark):
    """Against what a plain look at the sections says: where both moved texts are plausible they return, else nothing moves."""
    from foliant.plans import QUERIES
    from foliant.sources.corpus import sections

    d = "/root/testdata/sf0.001"
    rows = sections(spark, d).where(F.col("content") != segment.MISSING)
    true = {r[:2]: (r[2].split("\n"), r[3]) for r in map(tuple, segment.with_junk(rows).select("book_id", "section_number", "content", "junk").collect())}
    assert not any(any(junk) for _, junk in true.values())
    fits = lambda x: 60 <= len("\n\n".join(x)) <= 1200 and 2 <= len(x) <= 24
    want = {k: "\n".join(x) for k, (x, _) in true.items()}
    back = 0
    for (b, n), (x, _) in true.items():
        if n % 3 == 1 and (b, n + 1) in true and (b, n + 2) in true:
            y, z = true[b, n + 1][0], true[b, n + 2][0]
            if fits(x) and fits(y) and len(x[0]) < 250:
                want[b, n], want[b, n + 1], back = "\n\n".join(x), "\n\n".join(y), back + 1
                want[b, n + 2] = "\n".join(z) if fits(z) else segment.MISSING
            else:
                want[b, n], want[b, n + 2] = x[0], "\n".join([*x, f"{n + 1}.", *y])
                del want[b, n + 1]
    got = {r[:2]: r[2] for r in map(tuple, QUERIES["shifted_books"](spark, d).collect())}
    assert back > 50 and got == want


def test_crops_are_png(spark):
    import zlib

    page = np.full((200, 40), 255, np.uint8)
    page[16:160, 10:30] = np.arange(20)
    r = layout.art_crops(spark.createDataFrame([(7, 40, 200, bytearray(page.tobytes()))], "page_id long, width int, height int, pixels binary")).collect()[0]
    assert r["name"] == "p7.png" and r["png"][:8] == b"\x89PNG\r\n\x1a\n"
    at = r["png"].index(b"IDAT")
    raw = np.frombuffer(zlib.decompress(r["png"][at + 4 : at + 4 + int.from_bytes(r["png"][at - 4 : at], "big")]), np.uint8).reshape(r["height"], r["width"] + 1)
    assert (raw[:, 0] == 0).all() and (raw[:, 1:] == page[r["top"] : r["top"] + r["height"], r["left"] : r["left"] + r["width"]]).all()


def test_books_as_files(spark, tmp_path):
    import json

    from foliant.sources import files

    (tmp_path / "in").mkdir()
    for name, text in {"a.json": json.dumps({"title": "A", "introduction": "x", "sections": [{"number": 1, "content": "c", "image_path": None}]}), "b.json": "{no book", "a.cleaned.json": "{}", "c.txt": "{}"}.items():
        (tmp_path / "in" / name).write_text(text)
    books = files.read_books(spark, str(tmp_path / "in")).cache()
    assert sorted((r["title"] or "", r["broken"] is None) for r in books.collect()) == [("", False), ("A", True)]
    assert [tuple(r) for r in files.exploded(books).collect()] == [("A", 1, "c", None)]
    files.write_books(books.where("broken IS NULL").select("title"), str(tmp_path / "out"), "one")
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    try:
        files.write_books(books.select("title"), str(tmp_path / "out"), "one")
        raise AssertionError("an earlier version was overwritten")
    except Exception as error:
        assert "exist" in str(error).lower()
    (tmp_path / "m.json").write_text(json.dumps({"entries": [{"n": 1, "page": 2, "side": "L", "line": 3}, {"n": 2, "page": 2, "side": "R", "line": 9, "end": 11}]}))
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [(1, 2, "L", 3, None), (2, 2, "R", 9, 11)]


def test_streams_give_what_batches_give(spark, tmp_path):
    from foliant.streaming import progress

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counts = progress.windowed_counts(stream, late="10000 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    counts.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, progress.windowed_counts(events).collect()))
    first = progress.unlocks(stream, late="10000 days").writeStream.format("memory").queryName("first").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    first.awaitTermination()
    assert spark.table("first").count() == events.select("user_id", "event_type").distinct().count()


def test_double_pages_vote(spark):
    pages = [(1, k, 200, 100) for k in range(1, 6)] + [(1, k, 100, 100) for k in (6, 7, 8)] + [(2, 6, 116, 100), (2, 7, 100, 100), (2, 8, 115, 100)] + [(3, 1, 200, 100)] + [(4, 6, 100, 100)]
    got = layout.is_double_page(spark.createDataFrame(pages, "book_id long, page int, width int, height int"))
    assert dict(got.collect()) == {1: False, 2: True, 3: False, 4: False}


def test_manifest_leaves_out_pictures(spark):
    """Halves without starts count by their wordy lines; an end on the page, an end that isn't there, and a start that isn't."""
    words = "some longer words here"
    lines = [(1, 1, "L", 0, words), (1, 1, "L", 1, "tail of the first one"), (1, 1, "R", 2, "a caption"), (1, 2, "L", 0, words)] + [(1, 3, "L", k, f"{words} {k}") for k in range(5)]
    manifest = [(1, 1, 1, "L", 0, None), (1, 2, 2, "L", 0, None), (1, 3, 9, "L", 0, None), (1, 4, 3, "R", 1, 2), (1, 5, 3, "L", 4, 99)]
    got = segment.apply_manifest(spark.createDataFrame(lines, "book_id long, page int, side string, n int, text string"), spark.createDataFrame(manifest, "book_id long, section_number int, page int, side string, line int, end int"))
    want = {1: f"{words}\ntail of the first one", 2: "\n".join([words, *(f"{words} {k}" for k in range(5))]), 4: f"{words} 1\n{words} 2", 5: f"{words} 4"}
    assert {r["section_number"]: r["content"] for r in got.collect()} == want
