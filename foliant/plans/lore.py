"""Queries over rules, items, spells, foes and art, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import lore
from foliant.functions import text as T
from foliant.operators import layout, players, segment
from foliant.plans import IDS, KEY, query
from foliant.sources.corpus import MISSING, sections, table


@query("""SELECT p_partkey, 'STAMINA' AS stat, '2d6+' || p_size AS formula FROM part UNION ALL SELECT p_partkey, 'CREW STRIKE', '1d6+' || (p_partkey % 7) FROM part
  UNION ALL SELECT p_partkey, 'LOG', '30 days' FROM part UNION ALL SELECT p_partkey, 'BOOTY', p_partkey || ' Gold Pieces' FROM part""", books=False)
def rule_formulas(s, d):
    key = F.col("p_partkey").cast("string")
    intro = F.concat(F.lit("Roll two dice. Add "), F.col("p_size").cast("string"), F.lit(" to the result. Write it down\nas your STAMINA. Roll one die. Add "), (F.col("p_partkey") % 7).cast("string"), F.lit(" to the result. Enter it as CREW STRIKE. Be back within thirty days. You have only "), key, F.lit(" Gold Pieces."))
    return table(s, d, "part").select("p_partkey", F.inline(lore.rules(intro)))


@query(""", X AS (SELECT book_id, section_number, regexp_extract(text, '(?i)if you have the (\\w+ of \\w+ \\w+)', 1) AS name FROM L),
  Y AS (SELECT DISTINCT book_id, section_number, name FROM X WHERE name <> '' UNION SELECT DISTINCT book_id, section_number, array_to_string(string_split(name, ' ')[1:3], ' ') FROM X WHERE name <> '')
  SELECT book_id, section_number, name, 'weapon' AS type, 'legendary' AS rarity FROM Y UNION ALL SELECT DISTINCT book_id, section_number, 'Magic Potion', 'consumable', 'common' FROM L WHERE contains(text, 'You find a Magic Potion')""")
def items_catalog(s, d):
    return sections(s, d).select(*IDS, F.inline(lore.items(T.prose(F.col("content")))))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name, 'arcane' AS type FROM part
  UNION ALL SELECT p_partkey, 'Fire', 'arcane' FROM part""", books=False)
def spells_catalog(s, d):
    said = F.concat(F.lit("The wizards teach you "), F.initcap("p_name"), F.lit(". There is a\nspell of Fire; learn the FIRE. They taught you "), F.col("p_name"), F.lit("."))
    return table(s, d, "part").select("p_partkey", F.inline(lore.spells(T.prose(said))))


@query(r"SELECT book_id, section_number, unnest(list_distinct(regexp_extract_all(content, '(?i)\b(you\s+(?:find|discover|obtain|receive|acquire)\s+(?:a\s+|an\s+|the\s+)?([a-z][a-z ''.-]{2,20}))', 1))[1:3]) AS mention FROM S")
def item_mentions(s, d):
    return sections(s, d).select(*IDS, F.explode(lore.item_mentions(F.col("content"))).alias("mention"))


FOES = r""", X AS (SELECT book_id, section_number, text FROM L WHERE regexp_matches(text, '^[A-Z][A-Z'' -]*\s+SKILL\s+\d+\s+STAMINA\s+\d+'))
  SELECT book_id, section_number, regexp_extract(text, '^(.*?)\s+SKILL', 1) AS name, CAST(regexp_extract(text, 'SKILL\s+(\d+)', 1) AS INT) AS skill,
  CAST(regexp_extract(text, 'STAMINA\s+(\d+)', 1) AS INT) AS stamina"""


@query(f"{FOES}, false AS crew, true AS has_stats FROM X")
def enemies(s, d):
    return sections(s, d).select(*IDS, F.inline(lore.foes(F.col("content"))))


@query(f"{FOES} FROM X")
def client_encounters(s, d):
    return sections(s, d).select(*IDS, F.inline(lore.foes(F.col("content"), client=True))).drop("crew", "has_stats")


@query("""SELECT s_suppkey, unnest(['PIRATES', 'FIRST PIRATE', 'SECOND PIRATE', 'SEA ORC', 'BLACK SHIP']) AS name,
  unnest([0, 8, CAST(s_suppkey % 10 AS INT), 7, 9]) AS skill, unnest([0, 4, 5, 6, CAST(s_suppkey % 20 AS INT)]) AS stamina,
  unnest([false, false, false, false, true]) AS crew, unnest([false, true, true, true, true]) AS has_stats FROM supplier""", books=False)
def enemy_boxes(s, d):
    """Foes in the other forms of print: a box under a named header, stats under a name, crews."""
    k = F.col("s_suppkey")
    said = F.concat(F.lit("PIRATES SKILL STAMINA\nFIRST PIRATE 8 4\nSECOND PIRATE "), (k % 10).cast("string"), F.lit(" 5\nThey fight.\n- SEA ORC\nSKILLS 7 STAMINAS 6\nAt sea:\nBLACK SHIP STRIKE 9 STRENGTH "), (k % 20).cast("string"), F.lit(".\nIf you win, turn to 4."))
    return table(s, d, "supplier").select("s_suppkey", F.inline(lore.foes(said)))


@query(r"SELECT book_id, section_number, regexp_matches(lower(content), 'roll[^.!?]{0,80}(die|dice)') AND contains(lower(content), 'skill') AND contains(lower(content), 'luck') AS special FROM S")
def special_hits(s, d):
    return sections(s, d).select(*IDS, lore.special_hit(F.col("content")).alias("special"))


@query(r"""SELECT doc_id, count(*) FILTER (regexp_matches(trim(t), '^\d[0-9A-Za-z]?$')) AS n_garbled, count(*) FILTER (regexp_matches(trim(t), '(?i)\bturn\s+to\s+\d{1,4}(\s+\w+){0,3}\s*\)?[.!?]?\s*$')) AS n_ends
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) GROUP BY ALL""", books=False)
def line_kinds(s, d):
    rows = table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("t"))
    return rows.groupBy("doc_id").agg(F.count_if(lore.is_garbled_header(F.col("t"))).alias("n_garbled"), F.count_if(lore.is_terminator(F.col("t"))).alias("n_ends"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'weapon' ELSE 'quest' END AS type, CASE WHEN p_partkey % 3 = 1 THEN 'rare' ELSE 'common' END AS rarity FROM part""", books=False)
def asset_items(s, d):
    kind = F.element_at(F.array(F.lit("weapon"), F.lit("Legendary blade"), F.lit("hat")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", lore.asset_type(kind).alias("type"), lore.asset_rarity(kind).alias("rarity"))


@query("""SELECT o_orderkey, o_orderkey % 500 >= 400 OR o_orderkey % 7 = 0 AS complete,
  CASE WHEN o_orderkey % 500 < 400 AND o_orderkey % 7 <> 0 AND o_orderkey % 500 > 1 THEN o_orderkey % 500 ELSE 1 END AS resume FROM orders""", books=False)
def run_resume(s, d):
    runs = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 500).alias("section"), (F.col("o_orderkey") % 7).alias("choices"))
    done = lore.is_complete(F.col("section"), F.col("choices"))
    return runs.select("o_orderkey", done.alias("complete"), lore.resume_at(F.col("section"), done).cast("long").alias("resume"))


@query(f""", C AS (SELECT book_id, 'embedded' AS mode, 0 AS dpi, count(*) FILTER (section_number % 2 = 0 AND content <> '{MISSING}') AS present FROM S GROUP BY ALL
    UNION ALL SELECT book_id, 'flat', 250, count(*) FILTER (section_number % 3 = 0 AND content <> '{MISSING}') FROM S GROUP BY ALL
    UNION ALL SELECT book_id, 'split', 250, count(*) FILTER (section_number % 3 <> 0 AND content <> '{MISSING}') FROM S GROUP BY ALL
    UNION ALL SELECT book_id, 'flat', 300, count(*) FILTER (content <> '{MISSING}') FROM S GROUP BY ALL
    UNION ALL SELECT book_id, 'split', 300, count(*) FILTER (content <> '{MISSING}') FROM S GROUP BY ALL),
  P AS (SELECT book_id, max(present) FILTER (mode = 'embedded') AS e, max(present) FILTER (mode = 'flat' AND dpi = 250) AS f, max(present) FILTER (mode = 'split' AND dpi = 250) AS p FROM C GROUP BY ALL)
  SELECT book_id, mode, dpi, present, CASE dpi WHEN 0 THEN 0 WHEN 250 THEN 1 ELSE 2 END AS pass_id FROM C JOIN P USING (book_id)
  WHERE mode = 'embedded' OR (e < 6 AND dpi = 250 AND mode = CASE WHEN p > f THEN 'split' ELSE 'flat' END) OR (e < 6 AND greatest(p, f) < 6 AND dpi = 300 AND mode = 'flat')""")
def ocr_passes(s, d):
    every = sections(s, d)
    n = F.col("section_number")
    kinds = [("embedded", 0, n % 2 == 0), ("flat", 250, n % 3 == 0), ("split", 250, n % 3 != 0), ("flat", 300, F.lit(True)), ("split", 300, F.lit(True))]
    passes = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(dpi).alias("dpi"), F.when(kept, F.col("content")).otherwise(MISSING).alias("content")) for m, dpi, kept in kinds))
    candidates = every.select(*IDS, F.inline(passes))
    chosen = segment.choose_passes(candidates, primary=250, enough=6)
    return chosen.groupBy("book_id", "mode", "dpi", "pass_id").agg(F.count_if(F.col("content") != MISSING).alias("present"))


STORY = "The corridor leads on past a rusty gate and a row of doors."
MORE = "Behind the last of them you hear a quiet voice that sings."


@query(f"""SELECT book_id, section_number, '{STORY}' || chr(10) || chr(10) || '{MORE}' AS content FROM S WHERE section_number % 3 = 1 AND section_number + 2 <= n_sections
  UNION ALL SELECT book_id, section_number + 1, '{MORE}' || chr(10) || chr(10) || '{STORY}' FROM S WHERE section_number % 3 = 1 AND section_number + 2 <= n_sections
  UNION ALL SELECT book_id, section_number + 2, '{MISSING}' FROM S WHERE section_number % 3 = 1 AND section_number + 2 <= n_sections""")
def shifted_sections(s, d):
    """Every third section holds the texts of the two before it; they are put back."""
    starts = sections(s, d).where("section_number % 3 = 1 AND section_number + 2 <= n_sections")
    number = (F.col("section_number") + 1).cast("string")
    moved = F.concat(F.lit(f"{STORY}\n{MORE}\nx\n"), number, F.lit(f"\n12-14\n{MORE}\n{STORY}\n"))
    rows = starts.select("book_id", F.inline(F.array(F.struct(F.col("section_number"), F.lit("A short text.").alias("content")), F.struct((F.col("section_number") + 2).alias("section_number"), moved.alias("content")))))
    return segment.rebalance_shifted(segment.with_junk(rows.withColumn("discarded", F.lit(None).cast("string"))))


@query()
def shifted_books(s, d):
    """Whole books in which the header of each third section is misread: its own text and that of the one before it stand under the next number, whose text is discarded."""
    n = F.col("section_number")
    every = sections(s, d).where(F.col("content") != segment.MISSING)
    near = lambda k: every.select("book_id", (n - k).alias("section_number"), F.col("content").alias(f"next{k}"))
    three = every.where(n % 3 == 1).join(near(1), IDS).join(near(2), IDS)
    fragment = F.substring_index("content", "\n", 1)
    moved = F.concat("content", F.lit("\n"), (n + 1).cast("string"), F.lit(".\n"), F.col("next1"))
    rows = three.select("book_id", F.inline(F.array(F.struct(n, fragment.alias("content"), F.lit(None).cast("string").alias("discarded")), F.struct((n + 2).alias("section_number"), moved.alias("content"), F.col("next2").alias("discarded")))))
    taken = three.select("book_id", F.explode(F.array(n, n + 1, n + 2)).alias("section_number"))
    others = every.join(taken, IDS, "left_anti").select(*IDS, "content", F.lit(None).cast("string").alias("discarded"))
    return segment.rebalance_shifted(segment.with_junk(rows.unionByName(others)))


@query()
def orphan_sections(s, d):
    """Whole books in which each third section stands behind the one before it, its header garbled, left as a folio or lost; they are cut apart again."""
    every, n = sections(s, d), F.col("section_number")
    lost = (n % 3 == 2) & (F.col("content") != segment.MISSING)
    signal = F.when(F.col("book_id") % 3 == 0, F.concat(F.lit("\n"), F.left(n.cast("string"), F.lit(1)), F.lit("o"))).when(F.col("book_id") % 3 == 1, F.concat(F.lit("\n"), n.cast("string"), F.lit("-"), (n + 2).cast("string"))).otherwise("")
    gone = every.where(lost).select("book_id", (n - 1).alias("section_number"), F.concat(signal, F.lit("\n"), F.col("content")).alias("tail"))
    merged = every.where(~lost).join(gone, IDS, "left").select(*IDS, F.concat("content", F.coalesce("tail", F.lit(""))).alias("content"))
    return segment.split_orphans(merged, every.select("book_id", "n_sections").distinct())


@query("SELECT s_suppkey AS page_id, 'p' || s_suppkey || '.png' AS name, 0 AS \"left\", CAST(8 * (s_suppkey % 25 + 1) AS INT) AS top, 100 AS width, CAST(160 + 8 * (s_suppkey % 25) AS INT) AS height FROM supplier", books=False)
def art_crops(s, d):
    """Pages with one dark area each, 100 x 800 bytes of luminance."""
    k = (F.col("s_suppkey") % 25).cast("int")
    area = lambda c, n: F.repeat(F.lit(c * 800), n)  # noqa: E731  # n bands of 8 rows
    pixels = F.rpad(F.concat(area("z", k + 1), area(" ", k + 20)), 80_000, "z").cast("binary")
    pages = table(s, d, "supplier").select(F.col("s_suppkey").alias("page_id"), F.lit(100).alias("width"), F.lit(800).alias("height"), pixels.alias("pixels"))
    return layout.art_crops(pages, find=layout.blocks).drop("png")  # the reduced rule, which its SQL has


# A drawing is 16 rows of light ink, 40 + 8 (k mod 8) of dense, 64 of strong, 8 without, 40 of dense ink. Its run begins below the light rows
# and ends a band after the last; upwards it grows over the light rows and four bands without ink (32), downwards over four, at each side over four
# steps of 2; the margin is 6. So it begins 38 above the light rows, is 252 + 8 (k mod 8) high, and 79 = 50 + 1 + 2 (8 + 6) wide.
@query("""WITH P AS (SELECT s_suppkey AS k, unnest(range(0, CAST(1 + s_suppkey % 2 AS INT))) AS i FROM supplier)
  SELECT k AS page_id, 'p' || k || CASE i WHEN 0 THEN '' ELSE '_1' END || '.png' AS name, CAST(6 + 2 * (k % 5) AS INT) AS "left", CAST(122 + 8 * (k % 3) + i * (288 + 8 * (k % 8)) AS INT) AS top, 79 AS width, CAST(252 + 8 * (k % 8) AS INT) AS height FROM P""", books=False)
def art_illustrations(s, d):
    """Pages with one or two drawings, which have lighter bands, a gap, and light strokes around; found by the whole rule."""
    k = F.col("s_suppkey").cast("int")
    rows = lambda ink, n: F.repeat(F.rpad(F.concat(F.repeat(F.lit("z"), 20 + 2 * (k % 5)), F.repeat(F.lit(" "), ink)), 100, "z"), n)  # noqa: E731  # n rows with so much ink of 100
    drawing = F.concat(rows(F.lit(4), F.lit(16)), rows(F.lit(10), 40 + 8 * (k % 8)), rows(F.lit(50), F.lit(64)), rows(F.lit(0), F.lit(8)), rows(F.lit(10), F.lit(40)))
    second = F.when(k % 2 == 1, F.concat(rows(F.lit(0), F.lit(120)), drawing)).otherwise("")
    pixels = F.rpad(F.concat(rows(F.lit(0), 160 + 8 * (k % 3)), drawing, second), 120_000, "z").cast("binary")
    pages = table(s, d, "supplier").select(F.col("s_suppkey").alias("page_id"), F.lit(100).alias("width"), F.lit(1200).alias("height"), pixels.alias("pixels"))
    return layout.art_crops(pages).drop("png")


@query(rf""", C AS (SELECT book_id, section_number, CAST(unnest(regexp_extract_all(content, '(?im)^([^\n]+?)\bturn\s+to\s+(?:the\s+)?(\d{{1,4}})[.!]?\s*$', 2)) AS INT) AS target FROM S)
  SELECT book_id, section_number, target FROM C WHERE (book_id, target) IN (SELECT book_id, section_number FROM S WHERE content = '{MISSING}')""")
def dangling_choices(s, d):
    """Choices that lead to a section without text."""
    every = sections(s, d)
    gone = every.where(F.col("content") == MISSING).select("book_id", F.col("section_number").alias("target"))
    led = every.select(*IDS, F.explode(T.choices(F.col("content"))).alias("c")).select(*IDS, F.col("c.target").alias("target"))
    return led.join(gone, ["book_id", "target"], "left_semi").select(*IDS, "target")


@query(f""", C AS (SELECT book_id, 0 AS pass_id, count(*) FILTER (section_number % 2 = 0 AND content <> '{MISSING}') AS present FROM S GROUP BY ALL
    UNION ALL SELECT book_id, 1, count(*) FILTER (section_number % 3 <> 0 AND content <> '{MISSING}') FROM S GROUP BY ALL)
  SELECT book_id, pass_id, present FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY present DESC, pass_id) AS r FROM C) WHERE r = 1""")
def best_source(s, d):
    n = F.col("section_number")
    passes = F.array(*(F.struct(F.lit(k).alias("pass_id"), F.when(kept, F.col("content")).otherwise(MISSING).alias("content")) for k, kept in ((0, n % 2 == 0), (1, n % 3 != 0))))
    return players.best_source(sections(s, d).select("book_id", F.inline(passes)), MISSING)


@query("""SELECT c_custkey, greatest(1, least(20, CASE WHEN c_custkey % 4 = 0 THEN 12 ELSE CAST(c_custkey % 30 AS INT) END)) AS skill,
  CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 2 THEN 'New' END AS name FROM customer""", books=False)
def profile_patch(s, d):
    k = F.col("c_custkey")
    skill = players.patched(F.lit(12), F.when(k % 4 != 0, (k % 30).cast("int")))
    name = players.patched_text(F.col("c_name"), F.when(k % 3 == 1, "  ").when(k % 3 == 2, " New "))
    return table(s, d, "customer").select("c_custkey", players.clamp(skill, 1, 20).alias("skill"), name.alias("name"))
