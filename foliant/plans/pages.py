"""Queries over pages, their words, lines and images, and over stores of books that are written again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import lore
from foliant.functions import text as T
from foliant.operators import layout, players, segment
from foliant.plans import IDS, KEY, query
from foliant.plans.catalog import PAGES, _pages
from foliant.sources import files, images, sinks, transcripts
from foliant.sources.corpus import MISSING, lines, scratch, sections, table

WORDS = """WITH W AS (SELECT DISTINCT l_orderkey AS page_id, CASE WHEN l_orderkey % 3 = 0 THEN 500 ELSE 1000 END AS page_width, 700 AS page_height,
    (l_partkey * 37 + l_suppkey) % 940 AS lft, (l_partkey * 37 + l_suppkey) % 940 + 10 + l_suppkey % 30 AS rgt, l_partkey AS word FROM lineitem)"""


def _words(s, d):
    """A word for each part of an order, wherever on the page; two of three pages are two pages wide."""
    left = (F.col("l_partkey") * 37 + F.col("l_suppkey")) % 940
    width = F.when(F.col("l_orderkey") % 3 == 0, 500).otherwise(1000)
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), width.alias("page_width"), F.lit(700).alias("page_height"), left.alias("left"), (left + 10 + F.col("l_suppkey") % 30).alias("right"), F.col("l_partkey").alias("word")).distinct()


HALVES = """SELECT page_id, CASE WHEN page_width < 805 THEN page_id WHEN rgt <= middle THEN page_id * 2 - 1 WHEN lft >= middle THEN page_id * 2 END AS logical_page, lft AS "left", word FROM M WHERE rgt <= page_width"""


@query(f"{WORDS}, M AS (SELECT *, page_width / 2 AS middle FROM W) SELECT * FROM ({HALVES}) WHERE logical_page IS NOT NULL", books=False)
def page_columns(s, d):
    """Words by the halves of wide pages; those across the middle and beyond the page are dropped."""
    return layout.page_columns(_words(s, d)).select("page_id", "logical_page", "left", "word")


@query(f"""{WORDS}, R AS (SELECT *, max(rgt) OVER (PARTITION BY page_id ORDER BY lft, rgt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM W WHERE page_width = 1000),
  G AS (SELECT page_id, least(lft, page_width / 3 * 2) - greatest(reached, page_width / 3) AS gap, (least(lft, page_width / 3 * 2) + greatest(reached, page_width / 3)) / 2 AS gutter FROM R WHERE reached IS NOT NULL),
  B AS (SELECT page_id, arg_max(gutter, (gap, -gutter)) AS gutter FROM G WHERE gap > 0 GROUP BY page_id),
  M AS (SELECT W.*, coalesce(gutter, page_width / 2) AS middle FROM W LEFT JOIN B USING (page_id)) SELECT * FROM ({HALVES}) WHERE logical_page IS NOT NULL""", books=False)
def gutter_columns(s, d):
    """Words by the halves on both sides of the widest gap in the page's middle third."""
    return layout.page_columns(_words(s, d), by_gap=True).select("page_id", "logical_page", "left", "word")


SCANS = """WITH Q AS (SELECT l_orderkey AS page_id, 600 + (l_orderkey % 2) * 500 AS w, 1000 AS h, (l_partkey * 13) % 500 + CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE 90 END AS lft, (l_suppkey * 7 + l_partkey) % 1000 AS tp,
    CASE l_partkey % 4 WHEN 0 THEN CAST(l_suppkey AS VARCHAR) WHEN 1 THEN '  ' ELSE ' line ' || l_partkey || ' ' END AS text, l_partkey, l_suppkey FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem))"""


def _scans(s, d):
    """Lines of scans, some of them blank or mere numbers; every other page is wide."""
    part, supp, order = (F.col(f"l_{c}key") for c in ("part", "supp", "order"))
    text = F.when(part % 4 == 0, supp.cast("string")).when(part % 4 == 1, "  ").otherwise(F.concat(F.lit(" line "), part.cast("string"), F.lit(" ")))
    left = (part * 13) % 500 + F.when(supp % 2 == 0, 0).otherwise(90)
    rows = table(s, d, "lineitem").select(order, part, supp).distinct()
    return rows.select(order.alias("page_id"), (600 + (order % 2) * 500).alias("page_width"), F.lit(1000).alias("page_height"), left.alias("left"), (left + 110).alias("right"), ((supp * 7 + part) % 1000).alias("top"), text.alias("text"), (part * 1000 + supp).alias("seq"))


@query(f"""{SCANS} SELECT page_id, CASE WHEN w < 1150 THEN page_id WHEN lft + 55 < w // 2 THEN page_id * 2 - 1 ELSE page_id * 2 END AS logical_page, tp / 1000.0 AS top_fraction, trim(text) AS text
  FROM Q WHERE trim(text) <> '' AND NOT (regexp_matches(text, '^\\d+$') AND length(text) <= 4 AND (tp / 1000.0 > 0.95 OR tp / 1000.0 < 0.04))""".replace("1150", "1100"), books=False)
def scan_blocks(s, d):
    """Lines of scans as blocks: folios at the edges go, lines of wide pages go to the half of their centre."""
    return layout.scan_blocks(_scans(s, d), by_centre=True, two_up=1.1).select("page_id", "logical_page", "top_fraction", "text")


@query(f"""{SCANS}, P AS (SELECT *, CASE WHEN w < 1050 THEN 'M' WHEN lft < w // 2 THEN 'L' ELSE 'R' END AS side FROM Q WHERE trim(text) <> '')
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY side, tp, l_partkey * 1000 + l_suppkey) - 1 AS INT) AS n, side, trim(text) AS text FROM P""", books=False)
def numbered_lines(s, d):
    """Lines of scans numbered by side (left, middle, right) and top."""
    return layout.number_lines(_scans(s, d)).select("page_id", "n", "side", "text")


@query(f"""{SCANS}, V AS (SELECT * FROM Q WHERE trim(text) <> ''),
  C AS (SELECT page_id, lft, lead(lft) OVER o AS nxt, CAST(sum(lft) OVER o AS DOUBLE) AS a, row_number() OVER o AS k, CAST(sum(lft) OVER (PARTITION BY page_id) AS DOUBLE) AS whole, count(*) OVER (PARTITION BY page_id) AS n
    FROM V WHERE w >= 1050 WINDOW o AS (PARTITION BY page_id ORDER BY lft ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  T AS (SELECT page_id, arg_max((lft + nxt) / 2.0, (a * a / k + (whole - a) * (whole - a) / (n - k), -lft)) AS split FROM C WHERE nxt > lft GROUP BY page_id),
  P AS (SELECT V.*, CASE WHEN w < 1050 THEN 'M' WHEN lft < coalesce(split, w // 2) THEN 'L' ELSE 'R' END AS side FROM V LEFT JOIN T USING (page_id))
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY side, tp, l_partkey * 1000 + l_suppkey) - 1 AS INT) AS n, side, trim(text) AS text FROM P""", books=False)
def centred_lines(s, d):
    """The same, with the sides of wide pages by the two groups that their lines' starts fall into."""
    return layout.number_lines(_scans(s, d), by_centres=True).select("page_id", "n", "side", "text")


@query(rf""", X AS (SELECT book_id, section_number, regexp_extract(text, '(?i)if you have the (\w+ of \w+ \w+)', 1) AS name FROM L),
  Y AS (SELECT book_id, section_number, name, 'weapon' AS type, 'legendary' AS rarity FROM X WHERE name <> '' UNION ALL SELECT book_id, section_number, array_to_string(string_split(name, ' ')[1:3], ' '), 'weapon', 'legendary' FROM X WHERE name <> ''
    UNION ALL SELECT book_id, section_number, 'Magic Potion', 'consumable', 'common' FROM L WHERE contains(text, 'You find a Magic Potion'))
  SELECT book_id, arg_min(name, section_number) AS name, arg_min(type, section_number) AS type, arg_min(rarity, section_number) AS rarity, min(section_number) AS section_number FROM Y GROUP BY book_id, lower(name)""")
def book_items(s, d):
    """What can be found in a book, each thing once, with the section that has it first."""
    return lore.catalog(sections(s, d).where(F.col("content") != MISSING).select(*IDS, F.inline(lore.items(T.prose(F.col("content"))))))


@query("""WITH b AS (SELECT DISTINCT p_type AS book_title, CASE WHEN length(p_type) % 3 > 0 THEN 'map/' || p_type END AS m, CASE WHEN length(p_type) % 2 = 0 THEN 'sheet/' || p_type END AS s FROM part),
  r AS (SELECT p_type AS book_title, p_partkey AS run_id, p_size AS current_section FROM part WHERE p_partkey % 5 = 0 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) = 1)
  SELECT book_title, coalesce(m, s) AS cover, run_id, current_section FROM b LEFT JOIN r USING (book_title)""", books=False)
def saved_runs(s, d):
    """Every book with the run that was saved first, and its cover."""
    parts = table(s, d, "part")
    title = F.col("p_type")
    books = parts.select(title.alias("book_title")).distinct().select("book_title", F.when(F.length("book_title") % 3 > 0, F.concat(F.lit("map/"), "book_title")).alias("map_path"), F.when(F.length("book_title") % 2 == 0, F.concat(F.lit("sheet/"), "book_title")).alias("sheet_path"))
    return players.saved_runs(books, parts.where("p_partkey % 5 = 0").select(title.alias("book_title"), F.col("p_partkey").alias("run_id"), F.col("p_size").alias("current_section")))


IMAGES = """WITH J AS (SELECT o_custkey AS book_id, CAST(o_orderkey % 40 AS INT) AS page, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 40 ORDER BY o_orderkey) - 1 AS i, 40 + o_orderkey % 500 AS width, 45 + o_orderkey % 300 AS height,
    CASE WHEN o_orderkey % 3 = 0 THEN 580 ELSE 300 END AS bw, o_orderkey % 4 AS regions FROM orders)"""


def _images(s, d):
    """An image for each order: on which page, how large, how much of the page it covers, and how many regions of art it has."""
    key = F.col("o_orderkey")
    i = F.row_number().over(Window.partitionBy("o_custkey", key % 40).orderBy(key)) - 1
    return table(s, d, "orders").select(F.col("o_custkey").alias("book_id"), (key % 40).cast("int").alias("page"), i.alias("i"), (40 + key % 500).alias("width"), (45 + key % 300).alias("height"), F.when(key % 3 == 0, 580).otherwise(300).alias("bw"), (key % 4).alias("regions"))


@query(f"""{IMAGES} SELECT book_id, arg_min('p' || page || '_i' || i || '.png', (page, i)) AS map FROM J WHERE page < 20 AND width > 400 AND height >= 50 GROUP BY book_id""", books=False)
def book_maps(s, d):
    """The first large image early in each book, from the heads of PNG files."""
    rows = _images(s, d)
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), number("width"), number("height"), F.unhex(F.lit("0802000000")))
    name = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_i"), F.col("i").cast("string"), F.lit(".png"))
    files = rows.select(F.concat(F.col("book_id").cast("string"), F.lit("/"), name).alias("path"), F.octet_length(head).alias("length"), head.alias("content"))
    parts = F.split("path", "/")
    found = images.image_sizes(files).select(parts[0].cast("long").alias("book_id"), parts[1].alias("path"), F.regexp_extract("path", r"/p(\d+)_", 1).cast("int").alias("page"), F.regexp_extract("path", r"_i(\d+)", 1).cast("int").alias("i"), "width", "height")
    return images.book_maps(found, ("book_id",))


@query(f"""{IMAGES}, K AS (SELECT *, CASE WHEN bw * 800 / (600.0 * 900) >= 0.85 THEN 'scan' WHEN width >= 100 AND height >= 100 THEN 'embedded' END AS kind FROM J),
  P AS (SELECT book_id, page, sum(CASE kind WHEN 'scan' THEN regions WHEN 'embedded' THEN 1 ELSE 0 END) AS files, bool_or(coalesce(kind = 'embedded', false)) AS art FROM K GROUP BY ALL)
  SELECT book_id, CAST(sum(files) AS BIGINT) AS files, count(*) AS pages, count(*) FILTER (art) AS art_pages, count(*) FILTER (NOT art) AS scan_pages FROM P WHERE files > 0 GROUP BY book_id""", books=False)
def art_totals(s, d):
    """Files of art per book, and how many pages have embedded images and how many crops of scans."""
    kind = images.image_kind(F.col("width"), F.col("height"), F.col("bw"), F.lit(800), F.lit(600.0), F.lit(900))
    return images.page_totals(_images(s, d).withColumn("kind", kind))


def _settings(s, d):
    """Settings of two books of three: their slug and highest section, whether "turn to" is repaired, and patches."""
    book = F.col("book_id")
    patch = lambda number, find, put: F.struct(F.lit(number).cast("int").alias("section_number"), F.lit(find).alias("find"), F.lit(put).alias("put"))
    patches = F.when(book % 3 == 1, F.array(patch(2, None, "patched"), patch(None, "rusty gate", "golden door"), patch(1, "golden", "silver")))
    kept = sections(s, d).select("book_id").distinct().where(book % 3 != 0)
    return kept.select("book_id", F.concat(F.lit("ff"), (book % 10).cast("string")).alias("slug"), (6 + book % 4).cast("int").alias("most"), F.when(book % 2 == 0, 2).cast("int").alias("ahead"), F.when(book % 5 == 0, 3.0).alias("larger"), (book % 2 == 0).alias("repair_turns"), patches.alias("patches"))


@query(rf"""{PAGES}, H AS (SELECT book_id, page, side, count(*) FILTER (len(list_filter(string_split(text, ' '), lambda w: length(w) >= 4 AND regexp_matches(w, '[A-Za-z]'))) >= 3) AS wordy,
    count(*) FILTER (k = 0 AND section_number % 5 <> 0) AS entries FROM P GROUP BY ALL),
  Q AS (SELECT P.*, row_number() OVER (PARTITION BY book_id ORDER BY page, n) - 1 AS pos FROM P JOIN H USING (book_id, page, side) WHERE entries > 0 OR wordy >= 5),
  E AS (SELECT book_id, section_number, page, pos, CASE WHEN section_number = 4 THEN pos + 1 ELSE coalesce(lead(pos) OVER (PARTITION BY book_id ORDER BY section_number), 1000000) END AS stop FROM Q WHERE k = 0 AND section_number % 5 <> 0),
  C AS (SELECT E.book_id, E.section_number, string_agg(trim(Q.text), chr(10) ORDER BY Q.pos) AS c, page FROM E JOIN Q ON E.book_id = Q.book_id AND Q.pos >= E.pos AND Q.pos < E.stop GROUP BY E.book_id, E.section_number, E.page)
  SELECT book_id, section_number, CASE WHEN book_id % 3 <> 1 THEN c WHEN section_number = 2 THEN 'patched' WHEN section_number = 1 THEN replace(replace(c, 'rusty gate', 'golden door'), 'golden', 'silver') ELSE replace(c, 'rusty gate', 'golden door') END AS content,
    '/assets/game-art/' || CASE WHEN book_id % 3 = 0 THEN 'book' || book_id ELSE 'ff' || (book_id % 10) END || '/p' || page || '_i0.png' AS image_path FROM C WHERE book_id % 3 = 0 OR section_number <= 6 + book_id % 4""".replace("string_agg(trim(Q.text), chr(10) ORDER BY Q.pos) AS c, page FROM E JOIN Q", "string_agg(trim(Q.text), chr(10) ORDER BY Q.pos) AS c, E.page AS page FROM E JOIN Q"))
def settled_manifest(s, d):
    """Sections cut by a manifest, in which each book has settings of its own."""
    return segment.apply_manifest(*_pages(s, d), _settings(s, d))


@query(f""", H AS (SELECT DISTINCT book_id, section_number, CASE WHEN book_id % 3 = 0 THEN 400 ELSE 6 + book_id % 4 END AS most FROM L),
  R AS (SELECT book_id, section_number, -1 AS n, CASE WHEN section_number > most THEN CAST(section_number AS VARCHAR) END AS text, most FROM H UNION ALL SELECT book_id, section_number, n, text, most FROM L JOIN H USING (book_id, section_number)),
  T AS (SELECT *, max(CASE WHEN section_number <= most THEN section_number END) OVER (PARTITION BY book_id ORDER BY section_number, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS of FROM R)
  SELECT book_id, of AS section_number, string_agg(text, chr(10) || chr(10) ORDER BY section_number, n) AS content FROM T WHERE of IS NOT NULL AND text IS NOT NULL GROUP BY book_id, of""")
def settled_headers(s, d):
    """Bold headers found again, where a book's highest number is its own: numbers beyond it are text."""
    rows = lines(s, d)
    style = lambda bold: (F.lit(1).alias("page"), F.lit(10.0).alias("font_size"), F.lit(bold).alias("is_bold"))
    heads = rows.select(*IDS).distinct().select("book_id", (F.col("section_number") * 1000).cast("long").alias("seq"), F.col("section_number").cast("string").alias("text"), *style(True))
    body = rows.select("book_id", (F.col("section_number") * 1000 + F.col("n") + 1).cast("long").alias("seq"), "text", *style(False))
    return segment.header_fold(heads.unionByName(body), settings=_settings(s, d)).select(*IDS, "content")


@query("SELECT CAST(p_partkey // 50 % 7 AS BIGINT) AS book_id, CAST(p_partkey // 350 + 1 AS INT) AS page, CAST(p_partkey % 50 AS INT) AS n, CASE WHEN p_partkey % 50 < 25 THEN 'L' ELSE 'R' END AS side, p_name AS text FROM part", books=False)
def transcript_lines(s, d):
    """Pages dumped as files of JSON, and scanned again."""
    key = F.col("p_partkey")
    rows = table(s, d, "part").select(F.floor(key / 50 % 7).cast("long").alias("book_id"), (F.floor(key / 350) + 1).cast("int").alias("page"), (key % 50).cast("int").alias("n"), F.when(key % 50 < 25, "L").otherwise("R").alias("side"), (key % 50 / 50).alias("top"), F.col("p_name").alias("text"))
    path = scratch(s, "transcripts")
    transcripts.dump(rows, path)
    return transcripts.read_transcripts(s, path, 16).select("book_id", "page", "n", "side", "text")


@query("""WITH t AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'Saga' || c_custkey WHEN 1 THEN 'Tale (old) ' || c_custkey ELSE 'Quest ' || c_custkey END AS title, c_name FROM customer)
  SELECT title AS name, CASE WHEN k % 2 = 0 AND k % 3 < 2 THEN c_name || ' again' ELSE c_name END AS body FROM t UNION ALL SELECT title || ' (1)', c_name || ' again' FROM t WHERE k % 2 = 0 AND k % 3 = 2""", books=False)
def cleaned_store(s, d):
    """Books that are written, and every other one of them again; titles of one kind are protected and get a second name."""
    k = F.col("c_custkey")
    number = k.cast("string")
    title = F.when(k % 3 == 0, F.concat(F.lit("Saga"), number)).when(k % 3 == 1, F.concat(F.lit("Tale (old) "), number)).otherwise(F.concat(F.lit("Quest "), number))
    books = table(s, d, "customer").select(k, title.alias("title"), F.col("c_name").alias("body"))
    again = books.where(k % 2 == 0).withColumn("body", F.concat("body", F.lit(" again")))
    path = scratch(s, "cleaned")
    guard = F.col("title").startswith("Quest")
    sinks.write_cleaned(books.drop("c_custkey"), path, [], 8)
    # the protected titles' names are looked up by a table, not by a list in the plan
    sinks.write_cleaned(again.drop("c_custkey"), path, again.where(guard).select("title"), 8)
    return sinks.read_cleaned(s, path).select("name", "body")


@query(f"SELECT {KEY}, content FROM S WHERE section_number = book_id % 7 + 1")
def stored_sections(s, d):
    """A section of each book, looked up in a layout by buckets of books."""
    path = scratch(s, "sections-by-book")
    sinks.write_sections(sections(s, d), path, 8)
    keys = sections(s, d).select("book_id").distinct().select("book_id", (F.col("book_id") % 7 + 1).cast("int").alias("section_number"))
    return sinks.lookup_sections(s, path, keys, 8).select(*IDS, "content")


@query("SELECT 'Book ' || book_id AS title, CAST(section_number AS INT) AS number, content, CASE WHEN section_number % 2 = 0 THEN 'p' || section_number END AS image_path FROM S")
def book_files(s, d):
    """Whole books written as JSON and read again."""
    section = F.struct(F.col("section_number").cast("int").alias("number"), "content", F.when(F.col("section_number") % 2 == 0, F.concat(F.lit("p"), F.col("section_number").cast("string"))).alias("image_path"))
    books = sections(s, d).groupBy("book_id").agg(F.array_sort(F.collect_list(section)).alias("sections"))
    path = scratch(s, "books")
    files.write_books(books.select(F.concat(F.lit("Book "), F.col("book_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("introduction"), "sections"), path, "first")
    return files.exploded(files.read_books(s, f"{path}/run=first", per_line=True))


@query("SELECT CAST(p_partkey % 5 AS BIGINT) AS book, CAST(p_partkey // 5 + 1 AS INT) AS n, CAST(p_size AS INT) AS page, CASE WHEN p_partkey % 2 = 0 THEN 'L' ELSE 'R' END AS side, CAST(p_partkey % 40 AS INT) AS line, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 40 + 2 AS INT) ELSE -1 END AS stop FROM part", books=False)
def manifest_files(s, d):
    """Manifests of five books as files, read by the names of their folders."""
    key = F.col("p_partkey")
    entry = F.struct((F.floor(key / 5) + 1).cast("int").alias("n"), F.col("p_size").cast("int").alias("page"), F.when(key % 2 == 0, "L").otherwise("R").alias("side"), (key % 40).cast("int").alias("line"), F.when(key % 3 == 0, (key % 40 + 2).cast("int")).alias("end"))
    books = table(s, d, "part").groupBy((key % 5).alias("book")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    path = scratch(s, "manifests")
    # a file for each book: five folders, whatever the table's size
    books.select("book", F.to_json(F.struct("entries")).alias("value")).repartition("book").write.partitionBy("book").option("pathGlobFilter", "*.json").text(path)
    rows = s.read.schema("entries array<struct<n: int, page: int, side: string, line: int, `end`: int>>, book long").json(path, multiLine=True)
    return rows.select("book", F.inline("entries")).withColumn("stop", F.coalesce("end", F.lit(-1))).drop("end")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY book_id, section_number ORDER BY n) AS k FROM L),
  t AS (SELECT book_id, section_number, string_agg(text, chr(10) || chr(10) ORDER BY n) FILTER (n % 2 = 0) AS content, string_agg(text, chr(10) || chr(10) ORDER BY n) FILTER (n % 2 = 1) AS discarded FROM L GROUP BY ALL) SELECT * FROM t""".replace("WITH r AS", ", r AS"))
def repeated_headers(s, d):
    """Every section stands twice under its number, the even lines first: the first text stays, the second is kept as discarded."""
    rows, n = lines(s, d), F.col("n") % 2
    style = lambda bold: (F.lit(1).alias("page"), F.lit(10.0).alias("font_size"), F.lit(bold).alias("is_bold"))
    at = F.col("section_number") * 10_000 + n * 5_000
    heads = rows.select(*IDS, n.alias("n")).distinct().select("book_id", at.cast("long").alias("seq"), F.col("section_number").cast("string").alias("text"), *style(True))
    body = rows.select("book_id", (at + F.col("n") + 1).cast("long").alias("seq"), "text", *style(False))
    return segment.header_fold(heads.unionByName(body)).drop("page")


@query(f"SELECT c_custkey AS id, c_mktsegment AS plan, coalesce(({players.STATES})[c_custkey % 6 + 1], CAST(c_custkey % 6 AS VARCHAR)) AS status, c_name AS started_at, CAST(NULL AS VARCHAR) AS expires_at, CAST(NULL AS VARCHAR) AS renews_at FROM customer", books=False)
def subscription_responses(s, d):
    """Subscriptions as they are told: states by name, the user left out."""
    key = F.col("c_custkey")
    rows = table(s, d, "customer").select(key.alias("id"), F.col("c_nationkey").alias("user_id"), F.col("c_mktsegment").alias("plan"), (key % 6).alias("status"), F.col("c_name").alias("started_at"))
    return players.response(rows, "subscription")


@query("SELECT o_orderkey AS id, 'Book ' || o_custkey AS book_title, o_orderkey % 500 AS current_section, o_orderkey % 7 AS skill, o_orderkey % 20 AS stamina, o_orderkey % 6 AS luck, o_orderdate AS updated_at, o_orderstatus = 'F' AS is_complete FROM orders", books=False)
def adventure_responses(s, d):
    """Saved runs as they are told."""
    key = F.col("o_orderkey")
    runs = table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderstatus") == "F").alias("is_complete"), key.alias("id"), F.concat(F.lit("Book "), F.col("o_custkey").cast("string")).alias("book_title"), (key % 500).alias("current_section"), (key % 7).alias("skill"), (key % 20).alias("stamina"), (key % 6).alias("luck"), F.col("o_orderdate").alias("updated_at"))
    return players.response(runs, "adventure")


@query(f"SELECT {KEY}, trim(regexp_replace(content, ' +', ' ', 'g')) AS content FROM S WHERE content <> '{MISSING}'")
def extracted_sections(s, d):
    """Books set on pages of two columns, word by word, and read again: words to columns, lines, paragraphs, and sections by their headers."""
    every = lines(s, d).select("book_id", "section_number", "n", "text")
    heads = every.select(*IDS).distinct().select("book_id", "section_number", F.lit(-1).cast("long").alias("n"), F.col("section_number").cast("string").alias("text"))
    column = F.floor((F.col("section_number") - 1) / 2)
    rows = heads.unionByName(every.withColumn("n", F.col("n").cast("long"))).withColumn("column", column)
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("book_id", "column").orderBy("section_number", "n")))
    top = 990.0 - F.col("row") * 14
    page = (F.floor(F.col("column") / 2) + 1).cast("int")
    word = rows.select("book_id", page.alias("page"), F.lit(1400).alias("page_width"), F.lit(1000).alias("page_height"), "column", top.alias("top"), (top - 10).alias("bottom"), (F.col("n") < 0).alias("is_bold"), F.posexplode(F.split(F.trim("text"), " +")).alias("k", "text"))
    left = (F.col("column") % 2) * 700 + 5 + F.col("k") * 30
    words = word.withColumns({"left": left, "right": left + 25}).drop("column", "k")
    settings = every.select("book_id").distinct().select("book_id", F.lit(400).alias("most"), F.lit(400).alias("ahead"), F.lit(None).cast("double").alias("larger"))
    return segment.header_fold(layout.extract_blocks(words), settings=settings).select(*IDS, "content")


@query(f""", C AS (SELECT S.*, len(string_split(content, chr(10))) AS n_lines FROM S),
  D AS (SELECT C.*, section_number % 2 = 0 AND coalesce(lag(n_lines) OVER (PARTITION BY book_id ORDER BY section_number) <= 2, false) AS lost FROM C)
  SELECT book_id, CAST(section_number AS INT) AS section_number, CASE WHEN lost THEN '{MISSING}' WHEN content = '{MISSING}' THEN 'Nothing is written here.' ELSE replace(content, chr(10), chr(10) || chr(10)) END AS content,
    CASE WHEN NOT lost THEN '/assets/game-art/book_' || book_id || '/p' || (section_number // 3 + 1) || '_i0.png' END AS image_path, NOT lost AND contains(content, 'SKILL') AND contains(content, 'STAMINA') AS has_combat FROM D""")
def parsed_books(s, d):
    """Whole books from blocks with running heads and page numbers. Headers of some short sections' successors are lost with their texts: nothing tells them, so they get the placeholder."""
    n = F.col("section_number")
    said = F.when(F.col("content") == MISSING, "Nothing is written here.").otherwise(F.col("content"))
    every = sections(s, d).withColumn("lines", F.split(said, "\n"))
    before = F.lag(F.size("lines")).over(Window.partitionBy("book_id").orderBy("section_number"))
    kept = every.withColumn("before", before).where(~((n % 2 == 0) & F.coalesce(F.col("before") <= 2, F.lit(False))))
    page = (F.floor(n / 3) + 1).cast("int")
    block = lambda rows, seq, text, top: rows.select("book_id", seq.cast("long").alias("seq"), page.alias("page"), text.alias("text"), F.lit(top).alias("top_fraction"), F.lit(10.0).alias("font_size"), F.lit(False).alias("is_bold"))
    heads = block(kept, n * 1000, n.cast("string"), 0.5)
    body = block(kept.select("book_id", "section_number", F.posexplode("lines").alias("k", "line")), n * 1000 + F.col("k") + 1, F.col("line"), 0.5)
    first = every.where(n % 3 == 0)
    noise = block(first, n * 1000 - 3, F.lit("A BOOK OF ROADS"), 0.02).unionByName(block(first, n * 1000 - 2, F.floor(n / 3).cast("string"), 0.95))
    settings = every.groupBy("book_id").agg(F.max(n).cast("int").alias("most")).select("book_id", F.concat(F.lit("book_"), F.col("book_id").cast("string")).alias("slug"), "most", F.lit(400).alias("ahead"), F.lit(None).cast("double").alias("larger"))
    return segment.parse_books(heads.unionByName(body).unionByName(noise), settings)
