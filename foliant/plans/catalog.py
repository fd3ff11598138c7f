"""Queries over whole books and readers: terminal sections, manifests by page and line, introductions, listings, sessions and fights."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as T
from foliant.operators import graph, layout, players, segment
from foliant.plans import IDS, KEY, REFS, query
from foliant.sources.corpus import MISSING, lines, sections, table
from foliant.streaming import progress


@query(f"SELECT {KEY} FROM S WHERE len({REFS}) = 0 AND contains(content, 'Your adventure ends')")
def graph_terminal(s, d):
    return graph.terminal(sections(s, d))


@query(f"SELECT {KEY}, CAST(unnest(regexp_extract_all(content, '(?i)turn to (\\d+)', 1)) AS INT) AS target, regexp_matches(content, '(?i)roll|dice') AS is_dice_roll FROM S")
def raw_choices(s, d):
    return sections(s, d).select(*IDS, F.inline(T.raw_choices(F.col("content"))))


PAGES = """, P AS (SELECT book_id, (section_number - 1) // 3 + 1 AS page, section_number, n AS k, text,
    row_number() OVER (PARTITION BY book_id, (section_number - 1) // 3 ORDER BY section_number, n) - 1 AS n,
    CASE WHEN section_number % 3 = 0 THEN 'R' ELSE 'L' END AS side FROM L)"""


def _pages(s, d):
    """The corpus as pages of three sections, two on the left half and one on the right, and a manifest that leaves out each fifth section; section 4 has an end of its own."""
    number = F.col("section_number")
    page = F.floor((number - 1) / 3).cast("int") + 1
    order = Window.partitionBy("book_id", "page").orderBy("section_number", "k")
    rows = lines(s, d).select("book_id", "section_number", F.col("n").alias("k"), "text", page.alias("page"), F.when(number % 3 == 0, "R").otherwise("L").alias("side"))
    rows = rows.withColumn("n", F.row_number().over(order) - 1)
    starts = rows.where("k = 0 AND section_number % 5 <> 0").select("book_id", number.cast("int").alias("section_number"), "page", "side", F.col("n").alias("line"), F.when(number == 4, F.col("n")).alias("end"))
    return rows.select("book_id", "page", "side", "n", "text"), starts


@query(rf"""{PAGES}, H AS (SELECT book_id, page, side, count(*) FILTER (len(list_filter(string_split(text, ' '), lambda w: length(w) >= 4 AND regexp_matches(w, '[A-Za-z]'))) >= 3) AS wordy,
    count(*) FILTER (k = 0 AND section_number % 5 <> 0) AS entries FROM P GROUP BY ALL),
  Q AS (SELECT P.*, row_number() OVER (PARTITION BY book_id ORDER BY page, n) - 1 AS pos FROM P JOIN H USING (book_id, page, side) WHERE entries > 0 OR wordy >= 5),
  E AS (SELECT book_id, section_number, page, pos, CASE WHEN section_number = 4 THEN pos + 1 ELSE coalesce(lead(pos) OVER (PARTITION BY book_id ORDER BY section_number), 1000000) END AS stop FROM Q WHERE k = 0 AND section_number % 5 <> 0)
  SELECT E.book_id, E.section_number, string_agg(trim(Q.text), chr(10) ORDER BY Q.pos) AS content, '/assets/game-art/book' || E.book_id || '/p' || E.page || '_i0.png' AS image_path FROM E JOIN Q ON E.book_id = Q.book_id AND Q.pos >= E.pos AND Q.pos < E.stop GROUP BY ALL""")
def page_manifest(s, d):
    return segment.apply_manifest(*_pages(s, d))


@query(f"{PAGES} SELECT book_id, string_agg(trim(text), chr(10) ORDER BY page DESC, n) AS introduction FROM P WHERE page IN (1, 2) GROUP BY ALL")
def page_introductions(s, d):
    return segment.page_introduction(_pages(s, d)[0], [2, 1])


@query("SELECT book_id, string_agg(text, chr(10) || chr(10) ORDER BY section_number, n) AS introduction FROM L WHERE section_number <= 2 GROUP BY ALL")
def introductions(s, d):
    """Books in which the texts of the first two sections stand before the first number; page numbers below the band."""
    number = F.col("section_number")
    rows = lines(s, d).select("book_id", (number * 1000 + F.col("n")).alias("seq"), "text", F.lit(0.5).alias("top_fraction"))
    folios = lines(s, d).where("n = 0").select("book_id", (number * 1000 - 1).alias("seq"), number.cast("string").alias("text"), F.when(number > 2, 0.5).otherwise(0.95).alias("top_fraction"))
    return segment.introduction(rows.unionByName(folios)).where("introduction <> ''")


CHOICE = r"(?im)^([^\n]+?)\bturn\s+to\s+(?:the\s+)?(\d{1,4})[.!]?\s*$"


@query(rf""", C AS (SELECT book_id, CAST(unnest(regexp_extract_all(content, '{CHOICE}', 2)) AS INT) AS target FROM S),
  O AS (SELECT book_id, count(*) AS n FROM C WHERE target NOT BETWEEN 1 AND 14 GROUP BY ALL),
  A AS (SELECT book_id, count(*) AS n FROM C WHERE (book_id, target) IN (SELECT book_id, section_number FROM S WHERE content = '{MISSING}') GROUP BY ALL),
  I AS (SELECT book_id, string_agg(text, '' ORDER BY n) AS t FROM L WHERE section_number = 1 AND contains(text, 'corridor') GROUP BY ALL),
  B AS (SELECT book_id, count(*) FILTER (content <> '{MISSING}') AS present, max(section_number) AS top, CAST(floor(avg(length(content)) FILTER (content <> '{MISSING}')) AS BIGINT) AS mean FROM S GROUP BY book_id)
  SELECT book_id, present, top < 6 OR present < 5 OR coalesce(O.n, 0) > 0 OR coalesce(A.n, 0) > 0 OR coalesce(mean NOT BETWEEN 90 AND 190, false) OR t IS NULL AS needs_attention
  FROM B LEFT JOIN O USING (book_id) LEFT JOIN A USING (book_id) LEFT JOIN I USING (book_id)""")
def book_gate(s, d):
    """All six checks, with limits by which each decides for some books; an introduction is what section 1 says of corridors."""
    said = lines(s, d).where((F.col("section_number") == 1) & F.col("text").contains("corridor")).groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "").alias("introduction"))
    gate = segment.book_quality(sections(s, d), 14, said, least_top=6, least_present=5, lengths=(90, 190), most_astray=0)
    return gate.select("book_id", "present", "needs_attention")


@query(f"SELECT {KEY}, content FROM S WHERE section_number = 2 AND book_id % 10 = 1")
def section_lookup(s, d):
    """One section each of some books, by keys; the keys reach the scan as filters."""
    return sections(s, d).where((F.col("section_number") == 2) & (F.col("book_id") % 10 == 1)).select(*IDS, "content")


@query("SELECT DISTINCT p_type AS title FROM part", books=False)
def title_listing(s, d):
    return table(s, d, "part").select(F.col("p_type").alias("title")).distinct()


@query("SELECT p_type, p_name, p_partkey, row_number() OVER (ORDER BY p_type, p_name, p_partkey) AS pos FROM part QUALIFY pos BETWEEN 21 AND 40", books=False)
def catalog_page(s, d):
    """The second page of twenty of the catalog, by type and name: a limit is what a page is."""
    page = table(s, d, "part").select("p_type", "p_name", "p_partkey").orderBy("p_type", "p_name", "p_partkey").offset(20).limit(20)
    return page.withColumn("pos", (F.row_number().over(Window.orderBy("p_type", "p_name", "p_partkey")) + 20).cast("long"))  # of twenty rows


@query(f"SELECT {KEY}, substr(trim(regexp_replace(array_to_string(list_filter(string_split(content, chr(10)), lambda x: NOT regexp_matches(x, '(?i).+turn to \\d+\\.$')), ' '), '\\s+', ' ', 'g')), 1, 120) AS preview FROM S")
def look_preview(s, d):
    return sections(s, d).select(*IDS, F.substring(T.clean(F.col("content")), 1, 120).alias("preview"))


@query("""SELECT o_custkey AS user_id, 'MEDALLION_BOOK_' || b AS code, CASE WHEN b % 2 = 0 THEN 'Star of ' || b ELSE 'Medallion of Book ' || b END AS title
  FROM (SELECT DISTINCT o_custkey, o_orderkey % 10 AS b FROM orders WHERE o_orderstatus = 'F')""", books=False)
def medallions(s, d):
    runs = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("Book "), (F.col("o_orderkey") % 10).cast("string")).alias("book_title"))
    catalog = s.range(0, 10, 2).select(F.concat(F.lit("Book "), F.col("id").cast("string")).alias("book_title"), F.concat(F.lit("Star of "), F.col("id").cast("string")).alias("medallion_title"))
    return players.medallions(runs, catalog)


@query("""WITH o AS (SELECT o_custkey AS u, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS runs FROM orders GROUP BY ALL),
  e AS (SELECT user_id AS u, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY ALL)
  SELECT c_custkey AS user_id, coalesce(runs, '') AS runs, coalesce(kinds, '') AS kinds FROM customer LEFT JOIN o ON o.u = c_custkey LEFT JOIN e ON e.u = c_custkey""", books=False)
def nested_profile(s, d):
    users = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))
    runs = table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey")
    kinds = table(s, d, "events").select("user_id", "event_type").distinct()
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",")
    return players.nested_profile(users, runs=runs, kinds=kinds).select("user_id", names("runs", "o_orderkey").alias("runs"), names("kinds", "event_type").alias("kinds"))


@query("""SELECT c_custkey, ([9, 8, 11])[c_custkey % 4 + 1] AS skill, ([22, 18, 18])[c_custkey % 4 + 1] AS stamina, ([8, 12, 10])[c_custkey % 4 + 1] AS luck FROM customer WHERE c_custkey % 4 < 3""", books=False)
def starting_stats(s, d):
    kinds = F.array(*map(F.lit, ["Dreadknight", "Abyssal Mage", "Shadow Rogue", "Baker"]))
    stats = T.starting_stats(F.element_at(kinds, (F.col("c_custkey") % 4 + 1).cast("int")))
    return table(s, d, "customer").select("c_custkey", stats.alias("s")).select("c_custkey", F.col("s.skill").alias("skill"), F.col("s.stamina").alias("stamina"), F.col("s.luck").alias("luck")).where("skill IS NOT NULL")


@query("""SELECT p_partkey, (['SeaParser', 'CaveParser', 'RuleBased', 'SeaParser', 'RuleBased'])[p_partkey % 5 + 1] AS parser FROM part""", books=False)
def parser_selection(s, d):
    """The first rule that claims a title wins, whatever the case; a title that none claims, or none at all, has the default."""
    titles = F.array(*map(F.lit, ["The seas OF blood (1)", "Cave of Ends", "Seas", "Cave by the Seas of Blood", None]))
    title = F.element_at(titles, (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", players.parser_for(title, [("SeaParser", "Seas of Blood"), ("CaveParser", "cave of")], "RuleBased").alias("parser"))


@query("""SELECT p_partkey, n AS name FROM (SELECT p_partkey, (['Book ' || p_partkey, 'BOOK ' || p_partkey || ' (2)', 'Book ' || p_partkey || ' two', 'Saga (old) ' || p_partkey, 'Saga (old) ' || p_partkey || ' (1)'])[p_partkey % 5 + 1] AS n FROM part)
  WHERE (p_partkey % 5 = 2) OR (p_partkey % 5 < 2 AND p_partkey % 7 = 0)""", books=False)
def rewritten_files(s, d):
    k = F.col("p_partkey").cast("string")
    names = F.array(F.concat(F.lit("Book "), k), F.concat(F.lit("BOOK "), k, F.lit(" (2)")), F.concat(F.lit("Book "), k, F.lit(" two")), F.concat(F.lit("Saga (old) "), k), F.concat(F.lit("Saga (old) "), k, F.lit(" (1)")))
    parts = table(s, d, "part")
    stored = parts.select("p_partkey", F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("name"))
    titles = parts.where("p_partkey % 7 <> 0").select(F.concat(F.lit("book "), k).alias("title")).unionByName(parts.select(F.concat(F.lit("Saga (old) "), k).alias("title")))
    return players.rewritten(stored, titles, ["Other"]).select("p_partkey", "name")


@query("SELECT o_custkey AS book_id, count(*) FILTER (p BETWEEN 6 AND 8 AND o_orderkey % 3 = 0) >= greatest(1, count(*) FILTER (p BETWEEN 6 AND 8) // 2) AND count(*) FILTER (p BETWEEN 6 AND 8) > 0 AS is_double FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) GROUP BY ALL", books=False)
def double_pages(s, d):
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pages = table(s, d, "orders").select(F.col("o_custkey").alias("book_id"), F.row_number().over(order).alias("page"), F.when(F.col("o_orderkey") % 3 == 0, 120).otherwise(110).alias("width"), F.lit(100).alias("height"))
    return layout.is_double_page(pages)


@query("""WITH m AS (SELECT user_id, ts, event_id AS tie, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id % 400 + 1 AS INT) END AS section FROM events),
  g AS (SELECT *, sum(CASE WHEN section IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, tie) AS since FROM m),
  l AS (SELECT *, max(since) OVER (PARTITION BY user_id) AS top, count(*) OVER (PARTITION BY user_id) AS moves FROM g)
  SELECT user_id, arg_max(coalesce(section, 1), tie) AS current, string_agg(CAST(coalesce(section, 1) AS VARCHAR), ',' ORDER BY ts, tie) AS history, any_value(moves) AS moves FROM l WHERE since = top GROUP BY user_id""", books=False)
def session_states(s, d):
    """Where each reader is: events move to a section, errors stand for resets."""
    moves = table(s, d, "events").select("user_id", "ts", F.col("event_id").alias("tie"), F.when(F.col("event_type") != "error", (F.col("event_id") % 400 + 1).cast("int")).alias("section"))
    states = players.session_states(moves)
    return states.select("user_id", "current", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"), "moves")


@query("""WITH RECURSIVE f AS (SELECT s_suppkey AS id, CAST(0 AS BIGINT) AS i, 6 * (s_suppkey % 5 + 7 + s_suppkey % 9 + 6 + s_suppkey % 4 + 6 + s_suppkey % 5 + 4 + s_suppkey % 4 + 3) + 6 AS most, CAST(s_suppkey % 5 + 7 AS INT) AS skill, CAST(s_suppkey % 9 + 6 AS INT) AS stamina, CAST(s_suppkey % 4 + 6 AS INT) AS luck, 0 AS foe, 0 AS wounds,
    [CAST(s_suppkey % 6 + 6 AS INT), CAST(s_suppkey % 3 + 7 AS INT)] AS fs, [CAST(s_suppkey % 5 + 4 AS INT), CAST(s_suppkey % 4 + 3 AS INT)] AS fw, s_suppkey % 2 = 0 AS special FROM supplier
  UNION ALL SELECT id, i + 1, most,
    CASE WHEN own < other AND sp AND d4 BETWEEN 3 AND 4 THEN greatest(0, skill - 1) ELSE skill END,
    CASE WHEN own < other AND NOT (sp AND d4 > 2) THEN greatest(0, stamina - 2) ELSE stamina END,
    CASE WHEN own < other AND sp AND d4 > 4 THEN greatest(0, luck - 1) ELSE luck END,
    CASE WHEN wounds + CASE WHEN own > other THEN 2 ELSE 0 END >= fw[foe + 1] THEN foe + 1 ELSE foe END,
    CASE WHEN wounds + CASE WHEN own > other THEN 2 ELSE 0 END >= fw[foe + 1] THEN 0 ELSE wounds + CASE WHEN own > other THEN 2 ELSE 0 END END, fs, fw, special
  FROM (SELECT *, special AND foe = 0 AS sp, (id * 31 + i * 17 + 28) % 6 + 1 AS d4, (id * 31 + i * 17) % 6 + 1 + (id * 31 + i * 17 + 7) % 6 + 1 + skill AS own,
    (id * 31 + i * 17 + 14) % 6 + 1 + (id * 31 + i * 17 + 21) % 6 + 1 + fs[foe + 1] AS other FROM f WHERE i <= most AND stamina > 0 AND foe < 2))
  SELECT id, skill, stamina, luck, foe AS slain, i AS rounds, CASE WHEN stamina <= 0 THEN 'lost' WHEN foe >= 2 THEN 'won' ELSE 'endless' END AS outcome
  FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1""", books=False)
def fights(s, d):
    """Whole fights against two foes, of which the first may be special."""
    k = F.col("s_suppkey")
    foe = lambda skill, stamina, special: F.struct(skill.cast("int").alias("skill"), stamina.cast("int").alias("stamina"), special.alias("special"))
    rows = table(s, d, "supplier").select(k.alias("id"), (k % 5 + 7).alias("skill"), (k % 9 + 6).alias("stamina"), (k % 4 + 6).alias("luck"), F.array(foe(k % 6 + 6, k % 5 + 4, k % 2 == 0), foe(k % 3 + 7, k % 4 + 3, F.lit(False))).alias("foes"))
    return players.fights(rows)


@query("SELECT user_id, event_type, ts FROM (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL)", books=False)
def stored_upsert(s, d):
    """A table of older rows, and the newest row of each key in their place."""
    e = table(s, d, "events").select("user_id", "event_type", "ts")
    keys = ["user_id", "event_type"]
    old = e.groupBy(*keys).agg(F.min("ts").alias("ts"))
    return players.upsert(old, players.latest(e, keys, ["ts"]), keys)


@query("SELECT CAST(o_orderkey AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) - 1 AS INT) AS line, 'a b' || l_linenumber || ' c' AS text FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_linenumber FROM lineitem)", books=False)
def word_lines(s, d):
    """Words at places of their own, three in each line, the middle one a little lower; found as lines again."""
    base = 700.0 - F.col("l_linenumber") * 20
    word = lambda left, low, text: F.struct(F.lit(left).alias("left"), (base - low + 10).alias("top"), (base - low).alias("bottom"), text.alias("text"))
    three = F.array(word(9.0, 0.0, F.lit("c")), word(1.0, 0.0, F.lit("a")), word(5.0, 2.0, F.concat(F.lit("b"), F.col("l_linenumber").cast("string"))))
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), "l_linenumber").distinct()
    return layout.group_lines(rows.select("page_id", F.inline(three))).select("page_id", "line", "text")


@query("""WITH D AS (SELECT page_id, n, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS k FROM (SELECT DISTINCT l_orderkey AS page_id, l_linenumber AS n FROM lineitem)),
  T AS (SELECT *, 900.0 - k * 12 - k // 3 * 20 AS tp, k > 0 AND k % 3 = 0 AS wide, CASE (page_id + k) % 5 WHEN 0 THEN 'line ' || n WHEN 1 THEN 'a bro-' WHEN 2 THEN 'pages 12 - 14' WHEN 3 THEN n || '.' ELSE 'well- known-' END AS text, (page_id + k) % 5 = 3 AS num FROM D),
  G AS (SELECT *, coalesce(lag(num) OVER w, false) AS behind, lag(tp) OVER w AS above, NOT num AND coalesce(NOT lag(num) OVER w AND ends_with(lag(text) OVER w, '-'), false) AS glued FROM T WINDOW w AS (PARTITION BY page_id ORDER BY n)),
  N AS (SELECT *, k = 0 OR num OR behind OR (wide AND NOT glued) AS fresh, coalesce(lead(glued) OVER w, false) AS hyphen, CASE WHEN behind AND NOT num AND NOT wide THEN above ELSE tp END AS begins FROM G WINDOW w AS (PARTITION BY page_id ORDER BY n)),
  P AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY page_id ORDER BY n) AS para FROM N),
  F AS (SELECT page_id, para - (fresh AND k > 0 AND NOT behind)::INT AS para, sum(20.0 + k) / sum(2 + k % 2) AS font_size, bool_or(k % 4 = 0) AS is_bold FROM P GROUP BY ALL)
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY para) - 1 AS paragraph, text, top_fraction, coalesce(font_size, 0.0) AS font_size, coalesce(is_bold, false) AS is_bold FROM (SELECT page_id, para, trim(string_agg(CASE WHEN glued THEN '' ELSE chr(10) END || CASE WHEN hyphen THEN text[:-2] ELSE text END, '' ORDER BY n), chr(10)) AS text, 1 - arg_min(begins, n) / 1000.0 AS top_fraction FROM P GROUP BY page_id, para)
  LEFT JOIN F USING (page_id, para)""", books=False)
def paragraph_cut(s, d):
    """Lines of one height, after each third of them a wide gap; some end on a hyphen, some hold dashes, some are numbers."""
    page = Window.partitionBy("page_id").orderBy("n")
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("n")).distinct().withColumn("k", F.row_number().over(page) - 1)
    top, n = 900.0 - F.col("k") * 12 - F.floor(F.col("k") / 3) * 20, F.col("n").cast("string")
    said = F.element_at(F.array(F.concat(F.lit("line "), n), F.lit("a bro-"), F.lit("pages 12 - 14"), F.concat(n, F.lit(".")), F.lit("well- known-")), ((F.col("page_id") + F.col("k")) % 5 + 1).cast("int"))
    placed = rows.select("page_id", "n", top.alias("top"), (top - 10).alias("bottom"), said.alias("text"), (20.0 + F.col("k")).alias("font_total"), (2 + F.col("k") % 2).alias("n_words"), (F.col("k") % 4 == 0).alias("is_bold"), F.lit(1000.0).alias("page_height"))
    cut = layout.paragraphs(placed)
    return cut.withColumn("paragraph", (F.row_number().over(Window.partitionBy("page_id").orderBy("paragraph")) - 1).cast("long"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 3 AND 47", books=False)
def body_blocks(s, d):
    """Blocks between the bands of headers and footers."""
    placed = table(s, d, "part").select("p_partkey", "p_name", (F.col("p_size") / 50).alias("top_fraction"))
    return segment.inside_band(placed).select("p_partkey", "p_name")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL", books=False)
def event_windows(s, d):
    """The tumbling windows of the stream of events, over its table."""
    return progress.windowed_counts(table(s, d, "events"))
