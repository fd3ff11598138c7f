"""A deterministic corpus of branching books from the order tables: a book per customer, a section per order, a line per item."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The content of a section without text.
MISSING = "[Text missing or unreadable in PDF]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; in tests on one machine, where it is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if root is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="foliant-"))
    return root or sc.getCheckpointDir()


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, path: str) -> bool:
    place, store = _place(spark, path)
    return store.exists(place)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; what is written there goes when the session ends."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place, store = _place(spark, path)
    store.deleteOnExit(place)
    return path


_made: dict[tuple, str] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Tells a table from one that has been written again: its files' number and bytes, and when it changed."""
    place, store = _place(spark, path)
    held = store.getContentSummary(place)
    return path, held.getFileCount(), held.getLength(), store.getFileStatus(place).getModificationTime()


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The corpus is made once for a session and the state of its tables, and kept as a table in the shared folder until the session ends."""
    key = spark.sparkContext.applicationId, name, *(_state(spark, f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "part"))
    if key not in _made or not folder_exists(spark, _made[key]):
        path = scratch(spark, name)
        make().write.parquet(path)
        _made[key] = path
    return spark.read.parquet(_made[key])


def _say(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, section_number, n_sections, o_orderkey."""
    book = Window.partitionBy("o_custkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), "o_orderkey", F.row_number().over(book.orderBy("o_orderkey")).alias("section_number"), F.count(F.lit(1)).over(book).alias("n_sections"))
    return orders


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, section_number, n_sections, n (0, 1, ...), text."""
    return _once(spark, sf_dir, "lines", lambda: _lines(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = items.join(parts, "l_partkey").join(numbered(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")) - 1
    target = (F.col("l_partkey") % (F.col("n_sections") + 3)).cast("string")
    few = (F.col("l_suppkey") % 5 + 1).cast("string")
    kind = (F.col("l_suppkey") * 7 + F.col("l_partkey")) % 13
    said = [
        _say("If you go on, turn to ", target, "."),
        _say("Turn to ", target, "."),
        _say(F.upper("p_name"), " SKILL ", (F.col("p_size") % 6 + 5).cast("string"), " STAMINA ", (F.col("p_size") % 9 + 4).cast("string")),
        _say("Test your Luck."),
        _say("Lose ", few, " STAMINA points."),
        _say("Add ", few, " days to your LOG."),
        _say("You find a Magic Potion which glows."),
        _say("You gain ", few, " Gold Pieces from the  chest."),
        _say("Roll two dice. Then go to the ", target, "."),
        _say("Your adventure ends here."),
        _say("If you have the Sword of ", F.initcap("p_name"), ", turn to ", target, "."),
        _say("Lose ", few, " LUCK points and deduct ", few, " days from your LOG."),
        _say("The corridor leads  on past a rusty gate."),
    ]
    text = F.lit(None).cast("string")
    for k, s in reversed(list(enumerate(said))):
        text = F.when(kind == k, s).otherwise(text)
    return rows.select("book_id", "section_number", "n_sections", n.alias("n"), text.alias("text"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, section_number, n_sections, content: all sections, those without lines with the placeholder."""
    return _once(spark, sf_dir, "sections", lambda: _sections(spark, sf_dir))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lines(spark, sf_dir).groupBy("book_id", "section_number").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("l"))
    every = numbered(spark, sf_dir).drop("o_orderkey")
    content = F.coalesce(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit(MISSING))
    return every.join(joined, ["book_id", "section_number"], "left").select("book_id", "section_number", "n_sections", content.alias("content"))


#: The same corpus as common table expressions for DuckDB: L (lines) and S (sections).
SQL = f"""
    N AS (SELECT o_custkey AS book_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS section_number,
            count(*) OVER (PARTITION BY o_custkey) AS n_sections FROM orders),
    L0 AS (SELECT book_id, section_number, n_sections,
            row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS n,
            p_name, p_size, CAST(l_partkey % (n_sections + 3) AS VARCHAR) AS t, CAST(l_suppkey % 5 + 1 AS VARCHAR) AS f, (l_suppkey * 7 + l_partkey) % 13 AS k
           FROM lineitem JOIN part ON l_partkey = p_partkey JOIN N ON l_orderkey = o_orderkey),
    L AS (SELECT book_id, section_number, n_sections, n, CASE k
            WHEN 0 THEN 'If you go on, turn to ' || t || '.'
            WHEN 1 THEN 'Turn to ' || t || '.'
            WHEN 2 THEN upper(p_name) || ' SKILL ' || CAST(p_size % 6 + 5 AS VARCHAR) || ' STAMINA ' || CAST(p_size % 9 + 4 AS VARCHAR)
            WHEN 3 THEN 'Test your Luck.'
            WHEN 4 THEN 'Lose ' || f || ' STAMINA points.'
            WHEN 5 THEN 'Add ' || f || ' days to your LOG.'
            WHEN 6 THEN 'You find a Magic Potion which glows.'
            WHEN 7 THEN 'You gain ' || f || ' Gold Pieces from the  chest.'
            WHEN 8 THEN 'Roll two dice. Then go to the ' || t || '.'
            WHEN 9 THEN 'Your adventure ends here.'
            WHEN 10 THEN 'If you have the Sword of ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ', turn to ' || t || '.'
            WHEN 11 THEN 'Lose ' || f || ' LUCK points and deduct ' || f || ' days from your LOG.'
            ELSE 'The corridor leads  on past a rusty gate.' END AS text FROM L0),
    S AS (SELECT N.book_id, N.section_number, N.n_sections, coalesce(c, '{MISSING}') AS content
          FROM N LEFT JOIN (SELECT book_id, section_number, string_agg(text, chr(10) ORDER BY n) AS c FROM L GROUP BY ALL) USING (book_id, section_number))
"""
