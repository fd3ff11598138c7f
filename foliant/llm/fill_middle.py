"""Fill-in-the-middle: texts are cut in three at seeded places and put together in another order.

A text is a big integer with a bit for each of its bytes: bytes.translate gives the masks of byte classes, shifted boolean
operations mark where units begin, bit_count counts them, and recursive halving finds the byte at which the k-th begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers in front of prefix, suffix and middle; a text that holds one of them stays as it is.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, how many are cut, and of 100 of those, how many have the suffix in front.
CUT, SUFFIX_FIRST = 90, 20
#: Bits below which halving ends and bytes are counted off one by one.
SMALL = 64

#: Tables for bytes.translate: "1" for a byte of the class, "0" for others.
CONTINUES = bytes(49 if 0x80 <= b < 0xC0 else 48 for b in range(256))
BLANK = bytes(49 if b in (9, 10, 11, 12, 13, 32) else 48 for b in range(256))
BREAK = bytes(49 if b == 10 else 48 for b in range(256))


def mask(data: bytes, table: bytes) -> int:
    """A bit for each byte of the class; the first byte has the highest of len(data) bits."""
    return int(data.translate(table), 2) if data else 0


def begins(data: bytes, unit: str = "char") -> int:
    """A bit for each byte with which a unit begins: a code point, a word with the blanks after it, or a line with its break.

    Blanks in front of the first word are a unit of their own. Bytes that are no UTF-8 go with what stands before them if
    they are continuation bytes, else alone.
    """
    n = len(data)
    if not n:
        return 0
    every, first = (1 << n) - 1, 1 << (n - 1)
    if unit == "char":
        return every ^ mask(data, CONTINUES) | first
    if unit == "word":
        blank = mask(data, BLANK)
        return ~blank & (blank >> 1) & every | first
    if unit == "line":
        return mask(data, BREAK) >> 1 | first
    raise ValueError(f"no such unit: {unit}")


def place(bits: int, n: int, k: int) -> int:
    """Where the k-th set bit (from 0) of n bits stands, from the highest on; n if there are no more than k."""
    if k >= bits.bit_count():
        return n
    at = 0
    while n > SMALL:
        low = n // 2
        upper = bits >> low
        before = upper.bit_count()
        if k < before:
            bits, n = upper, n - low
        else:
            bits, k, at, n = bits & ((1 << low) - 1), k - before, at + n - low, low
    for i in range(n):
        if bits >> (n - 1 - i) & 1:
            if not k:
                return at + i
            k -= 1
    raise AssertionError("counted above")


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the SHA-256 of "seed:doc_id"; a null id is empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def cut(data: bytes, doc_id: int | None, seed: int = 1, unit: str = "char") -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, units of prefix and of middle (none if plain), and the text in its form."""
    bits, n = begins(data, unit), len(data)
    units = bits.bit_count()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or h3 % 100 >= CUT or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return units, "plain", None, None, data
    first, last = sorted((h1 % (units + 1), h2 % (units + 1)))
    a, b = place(bits, n, first), place(bits, n, last)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return units, "spm", first, last - first, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return units, "psm", first, last - first, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


MADE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("output", pa.binary())])
#: Bytes of output after which a batch is handed on.
OUT = 8 << 20


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = "char") -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units, output (binary): one row per row of docs (doc_id, text), in one pass without a shuffle.

    Prefix and middle end after ranked units, whose ranks follow from seed and doc_id alone, so reruns agree; repeated rows
    are cut alike, and rows of one id and different texts each by its own length. Form: psm (prefix, suffix, middle), spm (suffix
    first), or plain for a tenth of the texts, empty ones (null counts as empty) and those that hold a marker. A null doc_id
    counts as empty in the seed. An empty table gives no rows; other columns are ignored. A task has one text's masks in
    memory at once, an eighth of the text's size each.
    """
    if unit not in ("char", "word", "line"):
        raise ValueError(f"no such unit: {unit}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                i = doc_id.as_py()
                rows.append((i, *cut(text.as_py() or b"", i, seed, unit)))
                size += len(rows[-1][-1])
                if size > OUT:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, form string, prefix_units long, middle_units long, output binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(MADE)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MADE, strict=True)], schema=MADE)


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, as a string, from output (a string) and form alone: parts end where the next marker begins."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)  # noqa: E731  none of the parts holds a marker
    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
