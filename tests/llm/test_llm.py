"""The operators on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and against brute force."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import chat, token_records as records
from foliant.llm.decontaminate import decontaminate, find_leaks
from foliant.llm.exact_dedup import build_index, exact_dedup
from foliant.llm.jaccard_join import jaccard_components, near_dedup
from foliant.llm.kernels import PIECE as PIECE_BYTES
from foliant.llm.kernels import column_bytes, word_hashes
from foliant.llm.line_dedup import line_dedup, spread_lines
from foliant.llm.lm_scoring import CLASSES, HALF, PIECE, WINDOW, Model, _first_weights, classes_of, encoded, lm_scores, piece_windows, scored, train, training_pieces
from foliant.llm.mixing import mix, mixed_documents, source_plan, split_tree, taken, without_replacement, write_shards
from foliant.llm.queries import TOKENIZER
from foliant.llm.subwords import Encoder
from foliant.llm.suffix_dedup import suffix_dedup
from foliant.llm.toxicity import fit, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, key string, n long, count long, found string, row string"
RNG = np.random.default_rng(5)
VOCAB = ["".join(RNG.choice(list("abcdefgh"), 5)) for _ in range(60)]


def words(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCAB, n))


LONG = words(120, 1)
ROWS = [(1, LONG, "a"), (2, LONG + " tail", "b"), (3, None, None), (4, "", "a"), (5, " \n ", "b"), (6, LONG.upper(), "c"), (7, words(90, 2), "a"), (7, words(90, 2), "a"), (None, words(40, 3), None), (8, words(3, 4), "a"), (9, words(3, 4), "d"), (10, words(3000, 6), "e"), (11, words(60, 7) + "\n" + LONG, "e")]


LAST = Encoder(TOKENIZER).last
THUE = "a"
while len(THUE) < 4096:
    THUE += THUE.translate(str.maketrans("ab", "ba"))
#: Pairs of different words that polynomials modulo 2^64 can't tell apart, and words beyond the bytes of a piece.
WORDS = [x for n in (64, 1024, 2048, 4096) for x in (THUE[:n], THUE[:n].translate(str.maketrans("ab", "ba")))]
GIANT = " ".join(np.random.default_rng(12).choice(VOCAB, 150_000)) + " " + "z" * 600_000 + " " + " ".join(np.random.default_rng(13).choice(VOCAB, 60_000))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", "k", 1, 2, "f", "r") for i, t, s in rows], SCHEMA)


def lower(t):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())


def sets(t, width=5):
    w = WORD.findall(lower(t))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def test_jaccard_against_brute_force(spark):
    rows = ROWS + [(20 + k, " ".join(w if j % (9 + k) else w + "x" for j, w in enumerate(LONG.split())), "z") for k in range(12)]
    own = [sets(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(own[a] & own[b])
        if own[a] and own[b] and 100 * both >= 75 * (len(own[a]) + len(own[b]) - both):
            root[find(b)] = find(a)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), 1 << 60), r[0])
    want = sorted(((r[0] or -1, len(own[k]), least.get(find(k), -1)) for k, r in enumerate(rows)))
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard_components(frame(spark, rows)).collect())
    assert got == want
    kept = near_dedup(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i) == sorted({c for i, n, c in want if c > 0 and (n or i == c)})


def test_words_that_polynomials_confuse(spark):
    """Such words are different shingles, words and units."""
    assert len(GIANT.encode()) > 3 * PIECE_BYTES
    data = " ".join(WORDS).encode()
    hashes, _ = word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(np.unique(hashes)) == len(WORDS)
    rows = [(k, w, "s") for k, w in enumerate(WORDS)]
    assert all(r["component_id"] == r["doc_id"] for r in jaccard_components(frame(spark, rows)).collect())
    assert all(r["n_known"] == 2 if not r["held_out"] else r["n_known"] == 1 for r in lm_scores(frame(spark, rows), TOKENIZER).collect())
    items = spark.createDataFrame([(k, w) for k, w in enumerate(WORDS)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(frame(spark, rows), items).collect()} == {(k, k) for k in range(len(WORDS))}


def test_encoder_is_the_tokenizer():
    """Ids of any text, in any order, are those of the tokenizer for the whole text."""
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(TOKENIZER), np.random.default_rng(3)
    kinds = ["abcXYZ", "0123456789", " \t\n\x0b", "'<|>.,!-", "éÉßÿÀ×÷Œ", "中文字", "\u0301\u200d", "🙂👍🏽", "\u00a0\u2028\x00\x1c\x85", "İıſK"]
    texts = ["".join(rng.choice(list(kinds[k]), 1)[0] for k in rng.integers(0, len(kinds), n)) for n in rng.integers(0, 60, 3000)]
    texts += ["<|endoftext|> a", "<|ENDOFTEXT|> a", "x<|startoftext|>y", "x<|STARTOFTEXT|>y", "Don't DON'T don't", *WORDS, GIANT, None, ""]
    made = Encoder(TOKENIZER)
    for part in (texts, texts[::-1]):
        ids, at = made.encode(*column_bytes(pa.array(part, pa.string())))
        for t, a, b in zip(part, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == tok.encode(t or "", add_special_tokens=False).ids, (t or "")[:80]


def test_jaccard_of_giant_texts(spark):
    other = GIANT.replace(" ", "\t", 5).upper() + " more words"
    rows = [(1, GIANT, "a"), (2, other, "b"), (3, GIANT[: len(GIANT) // 2], "c")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, rows)).collect()}
    assert got == {k: (len(sets(t)), 3 if k == 3 else 1) for k, t, _ in rows}


def test_jaccard_empty(spark):
    assert jaccard_components(frame(spark, [])).count() == 0


def test_exact_dedup(spark):
    rows = frame(spark, ROWS + [(30, "a b", "a"), (29, "ab", "b"), (31, "a b", "c")])
    got = {(r["doc_id"], r["kept"]): r for r in exact_dedup(rows).collect()}
    assert got[29, False]["keep_id"] == 30 and got[31, False]["keep_id"] == 30 and got[30, True]["group_size"] == 3
    assert got[3, False]["keep_id"] == 5 and got[5, True]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (7, True) in got and (7, False) in got  # repeated rows: one stays
    assert exact_dedup(frame(spark, [])).count() == 0


def test_extendible_index_splits(spark, tmp_path):
    keys = spark.range(500).select(F.when(F.col("id") < 30, F.lit(5).cast("long")).otherwise(F.xxhash64("id")).alias("key"), "id")
    directory, index = build_index(keys, str(tmp_path / "i"), bucket_keys=20)
    assert index.count() == 500 and index.select("id").distinct().count() == 500
    sizes = {(r["slot"], r["depth"]): r["count"] for r in index.groupBy("slot", "depth").count().collect()}
    assert directory.depth == 24 and len({d for _, d in sizes}) > 1
    chain = 5, 24  # thirty records with one key stay together
    assert sizes.pop(chain) == 30 and max(sizes.values()) <= 20 and sizes.keys() <= directory.buckets.keys()


def test_exact_dedup_by_small_buckets(spark):
    rows = [(k, f"text {k % 90}" + " " * (k % 4), "s") for k in range(300)]
    one, two = (sorted(tuple(r) for r in exact_dedup(frame(spark, rows), n).collect()) for n in (5, 100_000))
    assert one == two and sum(r[3] for r in one) == 90


def test_line_dedup(spark):
    rows = [(k, f"own {k}\n  Shared line \nx", f"s{k}") for k in range(5)] + [(9, None, "s"), (10, "", None), (9, "Shared line\nShared line\n\nb", "s1")]
    got = {(r["doc_id"], r["n_lines"]): r for r in line_dedup(frame(spark, rows)).collect()}
    assert got[0, 3]["clean_text"] == "own 0" and got[9, 0]["clean_text"] is None and got[10, 1]["clean_text"] == ""
    assert got[9, 4]["clean_text"] == "\nb" and got[9, 4]["n_removed"] == 2


def test_spread_is_right_by_sketch_alone(spark):
    """Of 6,000 lines on 1 to 12 sites each, those on 5 or more; all but those on 5 by the sketch alone."""
    seen = spark.range(6000).select("id", F.explode(F.sequence(F.lit(1), (F.col("id") % 12 + 1).cast("int"))).alias("site")).select(F.xxhash64("id").alias("key"), F.xxhash64("site", "id").alias("site"), "id")
    want = {r[0] for r in seen.where("id % 12 >= 4").select("key").distinct().collect()}
    for margin in (0.15, 0.0):
        assert {r[0] for r in spread_lines(seen.select("key", "site"), margin=margin).collect()} == want
    assert line_dedup(frame(spark, [])).count() == 0


def targets(sizes, weights, share=1.5, limit=2.0):
    """By the words of the contract, one source after the other."""
    out, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = share * sum(sizes)
    while free:
        per = left / sum(weights[i] for i in free)
        over = [i for i in free if per * weights[i] > limit * sizes[i]]
        for i in over or free:
            out[i] = limit * sizes[i] if over else per * weights[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over] if over else []
    return out


def planned(spark, sizes, shards=16):
    """What is drawn of sources of these sizes, by name, and the ends of groups."""
    sums = spark.createDataFrame([(n, w, 1) for n, w in sizes], "source string, words long, docs long")
    made, ends = source_plan(sums, shards, 7)
    return sorted(made.collect(), key=lambda r: (r["source"] is None, r["source"] or "")), ends.collect()


def test_targets_and_tree(spark):
    got = targets([100, 1000, 10], [5, 2, 1])
    assert got[0] == 200 and got[2] == 20 and abs(sum(got) - 1665) < 1e-9
    for sizes in ([100, 1000, 10], [0, 5], [], [7, 0, 90000, 12, 3, 400, 1, 1, 1, 50_000_000], [3] * 50):
        rows, ends = planned(spark, [(f"s{k:03}", n) for k, n in enumerate(sizes[:-1])] + [(None, n) for n in sizes[-1:]])
        want = targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))])
        assert np.allclose([r["target"] for r in rows], want)
        assert all(0 <= r["drawn"] <= 2 * r["blocks"] and abs(r["drawn"] * r["block"] - r["target"]) <= r["block"] for r in rows)
        assert sum(e["draws"] for e in ends) == sum(r["drawn"] for r in rows) and all(e["ends"][-1] == e["draws"] and math.gcd(e["group_step"], e["draws"]) == 1 for e in ends)
    leaves = split_tree(np.array([40, 3, 0]), 7, np.random.default_rng(1))
    assert leaves.shape == (7, 3) and leaves.sum(axis=0).tolist() == [40, 3, 0] and leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 2
    large = np.array([3 * 10**9, 10, 10**9])
    part = without_replacement(large, 2 * 10**9, np.random.default_rng(1))
    assert part.sum() == 2 * 10**9 and (part <= large).all() and (part >= 0).all()


@pytest.mark.parametrize("few", [100_000, 1])
def test_mix(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr("foliant.llm.mixing.FEW_SOURCES", few)
    rows = [(k, words(20 + k % 50, 100 + k), f"s{k % 3}") for k in range(300)] + ROWS
    one, two = ([tuple(r) for r in mix(frame(spark, rows)).select("doc_id", "size", "source", "source_size", "target", taken(F.col("draws"))).collect()] for _ in range(2))
    assert sorted(one, key=str) == sorted(two, key=str) and len(one) == len(rows)
    assert all(r[5] <= 2 * r[1] for r in one)
    for name in {r[2] for r in one}:
        own = [r for r in one if r[2] == name]
        assert abs(sum(r[5] for r in own) - own[0][4]) <= max(32, 0.05 * own[0][4])
    assert mix(frame(spark, [])).count() == 0
    docs, drawn = frame(spark, rows), mix(frame(spark, rows)).select("doc_id", "draws").collect()
    # each draw is in one shard, and no two take the same words of a text in one epoch
    assert all(0 <= d["shard"] < 16 for r in drawn for d in r["draws"])
    assert all(len({(d["epoch"], d["block"]) for d in r["draws"]}) == len(r["draws"]) for r in drawn)
    made = mixed_documents(docs)
    assert made.columns == docs.columns
    want = sorted([r["doc_id"] or -1 for r in drawn for d in r["draws"] if d["first"] == 0] + [i for i, t, _ in rows if not WORD.findall(lower(t))])
    assert sorted(r["doc_id"] or -1 for r in made.collect()) == want
    write_shards(docs, str(tmp_path / "shards"))
    assert sorted(r["doc_id"] or -1 for r in spark.read.parquet(str(tmp_path / "shards")).collect()) == want
    assert mixed_documents(frame(spark, [])).count() == 0


def test_small_sources_take_their_words(spark):
    """Sources of a few words take their targets to a word; many of them together take 150 %."""
    for size in (1, 5, 40):
        rows, _ = planned(spark, [(f"s{k:04}", size) for k in range(999)])
        assert all(abs(r["block"] * r["drawn"] - r["target"]) <= 1 and r["drawn"] <= 2 * size for r in rows)
        assert abs(sum(r["block"] * r["drawn"] for r in rows) - 1.5 * size * 999) <= 2
    docs = [(k, words(10, k), f"s{k}") for k in range(3)]
    got = [tuple(r) for r in mix(frame(spark, docs)).select("target", taken(F.col("draws"))).collect()]
    assert all(abs(t - n) <= 1 for t, n in got) and sum(n for _, n in got) == 45


@pytest.mark.parametrize("hot", [1000, 3])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr("foliant.llm.suffix_dedup.HOT_CELLS", hot)
    shared = words(40, 50)
    rows = ROWS + [(40 + k, words(10, 60 + k) + shared[k : 140 + k * 7] + words(12, 80 + k) + "é" * k + shared[:130], "s") for k in range(12)] + [(60, "ab" * 400, "s"), (61, "x" * 100, "t"), (62, "x" * 99, "t")]
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, want = set(), []
    for i, t, _ in ordered:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((i or -1, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [(r["doc_id"] or -1, r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup(frame(spark, [])).count() == 0


def test_suffix_dedup_of_giant_texts(spark):
    """A passage that ends one giant text and begins another; runs of one letter repeat themselves."""
    shared = words(60_000, 77)
    one, two = GIANT + shared, shared + " " + words(3000, 78)
    got = {r["doc_id"]: (len(r["kept"]), len(r["spans"])) for r in suffix_dedup(frame(spark, [(1, one, "a"), (2, two, "b"), (3, None, "c")])).collect()}
    seen, want = set(), {3: (0, 0)}
    for k, t in ((1, one), (2, two)):
        b, gone = t.encode(), np.zeros(len(t.encode()) + 1, np.int64)
        for i in range(len(b) - 99):
            h = hash(b[i : i + 100])
            if h in seen:
                gone[i] += 1
                gone[i + 100] -= 1
            seen.add(h)
        off = np.cumsum(gone[:-1]) > 0
        want[k] = (int((~off).sum()), int((np.diff(np.r_[0, off.astype(int)]) == 1).sum()))
    assert got == want


def test_token_records(spark, tmp_path):
    from tokenizers import Tokenizer

    tok, rows = Tokenizer.from_file(TOKENIZER), ROWS + [(50, "Don't É́ 12a <|endoftext|> «ok».", "a")]
    files = records.write_records(frame(spark, rows), str(tmp_path / "t"), TOKENIZER, file_bytes=2000)
    got = [tuple(r) for r in records.read_records(files).orderBy("start").collect()]
    start = 0
    for doc, at, n, crc in got:
        assert at == start
        start += n
    assert [g[0] for g in got] == sorted([r[0] for r in rows], key=lambda i: (i is None, i or 0))
    want = sorted((r[0] or -1, *(lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))(tok.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in rows)
    assert sorted((g[0] or -1, g[2], g[3]) for g in got) == want
    name = [r["file"] for r in files.collect() if r["records"] > 1][0]
    by_id = {(i or -1, len(x)): x for i, x in ((r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows)}
    doc, ids = records.read_record(name, 1)
    assert ids.tolist() == by_id[doc or -1, len(ids)]
    one, two, other = ([(r["doc_id"] or -1, r["ids"]) for r in records.shuffled_records(files, k).collect()] for k in (1, 1, 2))
    assert one == two != other and sorted(one) == sorted(other) and all(x == by_id[i, len(x)] for i, x in one) and len(one) == len(rows)
    index = name.replace("file:", "").replace(".rec", ".idx")
    whole = open(index, "rb").read()
    open(index, "wb").write(whole[:-16])
    with pytest.raises(Exception, match="doesn't fit"):
        records.read_records(files).collect()
    open(index, "wb").write(whole)
    with pytest.raises(ValueError):
        list(records.frames(records.frame(b"abc")[:-1] + b"!"))
    assert records.read_records(records.write_records(frame(spark, []), str(tmp_path / "e"), TOKENIZER)).count() == 0


def test_leaks(spark):
    item = words(30, 90)
    docs = frame(spark, ROWS + [(70, words(2000, 91) + " " + item.upper().replace(" ", ", ") + " " + words(900, 92), "a"), (71, " ".join(item.split()[:15]), "b"), (72, words(50, 9) + " q w " + words(9, 8), "c")])
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "q w"), (5, words(25, 99))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in find_leaks(docs, items, block_chars=150).collect()}
    assert got == {(70, 1): 1.0, (72, 4): 1.0}
    assert docs.count() - decontaminate(docs, items).count() == 2 and decontaminate(docs, items).columns == docs.columns
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0


def test_leaks_against_brute_force(spark):
    """Documents that hold all, three quarters, less, or shuffled parts of items of all sizes."""
    rng = np.random.default_rng(21)
    clean = lambda t: re.sub(r"[!-/:-@\[-`{-~\s]+", " ", t.lower()).split()
    items = [(k, words(n, 300 + k)) for k, n in enumerate([1, 2, 4, 5, 6, 9, 12, 20, 35, 60, 120])] + [(20, words(20, 307)), (21, None), (22, "...")]
    docs = []
    for k in range(160):
        item = (items[k % 11][1]).split()
        cut = int(len(item) * rng.choice([0.5, 0.74, 0.8, 0.9, 1.0]))
        part = item[: max(1, cut)] if k % 3 else rng.permutation(item).tolist()
        docs.append((k, words(int(rng.integers(0, 400)), 500 + k) + " " + ", ".join(part).upper() + "\n" + words(int(rng.integers(0, 200)), 900 + k), "s"))
    docs += [(500, None, "s"), (501, "", "s"), (502, GIANT + " " + items[8][1], "s"), (7, docs[7][1], "s")]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = []
    for i, t, _ in docs:
        for item, text in items:
            own = clean(text or "")
            n = min(5, len(own))
            if n and len(grams(own, n) & grams(clean(t or ""), n)) >= 0.75 * len(grams(own, n)):
                want.append((i, item))
    for block in (100, 2_000_000):
        assert sorted((r["doc_id"], r["item_id"]) for r in find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_chars=block).collect()) == sorted(want)


def test_toxicity_columns(spark):
    """Columns named like those added give way; a graded text has the chosen words, however large the sample."""
    docs = frame(spark, [(k, words(30, k) + (" vile" if k % 4 == 0 else ""), "s") for k in range(200)]).withColumn("Severity", F.lit("x")).withColumn("grade", F.lit(9))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    got = toxicity(docs, labels, sample=80)
    assert [c for c in got.columns if c.lower() in ("severity", "grade", "rejected")] == ["severity", "grade", "rejected"]
    assert all(r["rejected"] == (r["doc_id"] % 4 == 0) for r in got.collect())
    again = {r["doc_id"]: r["severity"] for r in toxicity(docs.repartition(7), labels.repartition(3), sample=80).collect()}
    assert again == {r["doc_id"]: r["severity"] for r in got.collect()}


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    rows = [(k, words(40, k) + (" " + " ".join(rng.choice(["vile", "nasty"], 1 + k % 4)) if k % 5 == 0 else ""), "s") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0), 1) for k in range(200)] + [(999, 1, 0), (3, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    docs = frame(spark, rows + [(500, None, "s"), (501, "", "s")])
    got = {r["doc_id"]: r for r in toxicity(docs, labels).collect()}
    assert all(got[k]["rejected"] == (k % 5 == 0) for k in range(400)) and not got[500]["rejected"]
    assert got[15]["severity"] > got[20]["severity"] and {r["grade"] for r in got.values()} == {0, 1, 2}
    assert toxicity(docs, labels.limit(0)).where("rejected").count() == 0 and toxicity(docs.limit(0), labels).count() == 0
    assert (np.diff(fit(np.zeros(0, np.uint64), [], np.zeros(0)).thresholds) >= 0).all()


def cheapest(roles, limit=3):
    """Least cost by trying all roles, merges and insertions."""
    best = None
    for made in itertools.product(chat.ROLES, repeat=len(roles)):
        change = sum(0 if a == b else chat.RELABEL if b in chat.ROLES else chat.UNKNOWN for a, b in zip(made, roles, strict=True))
        for joins in itertools.product((False, True), repeat=len(roles)):
            state, cost, good = None, change, True
            for r, j in zip(made, joins, strict=True):
                if j:
                    good &= state == r
                    cost += chat.MERGE
                elif r in chat.LEGAL[state]:
                    pass
                elif any(r in chat.LEGAL[x] for x in chat.LEGAL[state]):
                    cost += chat.INSERT
                else:
                    good = False
                state = r
            if good:
                cost += chat.INSERT * {"assistant": 0, "user": 1, "system": 2}[state]
                best = cost if best is None else min(best, cost)
    return best


def test_repair_is_cheapest():
    for n in (1, 2, 3, 4):
        for roles in itertools.product(("system", "user", "assistant", None), repeat=n):
            assert chat.repair(list(roles))[0] == cheapest(roles), roles


def render(roles, texts):
    """The cheapest legal turns by trying all roles, merges and insertions, as text: what a repaired conversation may be rendered as."""
    best, cost = set(), cheapest(roles)
    for made in itertools.product(chat.ROLES, repeat=len(roles)):
        change = sum(0 if a == b else chat.RELABEL if b in chat.ROLES else chat.UNKNOWN for a, b in zip(made, roles, strict=True))
        for joins in itertools.product((False, True), repeat=len(roles)):
            for gaps in itertools.product((False, True), repeat=len(roles) + 1):
                turns, paid, good = [], change, True
                for r, t, j, gap in zip(made, texts, joins, gaps[:-1], strict=True):
                    if j:
                        good &= bool(turns) and turns[-1][0] == r and not gap
                        paid += chat.MERGE
                        if good:
                            turns[-1] = (r, turns[-1][1] + "\n" + t)
                        continue
                    last = turns[-1][0] if turns else None
                    if gap:
                        middle = [x for x in chat.LEGAL[last] if r in chat.LEGAL[x]]
                        good &= bool(middle) and r not in chat.LEGAL[last]
                        turns += [(middle[0], "")] if middle else []
                        paid += chat.INSERT
                    elif r not in chat.LEGAL[last]:
                        good = False
                    turns.append((r, t))
                if not (good and turns) or gaps[-1]:
                    continue
                last = turns[-1][0]
                for x in {"assistant": [], "user": ["assistant"], "system": ["user", "assistant"]}[last]:
                    turns.append((x, ""))
                    paid += chat.INSERT
                if paid == cost:
                    best.add("".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns))
    return best


def test_rendered_chats_are_cheapest(spark):
    cases = [c for n in (1, 2, 3) for c in itertools.product(("system", "user", "assistant", "bot"), repeat=n)]
    rows = [(k, i, role, f"t{i}") for k, roles in enumerate(cases) for i, role in enumerate(roles)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["rendered"] for r in chat.format_chats(docs.repartition(3)).collect()}
    for k, roles in enumerate(cases):
        known = [r if r in chat.ROLES else None for r in roles]
        assert got[k] in render(known, [f"t{i}" for i in range(len(roles))]), roles
    assert chat.format_chats(docs.limit(0)).count() == 0


def test_chats(spark):
    rows = [(1, 1, "assistant", "hi"), (1, 0, "user", None), (2, 0, "user", "a"), (2, 1, "user", "b"), (2, 2, "assistant", "c"), (None, None, None, "x"), (3, 5, "USER ", "q")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["cost"] == 0 and got[2]["n_merges"] == 1 and got[3]["n_inserts"] == 1 and set(got) == {None, 1, 2, 3}
    assert got[2]["rendered"] == "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_lm_scores(spark):
    rows = [(k, words(80, 200 + k), "s") for k in range(60)] + ROWS
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm_scores(frame(spark, rows), TOKENIZER).collect()}
    count, own = {}, {}
    for i, t, _ in rows:
        w = [*WORD.findall(lower(t)), b"\n"]
        own[i, len(w)] = w
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for key, w in own.items():
        r = got[key]
        assert r["train_tokens"] == n and r["n_known"] == sum(x in count for x in w)
        assert abs(r["base_score"] - sum(np.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w)) < 1e-6 * max(1, abs(r["base_score"]))
        assert r["score"] < 0
    assert lm_scores(frame(spark, []), TOKENIZER).count() == 0


def texts_of(spark, texts):
    rows = spark.createDataFrame([(k, k, False, t) for k, t in enumerate(texts)], "doc_id long, tie long, held_out boolean, text string")
    return encoded(rows.coalesce(1), TOKENIZER, 49407)


def learned(spark, texts):
    """Targets of all training windows, by window; and the texts' ids by the tokenizer."""
    from tokenizers import Tokenizer

    rows = training_pieces(texts_of(spark, texts), 49407).toArrow().combine_chunks()
    tok = Tokenizer.from_file(TOKENIZER)
    return piece_windows(rows.column("ids").combine_chunks(), rows.column("first").to_numpy(), 49407), [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_lm_learns_whole_texts(spark):
    """Each id of a long text is a target once, in order, after the ids that stand before it."""
    (windows, absent, _), (ids,) = learned(spark, [words(4000, 7)])
    assert len(ids) > 2 * PIECE * HALF
    got = windows[:, HALF + 1 :].ravel().tolist()[: len(ids)]
    assert len(got) >= len(ids) - HALF + 1 and got == ids[: len(got)]
    assert windows[1:, : HALF + 1].tolist() == windows[:-1, HALF:].tolist() and absent.tolist() == [HALF] + [0] * (len(windows) - 1)


def test_lm_learns_ends_tails_and_short_texts(spark):
    """Targets are all ids and the end of each text, short, empty and without blanks too; what fills a window is none."""
    texts = ["x", None, words(3, 8), "z" * 3000, "\u4e2d" * 700, words(500, 9)]
    (windows, absent, many), lists = learned(spark, texts)
    got = [w[HALF + 1 : HALF + 1 + n].tolist() for w, n in zip(windows, many, strict=True)]
    assert [i for w in got for i in w] == [i for ids in lists for i in [*ids, 49407]]
    assert (absent == HALF).sum() == len(texts)


def test_lm_classes():
    """Each id has a class, ends of words and other ids never one, and the within-class chances of a class add up to one."""
    counts = np.random.default_rng(3).zipf(1.3, len(LAST)) + 1.0
    for some in (counts, np.ones(len(LAST))):
        classes = classes_of(some, LAST)
        assert classes.min() >= 0 and classes.max() < CLASSES and not set(classes[LAST]) & set(classes[~LAST])
        assert (np.bincount(classes, minlength=CLASSES) == 1).sum() >= CLASSES * 3 // 4


def test_lm_gradients():
    """Gradients are those of the loss, by small changes of weights."""
    rng = np.random.default_rng(6)
    model = Model({k: v.astype(np.float32) for k, v in _first_weights(1, rng.integers(1, 900, CLASSES)).items()}, None, None, 0)
    rows, absent, many = rng.integers(0, CLASSES, (8, WINDOW + 1)), np.array([HALF, 0, 3, 0, 0, 0, 0, 0]), np.array([HALF, 3, HALF, HALF, 1, HALF, HALF, HALF])
    args = rows[:, :-1], absent, rows[:, HALF + 1 :], many
    _, g = model.step(*args)
    for name, weight in model.weights.items():
        for at in rng.integers(0, weight.size, 6):
            at = np.unravel_index(int(np.abs(g[name]).argmax()) if at % 2 else at, weight.shape)
            had, losses = weight[at], []
            for move in (0.02, -0.02):
                weight[at] = had + move
                losses.append(model.step(*args)[0])
            weight[at] = had
            assert abs((losses[0] - losses[1]) / 0.04 - g[name][at]) < 2e-3, (name, at)


def test_lm_step_ignores_what_fills_a_window():
    model, rng = Model(_first_weights(1, np.zeros(CLASSES)), None, None, 0), np.random.default_rng(2)
    one = rng.integers(0, CLASSES, (3, WINDOW + 1))
    two, many, none = one.copy(), np.array([HALF, 5, 1]), np.array([HALF, 0, 0])
    two[1, HALF + 6 :], two[2, HALF + 2 :] = 0, 0
    (a, g), (b, h) = (model.step(x[:, :-1], none, x[:, HALF + 1 :], many) for x in (one, two))
    assert abs(a - b) < 1e-6 and all(np.allclose(g[k], h[k], atol=1e-6) for k in g)


def test_lm_scores_are_those_of_the_windows(spark):
    """What scores() adds up for whole texts is what log_chances() says of each window, one window at a time; chances add up to one."""
    rng = np.random.default_rng(4)
    classes = rng.integers(0, CLASSES, 500)
    model = Model(_first_weights(3, rng.integers(1, 900, CLASSES)), classes, rng.normal(-1, 1, 500), 7)
    texts = [rng.integers(0, 500, n) for n in (0, 1, 15, 16, 17, 33, 200)]
    got = model.scores(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    for ids, score in zip(texts, got, strict=True):
        line, total = [7] * (HALF + 1) + [*ids, 7], 0.0
        for k in range(0, len(ids) + 1, HALF):
            window = (line[k : k + WINDOW] + [7] * WINDOW)[:WINDOW]
            y = model.log_chances(classes[[window]], np.array([max(0, HALF - k)]))[0]
            assert np.allclose(np.exp(y).sum(axis=1), 1)
            for j, target in enumerate(line[k + HALF + 1 : k + WINDOW + 1]):
                total += y[j, classes[target]] / np.log(10) + model.within[target]
        assert abs(total - score) < 1e-3 * max(1, abs(total))


def test_lm_does_not_depend_on_the_layout(spark):
    docs = [words(300, k) for k in range(40)]
    texts = texts_of(spark, docs)
    one = train(texts, LAST, 49407, shard_ids=4000)
    two = train(texts.repartition(5), LAST, 49407, shard_ids=4000)
    assert all(np.array_equal(one.weights[k], two.weights[k]) for k in one.weights)
    got = {r["doc_id"]: r["score"] for r in scored(texts.repartition(3), one).collect()}
    assert all(abs(r["score"] - got[r["doc_id"]]) < 1e-6 * abs(r["score"]) for r in scored(texts, two).collect())


def test_lm_beats_subword_frequencies_on_held_out_texts(spark):
    """In prose, context must help: a better score than the subword ids' own frequencies in the training texts give."""
    from tokenizers import Tokenizer

    tok, docs, ids = Tokenizer.from_file(TOKENIZER), spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), {}
    got = {r["doc_id"]: r for r in lm_scores(docs, TOKENIZER).collect()}
    lists = {r["doc_id"]: [*tok.encode(r["text"], add_special_tokens=False).ids, 49407] for r in docs.collect()}
    for k, own in lists.items():
        for i in own if not got[k]["held_out"] else ():
            ids[i] = ids.get(i, 0) + 1
    total = sum(ids.values())
    held = [k for k in lists if got[k]["held_out"]]
    alone = sum(np.log10((ids.get(i, 0) + 1) / (total + len(ids) + 1)) for k in held for i in lists[k])
    assert held and sum(got[k]["score"] for k in held) > alone


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs.columns, stage(spark, docs, d)
        assert docs.columns == before, name
    assert corpus_pipeline.run(spark, d).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage's rows by plain rules, on the stage's own input: nulls, blanks, copies, leaks, giant and toxic texts, extra columns of clashing names."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    item = words(25, 90)
    rows = [(k, words(40 + k % 30, 400 + k) + (" vile nasty" if k % 6 == 0 else ""), f"s{k % 4}") for k in range(180)]
    rows += [(200, rows[1][1], "s1"), (201, rows[1][1] + " more", None), (202, words(90, 5) + " " + item, "s2"), (203, None, "s1"), (204, "", None), (205, " \n", "s2"), (206, GIANT, "s3"), (207, words(3, 8), "s3"), (208, words(3, 8).upper(), "s3"), (7, rows[7][1], "s3"), (None, words(50, 11), "s0")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 6 == 0), None) for k in range(170)] + [(None, 1, 1)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none.parquet"))
    ids = lambda docs: sorted(r["doc_id"] or -1 for r in docs.collect())
    stage, d = dict(corpus_pipeline.STAGES), str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    one = stage["toxicity"](spark, docs, d)
    assert ids(one) == sorted(i or -1 for i, t, _ in rows if " vile" not in (t or ""))
    two = stage["ngram_jaccard_join"](spark, one, d)
    own = [(r["doc_id"], r["text"], sets(r["text"])) for r in one.collect()]
    root = list(range(len(own)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(range(len(own)), 2):
        both = len(own[a][2] & own[b][2])
        if own[a][2] and 100 * both >= 75 * (len(own[a][2]) + len(own[b][2]) - both):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(own):
        least[find(k)] = min(least.get(find(k), 1 << 60), 1 << 59 if i is None else i)
    assert ids(two) == sorted(-1 if i == 1 << 59 else i for i in least.values())
    three = stage["decontamination"](spark, two, d)
    assert ids(three) == [i for i in ids(two) if i != 202]
    four = stage["source_mix"](spark, three, d)
    times, size = {}, {r["doc_id"]: len(WORD.findall(lower(r["text"]))) for r in three.collect()}
    for r in four.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times.keys() <= size.keys() and all(n <= 2 for n in times.values()) and all(times[i] == 1 for i, n in size.items() if n == 0)
    kept = stage["token_records"](spark, four, d)
    tok = Tokenizer.from_file(TOKENIZER)
    made = [(r["doc_id"] or -1, [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in four.collect()]
    got = sorted(tuple(r) for r in kept.select(F.coalesce("doc_id", F.lit(-1)), "n_tokens", "ids_crc32").collect())
    assert got == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in made)
    empty = spark.read.parquet(f"{d}/none.parquet")
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, d).count() == 0, name
