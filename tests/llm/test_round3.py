"""Fill-in-the-middle, url filters and source divergence on small rows and against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import divergence, url_filter
from foliant.llm.divergence import audit_sources, pair_sums, share, shares, terms_of
from foliant.llm.fill_middle import begins, cut, fill_in_middle, place, restored
from foliant.llm.url_filter import DigestArray, filter_urls, judged, suffixes

GIANT = "päßt ☃\n" * 200_000
TEXTS = [(1, "hello wörld ☃ 🤖"), (2, None), (3, ""), (4, "with <S> inside"), (5, "x"), (6, " \n\t "), (None, "no id"), (7, GIANT), (8, "a\U0001f926\U0001f3fc‍♂️b"), (9, "<P"), (9, "<P"), (9, "M>")] + [(k, f"text {k} ä" * (k % 7)) for k in range(20, 320)]
DOCS = "doc_id long, text string, n long, form string, output string, term string, value long"


def units_of(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return re.findall(r"^[ \t\n\r\x0b\x0c]+|[^ \t\n\r\x0b\x0c]+[ \t\n\r\x0b\x0c]*", text)


def middle_by_hand(doc_id, text, unit="char"):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    own = units_of(text, unit)
    n = len(own)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (own[:a], own[a:b], own[b:]))
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fill_in_middle_against_brute_force(spark, unit):
    docs = spark.createDataFrame([(i, t, 1, "f", "o", "t", 2) for i, t in TEXTS], DOCS)
    made = fill_in_middle(docs, unit=unit).withColumn("output", F.col("output").cast("string"))
    rows = made.withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *middle_by_hand(i, t, unit), t or "") for i, t in TEXTS]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in rows), key=key) == sorted(want, key=key)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(docs, unit="page")


def test_ranked_bits():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 1000):
        bits = int("".join(rng.choice(["0", "1"], n)), 2)
        set_ = [k for k in range(n) if bits >> (n - 1 - k) & 1]
        assert [place(bits, n, k) for k in range(len(set_) + 2)] == [*set_, n, n]
    assert begins(b"\x80\x80a", "char").bit_count() == 2  # stray continuation bytes
    assert cut(b"\xffab", 5)[0] == 3


def test_cut_marks_that_touch():
    """Parts that end or begin with pieces of a marker come back."""
    for text in ("<", "<<P", "S><M", "P><S", "<S<P<M"):
        for i in range(200):
            _, form, _, _, out = cut(text.encode(), i)
            if form != "plain":
                parts = re.fullmatch(r"<P>(.*)<S>(.*)<M>(.*)", out.decode()) if form == "psm" else re.fullmatch(r"<S>(.*)<P>(.*)<M>(.*)", out.decode())
                p, s, m = parts.groups() if form == "psm" else (parts[2], parts[1], parts[3])
                assert p + m + s == text


URLS = [None, "", "no scheme", "http://a.net/x", "HTTP://A.Example.NET/en/1?q#f", "http://example.net/en", "https://b.example.com/de/2", "https://notexample.com/de/2", "http://x.org/fr/#top", "http://x.org/FR/", "http://net", "http://net?x", "://net/", "a://b://net/", "http://deep.er.example.net/en/ü/" + "p" * 5000, "http://" + "l." * 3000 + "net/x", "http://net./", "ftp://a.net:80/", "http://\nnet/\n", "http://b.c/xy", "http://a.b.c/xy"]
RULES = [("net", "/", "block"), ("Example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("example.com", "/de/", "allow"), ("org", "/fr/", "allow"), ("b.c", "/x", "allow"), ("c", "/xy", "block"), ("only.host", None, "block"), (None, "/a", "block"), ("x", "no slash", "block"), ("y", "/", None), ("y", "/", "maybe"), ("", "/", "block")]


def verdict_by_hand(url):
    at = (url or "").find("://")
    host, path = "", ""
    if at >= 0:
        host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", url[at + 3 :], re.S).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = {}
    for h, p, v in RULES:
        if h and v in ("allow", "block") and (p is None or p.startswith("/")):
            h, p = h.lower(), p or ""
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits[h + p] = max(fits.get(h + p, (False, 0, 0, "")), ((v == "block"), len(h + p), len(h), v))
    if not fits:
        return host, path, None, "allow"
    rule = max(fits, key=lambda r: fits[r][1:3])
    return host, path, rule, "block" if fits[rule][0] else "allow"


@pytest.mark.parametrize("mapped", [url_filter.MAPPED, 0])
def test_urls_against_brute_force(spark, mapped):
    pages = spark.createDataFrame([(k, u, "h", "p", "r", "v") for k, u in enumerate(URLS)] + [(None, URLS[4], "h", "p", "r", "v")] * 2, "page_id long, url string, host string, path string, rule string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted((tuple(r) for r in filter_urls(pages, rules, mapped=mapped).collect()), key=str)
    assert got == sorted([(k, *verdict_by_hand(u)) for k, u in enumerate(URLS)] + [(None, *verdict_by_hand(URLS[4]))] * 2, key=str)
    assert filter_urls(pages.limit(0), rules, mapped=mapped).count() == 0
    none = filter_urls(pages, rules.limit(0), default="block", mapped=-1 if mapped == 0 else mapped).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")}


def test_digest_collisions():
    """With digests of one or two bits nearly all keys collide; the stored strings still tell them apart."""
    rng = np.random.default_rng(4)
    rules = sorted({(f"{'abc'[k % 3]}{k % 11}.de/" + "xyz"[: k % 4], bool(k % 2)) for k in range(40)})
    rules = [(r.encode(), b) for r, b in dict(rules).items()]
    urls = [(f"w.{'abcd'[k % 4]}{k % 13}.de".encode(), b"/" + b"xyzz"[: k % 5]) for k in rng.permutation(300).tolist()]
    for most in (1, 3, 1 << 62):
        key = lambda keys, most=most: url_filter.digests(keys) % np.uint64(most)
        array = DigestArray(np.frombuffer(DigestArray.packed(rules, key), np.uint8))
        got = judged(array, urls, key)
        for (host, path), found in zip(urls, got, strict=True):
            fits = [(r, b) for r, b in rules if host.endswith(b"." + r.partition(b"/")[0]) and path.startswith(b"/" + r.partition(b"/")[2])]
            assert found == (max(fits, key=lambda f: len(f[0])) if fits else None)
    assert suffixes(b"a.b.c", 3) == [b"b.c", b"c"] and suffixes(b"abcdef", 3) == [] and suffixes(b"", 3) == [b""]


def audit_by_hand(docs, least, top):
    docs = [tuple(x or "" for x in r) for r in docs]
    counts, seen, groups = {}, {}, {(lang, source) for _, lang, source in docs}
    for text, lang, source in docs:
        own = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in own]
        counts.setdefault((lang, source), Counter()).update(own)
        seen.setdefault(lang, Counter()).update(set(own))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in seen[lang].items() if n >= least}
        sources = sorted(s for g, s in groups if g == lang)
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))
        whole = sum((counts[lang, s] for s in sources), Counter())
        own = {s: {t: p(counts[lang, s], t) for t in kept} for s in sources}
        q = {t: p(whole, t) for t in kept}
        utf = lambda r: (-r[1], r[0].encode())
        for s in sources:
            pairs = [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, own[s][t] - q[t]) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            out += [(lang, s, "pair", i, v, k + 1) for k, (i, v) in enumerate(sorted(pairs, key=utf))]
            out += [(lang, s, "term", i, v, k + 1) for k, (i, v) in enumerate(sorted(terms, key=utf)[:top])]
    return sorted(out)


def audit_rows(kind):
    rng = np.random.default_rng(9)
    vocab = [f"{a}{b}" for a in ("w", "É", "ß", "日", "Zz") for b in ("a", "b", "ö", "cc", "D", "é", "f", "g")]
    docs = []
    for k in range(400):  # a third of all rows in one source
        source = "hot" if k % 3 == 0 else f"s{k % 9}"
        some = rng.choice(vocab[: 8 + k % 33], int(rng.integers(0, 30)))
        docs.append((" 1".join(some) + "-tail", "en" if k % 4 else "de", source))
    docs += [(None, None, None), ("", "en", "empty"), (None, "xx", "b"), ("only here", "xx", "a"), ("wa wa", "en", None), docs[0], docs[0]]
    return [d for d in docs if kind == "all" or d[1] == "xx"]


@pytest.mark.parametrize("heavy,block,slice_rows", [(0.25, 512, 50_000), (0.0, 3, 20), (2.0, 4, 7), (0.5, 1, 50)])
def test_divergence_against_brute_force(spark, heavy, block, slice_rows):
    docs = audit_rows("all")
    rows = spark.createDataFrame([(t, g, s, "x", 1, 2) for t, g, s in docs], "text string, lang string, source string, item string, value long, rank long")
    got = audit_sources(rows, 5, 7, heavy, block, slice_rows)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == audit_by_hand(docs, 5, 7)


def test_divergence_edges(spark):
    schema = "text string, lang string, source string"
    assert audit_sources(spark.createDataFrame([], schema)).count() == 0
    alone = audit_rows("xx")
    assert sorted(map(tuple, audit_sources(spark.createDataFrame(alone, schema)).collect())) == audit_by_hand(alone, 30, 50)
    long = ("näh " * 600_000 + "z" * 3_000_000, "en", "s")  # more than a piece, and a term longer than one
    few = [long, ("näh B", "en", "t")]
    assert sorted(map(tuple, audit_sources(spark.createDataFrame(few, schema), 1).collect())) == audit_by_hand(few, 1, 50)


def test_terms_at_the_ends_of_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 5)
    text = "ab cdefghijk,Lm é é n 0 opqrstu".encode()
    assert sum(terms_of(text), []) == [t.lower() for t in re.findall(rb"[A-Za-z\x80-\xff]+", text)]


def test_shares_beyond_64_bits(spark):
    n = np.array([0, 1, 5, 10**12 + 7, 9 * 10**14], dtype=np.int64)
    total = np.array([5, 3, 5, 3 * 10**13 + 1, 9 * 10**14 + 2], dtype=np.int64)
    want = [1 + 10**9 * a // b for a, b in zip(n.tolist(), total.tolist(), strict=True)]
    assert shares(n, total).tolist() == want
    got = spark.createDataFrame(list(zip(n.tolist(), total.tolist(), strict=True)), "n long, t long").select(share(F.col("n"), F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == want


def test_pair_sums_of_both_parts():
    """Tiles and postings give the same sums as the shares themselves."""
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (30, 6)) * rng.integers(0, 2, (30, 6))
    totals = counts.sum(axis=0) + 5 * len(counts)
    p, base = shares(counts + 5, totals), shares(np.full(6, 5), totals)
    want = np.array([[np.abs(p[:, i] - p[:, j]).sum() - len(counts) * abs(base[i] - base[j]) for j in range(6)] for i in range(6)])
    term, source = np.nonzero(counts)
    args = term, source, counts[term, source], (counts > 0).sum(axis=1)[term], totals, 6
    off = ~np.eye(6, dtype=bool)
    for heavy in (0.0, 0.4, 2.0):
        assert (pair_sums(*args, None, heavy)[off] == want[off]).all()
        assert (pair_sums(*args, 2, heavy) == want[:2, 2:]).all()


def test_chats_without_id_stay_apart(spark):
    from foliant.llm.chat import format_chats

    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (None, 0, "user", "alone"), (None, 1, "assistant", "answer"), (None, 0, "user", "alone")]
    got = format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id or 0, r.n_turns) for r in got) == [(0, 1), (0, 1), (0, 1), (1, 2)]
    assert sum("alone" in r.rendered for r in got) == 2 and not any("alone" in r.rendered and "answer" in r.rendered for r in got)


def test_copies_of_a_text_train_in_all_shards(spark):
    from foliant.llm.lm_scoring import encoded, training_pieces
    from foliant.llm.queries import TOKENIZER

    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.lit(0).cast("long").alias("tie"), F.lit(False).alias("held_out"))
    pieces = training_pieces(encoded(rows, TOKENIZER, 49407), 49407).select(F.pmod(F.shiftright("place", 8), F.lit(8)).alias("shard"))
    sizes = [r["count"] for r in pieces.groupBy("shard").count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 900 and max(sizes) < 2 * 900 / 8


def test_rows_without_id_are_mixed_apart(spark):
    from foliant.llm.mixing import PARTS, _part, mix, taken

    docs = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("some words of "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    largest = docs.withColumn("tie", F.xxhash64("text")).groupBy(_part(7)).count().agg(F.max("count")).collect()[0][0]
    assert PARTS >= 512 and largest < 10
    out = mix(docs).select("size", taken(F.col("draws")).alias("n"), "target").collect()
    assert len(out) == 900 and abs(sum(r.n for r in out) - out[0].target) <= 0.02 * out[0].target


def test_lookup_of_many_hot_keys(spark, monkeypatch):
    from foliant.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 2)
    monkeypatch.setattr(shared, "HOT_KEYS", 3)
    rows = spark.range(400).select(F.expr("CAST(sqrt(id) AS LONG)").alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    out = shared.lookup(rows, table, ["k"], "n")
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()
    assert sorted((r.id, r.least) for r in out.collect()) == [(i, int(i**0.5) ** 2) for i in range(400)]


def test_severity_fit_is_the_optimum():
    """The cumulative-link fit against Newton steps with numerical derivatives of the same loss, written out text by text."""
    from foliant.llm.toxicity import fit

    rng = np.random.default_rng(6)
    words, toxic = np.arange(10, 14, dtype=np.uint64), (rng.random(80) < 0.5).astype(np.int64)
    rows = []
    for t in toxic:
        own = np.flatnonzero(rng.random(4) < (0.7 if t else 0.25))
        rows.append((own, rng.integers(1, 6 if t else 3, len(own)).astype(float)))
    hits = [c.sum() for _, c in rows]
    middle = np.quantile([h for h, t in zip(hits, toxic, strict=True) if t], 0.5)
    grade = [0 if not t else 2 if h > middle else 1 for h, t in zip(hits, toxic, strict=True)]

    def loss(theta):
        ends = [-np.inf, theta[4], theta[4] + np.exp(theta[5]), np.inf]
        below = lambda t, eta: 1 / (1 + np.exp(-(t - eta)))
        total = 0.0
        for (own, counts), y in zip(rows, grade, strict=True):
            eta = sum(np.log1p(c) * theta[w] for w, c in zip(own, counts, strict=True))
            total -= np.log(below(ends[y + 1], eta) - below(ends[y], eta))
        return total / len(rows) + 5e-4 * (theta[:4] ** 2).sum()

    theta, h, unit = np.zeros(6), 1e-4, np.eye(6)
    with np.errstate(over="ignore"):
        for _ in range(30):
            g = np.array([(loss(theta + h * e) - loss(theta - h * e)) / (2 * h) for e in unit])
            hess = np.array([[(loss(theta + h * (e + f)) - loss(theta + h * (e - f)) - loss(theta - h * (e - f)) + loss(theta - h * (e + f))) / (4 * h * h) for f in unit] for e in unit])
            step, scale = np.linalg.solve(hess + 1e-6 * unit, g), 1.0
            while loss(theta - scale * step) > loss(theta) and scale > 1e-6:
                scale /= 2
            theta = theta - scale * step
        made = fit(words, rows, toxic)
        found = np.concatenate([made.weights, [made.thresholds[0], np.log(made.thresholds[1] - made.thresholds[0])]])
        assert np.abs(g).max() < 1e-5 and loss(found) < loss(theta) + 1e-4
    assert np.allclose(made.weights, theta[:4], atol=0.05) and np.allclose(made.thresholds, [theta[4], theta[4] + np.exp(theta[5])], atol=0.05)


def test_toxicity_of_giant_texts(spark):
    from foliant.llm.toxicity import toxicity

    rng = np.random.default_rng(4)
    clean = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], n))
    docs = [(k, clean(30) + (" vileword filthword" * 3 if k % 2 else "")) for k in range(200)]
    docs += [(900, clean(300_000)), (901, "vileword filthword " * 60_000), (902, clean(200_000) + " " + "z" * 1_500_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(df, labels).select("doc_id", "severity", "rejected").collect()}
    assert got[901].rejected and not got[900].rejected and not got[902].rejected and len(got) == 203
    assert all(got[k].rejected == bool(k % 2) for k in range(200))


def test_toxic_stems_are_known_by_rare_forms(spark):
    """Each form of a stem is rare, and some unlabelled texts have forms that no labelled text has; a single toxic word suffices."""
    from foliant.llm.toxicity import toxicity

    rng = np.random.default_rng(21)
    tails = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(400)]
    clean = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été"], 30 + k % 9))
    docs = [(k, clean(k) + (f" größt{tails[k]}" * (1 + k % 3) if k % 5 == 0 else "")) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(250)], "doc_id long, toxic int")
    assert sorted(r.doc_id for r in toxicity(df, labels).where("rejected").collect()) == list(range(0, 400, 5))


def test_toxic_labels_of_sf01(spark):
    """Of the labelled toxic texts (a twentieth have no sign of it) nine tenths are rejected, of the others a hundredth at most; half of the labels are not learnt from."""
    from foliant.llm.toxicity import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for known, least in ((labels, 0.9), (labels.where("crc32(cast(doc_id as string)) % 2 = 0"), 0.87)):
        of = labels.withColumnRenamed("doc_id", "of").join(known.select("doc_id"), F.col("of") == F.col("doc_id"), "left_anti" if known is not labels else "left_semi")
        got = {r.toxic: r.share for r in toxicity(docs, known).join(of, F.col("doc_id") == F.col("of")).groupBy("toxic").agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
        assert got[1] >= least and got[0] <= 0.01, got


def test_large_benchmarks_are_joined(spark):
    """The join finds what the sketches in memory find, also of repeated rows and items, with all columns and without a sketch on the driver."""
    from foliant.llm import decontaminate as d

    rng = np.random.default_rng(12)
    vocab = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(50)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    items = [(k, say(int(rng.integers(1, 60)))) for k in range(60)] + [(60, None), (61, "...")]
    items += [items[3], (62, items[3][1])]
    docs = [(k, say(40) + " " + items[k % 60][1].upper() + ", " + say(20), "s") for k in range(200)] + [(None, items[5][1], None), (300, None, "s"), (300, "", "s")]
    docs += [(k, items[7][1] + " " + items[9][1], "hot") for k in range(400, 500)] + [docs[4], docs[4]]
    rows = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, source string, row long, digest string")
    bench = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, row string")
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    near, far = (d.find_leaks(rows, bench, block_chars=n) for n in (10**9, 10))
    assert near.columns == far.columns and key(near) == key(far) and near.count() > 300
    kept = [d.decontaminate(rows, bench, block_chars=n) for n in (10**9, 10)]
    assert kept[0].columns == kept[1].columns == rows.columns and key(kept[0]) == key(kept[1]) and 0 < kept[0].count() < len(docs)
    assert d.find_leaks(rows.limit(0), bench, block_chars=10).count() == 0
    assert key(d.decontaminate(rows, spark.createDataFrame([(1, "." * 50)], "item_id long, text string"), block_chars=10)) == key(rows)


def test_popular_passage_is_judged_where_it_lies(spark, monkeypatch):
    """A third of all texts share a passage: its cells don't meet in one task, and what is removed stays the same."""
    from foliant.llm import suffix_dedup as d

    rng = np.random.default_rng(3)
    say = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    passage = say(700)
    docs = spark.createDataFrame([(k, say(150) + (passage if k % 3 == 0 else "") + say(150)) for k in range(600)], "doc_id long, text string")
    monkeypatch.setattr(d, "CHUNK_BYTES", 4000)
    want = sorted((r.doc_id, r.n_bytes, repr(r.spans), bytes(r.kept)) for r in d.suffix_dedup(docs).collect())
    assert sum(w[2] != "[]" for w in want) >= 199
    monkeypatch.setattr(d, "HOT_CELLS", 40)
    seen = []
    apart = d._hot_apart
    monkeypatch.setattr(d, "_hot_apart", lambda cells, root: seen.append((cells, apart(cells, root))) or seen[-1][1])
    monkeypatch.setattr(d, "remove", lambda *a: None)
    got = sorted((r.doc_id, r.n_bytes, repr(r.spans), bytes(r.kept)) for r in d.suffix_dedup(docs).collect())
    largest = lambda df, *by: df.groupBy(*by).count().agg(F.max("count")).collect()[0][0]
    cells, (once, repeats) = seen[0]
    assert got == want and largest(cells, "anchor") > 100
    place = F.when(F.col("hot"), F.xxhash64("anchor", "span")).otherwise(F.col("anchor"))
    assert largest(once.withColumn("place", place), "place") < 50 and repeats.count() + once.count() == cells.count()


def test_lm_beats_word_counts_on_held_out_texts(spark):
    """On a table large enough: all held-out texts together are likelier by the model than by add-one word counts."""
    from foliant.llm.lm_scoring import lm_scores
    from foliant.llm.queries import TOKENIZER

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = lm_scores(docs, TOKENIZER).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.count(F.lit(1)).alias("n")).collect()[0]
    print(f"held-out texts {held.n}: score {held.score:.0f}, base_score {held.base:.0f}")
    assert held.n > 1000 and held.score > held.base


def test_lists_of_many_nodes_take_several_rounds(spark, monkeypatch):
    """With few pivots a round, links of a common shingle's list are all found; the rank of a list is limited before the shuffle."""
    from foliant.llm import jaccard_join as j

    rng = np.random.default_rng(2)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    start = " ".join(vocab[:5])
    docs = []
    for k in range(40):
        body = " ".join(rng.choice(vocab, 40))
        docs += [(3 * k, f"{start} {body}"), (3 * k + 1, f"{start} {body} more"), (3 * k + 2, f"{body} other words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in j.jaccard_components(df).collect()}
    assert all(want[k] == k - k % 3 for k in want)
    monkeypatch.setattr(j, "MOST_PIVOTS", 2)
    assert {r.doc_id: r.component_id for r in j.jaccard_components(df).collect()} == want


def test_lm_steps_fill_the_same_arrays():
    """After a first step no step makes arrays of all positions or targets anew beyond a few, and what a smaller step leaves in them changes nothing."""
    import tracemalloc

    from foliant.llm.lm_scoring import CLASSES, HALF, STEP, WIDTH, WINDOW, Model, _first_weights

    rng = np.random.default_rng(8)
    model, fresh = (Model(_first_weights(1, np.arange(CLASSES)), None, None, 0) for _ in range(2))
    args = lambda n: (x := rng.integers(0, CLASSES, (n, WINDOW + 1)), np.zeros(n, np.int64), np.full(n, HALF))
    steps = [args(n) for n in (STEP, 5, STEP)]
    peak = []
    for x, absent, many in steps:
        tracemalloc.start()
        loss, g = model.step(x[:, :-1], absent, x[:, HALF + 1 :], many)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    want, h = fresh.step(x[:, :-1], absent, x[:, HALF + 1 :], many)
    assert loss == want and all(np.array_equal(g[k], h[k]) for k in g)
    assert peak[2] < 8 * STEP * WINDOW * WIDTH * 4, peak


def test_lm_trains_in_place():
    """Gradients put into given arrays are those of a step of its own, without making keys and values; moves are Adam's, written out plainly."""
    import tracemalloc

    from foliant.llm.lm_scoring import CLASSES, HALF, STEP, WIDTH, WINDOW, Model, Optimizer, _first_weights, _flat, _shaped

    rng, flat = np.random.default_rng(5), _flat(_first_weights(1, np.arange(CLASSES)))
    optimizer = Optimizer(flat)
    model, plain, m, v = Model(_shaped(optimizer.weights), None, None, 0), flat.astype(float), 0.0, 0.0
    for n in range(1, 6):
        x = rng.integers(0, CLASSES, (STEP, WINDOW + 1))
        args = x[:, :-1], np.where(np.arange(STEP) % 9 == 0, HALF, 0), x[:, HALF + 1 :], np.where(np.arange(STEP) % 7 == 0, 3, HALF)
        loss, g = Model(_shaped(optimizer.weights.copy()), None, None, 0).step(*args)
        tracemalloc.start()
        model.step(*args, optimizer.gradients)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        grad = optimizer.flat.astype(float)
        assert loss > 0 and np.array_equal(_flat(g), optimizer.flat) and (n == 1 or peak < 3 * STEP * WINDOW * WIDTH * 4), peak
        optimizer.move(0.01 / n)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        plain -= 0.01 / n / (1 - 0.9**n) * m / (np.sqrt(v / (1 - 0.99**n)) + 1e-7)
        assert np.abs(plain - optimizer.weights).max() < 1e-4


def test_lm_rounds_have_each_piece_once(spark):
    from foliant.llm.lm_scoring import encoded, training_pieces
    from foliant.llm.queries import TOKENIZER

    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("tie"), F.lit(False).alias("held_out"), F.repeat(F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(" ")), 90).alias("text"))
    texts = encoded(rows, TOKENIZER, 49407)
    got = [sorted(tuple(r) for r in training_pieces(texts, 49407, *deal).collect()) for deal in ((), (3, 0), (3, 1), (3, 2))]
    assert sorted(got[1] + got[2] + got[3]) == got[0] and all(got) and [{r[0] % 3 for r in part} for part in got[1:]] == [{0}, {1}, {2}]
