"""Scores of texts by a small causal self-attention model over subword ids, beside a word-count baseline."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.jaccard_join import _pack, _unpack
from foliant.llm.kernels import column_bytes, pieces, word_hashes
from foliant.llm.shared import release, stored, tasks
from foliant.llm.subwords import encoder

#: Groups of classes of ids, and classes of a group; width of vectors; positions of a window, half of them context.
GROUPS, MEMBERS, WIDTH, WINDOW = 32, 64, 32, 32
CLASSES, HALF = GROUPS * MEMBERS, WINDOW // 2
#: Training: windows of a piece of a text at most, rounds of averaging, pieces that are shuffled together, windows in a step, and its rate.
PIECE, ROUNDS, BLOCK, STEP, RATE = 16, 3, 64, 128, 0.01
#: Ids that one model is trained on in all rounds; the models of a round's shards are averaged.
SHARD_IDS = 4_000_000
#: Windows scored at once (their logits stay in a core's cache), text bytes encoded or counted together, rows at most, and texts of a chunk from which a word is dealt as a count.
SCORED, CHUNK_BYTES, CHUNK_ROWS, SHARED = 256, 8 << 20, 60_000, 32
#: Weights that are moved at once (with their moments they stay in a core's cache).
NEAR = 1 << 14
#: Logits under this (for attention, nearer to 0 than this) need no shift before they are exponentiated.
SAFE = 60
SHAPES = {"embed": (CLASSES, WIDTH), "place": (WINDOW, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "mix": (WIDTH, WIDTH), "mix_bias": (WIDTH,), "out": (WIDTH, GROUPS), "out_bias": (GROUPS,), "inner": (GROUPS, WIDTH, MEMBERS), "inner_bias": (GROUPS, MEMBERS)}
SCALE = np.float32(1 / np.sqrt(WIDTH))
CAUSAL = np.where(np.arange(WINDOW)[None, :] <= np.arange(HALF, WINDOW)[:, None], 0, -1e9).astype(np.float32)


@dataclass
class Model:
    """One block: x = embed + place, h = x + attention(x), r = h + tanh(h mix), then a group of classes, a class of the group, and an id of the class by its counts."""

    weights: dict[str, np.ndarray]
    classes: np.ndarray  # of each id
    within: np.ndarray  # log10 probability of each id within its class
    end: int  # the id before and after each text
    spaces: dict[str, np.ndarray] = field(default_factory=dict)  # large arrays that each step fills anew

    def space(self, name: str, rows: int, columns: int) -> np.ndarray:
        if name not in self.spaces or len(self.spaces[name]) < rows:
            self.spaces[name] = np.empty((rows, columns), np.float32)
        return self.spaces[name][:rows]

    def hidden(self, ids: np.ndarray, absent: np.ndarray) -> tuple:
        """ids: classes of windows; absent: how many positions at the front are no text. What is computed for the latter half of positions, r last."""
        w, rows = self.weights, len(ids) * HALF
        x = w["embed"].take(ids, axis=0, mode="clip", out=self.space("x", ids.size, WIDTH).reshape(*ids.shape, WIDTH))
        x += w["place"]
        own = self.space("own", rows, WIDTH)
        own.reshape(len(ids), HALF, WIDTH)[:] = x[:, HALF:]
        q = np.matmul(own, self.link(), out=self.space("q", rows, WIDTH)).reshape(len(ids), HALF, WIDTH)
        a = _attention(q, x, absent, self.space("a", rows, WINDOW))
        y = np.matmul(a, x, out=self.space("y", rows, WIDTH).reshape(q.shape))
        h = np.matmul(_rows(y), w["value"], out=self.space("h", rows, WIDTH))
        h += own
        z = np.matmul(h, w["mix"], out=self.space("z", rows, WIDTH))
        z += w["mix_bias"]
        np.tanh(z, out=z)
        return x, own, q, a, y, h, z, np.add(h, z, out=self.space("r", rows, WIDTH)).reshape(q.shape)

    def chances(self, r: np.ndarray, targets: np.ndarray) -> tuple:
        """For rows r: exponentials of all groups' logits and 1 / their sum, the same, rows in order of their target's group, for all members of that; these rows, that order and where its groups begin."""
        w = self.weights
        outer = np.matmul(r, w["out"], out=self.space("outer", len(r), GROUPS))
        outer += w["out_bias"]
        of_outer = _exponentials(outer)
        group = (targets // MEMBERS).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        bounds = [0, *np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()]
        ranked, inner = r.take(order, axis=0, mode="clip", out=self.space("ranked", len(r), WIDTH)), self.space("inner", len(r), MEMBERS)
        for g, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if a < b:
                np.matmul(ranked[a:b], w["inner"][g], out=inner[a:b])
                inner[a:b] += w["inner_bias"][g]
        return outer, of_outer, inner, _exponentials(inner), ranked, order, bounds

    def log_chances(self, ids: np.ndarray, absent: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of all classes, at the latter half of positions."""
        r = self.hidden(ids, absent)[-1].astype(float)
        log = lambda y: y - np.log(np.exp(y).sum(axis=-1, keepdims=True))
        outer, inner = log(r @ self.weights["out"] + self.weights["out_bias"]), log(np.einsum("nhw,gwm->nhgm", r, self.weights["inner"]) + self.weights["inner_bias"])
        return (outer[..., None] + inner).reshape(*r.shape[:2], CLASSES)

    def link(self) -> np.ndarray:
        """Queries and keys of vectors meet in products alone: (x query) (y key)' = x link y'. So keys, and in the same way values before they are added up, are never made."""
        return self.weights["query"] @ self.weights["key"].T * SCALE

    def step(self, ids: np.ndarray, absent: np.ndarray, targets: np.ndarray, many: np.ndarray, into: dict[str, np.ndarray] | None = None) -> tuple[float | None, dict[str, np.ndarray]]:
        """The mean loss over the first ``many`` targets of each window, and its gradients; these alone, put into the arrays given, if there are any."""
        w, g = self.weights, into or {k: np.empty(s, np.float32) for k, s in SHAPES.items()}
        x, own, q, a, y, h, z, r = self.hidden(ids, absent)
        targets = targets.ravel()
        there = (np.arange(HALF) < many[:, None]).ravel()
        outer, of_outer, inner, of_inner, ranked, order, bounds = self.chances(_rows(r), targets)
        rows, group, member = np.arange(len(targets)), targets // MEMBERS, targets[order] % MEMBERS
        n, seen = there.sum(), there[order]
        share = np.float32(1 / n)
        outer *= of_outer * share
        inner *= of_inner * share
        loss = None if into else float(-(np.log(outer[rows, group][there] * n + 1e-30).sum() + np.log(inner[rows, member][seen] * n + 1e-30).sum()) / n)
        outer[rows, group] -= share
        inner[rows, member] -= share
        for d, some in ((outer, there), (inner, seen)):
            if not some.all():
                d[~some] = 0
        np.matmul(_rows(r).T, outer, out=g["out"])
        outer.sum(axis=0, out=g["out_bias"])
        back = self.space("back", len(ranked), WIDTH)
        for c, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if i < j:
                np.matmul(ranked[i:j].T, inner[i:j], out=g["inner"][c])
                inner[i:j].sum(axis=0, out=g["inner_bias"][c])
                np.matmul(inner[i:j], w["inner"][c].T, out=back[i:j])
            else:
                g["inner"][c], g["inner_bias"][c] = 0, 0
        dr = np.matmul(outer, w["out"].T, out=self.space("dr", len(outer), WIDTH))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        dr += back.take(place, axis=0, mode="clip", out=self.space("moved", len(order), WIDTH))
        dz = np.multiply(z, z, out=z)
        np.subtract(1, dz, out=dz)
        dz *= dr
        np.matmul(h.T, dz, out=g["mix"])
        dz.sum(axis=0, out=g["mix_bias"])
        dh = dr
        dh += np.matmul(dz, w["mix"].T, out=back)
        np.matmul(_rows(y).T, dh, out=g["value"])
        dy = np.matmul(dh, w["value"].T, out=back).reshape(q.shape)
        dx = np.matmul(a.transpose(0, 2, 1), dy, out=self.space("dx", ids.size, WIDTH).reshape(x.shape))
        ds = np.matmul(dy, x.transpose(0, 2, 1), out=self.space("ds", len(outer), WINDOW).reshape(a.shape))
        ds *= a
        a *= _sums(ds)
        ds -= a
        dx += np.matmul(ds.transpose(0, 2, 1), q, out=self.space("more", ids.size, WIDTH).reshape(x.shape))
        dq = _rows(np.matmul(ds, x, out=y))
        link = own.T @ dq * SCALE
        np.matmul(link, w["key"], out=g["query"])
        np.matmul(link.T, w["query"], out=g["key"])
        dh += np.matmul(dq, self.link().T, out=back)
        dx[:, HALF:] += dh.reshape(q.shape)
        dx.sum(axis=0, out=g["place"])
        g["embed"][:] = 0
        pairs = WIDTH // 2  # two numbers are added as one complex number: it takes half the time
        np.add.at(g["embed"].reshape(-1).view(np.complex64), (ids.reshape(-1, 1) * pairs + np.arange(pairs)).ravel(), dx.reshape(-1).view(np.complex64))
        return loss, g

    def score(self, ids: np.ndarray) -> float:
        return float(self.scores(ids, np.array([0, len(ids)]))[0])

    def scores(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text's ids and the end after them.

        Each window has HALF positions of context and scores the HALF ids after them; so each id is scored once.
        """
        n = np.diff(offsets) + 1  # predictions of each text
        many = -(-n // HALF)
        text, first = np.repeat(np.arange(len(n)), many), np.repeat(np.cumsum(many) - many, many)
        start = (np.arange(len(text)) - first) * HALF  # the first prediction of each window
        # predictions p of a text: inputs are end, id 0, id 1 ...; targets id 0, id 1 ..., end
        padded = np.full(len(ids) + 2 * len(n), self.end, dtype=np.int64)
        shift = offsets[:-1] + 2 * np.arange(len(n)) + 1
        padded[np.arange(len(ids)) + np.repeat(2 * np.arange(len(n)) + 1, np.diff(offsets))] = ids
        total = np.zeros(len(n))
        table = self.classes[padded]
        inner = self.within[padded]
        w = self.weights
        by_class, by_place = w["embed"] @ self.link(), w["place"][HALF:] @ self.link()  # once, not in each window
        for a in range(0, len(text), SCORED):
            t, s = text[a : a + SCORED], start[a : a + SCORED]
            at = shift[t][:, None] - 1 + s[:, None] + np.arange(-HALF, HALF)
            absent = np.maximum(HALF - s, 0)
            there = (s[:, None] + np.arange(HALF)) < n[t][:, None]
            at = np.clip(at, 0, len(padded) - 1)
            own = table[at]
            x = w["embed"].take(own, axis=0, mode="clip", out=self.space("x", own.size, WIDTH).reshape(*own.shape, WIDTH))
            x += w["place"]
            q = by_class.take(own[:, HALF:], axis=0, mode="clip", out=self.space("q", len(own) * HALF, WIDTH).reshape(len(own), HALF, WIDTH))
            q += by_place
            seen = np.matmul(_attention(q, x, absent, self.space("a", len(own) * HALF, WINDOW)), x, out=self.space("y", len(own) * HALF, WIDTH).reshape(q.shape))
            h = np.matmul(_rows(seen), w["value"], out=self.space("h", len(own) * HALF, WIDTH))
            h.reshape(q.shape)[:] += x[:, HALF:]
            r = np.matmul(h, w["mix"], out=self.space("z", len(h), WIDTH))
            r += w["mix_bias"]
            np.tanh(r, out=r)
            r += h
            to = np.minimum(at[:, HALF:] + 1, len(padded) - 1)
            target = table[to].ravel()
            outer, of_outer, members, of_members, _, order, _ = self.chances(r, target)
            rows, both = np.arange(len(target)), np.empty(len(target), np.float64)
            both[order] = np.maximum(members[rows, target[order] % MEMBERS] * of_members[:, 0], 1e-30)
            both *= np.maximum(outer[rows, target // MEMBERS] * of_outer[:, 0], 1e-30)
            log = np.log10(both)
            log = log.reshape(to.shape) + inner[to]
            total += np.bincount(t, weights=np.where(there, log, 0).sum(axis=1), minlength=len(n))
        return total


def _rows(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _exponentials(y: np.ndarray) -> np.ndarray:
    """Rows of logits to exponentials, in place; returns 1 / the sum of each row."""
    if y.size and y.max() > SAFE:
        y -= y.max(axis=-1, keepdims=True)
    np.exp(y, out=y)
    return 1 / _sums(y)


def _sums(y: np.ndarray) -> np.ndarray:
    """Sums along the last axis, which stays."""
    return (_rows(y) @ np.ones(y.shape[-1], np.float32)).reshape(*y.shape[:-1], 1)


def _attention(q: np.ndarray, x: np.ndarray, absent: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Weights of all positions before and at each of the latter half, of those that are text; made in space."""
    a = np.matmul(q, x.transpose(0, 2, 1), out=space.reshape(len(q), HALF, WINDOW))
    near = a.size and max(a.max(), -a.min()) < SAFE
    a += CAUSAL
    if (some := np.flatnonzero(absent)).size:
        a[some] += np.where(np.arange(WINDOW) < absent[some, None], np.float32(-1e9), np.float32(0))[:, None, :]
    if not near:
        a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a *= 1 / _sums(a)
    return a


def _first_weights(seed: int, mass: np.ndarray) -> dict[str, np.ndarray]:
    """mass: of each class; the first model knows how frequent groups and their classes are."""
    rng = np.random.default_rng(seed)
    out = {k: (rng.normal(0, 0.5 if k == "embed" else 0.2, s)).astype(np.float32) for k, s in SHAPES.items()}
    mass = np.maximum(mass, 0.5).reshape(GROUPS, MEMBERS)
    groups = mass.sum(axis=1)
    return out | {"mix_bias": np.zeros(WIDTH, np.float32), "out_bias": np.log(groups / groups.sum()).astype(np.float32), "inner_bias": np.log(mass / groups[:, None]).astype(np.float32)}


def classes_of(counts: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The class of each id: half of the groups are of ids that end a word (last), half of others, by frequency.

    Three quarters of the classes are of one id each, the most frequent ones; the rest of ids share the others by bands of equal mass.
    """
    classes, half = np.zeros(len(counts), dtype=np.int64), CLASSES // 2
    alone = half * 3 // 4
    for kind, ends in enumerate((True, False)):
        some = np.flatnonzero(last == ends)
        some = some[np.argsort(-counts[some], kind="stable")]
        classes[some[:alone]] = kind * half + np.arange(len(some[:alone]))
        rest, bands = some[alone:], half - alone
        upto = np.cumsum(counts[rest])
        classes[rest] = kind * half + alone + np.minimum(((upto - counts[rest] / 2) * bands / max(upto[-1] if len(upto) else 1, 1)).astype(np.int64), bands - 1)
    return classes


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).astype(np.float32, copy=False)
        at += n
    return out


class Optimizer:
    """Adam, in place: weights and gradients are one array each, of which a model's are views."""

    def __init__(self, flat: np.ndarray) -> None:
        self.weights, self.flat, self.n = flat.astype(np.float32), np.empty(len(flat), np.float32), 0
        self.gradients, self.first, self.second, self.spare = _shaped(self.flat), np.zeros_like(self.flat), np.zeros_like(self.flat), np.empty(NEAR, np.float32)

    def move(self, rate: float) -> None:
        """A step by the gradients, which are used up."""
        self.n += 1
        # moments are kept without their factors 0.1 and 0.01
        root = (0.01 / (1 - 0.99**self.n)) ** 0.5
        rate, least = 0.1 * rate / (1 - 0.9**self.n) / root, 1e-7 / root
        for a in range(0, len(self.flat), NEAR):
            now, grad, m, v = (x[a : a + NEAR] for x in (self.weights, self.flat, self.first, self.second))
            spare = self.spare[: len(now)]
            m *= 0.9
            m += grad
            v *= 0.99
            grad *= grad
            v += grad
            np.sqrt(v, out=spare)
            spare += least
            np.divide(m, spare, out=grad)
            grad *= rate
            now -= grad


ENCODED = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary())])


def encoded(rows: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """doc_id, tie, held_out, ids: the ids of each whole text and the end, as numbers of 16 bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for x, y, part, near in pieces(data, offsets, CHUNK_BYTES):
                ids, at = encoder(tokenizer).encode(part, near, end)
                raw = ids.astype("<u2").tobytes()
                own = pa.array([raw[2 * a : 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(x, y - x) for c in ("doc_id", "tie", "held_out")), own], schema=ENCODED)

    return rows.mapInArrow(work, "doc_id long, tie long, held_out boolean, ids binary")


def training_pieces(texts: DataFrame, end: int, rounds: int = 1, k: int = 0) -> DataFrame:
    """texts: ids. Rows (place, ids, first): the whole training texts with their ends, in pieces of PIECE windows.

    A piece has the HALF + 1 ids before its first target, then its targets; so each id of a text and the end are targets in
    one window of one piece. A text without ids has the end alone. Before a text's first target stand HALF positions without
    text and the end (``first``). place: a hash of the piece, its number and its doc_id, by which pieces are dealt and ordered:
    copies of one text are dealt apart. Of several rounds, only the pieces of round k are made rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front, long, lead = np.full(HALF + 1, end, "<u2").tobytes(), 2 * PIECE * HALF, 2 * (HALF + 1)
        for batch in batches:
            rows, first, place = [], [], []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                own = front + ids
                for at in range(0, len(ids), long):
                    piece = own[at : at + long + lead]
                    to = int.from_bytes(hashlib.blake2b(piece, digest_size=8, key=f"{doc_id} {at}".encode()).digest(), "little", signed=True)
                    if to % rounds == k:
                        rows.append(piece)
                        first.append(at == 0)
                        place.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(rows, pa.binary()), pa.array(first, pa.bool_())], names=["place", "ids", "first"])

    return texts.select("doc_id", "ids").mapInArrow(work, "place long, ids binary, first boolean")


def piece_windows(ids: pa.Array, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of pieces: WINDOW + 1 ids each, how many positions at the front are no text, and how many targets they have.

    A piece's last window is filled with ends, which are no targets.
    """
    data, offsets = column_bytes(ids)
    flat, at = np.append(data.view("<u2"), np.uint16(end)), offsets // 2
    targets = np.diff(at) - HALF - 1
    many = -(-targets // HALF)
    piece, begin = np.repeat(np.arange(len(many)), many), np.repeat(np.cumsum(many) - many, many)
    k = np.arange(len(piece)) - begin
    place = (k * HALF)[:, None] + np.arange(WINDOW + 1)
    place = np.where(place < np.diff(at)[piece][:, None], at[piece][:, None] + place, len(flat) - 1)
    return flat[place], np.where(first[piece] & (k == 0), HALF, 0), np.minimum(targets[piece] - k * HALF, HALF)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """From rows in order of shard and place: the shard, ids and first of BLOCK pieces at a time."""
    kept, shard = [], None
    for batch in batches:
        of = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if kept and of[a] != shard:
                yield from _blocks(kept, shard, 1)
            shard = int(of[a])
            kept.append(batch.select(["ids", "first"]).slice(a, b - a))
            yield from _blocks(kept, shard, BLOCK)
    if kept:
        yield from _blocks(kept, shard, 1)


def _blocks(kept: list[pa.RecordBatch], shard: int, least: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Blocks of the rows kept while there are at least so many; the rest stays in the list."""
    if sum(k.num_rows for k in kept) < least:
        return
    rows = pa.Table.from_batches(kept).combine_chunks()
    kept.clear()
    at = 0
    while rows.num_rows - at >= least:
        part = rows.slice(at, BLOCK)
        yield shard, part.column("ids").combine_chunks(), part.column("first").to_numpy()
        at += part.num_rows
    if at < rows.num_rows:
        kept.extend(rows.slice(at).to_batches())


def train(texts: DataFrame, last: np.ndarray, end: int, seed: int = 11, rounds: int = ROUNDS, shard_ids: int = SHARD_IDS) -> Model:
    """texts: doc_id and ids of the training texts (see encoded); last: for each id of the vocabulary whether it ends a word.

    All ids of all texts and their ends are counted, and each is a target once. Pieces are dealt by their hashes to rounds and
    to shards, whose number follows the number of ids alone. In a round each shard trains on its pieces in order of their
    hashes, and their models are averaged; so the model doesn't depend on how rows lie or how many tasks there are.
    """
    spark, size = texts.sparkSession, len(last)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(column_bytes(batch.column("ids"))[0].view("<u2"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counts = np.ones(size)
    for r in texts.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row per id of the vocabulary
        counts[r[0]] += r[1]
    shards = int(-(-(counts.sum() - size) // shard_ids)) or 1
    classes = classes_of(counts, last)
    mass = np.bincount(classes, weights=counts, minlength=CLASSES)
    within = np.log10(counts / mass[classes])
    model = Model(_first_weights(seed, mass), classes, within, end)
    for k in range(rounds):
        flat = _flat(model.weights)

        def local(batches: Iterator[pa.RecordBatch], flat: np.ndarray = flat, k: int = k) -> Iterator[pa.RecordBatch]:
            shard, own, n, optimizer = None, None, 0, None

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([_flat(own.weights).astype("<f4").tobytes()])], names=["shard", "n", "weights"])

            for of, ids, first in _shards(batches):
                if of != shard:
                    if shard is not None:
                        yield done()
                    optimizer = Optimizer(flat)
                    shard, own, n = of, Model(_shaped(optimizer.weights), classes, within, end), 0
                rows, absent, many = piece_windows(ids, first, end)
                order = np.random.default_rng([seed, k, shard, n]).permutation(len(rows))  # a step has windows of many texts
                rows, absent, many = classes[rows[order]], absent[order], many[order]
                for a in range(0, len(rows), STEP):
                    part = slice(a, a + STEP)
                    own.step(rows[part, :-1], absent[part], rows[part, HALF + 1 :], many[part], optimizer.gradients)
                    n += 1
                    optimizer.move(RATE / 2**k)
            if shard is not None:
                yield done()

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, least = 0.0, 0, None
            for batch in batches:
                for shard, steps, w in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "weights")), strict=True):
                    total, n, least = total + steps * np.frombuffer(w, "<f4").astype(np.float64), n + steps, shard if least is None else least
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([least], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).tobytes()])], names=["shard", "n", "weights"])

        dealt = training_pieces(texts, end, rounds, k).withColumn("shard", F.pmod(F.shiftright("place", 8), F.lit(shards)).cast("int"))
        made = dealt.repartitionById(min(shards, tasks(spark)), F.col("shard")).sortWithinPartitions("shard", "place").select("shard", "ids", "first")
        made = made.mapInArrow(local, "shard int, n long, weights binary")
        # averages of averages, always in the order of shards: the driver gets 16 weight vectors at most
        ranges = made.repartition(16, F.expr(f"shard * 16L div {shards}")).sortWithinPartitions("shard")
        parts = sorted(tuple(r) for r in ranges.mapInArrow(average, "shard int, n long, weights binary").collect())
        if parts:
            total = sum(r[1] for r in parts)
            model.weights = _shaped(sum(r[1] / total * np.frombuffer(r[2], "<f8") for r in parts))
    return model


def scored(texts: DataFrame, model: Model) -> DataFrame:
    """texts: doc_id, tie, ids (the end last); adds score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("ids"))
            out = [np.zeros(0)]
            for _, _, part, at in pieces(data, offsets):
                at = at // 2
                inner = np.ones(at[-1], dtype=bool)
                inner[at[1:] - 1] = False  # the model adds the ends itself
                out.append(model.scores(part.view("<u2")[inner].astype(np.int64), at - np.arange(len(at))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(np.concatenate(out))], names=["doc_id", "tie", "score"])

    return texts.select("doc_id", "tie", "ids").mapInArrow(work, "doc_id long, tie long, score double")


DEALT = pa.schema([("to", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
DEALT_DDL = "to int, chunk long, kind int, payload binary"
OWN, META, ANSWER, TOTALS = range(4)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(DEALT)], schema=DEALT)


def _deal(ranges: int):
    """Deals each chunk's words by hash range (a row's count and whether it trains)."""
    bounds = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64)

    def chunk_rows(chunk: int, text: pa.Array, ids: pa.Array, ties: pa.Array, held: np.ndarray) -> list[tuple]:
        data, offsets = column_bytes(text)
        hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b, part, at in pieces(data, offsets):
            h, own = word_hashes(part, at)
            hashes.append(h)
            rows.append(np.repeat(np.arange(a, b), np.diff(own)))
        h, row = np.concatenate(hashes), np.concatenate(rows)
        words = np.bincount(row, minlength=len(held))
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(h)))
        h, row = h[first], row[first]
        word = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        texts = np.diff(np.append(word, len(h)))
        largest = np.maximum.reduceat(times, word) if len(word) else np.zeros(0)
        hot_word = (texts >= SHARED) | (largest > 0x7FFF)
        hot = np.repeat(hot_word, texts)
        trains = ~held[row]
        hot_keys = h[word[hot_word]]
        hot_counts = np.add.reduceat(np.where(trains, times, 0), word)[hot_word] if len(word) else np.zeros(0, np.int64)
        present = np.array([x is not None for x in ids.to_pylist()], dtype=np.uint8)
        meta = _pack(ids.fill_null(0).to_numpy(), present, held.astype("u1"), words.astype("<i8"), ties.to_numpy(), h[hot], row[hot].astype("<u2"), times[hot].astype("<u4"))
        out = [(chunk % ranges, chunk, META, meta)]
        h, row, times, trains = h[~hot], row[~hot].astype("<u2"), times[~hot], trains[~hot]
        coded = (times | (trains << 15)).astype("<u2")
        at, hot_at = np.r_[0, np.searchsorted(h, bounds), len(h)], np.r_[0, np.searchsorted(hot_keys, bounds), len(hot_keys)]
        for r in range(ranges):
            a, b, c, d = at[r], at[r + 1], hot_at[r], hot_at[r + 1]
            if a < b or c < d:
                out.append((r, chunk, OWN, _pack(h[a:b], row[a:b], coded[a:b], hot_keys[c:d], hot_counts[c:d].astype("<i8"))))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = column_bytes(batch.column("text"))
            held = np.array(batch.column("held_out").to_pylist(), dtype=bool)
            for a, b, _, _ in pieces(np.zeros(0, np.uint8), offsets, CHUNK_BYTES):
                for x in range(a, b, CHUNK_ROWS):
                    y = min(b, x + CHUNK_ROWS)
                    yield _batch(chunk_rows(chunk, batch.column("text").slice(x, y - x), batch.column("doc_id").slice(x, y - x), batch.column("tie").slice(x, y - x), held[x:y]))
                    chunk += 1

    return work


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In the task of a range: how often the training texts have each word; answers with sums for each row, or counts of shared words."""
    parts: dict[int, list] = defaultdict(list)
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        passed = [r for r in rows if r[2] == META]
        if passed:
            yield _batch(passed)
        for to, chunk, kind, payload in rows:
            if kind == OWN:
                parts[to].append((chunk, _unpack(payload, "<u8", "<u2", "<u2", "<u8", "<i8")))
    for to in list(parts):
        own = parts.pop(to)
        h = np.concatenate([x for _, p in own for x in (p[0], p[3])])
        n = np.concatenate([x for _, p in own for x in (np.where(p[2] >> 15, p[2] & 0x7FFF, 0).astype(np.int64), p[4])])
        words, which = np.unique(h, return_inverse=True)
        total = np.bincount(which, weights=n, minlength=len(words)).astype(np.int64)
        del h, which
        yield _batch([(to, -1, TOTALS, _pack(np.array([(total > 0).sum(), total.sum()], dtype="<i8")))])
        for chunk, p in own:
            c = total[np.searchsorted(words, p[0])]
            times, rows = (p[2] & 0x7FFF).astype(float), np.unique(p[1])
            top = int(rows[-1]) + 1 if len(rows) else 0
            logs = np.bincount(p[1], weights=times * np.log10(c + 1.0), minlength=top)[rows]
            known = np.bincount(p[1], weights=times * (c > 0), minlength=top)[rows].astype("<i8")
            yield _batch([(to, chunk, ANSWER, _pack(rows.astype("<u2"), logs, known, p[3], total[np.searchsorted(words, p[3])]))])


COUNTED = "doc_id long, tie long, held_out boolean, n_words long, n_known_words long, logs double"


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    metas: dict[int, bytes] = {}
    answers: dict[int, list] = defaultdict(list)
    for batch in batches:
        for _, chunk, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == META:
                metas[chunk] = payload
            elif kind == ANSWER:
                answers[chunk].append(payload)
    if answers.keys() - metas.keys():
        raise RuntimeError("a chunk of texts changed while it was counted; run the query again")
    for chunk in list(metas):
        ids, present, held, words, ties, hot, hot_row, hot_times = _unpack(metas.pop(chunk), "<i8", "u1", "u1", "<i8", "<i8", "<u8", "<u2", "<u4")
        logs, known = np.zeros(len(ids)), np.zeros(len(ids))
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for p in answers.pop(chunk, []):
            rows, own, seen, k, c = _unpack(p, "<u2", "<f8", "<i8", "<u8", "<i8")
            logs[rows] += own
            known[rows] += seen
            keys.append(k)
            counts.append(c)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        if len(hot):
            order = np.argsort(keys)
            c = counts[order][np.searchsorted(keys[order], hot)]
            logs += np.bincount(hot_row, weights=hot_times * np.log10(c + 1.0), minlength=len(ids))
            known += np.bincount(hot_row, weights=hot_times * (c > 0), minlength=len(ids))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=present == 0), pa.array(ties), pa.array(held.astype(bool)), pa.array(words), pa.array(known.astype(np.int64)), pa.array(logs)],
            names=["doc_id", "tie", "held_out", "n_words", "n_known_words", "logs"])


def lm_scores(docs: DataFrame, tokenizer: str, end: int = 49407, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs: doc_id, text; other columns are ignored. Rows whose crc32 of doc_id (as text) modulo ``folds`` is ``held_fold`` are
    held out: neither model learns from them (rows without doc_id are not held out). base_score: add-one word counts over
    all training texts, the end of a text counted as a word. score: the attention model's log10 probability of the
    subword ids of the whole text and its end. A null text is empty and has its end alone. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ranges = tasks(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), held.alias("held_out"))
    dealt = rows.mapInArrow(_deal(ranges), DEALT_DDL).repartitionById(ranges, F.col("to"))
    answers = stored(dealt.mapInArrow(_count, DEALT_DDL), "counts")
    totals = [_unpack(bytes(r[0]), "<i8")[0] for r in answers.where(F.col("kind") == TOTALS).select("payload").collect()]  # a row per range
    words = stored(answers.where(F.col("kind") != TOTALS).repartition(ranges, "chunk").mapInArrow(_sum, COUNTED), "words")
    release(spark)
    texts = stored(encoded(rows, tokenizer, end), "ids")
    model = train(texts.where("not held_out"), encoder(tokenizer).last, end)
    scores = stored(scored(texts, model), "scores")
    ends = words.where("not held_out").count()
    distinct, tokens = sum(int(t[0]) for t in totals) + (ends > 0), sum(int(t[1]) for t in totals) + ends
    n = F.col("n_words") + 1
    base = F.col("logs") + F.log10(F.lit(ends + 1.0)) - n * F.log10(F.lit(float(tokens + distinct + 1)))
    known = F.col("n_known_words") + F.lit(int(ends > 0))
    # rows that repeat one have its score
    of = scores.groupBy(F.col("doc_id").alias("id"), F.col("tie").alias("of")).agg(F.max("score").alias("score"))
    both = words.join(of, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("of")))
    return both.select("doc_id", "held_out", n.alias("n_tokens"), known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
