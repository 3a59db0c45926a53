"""Near-duplicate classes by bottom-k sketches of one hash function.

A document's set is its distinct 5-word shingles, hashed once to 64 bits. Its
sketch is the K smallest hashes. Documents of equal sets are one node.

Order of values. How many sketches hold a value is counted by an exchange of
short fingerprints: each chunk of sketches sends every owner of a range the
sorted fingerprints of its values as Golomb codes, the owner adds them up and
answers with a byte for each, the power of two of its count. Values are ordered
by that byte, rarest first, then by value; those held once are known as such.

Candidates. Two nodes of Jaccard similarity t or more share at least `needed`
sketch values, but for a chance near 1e-9 (see needed()). So they share one
among the first (sketch size - needed + 1) of either in that order. Inverted
lists are kept for those values alone, and only where two sketches hold them.
Values of a passage that many documents share are frequent, so they come last
and seldom get a list.

Stars. In each list the smallest node is the centre; all nodes that share a
list with a centre make its star. Any two nodes of one list are then in one
star, and stars together are no larger than the lists. Each star is searched
for links in blocks. The lists of a block (for each value the nodes that retain
it) give the overlaps, the union sketch of each pair estimates its similarity,
pairs whose estimate passes and that are not connected yet are compared on
their full sets, and only the links that connect something new leave the task.
Nodes are held against the centre first; then only those that are left outside
the largest component are held against the others.

A star of more than BLOCK nodes is searched in two steps: first each block with
the centre, then, only for the nodes that the first step left outside their
star's largest component, against all other blocks.

Full sets are compared as 64-bit hashes of shingles: two sets of n and m
shingles hold a false match with a chance near n x m / 2**64.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm import common
from plumbline.llm.exact_dedup import golomb_decode, golomb_encode, rice_parameter

#: Values of a sketch.
K = 512
#: Values of the sketches that estimate a pair's similarity: the first ones of a sketch are a sketch.
ESTIMATE = 256
WORDS = 5
#: The similarity, as a fraction of integers.
NUMERATOR, DENOMINATOR = 75, 100
#: Nodes that are compared with one another in one task.
BLOCK = 128
#: Chance that a pair of the similarity is missed by the sketches.
MISS = 1e-9
#: Sketch values of a chunk, the unit of the exchange.
CHUNK = 2_000_000
#: Fingerprint bits beyond log2 of the number of values: about one value in 2**SPARE seems shared and is not.
SPARE = 10
#: Sketch values that one owner counts, about.
OWNED = 2_000_000
#: Bits of a node's number that count within its chunk, and of a chunk's that count within its task.
WITHIN = 24
IN_TASK = 16

#: Odd multipliers of the words' places in a shingle, and of the final mix (fixed values).
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)

_words: dict[bytes, int] = {}
_WORDS_LIMIT = 400_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX[0])
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles; of the whole sequence if it has fewer words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    new = {w for w in set(words) if w not in _words}
    if new:
        if len(_words) + len(new) > _WORDS_LIMIT:
            _words.clear()
            new = set(words)
        for w in new:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for k, m in enumerate(PLACES):
        total = _mixed(total + h[k : k + n] * np.uint64(m)) if k else h[:n] * np.uint64(m)
    return np.unique(total)


def set_key(values: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    import xxhash

    return xxhash.xxh3_128_digest(values.astype("<u8").tobytes())


def lower_end(k: int, union: int | None) -> int:
    """The largest x so that of k values, drawn from a union of which t or more is shared, fewer than x are shared with chance MISS at most.

    The draw is without replacement; with union None the union is as large as any (a binomial count).
    """
    t = NUMERATOR / DENOMINATOR
    if union is not None and union <= k:
        return -(-NUMERATOR * union // DENOMINATOR)
    marked = None if union is None else -(-NUMERATOR * union // DENOMINATOR)

    def choose(n: int, i: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)

    below = 0.0
    for x in range(k + 1):
        if union is None:
            log = choose(k, x) + x * math.log(t) + (k - x) * math.log(1 - t)
        elif x > marked or k - x > union - marked:
            continue
        else:
            log = choose(marked, x) + choose(union - marked, k - x) - choose(union, k)
        below += math.exp(log) if log > -700 else 0.0
        if below > MISS:
            return x
    return k


@functools.lru_cache(maxsize=4096)
def _needed(union: int | None, k: int) -> int:
    return lower_end(k, union)


def needed(size: int, k: int = K) -> int:
    """Sketch values that a node of a set of `size` shingles shares with any node similar to it, or more.

    If the union of two sets has at most k values, the sketches are the sets and
    the overlap is at least t x the larger set. Otherwise the union's k smallest
    values are each in both sets with chance t or more, drawn without
    replacement from a union of at most size / t values, and those are in both
    sketches. Unions are rounded up, which only lowers the number; one is taken
    off because of the rounding of t x union.
    """
    whole = max(1, -(-NUMERATOR * size // DENOMINATOR))
    union = size * DENOMINATOR // NUMERATOR
    if union <= k:
        return whole
    step = 1 << max(0, union.bit_length() - 6)
    union = -(-union // step) * step
    return max(1, min(whole, _needed(union if union < 64 * k else None, k) - 1))


@functools.cache
def least_estimate(k: int = ESTIMATE) -> float:
    """The estimate below which a pair is similar with a chance near MISS only."""
    return lower_end(k, None) / k


class Chunks:
    """Sketches of a task, written as files of about `most` values: how many, set sizes, sketches one after another."""

    def __init__(self, folder: str, most: int):
        self.stem = f"{folder}/{common.attempt_name()}"
        self.most = most
        self.number = common.part_id() << IN_TASK
        self._open()

    def _open(self) -> None:
        self.sizes: list[int] = []
        self.values: list[np.ndarray] = []
        self.held = 0

    @property
    def path(self) -> str:
        return f"{self.stem}-{self.number % (1 << IN_TASK):05d}.sketches"

    def add(self, values: np.ndarray) -> tuple[int, str | None]:
        """The sketch's number, and the file's path if it is the file's first."""
        if self.held >= self.most:
            self.close()
            self.number += 1
        self.sizes.append(len(values))
        self.values.append(values[:K].copy())
        self.held += min(K, len(values))
        first = len(self.sizes) == 1
        return (self.number << WITHIN) + len(self.sizes) - 1, self.path if first else None

    def close(self) -> None:
        if self.sizes:
            fs, p = common.filesystem(self.path)
            with fs.open_output_stream(p) as out:
                out.write(np.array([len(self.sizes)], "<u8").tobytes() + np.array(self.sizes, "<u4").tobytes())
                out.write(np.concatenate(self.values).astype("<u8").tobytes())
        self._open()


def load_chunk(path: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set sizes, owner of each value, values) of the given sketches of a file; owners count in `rows`."""
    fs, p = common.filesystem(path)
    with fs.open_input_stream(p) as f:
        data = f.read()
    n = int(np.frombuffer(data, "<u8", 1)[0])
    sizes = np.frombuffer(data, "<u4", n, 8).astype(np.int64)
    values = np.frombuffer(data, "<u8", offset=8 + 4 * n)
    held = np.minimum(sizes, K)
    wanted = np.full(n, -1, np.int64)
    wanted[rows] = np.arange(len(rows))
    owner = np.repeat(wanted, held)
    return sizes[rows], owner[owner >= 0], values[owner >= 0]


def _sketches(folder: str, schema: pa.Schema, most: int):
    """Rows of documents; sketches go to files, one for each set that the task has not met before."""

    def task(batches: Iterable[pa.RecordBatch]):
        chunks = Chunks(folder, most)
        known: dict[bytes, int] = {}
        for batch in batches:
            sizes, nodes, places, paths, digests = [], [], [], [], []
            for text in common.text_bytes(batch.column(1)):
                digests.append(hashlib.sha256(text).digest())
                values = shingle_set(text)
                sizes.append(len(values))
                key = set_key(values) if len(values) else None
                path = None
                if key is not None and key not in known:
                    known[key], path = chunks.add(values)
                nodes.append(key)
                places.append(known.get(key))
                paths.append(path)
            made = [batch.column(0).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(places, pa.int64()), pa.array(paths, pa.string())]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[2:]], schema=schema)
        chunks.close()

    return task


MESSAGES = pa.schema([("owner", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("r", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])
MESSAGES_DDL = "owner long, chunk long, n long, r int, codes binary, counts binary"
ANSWERS = "chunk long, owner long, classes binary"
LISTS = "value long, node long"


def _fingerprints(values: np.ndarray, bits: int) -> np.ndarray:
    """Sketches hold small values only, so they are mixed again."""
    return _mixed(values + np.uint64(PLACES[0])) >> np.uint64(64 - bits)


def _send(bits: int, owner_bits: int):
    """Each chunk's fingerprints to their owners."""

    def task(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for part in batch.to_pylist():
                _, _, values = load_chunk(part["path"], np.array(part["rows"], np.int64))
                prints, counts = np.unique(_fingerprints(values, bits), return_counts=True)
                span = bits - owner_bits
                owners = (prints >> np.uint64(span)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(owners, prepend=-1))
                sent = []
                for a, b in zip(cuts, np.append(cuts[1:], len(prints)), strict=True):
                    r = rice_parameter(1 << span, int(b - a))
                    codes = golomb_encode(prints[a:b] & np.uint64((1 << span) - 1), r)
                    sent.append({"owner": int(owners[a]), "chunk": part["chunk"], "n": int(b - a), "r": r, "codes": codes, "counts": zlib.compress(counts[a:b].astype("<u4").tobytes(), 1)})
                for k in range(0, len(sent), 512):
                    yield pa.RecordBatch.from_pylist(sent[k : k + 512], schema=MESSAGES)

    return task


def _answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's part: the power of two of each fingerprint's count, 0 for what one sketch alone holds."""
    lists = [golomb_decode(c, n, r) for c, n, r in zip(pdf["codes"], pdf["n"], pdf["r"], strict=True)]
    counts = np.concatenate([np.frombuffer(zlib.decompress(c), "<u4") for c in pdf["counts"]])
    prints, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(prints))
    classes = np.floor(np.log2(total)).astype(np.uint8)[inverse]
    ends = np.cumsum([len(x) for x in lists])
    return pd.DataFrame({"chunk": pdf["chunk"], "owner": pdf["owner"], "classes": [zlib.compress(classes[e - len(x) : e].tobytes(), 1) for x, e in zip(lists, ends, strict=True)]})


def _post(bits: int):
    """A chunk's inverted lists: of each sketch the first values in order, as far as they are shared."""

    def task(key: tuple, parts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        found = []
        for chunk, path, rows in zip(parts["chunk"], parts["path"], parts["rows"], strict=True):
            rows = np.asarray(rows, np.int64)
            sizes, owner, values = load_chunk(path, rows)
            classes = np.frombuffer(b"".join(zlib.decompress(c) for c in answers.sort_values("owner")["classes"]), np.uint8)
            _, inverse = np.unique(_fingerprints(values, bits), return_inverse=True)
            own = classes[inverse]
            different = {int(s): min(int(s), K) - needed(int(s)) + 1 for s in np.unique(sizes)}
            first = np.array([different[s] for s in sizes.tolist()], np.int64)
            order = np.lexsort((values, own, owner))
            held = np.minimum(sizes, K)
            rank = np.arange(len(values)) - np.repeat(np.cumsum(held) - held, held)  # sketches stand in one order in all three
            posted = order[(rank < np.repeat(first, held)) & (own[order] > 0)]
            found.append(pd.DataFrame({"value": values[posted].view(np.int64), "node": (int(chunk) << WITHIN) + rows[owner[posted]]}))
        return pd.concat(found) if found else pd.DataFrame({"value": [], "node": []}, dtype="int64")

    return task


def _sets(batches: Iterable[pa.RecordBatch]):
    """Text to the name of its set and the full set."""
    for batch in batches:
        values = [shingle_set(t) for t in common.text_bytes(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array([set_key(v) for v in values], pa.binary()), pa.array([v.astype("<u8").tobytes() for v in values], pa.binary())], names=["key", "values"])


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def main(self) -> np.ndarray:
        """Whether each is in the largest tree (the first of equal ones)."""
        roots = np.array([self.find(x) for x in range(len(self.up))])
        return roots == np.bincount(roots).argmax()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets is at least the threshold, in integers."""
    if DENOMINATOR * min(len(a), len(b)) < NUMERATOR * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common_values = int((both[1:] == both[:-1]).sum())
    return DENOMINATOR * common_values >= NUMERATOR * (len(a) + len(b) - common_values)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of left shares with each of right.

    Each value's inverted list adds one to the pairs it holds; lists are taken
    4096 at a time, as the product of their incidence matrices.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(left) or not len(right):
        return out
    here = [np.concatenate(x) for x in (left, right)]
    owner = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (left, right)]
    shared = np.intersect1d(np.unique(here[0]), np.unique(here[1]), assume_unique=True)
    sides = []
    for values, who in zip(here, owner, strict=True):
        at = np.searchsorted(shared, values)
        kept = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == values) if len(shared) else np.zeros(len(values), bool)
        at, who = at[kept], who[kept]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], who[order]))
    step = 4096
    for begin in range(0, len(shared), step):
        width = min(step, len(shared) - begin)
        x = []
        for (at, who), n in zip(sides, out.shape, strict=True):
            a, b = np.searchsorted(at, (begin, begin + width))
            m = np.zeros((n, width), np.float32)
            m[who[a:b], at[a:b] - begin] = 1
            x.append(m)
        out += x[0] @ x[1].T
    return out


def estimates(left: list[np.ndarray], right: list[np.ndarray], k: int = ESTIMATE) -> np.ndarray:
    """Similarity of each pair by its union sketch: of the values up to the smaller of the two last ones, the part in both."""

    def ranks(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
        ends = np.array([y[-1] if len(y) >= k else np.uint64(2**64 - 1) for y in ys], np.uint64)
        return np.stack([np.searchsorted(x, ends, side="right") for x in xs])

    both = overlaps(left, right)
    union = ranks(left, right) + ranks(right, left).T - both
    return both / np.maximum(union, 1)


def connect(sets: list[np.ndarray], forest: Forest, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets of left and of right (their numbers) that join trees of the forest.

    Candidates are taken in falling order of their estimate, so most are
    connected already when their turn comes.
    """
    if not len(left) or not len(right):
        return []
    estimate = estimates([sets[x][:ESTIMATE] for x in left], [sets[x][:ESTIMATE] for x in right])
    sizes = np.array([len(x) for x in sets])
    a, b = sizes[left][:, None], sizes[right][None, :]
    i, j = np.nonzero((estimate >= least_estimate()) & (DENOMINATOR * np.minimum(a, b) >= NUMERATOR * np.maximum(a, b)))
    order = np.argsort(-estimate[i, j], kind="stable")
    out = []
    for x, y in zip(left[i[order]].tolist(), right[j[order]].tolist(), strict=True):
        if forest.find(x) != forest.find(y) and similar(sets[x], sets[y]):
            forest.join(x, y)
            out.append((x, y))
    return out


EDGES = "a long, b long"


def _edges(names: np.ndarray, found: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"a": names[[a for a, _ in found]], "b": names[[b for _, b in found]]} if found else {"a": [], "b": []}, dtype="int64")


def _in_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links within a block of a star; the centre is part of every block and comes first."""
    pdf = pdf.drop_duplicates("node").sort_values("node")
    sets = [np.frombuffer(v, "<u8") for v in pdf["values"]]
    every = np.arange(len(sets))
    forest = Forest(len(sets))
    found = connect(sets, forest, every[:1], every[1:])
    main = forest.main()
    found += connect(sets, forest, every[~main], every)
    return _edges(pdf["node"].to_numpy(np.int64), found)


def _across(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks of a star, where one side or the other is open; known components are joined first."""
    pdf = pdf.drop_duplicates("node").sort_values("node")
    sets = [np.frombuffer(v, "<u8") for v in pdf["values"]]
    first: dict[int, int] = {}
    forest = Forest(len(sets))
    for k, x in enumerate(pdf["label"].tolist()):
        forest.join(k, first.setdefault(x, k))
    side, free = pdf["side"].to_numpy(), pdf["open"].to_numpy(bool)
    here, there = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found = connect(sets, forest, here[free[here]], there)
    found += connect(sets, forest, here[~free[here]], there[free[there]])
    return _edges(pdf["node"].to_numpy(np.int64), found)


def components(scratch: common.Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, label) of every node in edges (a, b): label is the component's smallest node.

    Each round a node takes the least label among its neighbours', a label takes
    the least that any node of that label took, and then each node its label's
    label. So whole trees are hooked to smaller ones and paths halve; rounds grow
    with the logarithm of a chain's length. Labels only fall, so the rounds end;
    when nothing changes, neighbours have equal labels.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), f"{name}-0")
    kept = scratch.keep(both, f"{name}-edges")
    for step in itertools.count(1):
        near = kept.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        low = scratch.keep(low, f"{name}-low-{step}")
        hooks = low.groupBy("old").agg(F.min("label").alias("hook")).withColumnRenamed("old", "of")
        hooked = low.join(hooks, F.col("node") == F.col("of"), "left").select("node", "old", F.least("label", F.coalesce("hook", "label")).alias("label"))
        hooked = scratch.keep(hooked, f"{name}-hooked-{step}")  # a table, so that the rows of a frequent label can be split
        roots = hooked.select(F.col("node").alias("r"), F.col("label").alias("root"))
        jumped = hooked.join(roots, F.col("label") == F.col("r"), "left").select("node", F.least("label", F.coalesce("root", "label")).alias("label"), "old")
        new = scratch.keep(jumped, f"{name}-{step}")
        done = new.filter(F.col("label") != F.col("old")).isEmpty()
        for gone in (f"{name}-{step - 1}", f"{name}-low-{step}", f"{name}-hooked-{step}"):
            scratch.drop(gone)
        labels = new.select("node", "label")
        if done:
            return labels


def near_dedup(spark: SparkSession, docs: DataFrame, block: int = BLOCK, carry: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, n_shingles, component_id, kept, text_sha256, class_id.

    Documents are linked if 100 x intersection >= 75 x union of their shingle
    sets (see shingle_set); component_id is the smallest doc_id that links lead
    to. class_id is the same for all rows of a component and for no others,
    whatever their doc_ids; null for a row without a set. A null text, or one
    without words, has no set and is linked with nothing. Documents of fewer
    than 5 words have one shingle, so they are linked with their equals. A text
    of any length is taken whole: its sketch is short, its full set is held by
    one task. A null doc_id never is the smallest of others; on its own it is
    kept and its component_id is null. Of rows that repeat a doc_id each is kept
    by its own component. An empty table gives no rows; other columns are
    ignored, but for those named in `carry`, which the result has too.
    """
    scratch = common.Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    carried = [f for f in docs.schema.fields if f.name in carry]
    types = [("doc_id", pa.int64()), ("sha", pa.binary()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("place", pa.int64()), ("path", pa.string())]
    schema = pa.schema([*types, *[(f.name, to_arrow_type(f.dataType)) for f in carried]])
    ddl = ", ".join(["doc_id long, sha binary, n_shingles long, key binary, place long, path string", *[f"`{f.name}` {f.dataType.simpleString()}" for f in carried]])
    folder = scratch.folder("chunks")
    rows = scratch.keep(docs.mapInArrow(_sketches(folder, schema, chunk), ddl), "rows")
    # one row a node; rows of one key have one set, whose sketch stands at each of their places
    nodes = scratch.keep(rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min("place").alias("node")), "nodes")
    lists = _lists(spark, scratch, rows, nodes)
    scratch.drop("chunks")
    members = scratch.keep(_stars(scratch, lists), "stars")
    edges = _search(scratch, docs, nodes, members, block)
    labels = components(scratch, edges, "labels")
    named = scratch.keep(nodes.select("node", "first_id").join(labels, "node"), "named")
    least = scratch.keep(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "least")
    classes = scratch.keep(named.join(least, "label").select(F.col("node").alias("of"), "label", "component_id"), "classes")
    every = nodes.join(classes, F.col("node") == F.col("of"), "left").select(F.col("key").alias("of"), F.coalesce("label", "node").alias("class_id"), F.coalesce("component_id", "first_id").alias("component_id"))
    every = scratch.keep(every, "all-classes")
    out = rows.join(every, F.col("key") == F.col("of"), "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "class_id", *carry)


def _lists(spark: SparkSession, scratch: common.Scratch, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(value, node): the inverted lists of the rarest values of each sketch."""
    paths = rows.filter("path is not null").select(F.shiftright("place", WITHIN).alias("chunk"), "path")
    held = nodes.groupBy(F.shiftright("node", WITHIN).alias("chunk")).agg(F.collect_list(F.col("node").bitwiseAND((1 << WITHIN) - 1)).alias("rows"))
    parts = scratch.keep(paths.join(held, "chunk").select("chunk", "path", "rows"), "parts")  # rows of a chunk, bounded by CHUNK
    chunks = parts.count()
    values = rows.agg(F.sum(F.least("n_shingles", F.lit(K)))).first()[0] or 1
    bits = min(60, values.bit_length() + SPARE)
    owners = max(2 * common.partitions(spark), values // OWNED)
    owner_bits = min(bits - 1, owners.bit_length())
    n = max(1, chunks)
    messages = parts.repartition(n, "chunk").mapInArrow(_send(bits, owner_bits), MESSAGES_DDL)
    answers = messages.groupBy("owner").applyInPandas(_answer, ANSWERS)
    posted = parts.repartition(n, "chunk").groupBy("chunk").cogroup(answers.repartition(n, "chunk").groupBy("chunk")).applyInPandas(_post(bits), LISTS)
    return scratch.keep(posted, "lists")


def _stars(scratch: common.Scratch, lists: DataFrame) -> DataFrame:
    """(centre, node): the nodes that share an inverted list with the list's smallest node."""
    centres = lists.groupBy("value").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("value", "centre")
    centres = scratch.keep(centres, "centres")  # a table, so that a frequent value's rows can be split
    return lists.join(centres, "value").select("centre", "node").distinct()


def _search(scratch: common.Scratch, docs: DataFrame, nodes: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """Links that connect all similar nodes of the stars."""
    wanted = scratch.keep(members.select("node").distinct().join(nodes, "node").select("node", F.col("key").alias("of"), "first_id"), "wanted")
    texts = docs.join(wanted.select("first_id").distinct(), F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets, "key binary, values binary").join(wanted.select("node", "of"), F.col("key") == F.col("of"))
    sets = scratch.keep(sets.dropDuplicates(["key"]).select("node", "values"), "sets")
    sizes = scratch.keep(members.groupBy("centre").agg(F.count(F.lit(1)).alias("n")), "sizes")
    members = members.join(sizes, "centre").withColumn("blocks", F.ceil((F.col("n") - 1) / F.lit(block)).cast("int"))
    # a node's block depends on its name alone; blocks of a star differ little in size
    members = members.withColumn("block", F.when(F.col("node") == F.col("centre"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1)))).cast("int"))
    members = scratch.keep(members.select("centre", "node", "blocks", "block"), "members")
    inner = members.filter("block >= 0").unionByName(members.filter("block < 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    first = scratch.keep(inner.join(sets, "node").groupBy("centre", "block").applyInPandas(_in_block, EDGES), "links-0")
    large = members.filter("blocks > 1 and block >= 0")
    if large.isEmpty():
        return first
    labels = components(scratch, first, "inner")
    large = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = large.groupBy("centre", "label").agg(F.count(F.lit(1)).alias("n"))
    main = scratch.keep(counts.groupBy("centre").agg(F.max(F.struct("n", "label")).alias("m")).select("centre", F.col("m.label").alias("main")), "main")
    large = scratch.keep(large.join(main, "centre").withColumn("open", F.col("label") != F.col("main")).select("centre", "node", "blocks", "block", "label", "open"), "open")
    # pairs of blocks of which one has an open node
    has = large.filter("open").select("centre", "block").distinct()
    others = large.select("centre", F.col("block").alias("other")).distinct()
    pairs = has.join(others, "centre").filter("block <> other").select("centre", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).distinct()
    ends = pairs.withColumn("block", F.col("left")).withColumn("side", F.lit(0)).unionByName(pairs.withColumn("block", F.col("right")).withColumn("side", F.lit(1)))
    sided = large.join(ends, ["centre", "block"])
    second = sided.join(sets, "node").groupBy("centre", "left", "right").applyInPandas(_across, EDGES)
    return first.unionByName(scratch.keep(second, "links-1"))


#: Rows-for-rows SQL of the query over documents with distinct ids: overlaps of all pairs that share a shingle, then reachability.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)] END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n_shingles FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT o.x, o.y FROM o JOIN n nx ON nx.doc_id = o.x JOIN n ny ON ny.doc_id = o.y WHERE 100 * shared >= 75 * (nx.n_shingles + ny.n_shingles - shared)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n_shingles, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept, sha256(w.text) AS text_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN m ON m.doc_id = w.doc_id
"""
