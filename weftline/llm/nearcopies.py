"""Near copies: a similarity join on word n-gram sets by MinHash banding, verified on the full sets.

1. Texts that are equal are one representative each (copies are counted, not paired).
2. Each representative gets MinHash values of its n-grams, in bands whose number and rows are chosen for the
   target recall at the threshold. Bands are shuffled by hash; buckets of one are dropped, and of buckets with
   the same members one is kept.
3. Within a bucket, signatures are compared in blocks of bounded size. Pairs whose signatures make the threshold
   plausible join their representatives into candidate classes; only a spanning forest of them leaves the task.
4. Each candidate class is verified in blocks: n-gram sets as a 0/1 matrix, whose product with itself holds all
   intersections. Every pair of a class is verified once, in the task of its two blocks; link counts and a
   spanning forest leave it. Classes are the connected components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import grams
from weftline.llm.common import blocks, id_and_text, join_hot, map_rows, sift, sorted_groups, stored, text_buffer, unused
from weftline.llm.components import components

#: Members and text bytes of a block; a task holds two blocks.
BLOCK_MEMBERS = 256
BLOCK_TEXT_BYTES = 4 << 20
#: Columns of the 0/1 matrix at once.
MATRIX_COLUMNS = 8192


@dataclass(frozen=True)
class Banding:
    threshold: float = 0.5
    n: int = 3
    recall: float = 0.95
    most_hashes: int = 200

    def shape(self) -> tuple[int, int]:
        """(bands, rows): the most rows a band, so the fewest false candidates, that reach the recall."""
        best = (max(1, self.most_hashes), 1)
        for r in range(1, 17):
            p = self.threshold**r
            b = 1 if p >= 1 else math.ceil(math.log(1 - self.recall) / math.log(1 - p))
            if b * r <= self.most_hashes:
                best = (b, r)
        return best

    def plausible(self) -> int:
        """Equal signature bytes from which a pair may reach the threshold (3.5 deviations below its mean)."""
        b, r = self.shape()
        t, k = self.threshold, b * r
        return max(1, math.floor(k * t - 3.5 * math.sqrt(k * t * (1 - t))))


def text_grams(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit n-gram hashes of all texts in turn, their count up to each text); repeats within a text stay.

    Words are runs of letters and digits in lower case; a text of fewer than n words has one gram of all of them.
    """
    parts = [_grams_of(p.column(0), n) for p in blocks(pa.RecordBatch.from_arrays([col], ["text"]), 0)]
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    before = np.cumsum([0, *(len(v) for v, _ in parts)])
    firsts = [f[:-1] + k for (_, f), k in zip(parts, before)]
    return np.concatenate([v for v, _ in parts]), np.concatenate([*firsts, before[-1:]])


def _grams_of(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    buf, offsets = text_buffer(pc.utf8_lower(col))
    starts, ends, firsts = grams.words(buf, offsets, grams.NOT_WORD)
    h = grams.word_hashes(buf, starts, ends)
    counts = np.diff(firsts)
    g = grams.windows(h, n)
    at = np.flatnonzero(grams.within_texts(firsts, n, len(g)))
    values = g[at]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            where = firsts[:-1][short]
            values = np.insert(values, np.searchsorted(at, where), grams.windows(h, k)[where])
            at = np.insert(at, np.searchsorted(at, where), where)
    return values, np.searchsorted(at, firsts, "left")


class Hasher:
    """MinHash signatures and band keys."""

    def __init__(self, bands: int, rows: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.flip = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
        self.times = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.salt = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def signatures(self, values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """(texts with a gram) x hashes, 32 bits each."""
        some = np.flatnonzero(np.diff(firsts))
        low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
        cut = firsts[:-1][some]
        out = np.empty((len(some), len(self.flip)), np.uint32)
        if len(some):
            with np.errstate(over="ignore"):
                for k, (f, t) in enumerate(zip(self.flip, self.times)):
                    out[:, k] = np.minimum.reduceat((low ^ f) * t, cut)
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        s = signatures.astype(np.uint64).reshape(len(signatures), self.bands, self.rows)
        with np.errstate(over="ignore"):
            h = np.broadcast_to(self.salt, s.shape[:2]).copy()
            for k in range(self.rows):
                h = grams.mix(h ^ (s[:, :, k] + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)))
        return h.view(np.int64)


def _sign(rows: DataFrame, banding: Banding) -> DataFrame:
    """(digest, text) to digest, n_bytes, bands, signature; texts without a word have none of the latter."""
    bands, per = banding.shape()

    def make():
        hasher = Hasher(bands, per)

        def work(part: pa.RecordBatch) -> dict:
            values, firsts = text_grams(part.column(1), banding.n)
            s = hasher.signatures(values, firsts)
            has = np.diff(firsts) > 0
            ends = np.concatenate([[0], np.cumsum(has)]).astype(np.int32)
            keys = pa.array(hasher.keys(s).ravel())
            raw = (s & np.uint32(0xFF)).astype(np.uint8)
            bytes_ = pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(ends * np.int32(bands * per)), pa.py_buffer(np.ascontiguousarray(raw))])
            return {
                "digest": part.column(0), "n_bytes": np.diff(text_buffer(part.column(1))[1]),
                "bands": pa.ListArray.from_arrays(pa.array(ends * np.int32(bands)), keys), "signature": bytes_,
            }

        return work

    return map_rows(rows, make, "digest binary, n_bytes long, bands array<long>, signature binary")


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of n nodes by the pairs given."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _in_blocks(members: DataFrame, key: str, n_blocks: str, rid: str = "rid") -> DataFrame:
    """Each member once for every pair (block_a <= block_b) of blocks that its own is in."""
    own = F.pmod(F.xxhash64(rid), F.col(n_blocks)).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(n_blocks).cast("int") - 1)))
    spread = spread.withColumn("block_a", F.least("own", "other")).withColumn("block_b", F.greatest("own", "other"))
    keys = [key, "block_a", "block_b"]
    return spread.repartition(*keys).sortWithinPartitions(*keys)


def _pairs(own: np.ndarray, a: int, b: int, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a task that are good: within its block, or across its two."""
    good = np.triu(good, 1)
    if a != b:
        good &= own[:, None] != own[None, :]
    return np.nonzero(good)


def candidate_edges(reps: DataFrame, banding: Banding) -> DataFrame:
    """(a, b): a forest that joins every two representatives that share a bucket and plausibly the threshold."""
    least = banding.plausible()
    bands = reps.select("rid", F.explode("bands").alias("key"))
    # of a bucket's members: rids are spread over all 64 bits, so that their sum without carry tells sets apart; of
    # one member all three are its rid, which costs the shuffle little
    who = [F.min("rid").alias("a"), F.max("rid").alias("b"), F.bit_xor("rid").alias("x")]
    buckets = bands.groupBy("key").agg(F.count("*").alias("members"), *who).filter("members > 1")
    buckets = stored(buckets.groupBy("members", "a", "b", "x").agg(F.min("key").alias("key")), "buckets")
    signatures = reps.select("rid", "signature")
    two = (
        buckets.filter("members = 2").select("a", "b")
        .join(signatures.select(F.col("rid").alias("a"), F.col("signature").alias("sign_a")), "a")
        .join(signatures.select(F.col("rid").alias("b"), F.col("signature").alias("sign_b")), "b")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s, t = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((s == t).sum(1) >= least))

    pairs = two.select("a", "b", "sign_a", "sign_b").mapInArrow(compare, "a long, b long")
    more = stored(buckets.filter("members > 2").select("key", "members", F.ceil(F.col("members") / BLOCK_MEMBERS).alias("n_blocks")), "buckets")
    members = join_hot(sift(bands, "key", more)[0], more, "key", "members").drop("members").join(signatures, "rid")
    spread = _in_blocks(members, "key", "n_blocks").select("key", "block_a", "block_b", "own", "rid", "signature")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, a, b), rows in sorted_groups(batches, 3):
            rid = rows.column("rid").to_numpy()
            own = rows.column("own").to_numpy()
            s = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(len(rid), -1)
            equal = np.zeros((len(rid), len(rid)), np.int16)
            for k in range(s.shape[1]):
                equal += s[:, k, None] == s[None, :, k]
            edges = _forest(len(rid), *_pairs(own, a, b, equal >= least))
            if edges:
                at = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(rid[at[:, 0]]), pa.array(rid[at[:, 1]])], names=["a", "b"])

    return pairs.unionByName(spread.mapInArrow(within, "a long, b long"))


def intersections(values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the texts' gram sets, sizes of all their intersections) by products of 0/1 matrices."""
    m = len(firsts) - 1
    owner = np.repeat(np.arange(m), np.diff(firsts))
    distinct, number = np.unique(values, return_inverse=True)
    once = np.unique(number.astype(np.int64) * m + owner)
    number, owner = once // m, once % m
    sizes = np.bincount(owner, minlength=m)
    shared = np.bincount(number, minlength=len(distinct)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[number]
    number, owner = column[number[keep]], owner[keep]
    owners = np.bincount(number)
    if int((owners**2).sum()) <= 4 * m * m:  # few texts share a gram: pair by pair
        size = owners[number]
        first = np.repeat(np.cumsum(owners) - owners, owners)
        other = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
        return sizes, np.bincount(np.repeat(owner, size) * m + owner[other], minlength=m * m).reshape(m, m).astype(float)
    both = np.zeros((m, m))
    for a in range(0, int(shared.sum()), MATRIX_COLUMNS):
        lo, hi = np.searchsorted(number, (a, a + MATRIX_COLUMNS))
        matrix = np.zeros((m, MATRIX_COLUMNS), np.float32)
        matrix[owner[lo:hi], number[lo:hi] - a] = 1
        both += matrix @ matrix.T
    return sizes, both


def verified(classes: DataFrame, texts: DataFrame, reps: DataFrame, banding: Banding) -> DataFrame:
    """Links within candidate classes: rows (a, null, number of links) and forest edges (a, b, null).

    texts (digest, text) may repeat; those of no member stay where they are, but for a few that the marks of the
    members' digests don't tell apart.
    """
    members = classes.select(F.col("node").alias("rid"), F.col("root").alias("class")).join(reps.select("rid", "digest", "n_bytes"), "rid")
    members = stored(members, "members")
    sizes = members.groupBy("class").agg(F.count("*").alias("members"), F.sum("n_bytes").alias("bytes"))
    n_blocks = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("bytes") / BLOCK_TEXT_BYTES))
    blocks = stored(sizes.select("class", "members", F.least(n_blocks, "members").alias("n_blocks")), "blocks")
    texts = sift(texts, "digest", members.select("digest"))[0].dropDuplicates(["digest"])
    placed = join_hot(members, blocks, "class", "members").drop("members").join(texts, "digest")
    spread = _in_blocks(placed, "class", "n_blocks").select("class", "block_a", "block_b", "own", "rid", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=["a", "b", "links"])

        for (_, a, b), rows in sorted_groups(batches, 3):
            rid, own = rows.column("rid").to_numpy(), rows.column("own").to_numpy()
            values, firsts = text_grams(rows.column("text").combine_chunks(), banding.n)
            sizes, both = intersections(values, firsts)
            union = sizes[:, None] + sizes[None, :] - both
            left, right = _pairs(own, a, b, (both >= banding.threshold * union) & (both > 0))
            links = np.bincount(left, minlength=len(rid)) + np.bincount(right, minlength=len(rid))
            held += [(int(rid[k]), None, int(links[k])) for k in np.flatnonzero(links)]
            held += [(int(rid[x]), int(rid[y]), None) for x, y in _forest(len(rid), left, right)]
            if len(held) > 20_000:
                yield batch_of()
                held = []
        if held:
            yield batch_of()

    return spread.mapInArrow(check, "a long, b long, links long")


def _with_digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("digest", F.unhex(F.md5(F.encode("text", "UTF-8"))))


def classes_of_texts(seen: DataFrame, banding: Banding) -> DataFrame:
    """(doc_id, text, digest) to one row a different text: digest, root of its class, n_links, n_copies, copy_of."""
    signed = _sign(seen.select("digest", "text"), banding)
    one = signed.groupBy("digest").agg(F.first(F.struct("n_bytes", "bands", "signature")).alias("s"))
    # xxhash64 of one long is a bijection: unique numbers that are spread over all 64 bits
    reps = stored(one.select(F.xxhash64(F.monotonically_increasing_id()).alias("rid"), "digest", "s.*"), "representatives")
    classes = components(candidate_edges(reps, banding))
    links = stored(verified(classes, seen.select("digest", "text"), reps, banding), "links")
    counts = links.filter("links IS NOT NULL").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("n_links"))
    joined = components(links.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("rid"), "root")
    copies = seen.groupBy("digest").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"))
    by_text = reps.select("rid", "digest").join(copies, "digest").join(counts, "rid", "left").join(joined, "rid", "left")
    return stored(
        by_text.select("digest", F.coalesce("root", "rid").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies", "copy_of"),
        "by-text",
    )


def near_copies(docs: DataFrame, banding: Banding = Banding(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, class_id, n_links, n_copies, copy_of.

    n_links: how many different texts have an n-gram Jaccard similarity with it of threshold at least. class_id:
    the least doc_id of the connected component of its text by such links, its own copies included. n_copies:
    rows with an equal text, itself too; copy_of: the least doc_id of those. Null and empty texts are equal, have
    no n-gram and no links. Repeated rows and null ids keep a row each; a class of null ids alone has a null
    class_id. Nothing is sampled or capped: hot buckets and classes are split into blocks, all pairs of which are
    compared.
    """
    seen = _with_digest(docs, id_col, text_col)
    by_text = classes_of_texts(seen, banding)
    classes = by_text.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    by_text = stored(by_text.join(classes, "root").select("digest", "class_id", "n_links", "n_copies", "copy_of"), "classes")
    rows = join_hot(seen.select("doc_id", "digest"), by_text, "digest", "n_copies")
    return rows.select("doc_id", "class_id", "n_links", "n_copies", "copy_of")


def first_of_each(docs: DataFrame, banding: Banding = Banding(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of near copies: that of the least id (null last), with all its columns.

    Of a class the text of the least id stays, and of its rows that of the least id; ties go by the text's digest
    and a hash of all columns. Rows without near copies all stay. An empty table stays empty.
    """
    digest, rank, kept = unused(docs, "digest", "rank", "kept")
    by_text = classes_of_texts(_with_digest(docs, id_col, text_col), banding)
    first = F.min(F.struct(F.col("copy_of").isNull(), "copy_of", "digest"))
    sets = by_text.groupBy("root").agg(first.alias("first"), F.sum("n_copies").alias("n_rows")).filter("n_rows > 1")
    sets = stored(sets.select("root", F.col("first.digest").alias("first_digest")), "sets")
    several = stored(by_text.join(sets, "root").select(F.col("digest").alias(digest)), "several")  # texts of a set of several rows
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(digest, F.unhex(F.md5(F.encode(text, "UTF-8"))))
    maybe, alone = sift(rows, digest, several)
    # one row a text leaves each map task, so that no text is hot
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).cast("long").alias("id"), F.xxhash64(*columns).alias("hash"))
    one = maybe.withColumn(rank, order).groupBy(digest).agg(F.min_by(F.struct(*columns), F.col(rank)).alias(kept))
    dropped = several.join(sets, F.col(digest) == F.col("first_digest"), "left_anti")
    return alone.select(*columns).unionByName(one.join(dropped, digest, "left_anti").select(f"{kept}.*"))
