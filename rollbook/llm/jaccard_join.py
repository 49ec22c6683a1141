"""N-gram Jaccard self-join by grouped prefixes, and its connected components.

Documents become sets of hashed word shingles; equal sets are one class.  In one
order of all shingles two sets can only reach the threshold if their prefixes share
a shingle.  The order begins with the lowest hashes, the frequent ones among them
last.  Classes with the same prefix and size form a group, and groups are filtered
before members meet:

* rare shingles: all pairs of groups are counted, and a pair goes on only if what the
  prefixes share leaves room for the overlap that it needs; members of the pairs left
  are verified on whole sets;
* late shingles, the frequent ones, stand in a prefix only where little else is left
  (families of copies, boilerplate).  Each group first meets the one centre it shares most
  of them with.  Then the groups that such shingles connect, a family, are cut into blocks
  of like size, and blocks that are not yet in one component are compared whole, set by
  set, inside a task; only links that join components leave it.

Pairs that are skipped are in one component already or cannot reach the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.base import materialise, release
from rollbook.llm.components import components, with_least

#: A shingle in at least FREQUENT documents moves behind the others, at most MAX_FREQUENT of them
#: (the list is broadcast).  Both only steer the work: any order is right.
FREQUENT = 16
MAX_FREQUENT = 500_000
#: Shingles and sets in a block of a family, about, and sets whose overlaps are held as whole
#: numbers at once.
BLOCK, BLOCK_SETS, STRIP = 150_000, 2000, 256
#: Words of 64 bits in a filter of ids (it is broadcast, 8 MB at most), and where the hash of an id has the
#: places of its bits.  Both only steer the work.
MAX_WORDS, SHIFTS = 1 << 20, (0, 6, 12, 18)
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: A-Z lower-cased, words between ASCII white
    space.  Fewer words than a shingle make one shingle of all, no word makes none."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.int64)
    if len(hashes) > 200_000:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(found))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out * P1) ^ h[i:len(h) - n + 1 + i]
        out ^= out >> np.uint64(29)
        out *= P2
    return np.unique((out ^ (out >> np.uint64(32))).view(np.int64))


def prefix_length(size: int, percent: int) -> int:
    """How many first shingles of a set must meet those of any set it is similar to."""
    return size - -(-percent * size // 100) + 1


def fingerprint(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def low_edge(percent: int) -> np.int64:
    """The largest of the low hashes: half as many again as prefixes take of a set."""
    return np.int64(-(1 << 63) + int(min(1.0, 1.5 * (100 - percent) / 100) * ((1 << 64) - 1)))


def shared_shingles(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(token, n) of the shingles with low hashes in more than one document, as a written table."""
    edge = low_edge(percent)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(n, pa.int64())], ["token", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch.column(0):
                s = shingles(text.as_py(), words, hashes)
                held.append(s[:np.searchsorted(s, edge, "right")])
                size += len(held[-1])
                if size > 1_000_000:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)
        release()

    return materialise(docs.select("text").where("text is not null").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
                       .where("n > 1"), "shared")


def frequent_shingles(shared: DataFrame) -> np.ndarray:
    """The frequent ones of shared shingles, rarer ones first; at most MAX_FREQUENT."""
    found = shared.where(F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "token").limit(MAX_FREQUENT).toArrow()
    return found.column("token").to_numpy()[::-1].copy()


def sketches(docs: DataFrame, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """The columns besides text, size, class_id (of the set), group_id (of size and prefix),
    prefix, and how many late shingles (frequent ones, then those with higher hashes) end it.  Documents without words have size 0 and nulls."""
    rank = np.argsort(frequent)
    shipped = docs.sparkSession.sparkContext.broadcast((frequent[rank], rank))
    edge = low_edge(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = shipped.value
        hashes = WordHashes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                sizes, classes, groups, prefixes, heavy = [], [], [], [], []
                for text in part.column(part.num_columns - 1):
                    s = shingles(text.as_py(), words, hashes)
                    sizes.append(len(s))
                    if not len(s):
                        for column in (classes, groups, prefixes, heavy):
                            column.append(None)
                        continue
                    p = prefix_length(len(s), percent)
                    low = s[:np.searchsorted(s, edge, "right")]
                    if len(known):
                        at = np.minimum(np.searchsorted(known, low), len(known) - 1)
                        often = known[at] == low
                        rare, late = low[~often], low[often][np.argsort(ranks[at[often]])]
                    else:
                        rare, late = low, low[:0]
                    first = np.concatenate([rare, late, s[len(low):]])[:p]
                    heavy.append(max(0, p - len(rare)))
                    classes.append(fingerprint(s))
                    groups.append(fingerprint(np.append(first, len(s))))
                    prefixes.append(first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(sizes, pa.int32()), pa.array(classes, pa.binary()), pa.array(groups, pa.binary()),
                     pa.array(prefixes, pa.list_(pa.int64())), pa.array(heavy, pa.int32())],
                    [*kept, "size", "class_id", "group_id", "prefix", "heavy"])
        release()

    kept = [c for c in docs.columns if c != "text"]
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, "text").mapInArrow(run, f"{types}, size int, class_id binary, group_id binary, prefix array<bigint>, heavy int")


def needed(size_a: str, size_b: str, percent: int) -> Column:
    """The overlap that two sizes need: the least o with 100 o >= percent (a + b - o)."""
    return F.ceil(percent * (F.col(size_a) + F.col(size_b)) / (100 + percent))


def roomy(pairs: DataFrame, percent: int) -> DataFrame:
    """Group pairs whose shared prefix shingles leave room for the overlap they need.

    Of the set whose prefix ends first every shingle up to there is settled, so the overlap is
    at most what is shared and the rest of one of the two sets.
    """
    p = lambda s: F.col(s) - F.ceil(percent * F.col(s) / 100) + 1
    rest = F.greatest(F.col("size_a") - p("size_a"), F.col("size_b") - p("size_b"))
    return pairs.where(F.col("shared") + rest >= needed("size_a", "size_b", percent))


def paired(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Rows (token, group_id, size, heavy) of two sides joined by token; sizes that can reach the threshold."""
    a = left.select("token", F.col("group_id").alias("a"), F.col("size").alias("size_a"), F.col("heavy").alias("heavy_a"))
    b = right.select("token", F.col("group_id").alias("b"), F.col("size").alias("size_b"), F.col("heavy").alias("heavy_b"))
    return a.join(b, "token").where((F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent) & (F.col("a") != F.col("b")))


def class_pairs(pairs: DataFrame, but: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b) with a < b, without those of another table, as a written table."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    return materialise(pairs if but is None else pairs.join(but, ["a", "b"], "left_anti"), "pairs")


def id_hashes(rows: DataFrame, *others: str) -> DataFrame:
    """The place and bits of each row's doc_id (null is one id) in a filter, and ``others``."""
    return rows.select(F.xxhash64("doc_id").alias("place"), F.xxhash64("doc_id", F.lit(1)).alias("bits"), *others)


def id_filter(rows: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids of ``rows`` (doc_id): words of 64 bits, of which an id sets up to four in one word.

    Four ids share a word, about, which lets some 1 % of other ids through; with more than 4 MAX_WORDS
    ids it lets more through, and never misses one.  The driver gets the words that are not empty.
    """
    words = min(MAX_WORDS, rows.count() // 4 + 1)
    set_bits = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(bits, {shift}) & 63 as int))" for shift in SHIFTS))
    found = id_hashes(rows).groupBy(F.pmod("place", F.lit(words)).cast("int").alias("word")).agg(F.bit_or(set_bits).alias("set")).toArrow()
    out = np.zeros(words, np.int64)
    out[found.column("word").to_numpy()] = found.column("set").to_numpy()
    return out


def in_filter(known: np.ndarray, place: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each id, given by its place and bits, may be in the filter."""
    bits = bits.view(np.uint64)
    wanted = np.zeros(len(bits), np.uint64)
    for shift in SHIFTS:
        wanted |= np.uint64(1) << ((bits >> np.uint64(shift)) & np.uint64(63))
    return known[place % len(known)].view(np.uint64) & wanted == wanted


def whole_sets(used: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(class_id, tokens) of the classes in ``used`` (class_id, distinct), made anew from one text of each, and of
    some others.  Texts are not shuffled: the tasks that read them pick the rows by a filter of the ids."""
    wanted = materialise(classes.join(used, "class_id").select("doc_id"), "wanted")
    shipped = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = shipped.value, WordHashes()
        for batch in batches:
            hits = np.flatnonzero(in_filter(known, batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            for begin in range(0, len(hits), 500):
                sets = [s for s in (shingles(batch.column(2)[i].as_py(), words, hashes) for i in hits[begin:begin + 500].tolist()) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(fingerprint, sets)), pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["class_id", "tokens"])
        release()

    return materialise(id_hashes(docs, "text").mapInArrow(run, "class_id binary, tokens array<bigint>"), "sets").dropDuplicates(["class_id"])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Of distinct class pairs (a, b), a written table, those whose whole sets reach the threshold."""
    used = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id"))).distinct()
    sets = whole_sets(used, docs, classes, words)
    side = lambda name: sets.select(F.col("class_id").alias(name), F.col("tokens").alias(f"tokens_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.where(100 * shared >= percent * (F.size("tokens_a") + F.size("tokens_b") - shared)).select("a", "b")


def links_of_blocks(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each set of one block reaches the threshold with each set of the other."""
    def columns(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (x, of_x), (y, of_y) = columns(left), columns(right)
    common = np.intersect1d(x, y)
    shared = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, len(common), 8192):
        part = common[i:i + 8192]
        dense = []
        for tokens, owner, n in ((x, of_x, len(left)), (y, of_y, len(right))):
            at = np.minimum(np.searchsorted(part, tokens), len(part) - 1)
            hit = part[at] == tokens
            table = np.zeros((n, len(part)), np.float32)
            table[owner[hit], at[hit]] = 1
            dense.append(table)
        shared += dense[0] @ dense[1].T
    size_left, size_right = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    out = np.empty(shared.shape, bool)
    for i in range(0, len(left), STRIP):
        overlap = shared[i:i + STRIP].astype(np.int64)
        out[i:i + STRIP] = 100 * overlap >= percent * (size_left[i:i + STRIP, None] + size_right - overlap)
    return out


def in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (class_id, family, size and others) with band and salt, which with the family
    name a block of about BLOCK shingles and BLOCK_SETS sets at most."""
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent)) if percent < 100 else F.col("size").cast("long")
    members = members.withColumn("band", band)
    cut = members.groupBy("family", "band").agg(F.ceil(F.greatest(F.sum("size") / BLOCK, F.count("*") / BLOCK_SETS)).alias("n"))
    return members.join(cut, ["family", "band"]).withColumn("salt", F.pmod(F.xxhash64("class_id"), "n")).drop("n")


def compared(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components within families.

    ``members``: class_id, family, size, home (component so far).  A family is cut by size into
    bands, of which only neighbours can reach the threshold, and a band into blocks of about
    BLOCK shingles and BLOCK_SETS sets at most.  Two blocks meet in one task unless all their members are in one component.
    """
    members = materialise(in_blocks(members, percent).drop("size"), "members")
    blocks = members.groupBy("family", "band", "salt").agg(F.min("home").alias("low"), F.max("home").alias("high"))
    one = blocks.select("family", F.col("band").alias("band_a"), F.col("salt").alias("salt_a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"),
                        F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    meet = one.join(blocks, ["family", "band"]).where(
        ((F.col("band") > F.col("band_a")) | (F.col("salt") >= F.col("salt_a"))) & (F.least("low", "low_a") != F.greatest("high", "high_a")))
    meet = materialise(meet.select("family", "band_a", "salt_a", F.col("band").alias("band_b"), F.col("salt").alias("salt_b")), "meet")
    key = ["family", "band_a", "salt_a", "band_b", "salt_b"]
    first = members.withColumnsRenamed({"band": "band_a", "salt": "salt_a"}).join(meet, ["family", "band_a", "salt_a"]).withColumn("side", F.lit(0))
    second = members.withColumnsRenamed({"band": "band_b", "salt": "salt_b"}).join(
        meet.where("band_a <> band_b or salt_a <> salt_b"), ["family", "band_b", "salt_b"]).withColumn("side", F.lit(1))
    rows = first.select(*key, "side", "class_id", "home").unionByName(second.select(*key, "side", "class_id", "home")).join(sets, "class_id")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["side", "class_id"])
        left, right = part[part.side == 0], part[part.side == 1]
        same = not len(right)
        right = left if same else right
        found = links_of_blocks(list(left.tokens), list(right.tokens), percent)
        if same:
            found = np.triu(found, 1)
        names = pd.factorize(pd.concat([left.home, right.home]))[0]
        root = list(range(names.max() + 1))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        out = []
        of_left, of_right = names[:len(left)], names[len(left):]
        found &= of_left[:, None] != of_right[None, :]
        for i, j in zip(*np.nonzero(found)):
            a, b = find(of_left[i]), find(of_right[j])
            if a != b:
                root[a] = b
                out.append((left.class_id.iat[i], right.class_id.iat[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy(*key).applyInPandas(run, "a binary, b binary")


def joined(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The columns of ``docs`` (doc_id, text and others) besides text, n_shingles, component_id
    and root, a name of the component (null for documents without words)."""
    known = shared_shingles(docs, words, percent)
    seen = materialise(sketches(docs, words, percent, frequent_shingles(known)), "sketches")
    full = seen.where("size > 0")
    classes = materialise(full.groupBy("class_id", "group_id", "size", "heavy").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "classes")
    members = classes.groupBy("group_id").agg(F.min("class_id").alias("centre"), F.count("*").alias("members"))

    groups = full.select("group_id", "size", "heavy", "prefix").dropDuplicates(["group_id"])
    postings = (groups.select("group_id", "size", "heavy", F.posexplode("prefix").alias("place", "token"), F.size("prefix").alias("length"))
                .select("group_id", "size", "heavy", "token", (F.col("place") >= F.col("length") - F.col("heavy")).alias("late")))
    # Low hashes are counted, the few others in prefixes are not.
    counted = F.col("token") <= int(low_edge(percent))
    columns = ["group_id", "size", "heavy", "token", "late"]
    postings = materialise(postings.where(counted).join(known.select("token"), "token").select(*columns).unionByName(postings.where(~counted).select(*columns)), "postings")
    light, late = postings.where("not late").drop("late"), postings.where("late").drop("late")

    # Light shingles: all pairs of groups, counted; the frequent ones of both prefixes may come on top.
    near = (paired(light, light, percent).where("a < b").groupBy("a", "b", "size_a", "size_b", "heavy_a", "heavy_b")
            .agg(F.count("*").alias("light")).withColumn("shared", F.col("light") + F.least("heavy_a", "heavy_b")))
    near = materialise(roomy(near, percent).select("a", "b"), "near")

    # Frequent shingles: each group and the centre, of about its size, that it shares most of them with.
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent)) if percent < 100 else F.col("size")
    banded = late.withColumn("band", band)
    star = (with_least(banded, ["token", "band"], "group_id", "b").where("group_id <> b").groupBy(F.col("group_id").alias("a"), "b").agg(F.count("*").alias("n"))
            .groupBy("a").agg(F.max(F.struct("n", "b")).alias("best")).select("a", F.col("best.b").alias("b")))

    # First links: members of a group to its centre, and centres of group pairs to each other.
    centre = members.select("group_id", "centre")
    first = (near.unionByName(star).join(centre.toDF("a", "centre_a"), "a").join(centre.toDF("b", "centre_b"), "b")
             .select(F.col("centre_a").alias("a"), F.col("centre_b").alias("b")))
    inner = classes.join(centre, "group_id").select(F.col("class_id").alias("a"), F.col("centre").alias("b"))
    met = class_pairs(first.unionByName(inner))
    links = materialise(verified(met, docs, classes, words, percent), "links")

    # What could still link two components: members of the same group pairs, and families over late shingles.
    homes = materialise(classes.join(components(links), F.col("class_id") == F.col("node"), "left")
                        .select("group_id", "class_id", "size", F.coalesce("root", "class_id").alias("home")), "homes")
    side = lambda n: homes.select(F.col("group_id").alias(n), F.col("class_id").alias(f"class_{n}"), F.col("home").alias(f"home_{n}"))
    left = near.join(side("a"), "a").join(side("b"), "b").where("home_a <> home_b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    more = verified(class_pairs(left, met), docs, classes, words, percent)

    kindred = with_least(late, ["token"], "group_id", "b")
    families = components(kindred.select(F.col("group_id").alias("a"), "b")).select(F.col("node").alias("group_id"), F.col("root").alias("family"))
    mixed = homes.groupBy("group_id").agg(F.min("home").alias("home"), F.max("home").alias("last")).where("home <> last").select("group_id")
    family = (families.unionByName(mixed.join(families, "group_id", "left_anti").select("group_id", F.col("group_id").alias("family"))))
    kin = homes.join(family, "group_id").select("class_id", "family", "size", "home")
    apart = kin.groupBy("family").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low <> high").select("family")
    kin = materialise(kin.join(apart, "family"), "kin")
    more = more.unionByName(compared(kin, whole_sets(kin.select("class_id"), docs, classes, words), percent))

    roots = components(links.unionByName(more))
    least = (classes.join(roots, F.col("class_id") == F.col("node"), "left").select("class_id", "doc_id", F.coalesce("root", "class_id").alias("root")))
    least = least.join(least.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("class_id", "root", "component_id")
    kept = [c for c in docs.columns if c != "text"]
    alone = seen.where("size = 0").select(*kept, F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("root"))
    return (full.select(*kept, "class_id", F.col("size").cast("long").alias("n_shingles")).join(least, "class_id")
            .select(*kept, "n_shingles", "component_id", "root").unionByName(alone))


def ngram_jaccard(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text).

    Two documents are linked if their shingle sets have a Jaccard similarity of at least
    ``percent`` / 100; component_id is the least doc_id that links reach.  Null and empty
    texts and texts without words have no shingles and no links.  Every row is a document
    of its own, also if its id or text repeats.
    """
    return joined(docs.select("doc_id", "text"), words, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all columns, one of each component: that with the least doc_id.

    Documents without words stay.  Rows with equal id and text are one document, and one of
    them stays.
    """
    row_id = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))))
    keyed = docs.select("doc_id", "text", row_id.alias("row_id"))
    found = materialise(joined(keyed, words, percent).select("doc_id", "row_id", "root"), "joined")
    stay = (found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "row_id")).alias("first")).select("first.row_id")
            .unionByName(found.where("root is null").select("row_id")).distinct())
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_id.alias("row_id"))
    rows = source.join(materialise(stay, "stay"), "row_id").dropDuplicates(["row_id"])
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
