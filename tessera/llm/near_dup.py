"""Near-duplicate documents by HyperMinHash.

Each document becomes a set of word shingles, each set 256 registers of 16 bits: the shingles are dealt to buckets by
the first 8 bits of their hash, and a register holds, of the smallest remaining value in its bucket, the count of leading
zeros and 10 mantissa bits. An empty bucket borrows the register of the first non-empty one in a fixed random order of
its own. 51 bands of 5 compressed registers propose candidates; a collision-corrected Jaccard estimate from the
registers drops the far ones; what is left is confirmed on the full sets.

Two sets of similarity 0.8 share fewer than 3 bands with a chance of about 5e-7, and an estimate below 0.67 is more than five standard
deviations off. Inside a band's bucket members are first compared with two pivots (the smallest and largest id). Only
where several components are then left, members are compared further across components, in blocks, so a group of n near
copies costs about n comparisons, and yet no link is lost. Equal sets count as one node throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import components, dropped, joined, small, table
from tessera.llm.words import U, shingle_hashes, slices, text_bytes, word_hashes

REGISTERS, MANTISSA, ROWS = 256, 10, 5
#: Bits of a hash besides those that choose its bucket.
REST = 56
_PROBES = np.random.default_rng(20240229).integers(0, REGISTERS, (1024, REGISTERS))
#: Registers of unrelated sets agree by chance when leading zeros (chance 1/3) and mantissa do.
COLLISION = 2.0**-MANTISSA / 3
#: Pairs below this estimate can't be similar. Sets in a block of a family.
NEAR, BLOCK = 0.67, 128
#: Registers that sets of such an estimate have in common at least.
AGREE = next(c for c in range(REGISTERS + 1) if (c / REGISTERS - COLLISION) / (1 - COLLISION) >= NEAR)
#: Bands that a similar pair shares at least. Members of a bucket that are compared without a look at its ends first.
SHARED, FEW = 3, 6


def registers(shingles: np.ndarray) -> np.ndarray:
    """The registers of a non-empty sorted array of distinct hashes."""
    bucket = np.arange(REGISTERS, dtype=U)
    at = np.minimum(np.searchsorted(shingles, bucket << U(REST)), len(shingles) - 1)
    full = (shingles[at] >> U(REST)) == bucket
    part, power = np.frexp((shingles[at] & U((1 << REST) - 1)).astype(np.float64))
    mantissa = np.maximum((part - 0.5) * (2 << MANTISSA), 0).astype(np.uint16)
    out = ((REST - np.minimum(power, REST)).astype(np.uint16) << MANTISSA) | mantissa
    empty = np.flatnonzero(~full)
    for depth in (64, len(_PROBES)):
        if len(empty):
            hit = full[_PROBES[:depth, empty]]
            first, found = hit.argmax(0), hit.any(0)
            out[empty[found]] = out[_PROBES[first[found], empty[found]]]
            empty = empty[~found]
    if len(empty):
        own = np.flatnonzero(full)
        out[empty] = out[own[np.searchsorted(own, empty) % len(own)]]
    return out


def shingle_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches):
        data, off = text_bytes(batch.column("text"))
        h, at = shingle_hashes(*word_hashes(data, off), k)
        sets = []
        for i in range(batch.num_rows):
            s = np.sort(h[at[i] : at[i + 1]])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
        yield batch, sets


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits, equal for equal sets; null for empty ones), registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in shingle_sets(batches, k):
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            regs = [registers(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "set_key", "registers"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, registers binary")


def _estimates(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, est): the collision-corrected similarity that the registers of each pair promise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                est = ((x == y).mean(1) - COLLISION) / (1 - COLLISION)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est)], ["a", "b", "est"])

    reg = nodes.select("node", "registers")
    both = pairs.join(reg.toDF("a", "ra"), "a").join(reg.toDF("b", "rb"), "b").select("a", "b", "ra", "rb")
    return both.mapInArrow(run, "a long, b long, est double")


def _lanes(nodes: DataFrame) -> DataFrame:
    """(node, lanes): the registers of each node as whole numbers of four each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("registers").to_pylist()), "<i8")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * (REGISTERS // 4), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "lanes"])

    return nodes.select("node", "registers").mapInArrow(run, "node long, lanes array<long>")


def _agree(x: str, y: str) -> str:
    """SQL: how many registers two `lanes` have in common. Of four at a time two have room to carry where they differ."""
    mask, carry = 0x0000FFFF0000FFFF, 0x0001000000010000
    apart = lambda v: f"bit_count((({v} & {mask}L) + {mask}L) & {carry}L)"
    return f"{REGISTERS} - aggregate(zip_with({x}, {y}, (p, q) -> {apart('(p ^ q)')} + {apart('shiftrightunsigned(p ^ q, 16)')}), 0, (s, d) -> s + d)"


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                keep.append(_similar(p, q, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = pairs.select("a", "b").join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return own.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _family_links(family: DataFrame, root: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components inside each family (node, root: the family) of near documents.

    The largest component of a family needs no further links in itself. Every other member is compared with all members
    of other components, in pairs of blocks of about BLOCK sets, each pair of blocks a task's group of its own; inside it
    a link that joins what is joined already is skipped, so a group yields fewer links than it has members.
    """
    named = family.toDF("node", "family").join(root, "node", "left").select("node", "family", F.coalesce("root", "node").alias("root"))
    named = table(named, "families")
    parts = named.groupBy("family", "root").agg(F.count("*").alias("n"))
    mains = parts.groupBy("family").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n")).where("n > most.n")
    mains = mains.select("family", F.col("most.root").alias("main"), F.ceil(F.col("most.n") / BLOCK).alias("of_main"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("of_rest"))
    rows = named.join(mains, "family").withColumn("is_main", F.col("root") == F.col("main")).join(sets, "node")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("of_main")).otherwise(F.col("of_rest")))
    rows = rows.withColumn("own", own).withColumn("with_main", F.sequence(F.lit(0), F.col("of_main") - 1)).withColumn("with_rest", F.sequence(F.lit(0), F.col("of_rest") - 1))
    across = F.transform(F.col("with_rest"), lambda i: F.struct(F.lit(True).alias("m"), i.alias("i"), F.col("own").alias("j")))
    down = F.transform(F.col("with_main"), lambda j: F.struct(F.lit(True).alias("m"), F.col("own").alias("i"), j.alias("j")))
    among = F.transform(F.col("with_rest"), lambda j: F.struct(F.lit(False).alias("m"), F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    rows = rows.select("family", "node", "root", "is_main", "set", F.explode(F.when(F.col("is_main"), across).otherwise(F.concat(down, among))).alias("at"))

    def compare(group: pa.Table) -> pa.Table:
        nodes, roots, main = group["node"].to_pylist(), group["root"].to_pylist(), group["is_main"].to_pylist()
        sets = [np.frombuffer(x.as_buffer(), U) for x in group["set"]]
        regs = np.array([registers(s) for s in sets]).reshape(-1, REGISTERS)
        above = {r: r for r in roots}

        def top(r: int) -> int:
            while above[r] != r:
                above[r] = r = above[above[r]]
            return r

        found = []
        for i in range(len(nodes)):
            if not main[i]:
                est = ((regs == regs[i]).mean(1) - COLLISION) / (1 - COLLISION)
                for j in np.flatnonzero(est >= NEAR):
                    if (main[j] or j > i) and top(roots[i]) != top(roots[j]) and _similar(sets[i], sets[j], percent):
                        above[max(top(roots[i]), top(roots[j]))] = min(top(roots[i]), top(roots[j]))
                        found.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.groupBy("family", "at").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text and any other columns).

    Documents are linked when the Jaccard similarity of their k-word shingle sets is at least percent / 100; the
    component_id is the smallest doc_id that links reach. A null, empty or blank text has an empty set and no links.
    Rows that repeat a doc_id count as one document in the graph and give a row each. A row without doc_id takes no
    part: its component_id is null and it is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = table(sketches(docs, k), "sketches")
    known = rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    nodes = table(known.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.first("registers").alias("registers")), "nodes")
    # Sets of fewer than 4 shingles are this similar only if they are equal.
    able = nodes.where(f"n >= {-(-percent // (100 - percent)) if percent < 100 else 2**62}")
    own_bands = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(REGISTERS // ROWS)])
    bands = able.select("node", F.col("n").cast("int").alias("n"), F.explode(own_bands).alias("bucket"))
    bands = bands.repartition("bucket")  # one exchange serves the ends and the members
    ends = bands.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min_by("n", "node").alias("nlo"), F.max_by("n", "node").alias("nhi")).where("lo < hi")
    # Whether a member's set and its pivot's are near enough in size to be similar at all.
    sized = lambda a, b: F.col(a).cast("long") * 100 >= F.col(b).cast("long") * percent
    fits = {"lo_fits": sized("n", "nlo") & sized("nlo", "n"), "hi_fits": sized("n", "nhi") & sized("nhi", "n")}
    members = table(bands.join(ends, "bucket").select("bucket", "node", "lo", "hi", *[c.alias(k) for k, c in fits.items()]), "members")

    def sets_of(some: DataFrame, but: DataFrame | None = None) -> DataFrame:
        """(node, set) of the nodes in some, less those in but; equal sets have one node, so one row of a node does."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, sets in shingle_sets(batches, k):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])

        wanted = some.select(F.col("a").alias("doc_id")).unionAll(some.select("b")).distinct()
        if but is not None:
            wanted = wanted.join(but.select(F.col("a").alias("doc_id")).unionAll(but.select("b")), "doc_id", "left_anti")
        # Ids alone are sent to where the texts are; only where they are too many are texts shuffled.
        return table(docs.join(small(table(wanted, "wanted")), "doc_id", "left_semi").mapInArrow(run, "node long, set binary"), "sets")

    def apart(some: DataFrame) -> DataFrame:
        """Those pairs whose ends are in different components so far."""
        r = root.select("node", "root")
        some = some.join(r.toDF("a", "xa"), "a", "left").join(r.toDF("b", "xb"), "b", "left")
        return some.where("coalesce(xa, a) <> coalesce(xb, b)").drop("xa", "xb")

    # One pair for each node, with the smallest pivot of its buckets, joins most of a large group; ends that are joined need no estimate.
    first = members.where("lo < node AND lo_fits").groupBy("node").agg(F.min("lo").alias("lo")).select(F.col("lo").alias("a"), F.col("node").alias("b"))
    known = table(_estimates(first, able), "known")
    tried = known.where(f"est >= {NEAR}")
    sets = sets_of(tried)
    root = components(table(_confirmed(tried, sets, percent), "links"))
    ways = F.array(F.struct(F.col("lo").alias("a"), F.col("node").alias("b"), F.col("lo_fits").alias("fits")), F.struct(F.col("node").alias("a"), F.col("hi").alias("b"), F.col("hi_fits").alias("fits")))
    pairs = members.select(F.explode(ways).alias("p")).select("p.*").where("a < b AND fits").select("a", "b").distinct()
    near = table(_estimates(apart(pairs.join(known, ["a", "b"], "left_anti")), able), "near")
    known, near = known.unionAll(near), near.where(f"est >= {NEAR}")
    sets = sets.unionAll(sets_of(near, but=tried))
    best = near.groupBy("b").agg(F.max_by("a", "est").alias("a")).select("a", "b")
    root = joined(root, table(_confirmed(best, sets, percent), "links"))
    root = joined(root, table(_confirmed(apart(near), sets, percent), "links"))
    # What two pivots of a bucket can't decide. Members near a pivot: families of near pairs that still hold several components.
    root = joined(root, table(_family_links(components(near.unionAll(tried)), root, sets, percent), "links"))
    # The others, bucket by bucket. The share of registers that differ is a metric, so two sets whose estimates to a pivot
    # differ by more than 1 - NEAR have an estimate below NEAR themselves: both pivots rule such pairs out unseen.
    named = members.join(root, "node", "left").select("bucket", "node", "lo", "hi", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 <> r1 AND n > 3").select("bucket", (F.col("n") > FEW).alias("many"))
    inner = table(named.join(mixed, "bucket").where("node <> lo AND node <> hi"), "inner")
    both_ends = inner.where("many").select(F.col("lo").alias("a"), F.col("node").alias("b")).unionAll(inner.where("many").select("node", "hi")).distinct()
    to_pivot = known.unionAll(table(_estimates(both_ends.join(known, ["a", "b"], "left_anti"), able), "to_pivot"))
    # Few members are fewer pairs than ends to estimate, so nothing rules their pairs out.
    inner = inner.join(to_pivot.toDF("lo", "node", "el"), ["lo", "node"], "left").join(to_pivot.toDF("node", "hi", "eh"), ["node", "hi"], "left").join(able.select("node", "n", own_bands.alias("bands")), "node").join(_lanes(able), "node")
    inner = table(inner.select("bucket", "node", "n", "root", "el", "eh", "bands", "lanes"), "inner")
    x, y = inner.toDF("bucket", "a", "na", "xa", "la", "ha", "ba", "ra"), inner.where(f"coalesce(el, 0) < {NEAR}").toDF("bucket", "b", "nb", "xb", "lb", "hb", "bb", "rb")
    apart_by = f"coalesce(abs(la - lb) <= {1 - NEAR + 1e-9}, true) AND coalesce(abs(ha - hb) <= {1 - NEAR + 1e-9}, true)"
    # A pair comes up in the first of the buckets that it shares, and in no other.
    same = "zip_with(ba, bb, (p, q) -> p = q)"
    first_shared = f"element_at(ba, cast(array_position({same}, true) AS int)) = bucket AND size(filter({same}, p -> p)) >= {SHARED}"
    # The join itself looks at the registers, so that no pair that they rule out becomes a row.
    rest = x.join(y, "bucket").where(f"xa <> xb AND {apart_by} AND (coalesce(la, 0) >= {NEAR} OR a < b) AND 100 * least(na, nb) >= {percent} * greatest(na, nb) AND {first_shared} AND {_agree('ra', 'rb')} >= {AGREE}")
    rest = table(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "rest")
    dropped(inner)
    dropped(members)
    if not rest.isEmpty():
        root = joined(root, table(_confirmed(rest, sets_of(rest), percent), "links"))
    keyed = nodes.join(root, "node", "left").select("set_key", F.coalesce("root", "node").alias("root"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(keyed, "set_key", "left")
    whose = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", whose.alias("component_id"), F.col("doc_id").eqNullSafe(whose).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs less near copies: of each component the document with the smallest doc_id stays.

    Rows that repeat a kept doc_id stay all; rows without doc_id stay.
    """
    gone = near_duplicates(docs, k, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
