"""Whole comparisons of object fingerprints: frames with defaults, five descriptors in one pass, and an ordered table of rules.

A fingerprint is a struct (FINGERPRINT) of a rating, metadata and frames; a frame carries up to five descriptors of a picture and
the pose of the camera. `compare` scores pairs of objects under every descriptor and says what follows, with coded reasons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import size_check
from tessera.functions.vectors import half_up
from tessera.operators import matching as M

#: Descriptors in order of preference, the field of a frame that has each, and how two of them are compared.
DESCRIPTORS = {"dino_p": ("emb_p", "vector"), "dino": ("emb", "vector"), "color_p": ("chist_p", "histogram"), "color": ("chist", "histogram"), "dhash": ("dhash", "bits")}
FALLBACK = ("color_p", "color", "dhash", "dino_p", "dino")
MIN_SHOTS, COLOUR_SEEN, SHARP, THIN_RATING = 3, 0.5, 12, 75
#: Frames in a block of objects.
FRAMES = 1024
#: Differing bits up to which hashes are the same, and from which on they have nothing in common.
SAME_BITS, OTHER_BITS = 6, 22

FRAME = "struct<file: string, cell: string, sector: int, seq: int, chist: array<double>, chist_p: array<double>, dhash: array<bigint>, emb: array<double>, emb_p: array<double>, mat: struct<az: double, el: double>, sharp: double>"
FINGERPRINT = f"struct<rating: double, tier: string, created: string, metadata: struct<dominantColor: struct<name: string, hex: string>, dimensions_mm: struct<width: double, depth: double, height: double>, hasEmbeddings: boolean>, frames: array<{FRAME}>>"


def parse_fingerprint(c: Column) -> Column:
    """The FINGERPRINT in a JSON text; fields of another kind are null, and so is a text that isn't an object."""
    return F.from_json(c, FINGERPRINT)


def frames_of(fp: Column) -> Column:
    """The frames of a fingerprint with defaults: a file name by place, a cell of its own, sector -1, seq from 1."""

    def one(f: Column, i: Column) -> Column:
        file = F.coalesce(f["file"], F.format_string("frames/%03d.jpg", i))
        cell = F.coalesce(F.nullif(f["cell"], F.lit("")), F.concat(F.lit("c"), file))
        az, el = (F.when(~F.isnan(f["mat"][x]) & (F.abs(f["mat"][x]) < float("inf")), f["mat"][x]) for x in ("az", "el"))
        both = az.isNotNull() & el.isNotNull()
        fields = [file.alias("file"), cell.alias("cell"), F.coalesce(f["sector"], F.lit(-1)).alias("sector"), F.coalesce(f["seq"], i + 1).alias("seq"), *(f[k].alias(k) for k, _ in DESCRIPTORS.values())]
        return F.when(f.isNotNull(), F.struct(*fields, F.when(both, F.pmod(az, F.lit(360.0))).alias("az"), F.when(both, el).alias("el"), f["sharp"].alias("sharp")))

    return F.coalesce(F.filter(F.transform(fp["frames"], one), lambda f: f.isNotNull()), F.array())


def has_descriptor(frame: Column, descriptor: str) -> Column:
    return F.coalesce(F.size(frame[DESCRIPTORS[descriptor][0]]) > 0, F.lit(False))


def carrying(frames: Column, descriptor: str) -> Column:
    """How many of the frames carry a descriptor."""
    return F.size(F.filter(frames, lambda f: has_descriptor(f, descriptor)))


def effort(frames: Column) -> Column:
    """How many of the frames are sharp, or of unknown sharpness."""
    return F.size(F.filter(frames, lambda f: F.coalesce(f["sharp"] >= SHARP, F.lit(True))))


def views(objects: DataFrame, key: str, fp: str) -> DataFrame:
    """A row for each frame: key and the frame's fields; objects without frames have none."""
    return objects.select(key, F.explode(frames_of(F.col(fp))).alias("f")).select(key, "f.*")


def fingerprint_summary(objects: DataFrame, key: str, fp: str) -> DataFrame:
    """key, rating, tier, created, views, views_with_embeddings, has_embeddings, views_with_pose, colour, hex, width, depth, height."""
    own = objects.select(key, F.col(fp).alias("fp"), frames_of(F.col(fp)).alias("f"))
    texture = F.size(F.filter("f", lambda f: has_descriptor(f, "dino") | has_descriptor(f, "dino_p")))
    meta = F.col("fp")["metadata"]
    told = F.coalesce(meta["hasEmbeddings"], F.lit(False)) | (texture > 0)
    return own.select(
        key, *(F.col("fp")[c].alias(c) for c in ("rating", "tier", "created")), F.size("f").alias("views"), texture.alias("views_with_embeddings"), told.alias("has_embeddings"),
        F.size(F.filter("f", lambda f: f["az"].isNotNull())).alias("views_with_pose"), meta["dominantColor"]["name"].alias("colour"), meta["dominantColor"]["hex"].alias("hex"), *(meta["dimensions_mm"][c].alias(c) for c in ("width", "depth", "height")),
    )


def headline(have: Column, other: Column) -> Column:
    """The descriptor that decides, from two maps of descriptor to how many frames carry it: the first that MIN_SHOTS on both sides do."""
    chosen = F.lit("color")
    for d in ("color", "dino"):
        chosen = F.when((have[d] > 0) & (other[d] > 0), d).otherwise(chosen)
    for d in reversed([d for d in DESCRIPTORS if d != "dhash"]):
        chosen = F.when((have[d] >= MIN_SHOTS) & (other[d] >= MIN_SHOTS), d).otherwise(chosen)
    return chosen


def similarities(q: list, r: list, kind: str) -> np.ndarray:
    """Each of q's descriptors (a list or None) against each of r's: 0 to 1, and 0 for what can't be compared."""
    out = np.zeros((len(q), len(r)))
    if kind == "bits":
        words = [[[(int(x or 0)) & 0xFFFFFFFF for x in v[:2]] if v is not None and len(v) >= 2 else None for v in side] for side in (q, r)]
        i, j = ([p for p, w in enumerate(side) if w] for side in words)
        if i and j:
            a, b = (np.array([side[p] for p in at], np.uint64) for side, at in zip(words, (i, j), strict=True))
            apart = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2).astype(float)
            out[np.ix_(i, j)] = np.clip((OTHER_BITS - apart) / (OTHER_BITS - SAME_BITS), 0, 1)
        return out
    sound = [[v if v is not None and len(v) and not any(x is None or x != x for x in v) else None for v in side] for side in (q, r)]
    for d in {len(v) for v in sound[0] if v} & {len(v) for v in sound[1] if v}:
        i, j = ([p for p, v in enumerate(side) if v and len(v) == d] for side in sound)
        unit = []
        for side, at in zip(sound, (i, j), strict=True):
            m = np.array([side[p] for p in at], float)
            m = m - m.mean(axis=1, keepdims=True) if kind == "histogram" else m
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            unit.append(m / np.where(norm > 0, norm, 1))
        out[np.ix_(i, j)] = np.clip(unit[0] @ unit[1].T, 0, 1)
    return out


def _scored(q: list[dict], r: list[dict], rules: str) -> list[dict]:
    """For each descriptor the pairs of shots and views, as sums that `compare` needs."""
    poses = [[(f["az"], f["el"]) if f["az"] is not None else None for f in side] for side in (q, r)]
    cells = [f["cell"] for f in r]
    out = []
    for name, (field, kind) in DESCRIPTORS.items():
        left, right = [f[field] for f in q], [f[field] for f in r]
        have, other = sum(bool(v) for v in left), sum(bool(v) for v in right)
        row = {"descriptor": name, "shots_with": have, "views_with": other, "sims": [], "views_matched": 0, "pose_used": False, "turn": None}
        if have and other:
            s = similarities(left, right, kind)
            if rules == "v2":
                taken, turn = M.greedy(s, *poses)
                row |= {"pose_used": turn is not None, "turn": turn}
                best = list(taken.items())
            else:
                best = list(enumerate(s.argmax(axis=1).tolist()))
            strong = [(round(float(round(s[i, j], 6) if rules == "v2" else s[i, j]), 4), cells[j]) for i, j in best]
            strong = [x for x in strong if x[0] >= M.STRONG]
            row |= {"sims": sorted((x for x, _ in strong), reverse=True), "views_matched": len({c for _, c in strong})}
        out.append(row)
    return out


SCORES = "array<struct<descriptor: string, shots_with: int, views_with: int, sims: array<double>, views_matched: int, pose_used: boolean, turn: int>>"


def scores(captures: DataFrame, refs: DataFrame, pairs: DataFrame | None, rules: str = "v2") -> DataFrame:
    """q, r, each side's fields and `scores`, one struct a descriptor, for pairs (q, r) of captures and refs (id, fp); without pairs for all.

    Both sides' frames meet in Arrow batches (bounded in bytes by Spark), a pair at a time; pairs of one object come together, so
    that it is made ready once.
    """
    if pairs is None:
        if rules == "v1":
            return _all_scores(captures, refs)
        pairs = M.candidate_pairs(*(df.select(F.col("id").alias("owner")) for df in (captures, refs)))
    own = lambda df, side: df.select(F.col("id").alias(side), F.col("fp").alias(f"{side}_fp")).select(side, frames_of(F.col(f"{side}_fp")).alias(f"{side}_frames"), *_facts(side))
    both = pairs.select("q", "r").distinct().join(own(captures, "q"), "q").join(own(refs, "r"), "r")
    kept = [c for c in both.columns if not c.endswith("_frames")]
    kinds = dict(both.dtypes)
    fields = pa.list_(pa.struct([("descriptor", pa.string()), ("shots_with", pa.int32()), ("views_with", pa.int32()), ("sims", pa.list_(pa.float64())), ("views_matched", pa.int32()), ("pose_used", pa.bool_()), ("turn", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, r = batch.column("q_frames"), batch.column("r_frames")
            out = [_scored(q[i].as_py(), r[i].as_py(), rules) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, fields)], [*kept, "scores"])

    return both.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + f", scores {SCORES}")


class _Objects:
    """A block's objects: `code` is each frame's object; `some` are those that have frames, which begin at `starts`."""

    def __init__(self, rows: pa.RecordBatch):
        self.rows, frames = rows, rows.column("frames")
        counts = pc.list_value_length(frames).to_numpy()
        self.code, self.some = np.repeat(np.arange(len(counts)), counts), np.flatnonzero(counts)
        self.sizes = counts[self.some]
        self.ends = np.concatenate([[0], np.cumsum(counts)])
        self.starts = self.ends[self.some]
        flat = frames.flatten()
        self.cells = M.codes(flat.field("cell"))
        self.sides, self.have = {}, {}
        for name, (field, kind) in DESCRIPTORS.items():
            lists = flat.field(field)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            self.have[name] = np.bincount(self.code[size > 0], minlength=len(counts))
            self.sides[name] = _words(lists, size) if kind == "bits" else _unit_views(lists, size, kind)

    def chunks(self, width: int) -> Iterator[tuple[int, int]]:
        """Runs of objects (from, to) whose products with `width` frames, and whose pairs, can be held at once."""
        first = 0
        for k in range(1, len(self.ends)):
            if k == len(self.ends) - 1 or (self.ends[k + 1] - self.ends[first]) * width > M.PRODUCTS:
                yield first, k
                first = k


def _words(lists: pa.ListArray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the lists hold two words, and these as one number."""
    at = np.flatnonzero(size >= 2)
    own = lists.take(pa.array(at))
    hi, lo = (pc.fill_null(pc.list_element(own, k), 0).to_numpy().astype(np.uint64) & np.uint64(0xFFFFFFFF) for k in (0, 1))
    return at, hi << np.uint64(32) | lo


def _unit_views(lists: pa.ListArray, size: np.ndarray, kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """matching.units of the lists without nulls, NaN and infinities, centred if they are histograms."""
    flat = pc.fill_null(lists.flatten(), float("nan")).to_numpy()
    broken = np.unique(pc.list_parent_indices(lists).to_numpy()[~np.isfinite(flat)])
    sound = np.setdiff1d(np.flatnonzero(size), broken)
    out = {}
    for d, (i, m) in M.units(lists.take(pa.array(sound))).items():
        m = m - m.mean(axis=1, keepdims=True) if kind == "histogram" else m
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        out[d] = (sound[i], m / np.where(norm > 0, norm, 1))
    return out


def _like(x: tuple, y: tuple, lo: int, hi: int, width: int) -> np.ndarray:
    """`similarities` of hashes lo to hi with all others."""
    out, (i, a), (j, b) = np.zeros((hi - lo, width)), x, y
    p, q = np.searchsorted(i, [lo, hi])
    apart = np.bitwise_count(a[p:q, None] ^ b[None, :]).astype(float)
    out[np.ix_(i[p:q] - lo, j)] = np.clip((OTHER_BITS - apart) / (OTHER_BITS - SAME_BITS), 0, 1)
    return out


def _all_scores(captures: DataFrame, refs: DataFrame) -> DataFrame:
    """`scores` (v1) of every capture with every other object: blocks of objects meet, and each descriptor's products are made at once."""
    own = lambda df, side: df.where("id IS NOT NULL").select("id", F.col("fp").alias(f"{side}_fp")).select("id", frames_of(F.col(f"{side}_fp")).alias("frames"), *_facts(side))
    left, right = own(captures, "q"), own(refs, "r")
    kept = {side: [c for c in df.columns if c.startswith(f"{side}_")] for side, df in (("q", left), ("r", right))}
    schema = f"q {dict(left.dtypes)['id']}, r {dict(right.dtypes)['id']}, " + "".join(f"{c} {kind}, " for side, df in (("q", left), ("r", right)) for c, kind in df.dtypes if c in kept[side]) + f"scores {SCORES}"
    names = list(DESCRIPTORS)

    def pairs(x: _Objects, y: _Objects) -> Iterator[pa.RecordBatch]:
        width, others, every = len(y.code), y.rows.num_rows, len(names)
        ids = pa.concat_arrays([x.rows.column("id"), y.rows.column("id")]).dictionary_encode().indices.to_numpy()
        other = ids[: x.rows.num_rows, None] != ids[None, x.rows.num_rows :]
        for first, to in x.chunks(max(width, others)):
            lo, hi = int(x.ends[first]), int(x.ends[to])
            found = [(np.zeros(0, int), np.zeros(0), np.zeros(0, int))]
            for d, name in enumerate(names if hi > lo and width else []):
                a, b = x.sides[name], y.sides[name]
                s = _like(a, b, lo, hi, width) if isinstance(a, tuple) else M.products(a, b, lo, hi, width)
                a, b = ({}, {}) if isinstance(a, tuple) else (a, b)
                i, r, j, v = M.first_best(s, lo, a, b, y.starts, y.sizes, M.STRONG - 1e-4)
                v = np.array([round(z, 4) for z in v.tolist()], float)
                i, r, j, v = i[v >= M.STRONG], r[v >= M.STRONG], j[v >= M.STRONG], v[v >= M.STRONG]
                found.append((((x.code[i + lo] - first) * others + y.some[r]) * every + d, v, y.cells[j]))
            key, v, cell = (np.concatenate(c) for c in zip(*found, strict=True))
            strong, matched = M.lists_by(key, (to - first) * others * every, v, cell)
            q, r = np.nonzero(other[first:to])
            at = ((q * others + r)[:, None] * every + np.arange(every)).ravel()
            q = q + first
            counts = [pa.array(np.stack([side.have[n] for n in names])[:, k].T.ravel(), pa.int32()) for side, k in ((x, q), (y, r))]
            each = pa.StructArray.from_arrays(
                [pa.array(np.tile(names, len(q)), pa.string()), *counts, strong.take(pa.array(at)), pa.array(matched[at], pa.int32()), pa.array(np.zeros(len(at), bool)), pa.nulls(len(at), pa.int32())],
                ["descriptor", "shots_with", "views_with", "sims", "views_matched", "pose_used", "turn"],
            )
            scored = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * every, pa.int32()), each)
            facts = [side.rows.column(c).take(pa.array(k)) for side, k, s in ((x, q, "q"), (y, r, "r")) for c in ("id", *kept[s])]
            cut = 1 + len(kept["q"])
            yield pa.RecordBatch.from_arrays([facts[0], facts[cut], *facts[1:cut], *facts[cut + 1 :], scored], ["q", "r", *kept["q"], *kept["r"], "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from pairs(*(_Objects(M.unpack(batch, c, k)) for c in ("x_rows", "y_rows")))

    x, y = (M.blocks(df, "id", "frames", side, M.BLOCK, numbers=FRAMES) for df, side in ((left, "x"), (right, "y")))
    return M.met(x, y).mapInArrow(run, schema)


def _facts(side: str) -> list[Column]:
    fp, frames = F.col(f"{side}_fp"), frames_of(F.col(f"{side}_fp"))
    size = fp["metadata"]["dimensions_mm"]
    positive = lambda c: F.when(c != 0, c)
    measured = F.coalesce(size["width"], size["depth"], size["height"]).isNotNull()
    return [
        F.size(frames).alias(f"{side}_shots"), effort(frames).alias(f"{side}_effort"), F.greatest(positive(size["width"]), positive(size["depth"])).alias(f"{side}_foot"), size["height"].alias(f"{side}_height"),
        measured.alias(f"{side}_measured"), fp["rating"].alias(f"{side}_rating"), F.create_map(*(x for d in DESCRIPTORS for x in (F.lit(d), carrying(frames, d)))).alias(f"{side}_has"),
    ]


def insufficient(descriptor: Column, shots_with: Column, views_with: Column, shots: Column) -> Column:
    """A code of why these shots can't support any verdict, or null."""
    blind = descriptor.isin("color", "color_p") & (shots_with < COLOUR_SEEN * shots)
    return F.when(shots_with < MIN_SHOTS, "few_shots").when(views_with < MIN_SHOTS, "few_views").when(blind, "colour_unseen")


def _judged(s: Column, rules: str, effort_: Column, shots: Column) -> Column:
    """A descriptor's scores with confidence, quality, spread, strong, available, insufficient and verdict."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    top = F.slice(s["sims"], 1, M.TOP_SIMS)
    quality = F.when(F.size(s["sims"]) > 0, total(top) / F.size(top)).otherwise(0.0)
    spread = F.least(F.lit(1.0), s["views_matched"] / M.SPREAD_TARGET)
    available = (s["shots_with"] > 0) & (s["views_with"] > 0)
    if rules == "v2":
        confidence = F.when(available, half_up(100 * total(s["sims"]) / s["shots_with"])).otherwise(0)
        why = F.when(available, insufficient(s["descriptor"], s["shots_with"], s["views_with"], shots))
    else:
        confidence, why = half_up(100 * quality * (0.4 + 0.6 * spread)), F.lit(None).cast("string")
    said = M.verdict(confidence, s["views_matched"], effort_)
    said = F.when(why.isNotNull() & (said != "match"), "insufficient").otherwise(said)
    return F.struct(
        s["descriptor"].alias("descriptor"), available.alias("available"), confidence.alias("confidence"), F.round(quality, 4).alias("quality"), F.round(spread, 4).alias("spread"), s["views_matched"].alias("views_matched"), F.size(s["sims"]).alias("strong"),
        s["shots_with"].alias("shots_with"), s["views_with"].alias("views_with"), s["pose_used"].alias("pose_used"), s["turn"].alias("turn"), why.alias("insufficient"), F.when(available, said).alias("verdict"),
    )


def compare(captures: DataFrame, refs: DataFrame, pairs: DataFrame | None = None, rules: str = "v2", descriptor: str | None = None, least_effort: int | None = None) -> DataFrame:
    """q, r, descriptor, confidence, verdict, quality, spread, views_matched, strong, pose_used, turn, shots, effort, size_ok,
    size_difference, size_conflict, breakdown, reasons, caveats for each pair (q, r) of captures and refs (id, fp a FINGERPRINT); without
    pairs for every capture with every other object.

    rules: "v1" gives each shot its best view, "v2" pairs one to one and knows "insufficient". descriptor overrides the choice of the
    deciding one; if the chosen one can't be compared the first of FALLBACK that can is taken. least_effort stands for the count of
    sharp shots. Pairs whose ids are unknown have no row; a null fingerprint has no frames. reasons and caveats are coded, in this order.
    """
    df = scores(captures, refs, pairs, rules)
    spent = F.lit(least_effort) if least_effort is not None else F.col("q_effort")
    # Each step is exploded from an array of one, or its expressions would be computed again by everything that reads them.
    df = df.withColumn("effort", spent).withColumn("breakdown", F.transform("scores", lambda s: _judged(s, rules, F.col("effort"), F.col("q_shots"))))
    wanted = F.lit(descriptor) if descriptor in DESCRIPTORS else headline(F.col("q_has"), F.col("r_has"))
    of = lambda name: F.get(F.filter("breakdown", lambda b: b["descriptor"] == name), 0)
    usable = F.filter(F.array(wanted, *map(F.lit, FALLBACK)), lambda d: F.exists("breakdown", lambda b: (b["descriptor"] == d) & b["available"]))
    df = df.withColumn("descriptor", F.coalesce(F.get(usable, 0), wanted))
    size = size_check(F.col("q_foot"), F.col("q_height"), F.col("r_foot"), F.col("r_height"))
    df = df.withColumn("size", size).withColumn("h", of(F.col("descriptor")))
    conflict = F.coalesce(~F.col("size.ok"), F.lit(False))
    h = F.col("h")
    said = F.coalesce(h["verdict"], F.lit("inconc"))
    texture = F.exists("breakdown", lambda b: (b["descriptor"] == "dino") & ~b["available"]) & F.exists("breakdown", lambda b: (b["descriptor"] == "dino_p") & ~b["available"]) & (F.col("descriptor") != "dino")
    others = F.transform(F.filter("breakdown", lambda b: b["available"] & (b["descriptor"] != F.col("descriptor"))), lambda b: F.concat(F.lit("also:"), b["descriptor"], F.lit(":"), b["confidence"].cast("string")))
    sized = (
        F.when(~F.col("q_measured") & ~F.col("r_measured"), "size:none").when(~F.col("q_measured"), "size:not_captured").when(~F.col("r_measured"), "size:not_registered")
        .when(F.col("size.ok").isNull(), "size:not_comparable").when(F.col("size.ok"), "size:within").otherwise("size:apart")
    )
    alone = F.when(h["available"], F.concat(F.lit("headline:"), F.col("descriptor"))).otherwise("nothing_to_compare")
    partial = F.when(h["insufficient"].isNotNull(), F.concat(F.lit("insufficient:"), h["insufficient"])).when(h["available"] & (h["shots_with"] < F.col("q_shots")), "partly_carried")
    reasons = F.concat(F.array_compact(F.array(alone, F.when(h["pose_used"], "poses_used"), partial)), others, F.array_compact(F.array(F.when(texture, "no_texture"), sized)))
    caveats = F.array_compact(F.array(
        F.when(conflict & (said == "match"), "held_by_size"), F.when(F.col("r_rating") < THIN_RATING, "thin_reference"),
        F.when(F.col("effort") < M.MIN_EFFORT, "few_sharp_shots"), F.when(F.col("descriptor").isin("color", "color_p"), "colour_alone"),
    ))
    return df.select(
        "q", "r", "descriptor", F.coalesce(h["confidence"], F.lit(0)).alias("confidence"), F.when(conflict & (said == "match"), "inconc").otherwise(said).alias("verdict"),
        *(F.coalesce(h[c], F.lit(0)).alias(c) for c in ("quality", "spread", "views_matched", "strong")), F.coalesce(h["pose_used"], F.lit(False)).alias("pose_used"), h["turn"].alias("turn"),
        F.col("q_shots").alias("shots"), "effort", F.col("size.ok").alias("size_ok"), F.col("size.difference").alias("size_difference"), conflict.alias("size_conflict"), "breakdown", reasons.alias("reasons"), caveats.alias("caveats"),
    )


def near_pairs(captures: DataFrame, refs: DataFrame, near: int, field: str = "emb") -> DataFrame:
    """q, r: for each capture the `near` objects of refs (id, fp) whose mean vector is nearest to its own; what has no vectors is left out.

    Exact over means, but an object whose single views match can have a mean further away: use matching.candidate_pairs for all.
    """
    mean = lambda df: M.centroids(views(df, "id", "fp"), "id", field)
    found = M.knn(mean(captures), mean(refs), "id", "centroid", near)
    return found.select(F.col("query").alias("q"), F.col("id").alias("r"))


def rank_candidates(compared: DataFrame, k: int = 5) -> DataFrame:
    """matching.candidates of compared pairs with each one's descriptor and verdict."""
    return M.candidates(compared, k).join(compared.select("q", "r", "descriptor", "verdict"), ["q", "r"])
