"""Whole comparisons against plain Python on fingerprints with all descriptors, poses, sizes, blanks and broken values."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import comparison as C

RNG = random.Random(7)
HUES = {"orange": 1, "amber": 2, "green": 6, "blue": 10, "violet": 12, "red": 15}
KEYS = {"dino_p": "emb_p", "dino": "emb", "color_p": "chist_p", "color": "chist", "dhash": "dhash"}


def hist(hue, noise=25):
    h = [RNG.randint(0, noise) for _ in range(64)]
    h[HUES[hue] * 4 + 2] += 650
    h[HUES[hue] * 4 + 3] += 250
    return h


def vector(k, noise=0.04):
    return [round((i == k) + RNG.uniform(-noise, noise), 5) for i in range(16)]


def made(hue, n=12, emb=None, dims=None, sharp=40.0, rating=84, piece=0, turn=None, blank=0):
    frames = []
    for i in range(n):
        f = {"file": f"frames/{i:03d}.jpg", "seq": i + 1, "cell": f"{i % 8}:1", "sharp": sharp, "chist": hist(hue) if i >= blank else [], "dhash": [RNG.getrandbits(32), RNG.getrandbits(32)]}
        if emb is not None and i < 8:
            f["emb"] = vector(emb)
        if i < piece:
            f["emb_p"], f["chist_p"] = vector((emb or 0) + 1), hist(hue, 5)
        if turn is not None:
            f["mat"] = {"az": (i * 30 + turn) % 720 - 360, "el": 20 + i}
        frames.append(f)
    return {"created": "2026", "rating": rating, "tier": "Strong", "metadata": {"dimensions_mm": dims} if dims else {}, "frames": frames}


def near(a, b, name):
    if name == "dhash":
        if not a or not b or len(a) < 2 or len(b) < 2:
            return 0.0
        bits = sum(((x & 0xFFFFFFFF) ^ (y & 0xFFFFFFFF)).bit_count() for x, y in zip(a[:2], b[:2], strict=True))
        return min(1.0, max(0.0, (22 - bits) / 16))
    if not a or not b or len(a) != len(b) or any(x is None for x in a + b):
        return 0.0
    if name.startswith("color"):
        a, b = ([x - sum(v) / len(v) for x in v] for v in (a, b))
    top, bottom = sum(x * y for x, y in zip(a, b, strict=True)), math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    return min(1.0, max(0.0, top / bottom)) if bottom else 0.0


def pose(f):
    m = f.get("mat") or {}
    return (m["az"] % 360, m["el"]) if isinstance(m.get("az"), (int, float)) and isinstance(m.get("el"), (int, float)) else None


def scored(qf, rf, name, rules):
    """(sim, cell) of the strong pairs, and the turn."""
    s = [[near(q.get(KEYS[name]), r.get(KEYS[name]), name) for r in rf] for q in qf]
    cells = [r.get("cell") or "c" + r.get("file", f"frames/{j:03d}.jpg") for j, r in enumerate(rf)]
    if rules == "v1":
        best = [(max(range(len(rf)), key=lambda j: (row[j], -j)), row) for row in s]
        return [(round(row[j], 4), cells[j]) for j, row in best if round(row[j], 4) >= 0.5], None
    posed = sum(map(bool, map(pose, qf))) >= 3 and sum(map(bool, map(pose, rf))) >= 3
    order = sorted((-round(s[i][j], 6), i, j) for i in range(len(qf)) for j in range(len(rf)) if round(s[i][j], 6) >= 0.5)
    tried = []
    for turn in range(0, 360, 30) if posed else [None]:
        left, right, off = {}, set(), 0.0
        for _, i, j in order:
            if i in left or j in right:
                continue
            p, r = pose(qf[i]), pose(rf[j])
            if turn is not None and p and r:
                d = abs((p[0] - r[0] - turn + 180) % 360 - 180)
                if d > 45 or abs(p[1] - r[1]) > 25:
                    continue
                off += d
            left[i] = j
            right.add(j)
        tried.append(((round(sum(round(s[i][j], 6) for i, j in left.items()), 6), len(left), -round(off, 6)), turn, left))
    best = max(tried, key=lambda t: t[0])
    return [(round(round(s[i][j], 6), 4), cells[j]) for i, j in best[2].items()], best[1]


def plain(q, r, rules):
    qf, rf = q.get("frames") or [], r.get("frames") or []
    effort = sum(f.get("sharp") is None or f["sharp"] >= 12 for f in qf)
    out = {}
    for name, key in KEYS.items():
        have, other = (sum(bool(f.get(key)) for f in side) for side in (qf, rf))
        strong, turn = scored(qf, rf, name, rules) if have and other else ([], None)
        sims = sorted((x for x, _ in strong), reverse=True)
        cells, quality = len({c for _, c in strong}), sum(sims[:8]) / len(sims[:8]) if sims else 0.0
        confidence = math.floor((100 * sum(sims) / have if have else 0) + 0.5) if rules == "v2" else math.floor(100 * quality * (0.4 + 0.6 * min(1, cells / 6)) + 0.5)
        said = "match" if confidence >= 70 and cells >= 3 else "nomatch" if effort >= 8 and confidence < 40 and cells < 2 else "inconc"
        why = None
        if rules == "v2":
            why = "few_shots" if have < 3 else "few_views" if other < 3 else "colour_unseen" if name.startswith("color") and have < 0.5 * len(qf) else None
            said = "insufficient" if why and said != "match" else said
        out[name] = {"ok": bool(have and other), "have": have, "other": other, "confidence": confidence, "cells": cells, "strong": len(sims), "said": said, "why": why, "turn": turn}
    chosen = next((d for d in ("dino_p", "dino", "color_p", "color") if out[d]["have"] >= 3 and out[d]["other"] >= 3), None) or next((d for d in ("dino", "color") if out[d]["ok"]), "color")
    if not out[chosen]["ok"]:
        chosen = next((d for d in ("color_p", "color", "dhash", "dino_p", "dino") if out[d]["ok"]), chosen)
    h = out[chosen]
    said = h["said"] if h["ok"] else "inconc"
    sizes = [(f.get("metadata") or {}).get("dimensions_mm") for f in (q, r)]
    apart = []
    if all(sizes):
        feet = [max((d.get(k) for k in ("width", "depth") if d.get(k)), default=None) for d in sizes]
        apart = [abs(a - b) / max(a, b) for a, b in (feet, [d.get("height") for d in sizes]) if a and b]
    ok = round(max(apart), 3) <= 0.25 if apart else None
    size = "none" if not any(sizes) else "not_captured" if not sizes[0] else "not_registered" if not sizes[1] else "not_comparable" if ok is None else "within" if ok else "apart"
    reasons = [f"headline:{chosen}" if h["ok"] else "nothing_to_compare"]
    reasons += ["poses_used"] * (h["turn"] is not None)
    reasons += [f"insufficient:{h['why']}"] if h["ok"] and h["why"] else ["partly_carried"] if h["ok"] and h["have"] < len(qf) else []
    reasons += [f"also:{d}:{out[d]['confidence']}" for d in KEYS if d != chosen and out[d]["ok"]]
    reasons += ["no_texture"] * (not out["dino"]["ok"] and not out["dino_p"]["ok"] and chosen != "dino")
    held = ok is False and said == "match"
    caveats = ["held_by_size"] * held + ["thin_reference"] * (r.get("rating") is not None and r["rating"] < 75) + ["few_sharp_shots"] * (effort < 8) + ["colour_alone"] * chosen.startswith("color")
    return chosen, h["confidence"] if h["ok"] else 0, "inconc" if held else said, h["cells"], h["strong"], h["turn"], reasons + [f"size:{size}"], caveats


def objects():
    dims = {"width": 70, "depth": 68, "height": 75}
    yield from (made(h, emb=i) for i, h in enumerate(("orange", "blue", "green", "violet")))
    yield made("orange")
    yield made("orange", n=4)
    yield made("orange", rating=55, dims=dims)
    yield made("orange", dims=dims | {"height": 110})
    yield made("orange", dims={"width": 0, "height": None})
    yield made("blue", emb=1, piece=5, turn=0)
    yield made("blue", emb=1, piece=2, turn=60)
    yield made("blue", emb=1, turn=95, blank=8)
    yield made("red", blank=10)
    yield made("red", sharp=3)
    yield made("red", sharp=None, emb=3, n=2)
    yield {"frames": []}
    yield {}
    yield {"frames": [{"chist": [5] * 64, "dhash": [1]}, {"chist": [1, 2, 3], "sector": None}, {"emb": [1.0, None]}, {"emb": [0.0] * 16}], "rating": None}


@pytest.mark.parametrize("rules", ["v1", "v2"])
def test_every_pair_equals_plain_python(spark, rules):
    every = list(objects())
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(every)], "id long, text string").select("id", C.parse_fingerprint(F.col("text")).alias("fp"))
    pairs = spark.createDataFrame(list(itertools.product(range(len(every)), repeat=2)) + [(0, 1), (0, 999)], "q long, r long")
    rows = C.compare(df, df, pairs, rules).collect()
    assert len(rows) == len(every) ** 2
    verdicts = set()
    for r in rows:
        got = (r.descriptor, r.confidence, r.verdict, r.views_matched, r.strong, r.turn, r.reasons, r.caveats)
        assert got == plain(every[r.q], every[r.r], rules), (r.q, r.r)
        verdicts.add(r.verdict)
    assert verdicts == {"match", "nomatch", "inconc"} | ({"insufficient"} if rules == "v2" else set())


def test_frames_have_defaults_and_summaries(spark):
    texts = [json.dumps({"frames": [{"file": "frames/003.jpg", "chist": [1] * 64}, None, {"chist": [1] * 64, "sector": None, "cell": ""}], "rating": 80}), "not json", None, "[1]", json.dumps({"frames": "nope"})]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", C.parse_fingerprint(F.col("text")).alias("fp"))
    assert [(r.id, r.file, r.cell, r.sector, r.seq) for r in C.views(df, "id", "fp").collect()] == [(0, "frames/003.jpg", "cframes/003.jpg", -1, 1), (0, "frames/002.jpg", "cframes/002.jpg", -1, 3)]
    summary = {r.id: r for r in C.fingerprint_summary(df, "id", "fp").collect()}
    assert [summary[i].views for i in range(5)] == [2, 0, 0, 0, 0] and summary[0].rating == 80 and not summary[0].has_embeddings


def test_candidates_rank_margin_and_ambiguity(spark):
    twin = made("orange")
    refs = [(0, made("blue", emb=1)), (1, made("orange", emb=0)), (2, made("green", emb=2)), (3, {"frames": "nope"}), (10, twin), (11, twin)]
    frame = lambda rows: spark.createDataFrame([(i, json.dumps(x)) for i, x in rows], "id long, text string").select("id", C.parse_fingerprint(F.col("text")).alias("fp"))
    q, r = frame([(100, made("orange", emb=0)), (101, made("orange"))]), frame(refs)
    pairs = spark.createDataFrame([(100, i) for i in range(4)] + [(101, 10), (101, 11)], "q long, r long")
    got = {(x.q, x["rank"]): x for x in C.rank_candidates(C.compare(q, r, pairs), 3).collect()}
    assert got[100, 1].r == 1 and got[100, 1].verdict == "match" and got[100, 1].margin >= 50 and not got[100, 1].ambiguous and len(got) == 5
    assert got[101, 1].ambiguous and got[101, 1].margin < 10
    near = {tuple(x) for x in C.near_pairs(q, r, 2).collect()}
    assert (100, 1) in near and len(near) == 2
