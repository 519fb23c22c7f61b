"""Personal data: four fixed patterns, and further spans that labelers vote on, weighed by expectation-maximisation and a classifier."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import load, table
from tessera.llm.words import slices

#: The first four are base kinds, in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone", "name", "number", "address", "handle", "mail")
BASE = 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: A match begins where a run of digits does, as whatever follows the run decides.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Further candidates.
MORE = {
    "name": re.compile(r"(?<![\w.-])[A-Z][a-zà-öø-ÿ]{1,20}(?: [A-Z][a-zà-öø-ÿ]{1,20}){1,2}(?!\w)"),
    "number": re.compile(r"(?<![\w.+/-])\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,5}){1,3}(?![\w/])"),
    "address": re.compile(r"(?<!\w)[0-9]{1,5} (?:[A-Z][a-zà-ÿ]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Way)(?!\w)"),
    "handle": re.compile(r"(?<![\w.@%+-])@[A-Za-z][A-Za-z0-9_]{2,30}(?![\w.@-])"),
    "mail": re.compile(r"(?<!\w)[A-Za-z0-9._-]{2,40} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,40} ?(?:\(dot\)|\[dot\]| dot ) ?[a-z]{2,10}(?!\w)"),
}

#: Common given names, and capitalised words that aren't names of persons.
GIVEN = frozenset("""Anna Maria Laura Sara Julia Emma Sophie Marie Lena Eva Clara Elena Carmen Lucia Ana Isabel Rosa Claire Camille Alice Jane Mary Susan Linda
Karen Nancy Lisa Emily Sarah Jessica Ashley Amanda Hannah Olivia Ava Mia John James Robert Michael William David Richard Joseph Thomas Charles
Daniel Matthew Anthony Mark Paul Steven Andrew Peter Hans Klaus Jan Lukas Felix Jonas Leon Pierre Jean Louis Luc Hugo Carlos Jose Juan Luis Pedro
Miguel Javier Pablo Diego Ahmed Mohammed Ali Omar Fatima Wei Ming Chen Yuki Hiro Raj Priya Amit Ivan Olga Dmitri Anders Lars Ingrid""".split())
NOT_NAMES = frozenset("""The This That These Those And But Or If In On At Of For From With Without By To As Is Are Was Were Be It He She They We You
January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday
License Licensed Version Apache General Public Software Foundation Copyright Creative Commons Free Open Source Terms Conditions Section Chapter
Table Figure North South East West New United States Kingdom University Company Inc Ltd Corporation Government Der Die Das Und La El Los Las Le Les""".split())
ENDINGS = frozenset("com org net edu gov io co info biz de fr es uk us ca au it nl se no dk fi pl ru jp cn in br mx ch at be eu dev app".split())
#: Words before a span that speak for and against it, by kind.
CUES = {
    "name": "mr mrs ms dr prof name contact dear signed sincerely regards author employee patient customer",
    "number": "call phone tel telephone mobile cell fax ssn passport account acct iban id license",
    "address": "address lives living at street located home mail ship",
    "handle": "twitter instagram follow user username handle telegram",
    "mail": "mail email contact write reach address",
    "email": "mail email contact write reach", "ip": "ip host client address login from", "card": "card visa mastercard credit payment account", "phone": "call phone tel telephone mobile fax contact",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
AGAINST = frozenset("version release isbn issn order invoice page pages section chapter figure table copyright license years since between room lines bytes".split())

LABELERS = ("form", "check", "gazetteer", "ending", "cue", "against", "neighbour")
#: Hashed features, candidates of a kind that the classifier is fitted on, and the probability from which a span is added.
BUCKETS, SAMPLE, LEAST = 4096, 1024, 0.9
WORD = re.compile(r"\w+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four patterns, in order."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((begin, 0, done := m.end()))
        at = text.find("@", max(at + 1, done))
    if any(map(text.__contains__, "0123456789")):
        for m in IP.finditer(text):
            if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def more_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the further kinds that overlap no base span and no candidate before them."""
    found = []
    for kind, pattern in MORE.items():
        if kind == "handle" and "@" not in text or kind == "mail" and " dot " not in text and "dot)" not in text and "dot]" not in text:
            continue
        found += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text) if kind != "number" or 7 <= sum(c.isdigit() for c in m[0]) <= 15]
    kept, end, i, taken = [], 0, 0, 0
    for a, kind, b in sorted(found):
        while i < len(base) and base[i][0] < b:
            taken = max(taken, base[i][2])
            i += 1
        if a >= max(end, taken):
            kept.append((a, kind, b))
            end = b
    return kept


def votes_of(text: str, a: int, kind: int, b: int, near: bool) -> list[int]:
    """What each labeler says of a span: 1 personal, -1 not, 0 nothing."""
    name, span = KINDS[kind], text[a:b]
    words = span.split()
    digits = re.sub(r"\D", "", span)
    before = [w.lower() for w in WORD.findall(text[max(0, a - 40) : a])][-4:]
    form = 1 if kind < BASE or name in ("address", "mail") else 0
    if name == "number":
        date = re.fullmatch(r"(?:19|20)\d\d[.-](?:0?[1-9]|1[0-2])[.-](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[.-](?:0?[1-9]|1[0-2])[.-](?:19|20)\d\d|(?:19|20)\d\d[\x20-](?:19|20)\d\d", span)
        form = -1 if date else 1 if re.fullmatch(r"\d{3}-\d{2}-\d{4}|\(?\d{3}\)?[\x20.-]\d{3}[.-]\d{4}", span) else 0
    check = 0
    if len(digits) >= 7:
        check = -1 if len(set(digits)) <= 2 else 1 if name == "card" else 0
    if name == "ip":
        check = -1 if span.startswith(("127.", "0.", "10.", "192.168.")) else 1
    gazetteer = 0
    if name == "name":
        gazetteer = -1 if any(w in NOT_NAMES for w in words) or len(set(words)) < len(words) else 1 if words[0] in GIVEN else 0
    ending = (1 if span.rsplit(".", 1)[-1].lower() in ENDINGS else -1) if name == "email" else (1 if re.split(r"[^a-z]+", span)[-1] in ENDINGS else -1) if name == "mail" else 0
    cue = int(any(w in CUES[name] for w in before))
    against = -int(any(w in AGAINST for w in before))
    return [form, check, gazetteer, ending, cue, against, int(near)]


def features_of(text: str, a: int, kind: int, b: int, votes: list[int]) -> list[int]:
    """Hashed features of a span: its kind with its shape, its length, the words beside it, and each labeler's vote."""
    name = KINDS[kind]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-zà-ÿ]", "a", re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"\d", "9", text[a : min(b, a + 60)]))))
    before, after = WORD.findall(text[max(0, a - 30) : a]), WORD.findall(text[b : b + 30])
    parts = [f"kind={name}", f"{name} shape={shape}", f"{name} size={(b - a).bit_length()}", f"{name} before={(before or [''])[-1].lower()}", f"{name} after={(after or [''])[0].lower()}"]
    parts += [f"{labeler}={v}" for labeler, v in zip(LABELERS, votes, strict=True) if v]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


def _packed(votes: list[int]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(votes))


def candidates(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id and c, its candidates in order (base ones among them): start, kind, end, packed votes, features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("votes", pa.int32()), ("f", pa.list_(pa.int32()))])
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                text, rows = text or "", []
                base = base_spans(text)
                spans, i = sorted(base + more_spans(text, base)), 0
                for a, kind, b in spans:
                    while i < len(base) and base[i][2] < a - 80:
                        i += 1
                    near = any(x != (a, kind, b) and x[0] <= b + 80 and x[2] >= a - 80 for x in base[i : i + 3])
                    v = votes_of(text, a, kind, b, near)
                    rows.append({"start": a, "kind": kind, "end": b, "votes": _packed(v), "f": features_of(text, a, kind, b, v)})
                out.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(each))], ["doc_id", "c"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, c array<struct<start: long, kind: int, end: long, votes: int, f: array<int>>>")


@dataclass
class Reliability:
    """What expectation-maximisation has found: the share of personal spans by kind, and the chances of each labeler's votes by class."""

    prior: np.ndarray
    chance: np.ndarray  # labeler, class, vote

    def posterior(self, kinds: np.ndarray, votes: np.ndarray) -> np.ndarray:
        """The probability of being personal; votes: rows of 0 (not), 1 (nothing), 2 (personal)."""
        each = np.arange(votes.shape[1])
        yes, no = (np.log(self.chance[each, c, votes]).sum(axis=1) for c in (1, 0))
        return 1 / (1 + np.exp(no - yes + np.log(1 - self.prior[kinds]) - np.log(self.prior[kinds])))

    def accuracy(self) -> dict[str, float]:
        """For each labeler the balanced chance that a vote it gives is right."""
        yes = self.chance[:, 1, 2] / (self.chance[:, 1, 2] + self.chance[:, 1, 0])
        no = self.chance[:, 0, 0] / (self.chance[:, 0, 2] + self.chance[:, 0, 0])
        return dict(zip(LABELERS, ((yes + no) / 2).tolist(), strict=True))


def unpacked(votes: np.ndarray, labelers: int = len(LABELERS)) -> np.ndarray:
    return votes[:, None] // 3 ** np.arange(labelers) % 3


def estimate(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 500, kind_count: int = len(KINDS)) -> Reliability:
    """Expectation-maximisation over the counts of all vote patterns, begun at the majority; a few imagined votes keep chances off 0."""
    n = votes.shape[1]
    imagined = np.array([[4.0, 4.0, 1.0], [1.0, 4.0, 4.0]])
    p = np.where((votes - 1).sum(axis=1) > 0, 0.9, 0.1)
    model = None
    for _ in range(rounds):
        yes = np.bincount(kinds, counts * p, kind_count)
        prior = (yes + 1) / (np.bincount(kinds, counts, kind_count) + 2)
        chance = np.array([[np.bincount(votes[:, i], counts * w, 3) for w in (1 - p, p)] for i in range(n)]) + imagined
        model = Reliability(prior, chance / chance.sum(axis=2, keepdims=True))
        before, p = p, model.posterior(kinds, votes)
        if not len(p) or np.abs(p - before).max() < 1e-7:
            break
    return model


def fit(rows: list[np.ndarray], target: np.ndarray, rounds: int = 300, l2: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on hashed features and probabilities, by AdaGrad over all rows; the last is the intercept."""
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    if not rows:
        return w
    at = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], len(rows)) + w[-1], -35, 35)))
        off = (p - target) / len(rows)
        g = np.append(np.bincount(at, off[row], BUCKETS), off.sum()) + l2 * w / len(rows)
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    return w


def learn(found: DataFrame) -> tuple[Reliability, np.ndarray]:
    """The reliabilities over all candidates, and the classifier, fitted on at most SAMPLE candidates of each kind.

    The counts of vote patterns (9 kinds by 3**7 at most) and that sample reach the driver; the sample are those with the smallest
    hashes of id and place, so it doesn't depend on partitions.
    """
    each = found.select("doc_id", F.explode("c").alias("c")).select("doc_id", "c.*")
    patterns = each.groupBy("kind", "votes").count().collect()
    kinds, votes, counts = (np.array([r[i] for r in patterns], np.int64) for i in range(3))
    model = estimate(kinds, unpacked(votes), counts)
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "end", "votes"))
    few = [each.where(F.col("kind") == k).orderBy(key, "doc_id", "start", "votes", "f").limit(SAMPLE).select("kind", "votes", "f") for k in range(len(KINDS))]
    part = few[0]
    for more in few[1:]:
        part = part.unionByName(more)
    rows = sorted(part.collect(), key=lambda r: (r.kind, r.votes, r.f))
    target = model.posterior(np.array([r.kind for r in rows], int), unpacked(np.array([r.votes for r in rows], int)))
    return model, fit([np.array(r.f) for r in rows], target)


def find_personal(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of docs (doc_id, text; others aren't read).

    Spans are kind:start:end in code points, by start and then kind, comma-joined. Base spans always stand; a further one is added if
    it overlaps none of them, a labeler speaks for it and the classifier gives it `least` or more. A null or empty text has none.
    Rows are taken one by one, so repeats give equal rows, and a null id stays null. Texts are read once; candidates go to a table.
    """
    found = table(candidates(docs), "candidates", "zstd")
    sent = docs.sparkSession.sparkContext.broadcast(learn(found)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        joined = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        for batch in batches:
            out = []
            for rows in batch.column("c").to_pylist():
                base = [(r["start"], r["kind"], r["end"]) for r in rows if r["kind"] < BASE]
                more = [(r["start"], r["kind"], r["end"]) for r in rows if r["kind"] >= BASE and (unpacked(np.array([r["votes"]])) == 2).any() and 1 / (1 + np.exp(-w[r["f"]].sum() - w[-1])) >= least]
                kinds = [k for _, k, _ in base]
                out.append((*(kinds.count(k) for k in range(BASE)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)))
            types = (*[pa.int64()] * BASE, pa.string(), pa.string(), pa.int64())
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def personal_of(spark, sf_dir: str) -> DataFrame:
    return find_personal(load(spark, sf_dir, "documents"))
