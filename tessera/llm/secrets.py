"""Secret scans: three patterns, and a guess-cost search over values in credential contexts."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import dropped, load, table
from tessera.llm.words import slices

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: More contexts than ASSIGN has, more separators, and any value without white space, quotes or brackets.
CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|(?:access|auth|bearer)?[_-]?token|(?:api|access|secret|private)[_-]?key|credentials?|bearer)["']?(?:\x20*(?::=|=>|[:=])|\x20+is)\x20*["']?([^\s"'<>(){}\[\],;]+)""")
#: A text without any of these (lower-cased) has no context.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer")
#: Words that guessers try first, most frequent first.
WORDS = """password pass admin user login welcome secret token letmein monkey dragon master qwerty sunshine princess football
baseball shadow superman batman trustno iloveyou hello freedom whatever test testing example sample change changeme default guest
root server database access private public key api the and you love summer winter spring autumn january february march april
june july august september october november december monday tuesday wednesday thursday friday saturday sunday your my here
none null value string insert placeholder xxxx todo foo bar baz lorem ipsum""".split()
#: Words of the documents that follow them: so many at most (a proven size for what is broadcast), each found so often.
CORPUS_WORDS, OFTEN = 20_000, 3
WORD = re.compile(r"[^\W\d_]{3,24}")
#: Rows of a keyboard, the alphabet and the digits; a walk goes along one of them either way.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "0123456789")
STEPS = {(a, b) for row in ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))}
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
#: Powers of ten of guesses: a value above LEAST counts as a secret. Every segment costs JOIN more.
LEAST, JOIN = 10.0, 0.3


class Ranks:
    """Words by the order in which guessers try them: the fixed ones, then `more`. Equal to itself alone, so it can be cached by."""

    def __init__(self, more: list[str] = ()):
        self.of = {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *more]))}
        self.longest = max(map(len, self.of))


FIXED = Ranks()


def _dates(value: str) -> dict[int, list[int]]:
    """Where the dates that end at each position begin, in every reading."""
    found: dict[int, list[int]] = {}
    for i, c in enumerate(value):
        if c.isdigit():
            for n in range(4, 11):
                if i + n <= len(value) and DATE.fullmatch(value, i, i + n):
                    found.setdefault(i + n, []).append(i)
    return found


class _Run:
    """The places from which a repeat or walk that is still going on may be cheapest.

    A later place i beats an earlier one at no end if it costs log10((i + 3 - earlier) / 3) more, so only a few are kept.
    """

    def __init__(self) -> None:
        self.starts: list[tuple[int, float]] = []

    def offer(self, i: int, cost: float) -> None:
        if all(cost < c + math.log10((i + 3 - k) / 3) for k, c in self.starts):
            self.starts.append((i, cost))

    def best(self, j: int) -> float:
        return min((c + math.log10(j - k) for k, c in self.starts if j - k >= 3), default=math.inf)


@lru_cache(maxsize=4096)
def guess_cost(value: str, ranks: Ranks = FIXED) -> float:
    """log10 of the guesses for the cheapest segmentation of value, over all segmentations.

    Segments are words of `ranks` (by rank, more for capitals), dates, repeats of a character, walks along a keyboard row or the
    alphabet, and brute force at the size of the character classes that value has. Time grows with the length of value alone.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters become two when lower-cased
        low = "".join(c.lower()[0] for c in value)
    brute, walk_first = brute_cost(value), math.log10(60)
    dates = _dates(value)
    best = [0.0] + [math.inf] * n
    same, walk = _Run(), _Run()
    for j in range(1, n + 1):
        if j > 1 and low[j - 2] != low[j - 1]:
            same = _Run()
        if j > 1 and (low[j - 2], low[j - 1]) not in STEPS:
            walk = _Run()
        for run in (same, walk):
            run.offer(j - 1, best[j - 1])
        options = [best[j - 1] + brute, same.best(j) + JOIN + brute, walk.best(j) + JOIN + walk_first]
        for i in range(max(0, j - ranks.longest), j - 2):
            if rank := ranks.of.get(low[i:j]):
                options.append(best[i] + word_cost(value[i:j], rank))
        options += [best[i] + date_cost(j - i) for i in dates.get(j, ())]
        best[j] = min(options)
    return best[n]


def brute_cost(value: str) -> float:
    """log10 of the guesses for one character, from the classes that value has."""
    size = sum(k for k, p in ((10, r"\d"), (26, r"[a-z]"), (26, r"[A-Z]"), (33, r"[^0-9A-Za-z]")) if re.search(p, value))
    return math.log10(max(size, 2))


def word_cost(word: str, rank: int) -> float:
    return JOIN + math.log10(rank + 1) + math.log10(2) * min(sum(c.isupper() for c in word), 3)


def date_cost(size: int) -> float:
    return JOIN + (2.3 if size == 4 else 4.9)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns; kinds 0 assign, 1 access, 2 hex."""
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    return sorted(found)


def guessed_spans(text: str, least: float = LEAST, ranks: Ranks = FIXED) -> list[tuple[int, int, int]]:
    """(start, 3, end) of values in credential contexts that cost 10**least guesses or more."""
    found = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".!?:")
        if len(value) >= 6 and guess_cost(value, ranks) >= least:
            found.append((m.start(1), 3, m.start(1) + len(value)))
    return found


def corpus_words(docs: DataFrame) -> list[str]:
    """The words (3 to 24 letters, lower-cased) found most often in docs outside of credential contexts, most frequent first.

    What stands in a context isn't counted: a secret in many copies of a document would become a word. Counts are summed where
    texts are read and again by Spark; CORPUS_WORDS words, those of one range besides and a count for each range come to the driver at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                low = (text or "").lower()
                counts.update(WORD.findall(CONTEXT.sub(" ", text).lower() if any(h in low for h in HINTS) else low))
                if len(counts) > 200_000:
                    yield out()
                    counts.clear()
        yield out()

    counts = table(docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN), "counts")
    # In ranges from the most frequent on, of which the first ones hold enough; else every task would send its own most frequent words.
    ranges = table(counts.repartitionByRange(F.desc("n"), "word").withColumn("part", F.spark_partition_id()), "ranges")
    last, sofar = -1, 0
    for last, size in ranges.groupBy("part").count().orderBy("part").collect():
        sofar += size
        if sofar >= CORPUS_WORDS:
            break
    words = [r.word for r in ranges.where(F.col("part") <= last).orderBy(F.desc("n"), "word").limit(CORPUS_WORDS).collect()]
    dropped(counts)
    dropped(ranges)
    return words


KINDS = ("assign", "access", "hex", "guess")


def find_secrets(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, highest_cost for each row of docs (doc_id, text).

    Spans are kind:start:end in code points with the whole match of a pattern (for `guess` the value), by start and then kind,
    comma-joined. A null or empty text has none. Rows are taken one by one, so repeats give equal rows. Frequent words of all
    of docs are cheap to guess, so docs is read twice.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Ranks(corpus_words(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = sent.value
        joined = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                low = text.lower()
                hinted = any(h in low for h in HINTS)
                base = base_spans(text) if hinted or "AKIA" in text else [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
                more = guessed_spans(text, least, ranks) if hinted else []
                kinds = [k for _, k, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more), max((guess_cost(text[a:b], ranks) for a, _, b in more), default=None)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64())
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "highest_cost"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, highest_cost double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def secrets_of(spark, sf_dir: str) -> DataFrame:
    return find_secrets(load(spark, sf_dir, "documents"))
