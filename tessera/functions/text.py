"""Column functions on names, places, dates, links and keys."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What counts as blank in a cell.
BLANKS = ["", "nan", "none", "null", "n/a", "-", "—"]
#: What is no name.
NO_NAMES = ["test", "example", "asdf", "unknown", "n/a", "na", "none", "anonymous", "tbd"]
def _one_letter() -> tuple[str, str]:
    """The letters of the Latin blocks that decompose to one ASCII sign and marks, and what is left of each."""
    plain = lambda i: unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode()
    found = [(chr(i), plain(i)) for lo, hi in ((0xA0, 0x250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F)) for i in range(lo, hi) if len(plain(i)) == 1]
    return "".join(c for c, _ in found), "".join(p for _, p in found)


MARKED, PLAIN = _one_letter()


def collapse(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm(c: Column) -> Column:
    return F.lower(collapse(c))


def fold(c: Column) -> Column:
    """Marks stripped from letters of the Latin blocks, other signs beyond ASCII dropped, lower case, and a space for every other run.

    Signs that decompose to several letters (ligatures, fractions) are dropped too: fold_exact spells them out.
    """
    ascii_only = F.regexp_replace(F.translate(c, MARKED, PLAIN), r"[^\x00-\x7f]+", "")
    return F.trim(F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", " "))


@F.arrow_udf(StringType())
def _decomposed(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_normalize(texts, form="NFKD"), r"[^\x00-\x7f]+", "")


def fold_exact(c: Column) -> Column:
    """fold by the compatibility decomposition of every sign, in Arrow batches."""
    return F.trim(F.regexp_replace(F.lower(_decomposed(c)), "[^a-z0-9]+", " "))


def name_tokens(c: Column, titles: tuple[str, ...] = ("dr", "mr", "mrs", "ms", "prof")) -> Column:
    """The fold of a name without titles, its words sorted: equal for any order of them."""
    words = F.filter(F.split(fold(c), " "), lambda w: ~w.isin(*titles))
    return F.array_join(F.array_sort(words), " ")


def clean_blank(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~F.lower(t).isin(BLANKS), t)


def looks_like_name(c: Column) -> Column:
    """2 to 120 characters with a Latin letter, no @, and not a placeholder."""
    t = clean_blank(collapse(c))
    return F.coalesce(F.length(t).between(2, 120) & ~F.contains(t, F.lit("@")) & t.rlike("[A-Za-zÀ-ɏ]") & ~F.lower(t).isin(NO_NAMES), F.lit(False))


def slug(c: Column, n: int = 60, otherwise: str = "item") -> Column:
    s = F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(n)), "-+$", "")
    return F.coalesce(F.when(s != "", s), F.lit(otherwise))


def split_multi(c: Column, pattern: str = r"[,|;]") -> Column:
    """The distinct non-empty parts of a multi-value cell, in order."""
    parts = F.transform(F.split(c, pattern), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def place_parts(c: Column) -> Column:
    """struct<city, region, country> of "City, Region, Country"; two parts are city and country, one is the city."""
    p = split_multi(c, ",")
    n = F.size(p)
    return F.struct(F.get(p, 0).alias("city"), F.when(n >= 3, F.get(p, 1)).alias("region"), F.when(n >= 2, F.element_at(p, -1)).alias("country"))


def host(c: Column) -> Column:
    """A link's host without www."""
    h = F.regexp_extract(F.lower(F.trim(c)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#:]+)", 1)
    return F.when(h != "", h)


def handle(c: Column) -> Column:
    h = F.regexp_extract(F.lower(F.trim(c)), r"(?:instagram\.com/|^@)([a-z0-9_.]+)", 1)
    return F.when(h != "", h)


def year_of(c: Column) -> Column:
    y = F.regexp_extract(c, r"(?:^|[^0-9])(1[0-9]{3}|20[0-9]{2})(?:[^0-9]|$)", 1)
    return F.when(y != "", y.cast("int"))


def partial_date(c: Column) -> Column:
    """struct<value, precision>: 11 for a day, 10 for a month (padded -00), 9 for a year (padded -00-00)."""
    t = F.trim(c)
    precision = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), 11).when(t.rlike(r"^\d{4}-\d{2}$"), 10).when(t.rlike(r"^\d{4}$"), 9)
    value = F.when(precision == 11, t).when(precision == 10, F.concat(t, F.lit("-00"))).when(precision == 9, F.concat(t, F.lit("-00-00")))
    return F.when(precision.isNotNull(), F.struct(value.alias("value"), precision.cast("int").alias("precision")))


def any_date(c: Column) -> Column:
    """A date in one of the forms that the forms allow."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "MM/dd/yyyy", "d MMMM yyyy", "MMMM d, yyyy")])


def days_until(c: Column, as_of: Column) -> Column:
    return F.datediff(c, as_of)


def key_for(kind: str, c: Column) -> Column:
    return F.concat_ws(":", F.lit("reg"), F.lit(kind), c)


def key_ident(c: Column) -> Column:
    return F.regexp_extract(c, r"^reg:[^:]*:(.*)$", 1)


def clip(c: Column, n: int) -> Column:
    """Spaces collapsed, then at most n characters, the last an ellipsis where something was cut."""
    t = collapse(c)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.left(t, F.lit(n - 1))), F.lit("…"))).otherwise(t)


def row_id(tbl: str, keys: list[Column], everything: dict[str, Column]) -> Column:
    """The first 16 digits of the SHA-1 of table and keys; when all keys are blank, of table and `name=value` in name order.

    A null counts as blank, so that rows without a key don't share one id.
    """
    text = lambda k: F.coalesce(k.cast("string"), F.lit(""))
    whole = [F.concat(F.lit(f"{n}="), text(everything[n])) for n in sorted(everything)]
    blank = F.trim(F.concat(F.lit(""), *[text(k) for k in keys])) == ""
    return F.left(F.sha1(F.when(blank, F.concat_ws("|", F.lit(tbl), *whole)).otherwise(F.concat_ws("|", F.lit(tbl), *[text(k) for k in keys]))), F.lit(16))


def content_hash(*cols: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def visitor_hash(day: Column, who: Column, salt: str) -> Column:
    """Differs from day to day, so that a visitor can't be followed."""
    return F.left(F.sha2(F.concat_ws("|", F.lit(salt), day.cast("string"), who.cast("string")), 256), F.lit(16))


def commitment(value: Column, salt_hex: Column) -> Column:
    return F.sha2(F.concat(value.cast("binary"), F.unhex(salt_hex)), 256)


def height_mm(c: Column) -> Column:
    """The third measure of "W × D × H mm", if positive."""
    h = F.regexp_extract(c, r"(?i)^\s*[\d.]+\s*[×x*]\s*[\d.]+\s*[×x*]\s*([\d.]+)\s*mm", 1).try_cast("double")
    return F.when(h > 0, h)


def valid_point(lat: Column, lng: Column) -> Column:
    a, b = lat.try_cast("double"), lng.try_cast("double")
    return F.coalesce(a.between(-90, 90) & b.between(-180, 180) & ~((a == 0) & (b == 0)), F.lit(False))


def rarity(legendary: Column, claimed: Column, fingerprinted: Column, edition: Column) -> Column:
    return F.when(legendary & claimed, "legendary").when(fingerprinted & (F.coalesce(edition, F.lit(1)) <= 3), "rare").when(fingerprinted, "uncommon").otherwise("common")


def rarity_points(rarity_: Column) -> Column:
    return F.when(rarity_ == "legendary", 20).when(rarity_ == "rare", 5).when(rarity_ == "uncommon", 2).otherwise(1)


#: Words of colours without a hue, and of cool ones; the hue (in degrees) below which a family ends.
NEUTRAL = ["clear", "colourless", "colorless", "crystal", "white", "grey", "gray", "black", "smoke"]
COOL = ["blue", "cobalt", "teal", "green", "aqua", "violet", "purple"]
HUES = [(15, "red"), (45, "orange"), (70, "yellow"), (170, "green"), (200, "teal"), (260, "blue"), (300, "purple"), (345, "pink")]


def colour_family(c: Column) -> Column:
    """The family of a hex colour by hue; of a word neutral, cool or else warm; empty for nothing."""
    t = F.trim(F.coalesce(c, F.lit("")))
    raw = F.lower(F.regexp_extract(t, "^#?([0-9a-fA-F]{6}|[0-9a-fA-F]{3})$", 1))
    h = F.when(F.length(raw) == 3, F.concat(*[F.repeat(F.substring(raw, i, 1), F.lit(2)) for i in (1, 2, 3)])).otherwise(raw)
    r, g, b = (F.conv(F.substring(h, i, 2), 16, 10).cast("double") / 255 for i in (1, 3, 5))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    turn = F.when(span == 0, 0.0).when(top == r, (g - b) / span).when(top == g, 2 + (b - r) / span).otherwise(4 + (r - g) / span)
    degrees = F.pmod(turn / 6, F.lit(1.0)) * 360
    by_hue = F.coalesce(*[F.when(degrees < d, n) for d, n in HUES], F.lit("red"))
    of_hex = F.when(top < 0.12, "black").when(F.when(top > 0, span / top).otherwise(0.0) < 0.12, "neutral").otherwise(by_hue)
    has = lambda words: F.lower(t).rlike("|".join(words))
    return F.when(raw != "", of_hex).when(t == "", "").when(has(NEUTRAL), "neutral").when(has(COOL), "cool").otherwise("warm")


#: Parts of a user agent, and the browser that each tells.
BROWSERS = [("CriOS", "Chrome"), ("FxiOS", "Firefox"), ("EdgA", "Edge"), ("Edg/", "Edge"), ("SamsungBrowser", "Samsung"), ("Firefox", "Firefox"), ("Chrome", "Chrome"), ("Safari", "Safari")]


def device_line(ua: Column, width: Column, height: Column) -> Column:
    """Model, browser and camera size of a capture device, as far as they are known."""
    ua = F.coalesce(ua, F.lit(""))
    inner = F.regexp_extract(ua, r"\(([^)]*)\)", 1)
    parts = F.transform(F.split(inner, ";"), lambda p: F.trim(p))
    version = F.get(F.filter(parts, lambda p: F.startswith(p, F.lit("Android"))), 0)
    model = F.coalesce(F.get(F.filter(parts, lambda p: (p != "") & ~p.isin("Linux", "U", "wv") & ~F.startswith(p, F.lit("Android"))), 0), F.lit("Android"))
    ios = F.replace(F.nullif(F.regexp_extract(inner, r"OS (\d+[_\d]*)", 1), F.lit("")), F.lit("_"), F.lit("."))
    apple = F.concat_ws(" · ", F.when(F.contains(inner, F.lit("iPhone")), "iPhone").otherwise("iPad"), F.concat(F.lit("iOS "), ios))
    kind = F.when(inner == "", None).when(F.contains(inner, F.lit("Android")), F.concat_ws(" · ", model, version)).when(inner.rlike("iPhone|iPad"), apple)
    kind = kind.when(F.contains(inner, F.lit("Macintosh")), "Mac").when(F.contains(inner, F.lit("Windows")), "Windows").otherwise(F.left(F.get(F.split(inner, ";"), 0), F.lit(40)))
    browser = F.coalesce(*[F.when(F.contains(ua, F.lit(k)), b) for k, b in BROWSERS])
    camera = F.when(width > 0, F.concat(width.cast("string"), F.lit("×"), height.cast("string")))
    return F.left(F.concat_ws(" · ", F.nullif(kind, F.lit("")), browser, camera), F.lit(200))


def size_check(foot: Column, height: Column, ref_foot: Column, ref_height: Column, tolerance: float = 0.25) -> Column:
    """struct<difference, ok>: the larger share by which footprint and height differ; null where nothing was measured on both sides."""
    apart = lambda a, b: F.when((a > 0) & (b > 0), F.abs(a - b) / F.greatest(a, b))
    difference = F.round(F.greatest(apart(foot, ref_foot), apart(height, ref_height)), 3)
    return F.struct(difference.alias("difference"), (difference <= tolerance).alias("ok"))
