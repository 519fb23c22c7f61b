"""Places in free text: states, countries, and the parts of "City, Region, Country"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clean_blank, collapse, fold

#: States by their abbreviation.
STATES = dict(x.strip().split(" ", 1) for x in """
AL Alabama, AK Alaska, AZ Arizona, AR Arkansas, CA California, CO Colorado, CT Connecticut, DE Delaware, FL Florida, GA Georgia, HI Hawaii,
ID Idaho, IL Illinois, IN Indiana, IA Iowa, KS Kansas, KY Kentucky, LA Louisiana, ME Maine, MD Maryland, MA Massachusetts, MI Michigan,
MN Minnesota, MS Mississippi, MO Missouri, MT Montana, NE Nebraska, NV Nevada, NH New Hampshire, NJ New Jersey, NM New Mexico, NY New York,
NC North Carolina, ND North Dakota, OH Ohio, OK Oklahoma, OR Oregon, PA Pennsylvania, RI Rhode Island, SC South Carolina, SD South Dakota,
TN Tennessee, TX Texas, UT Utah, VT Vermont, VA Virginia, WA Washington, WV West Virginia, WI Wisconsin, WY Wyoming, DC District of Columbia
""".split(","))
#: Countries, each with its other spellings.
COUNTRIES = {x.split(":")[0].strip(): [y.strip() for y in (x.split(":") + [""])[1].split(",") if y.strip()] for x in """
United States: USA, US, U.S., U.S.A., United States of America, America; United Kingdom: UK, U.K., GB, Great Britain, Britain; England; Scotland; Wales;
Italy: IT, Italia; Canada: CA; Germany: DE, Deutschland; France: FR; Japan: JP; Australia: AU; Czech Republic: CZ, Czechia; Netherlands: NL, The Netherlands, Holland;
Sweden: SE; Denmark: DK; Spain: ES, España; Mexico: MX, México; New Zealand: NZ; Ireland: IE; Finland: FI; Norway: NO; Belgium: BE; Austria: AT; Switzerland: CH;
Poland: PL; Türkiye: TR, Turkey; Israel: IL; India: IN; China: CN; Brazil: BR, Brasil; Argentina: AR; South Africa: ZA; Portugal: PT; South Korea: KR, Korea;
Taiwan: TW; Greece: GR; Hungary: HU; Slovakia: SK; Croatia: HR; Iceland: IS; Estonia: EE; Latvia: LV; Lithuania: LT; Chile: CL; Colombia: CO; Philippines: PH;
Thailand: TH; Singapore: SG; United Arab Emirates: AE, UAE; Egypt: EG
""".split(";")}


def _plain(text: str) -> str:
    import unicodedata

    low = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return " ".join("".join(c if c.isalnum() else " " for c in low).split())


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def state_of(c: Column) -> Column:
    """A state's name from its abbreviation or name, in any case."""
    names = _map({_plain(v): v for v in STATES.values()})
    return F.coalesce(F.try_element_at(_map(STATES), F.upper(c)), F.try_element_at(names, fold(c)))


def country_label(c: Column) -> Column:
    """A country's label from any of its spellings; null for others."""
    return F.try_element_at(_map({_plain(x): label for label, more in COUNTRIES.items() for x in (label, *more)}), fold(c))


def split_place(c: Column) -> Column:
    """struct<city, region, country> of free text: the first part that is a country, then the first that is a state, then city, then region.

    Parts are separated by commas, slashes, semicolons, or a dash between spaces; blank words don't count. A state without a
    country is in the United States. Empty where nothing was found.
    """
    parts = F.filter(F.transform(F.split(c, r"[,/;]|\s[-–]\s"), lambda p: clean_blank(collapse(p))), lambda p: p.isNotNull())
    # Each part with its readings, so that they are looked up once.
    read = F.transform(parts, lambda p: F.struct(p.alias("p"), country_label(p).alias("country"), state_of(p).alias("state")))
    put = lambda a, city=None, region=None, country=None: F.struct(
        (city if city is not None else a["city"]).alias("city"), (region if region is not None else a["region"]).alias("region"), (country if country is not None else a["country"]).alias("country"))

    def step(a: Column, x: Column) -> Column:
        return (
            F.when(x["country"].isNotNull() & (a["country"] == ""), put(a, country=x["country"])).when(x["state"].isNotNull() & (a["region"] == ""), put(a, region=x["state"]))
            .when(a["city"] == "", put(a, city=x["p"])).when(a["region"] == "", put(a, region=x["p"])).otherwise(a)
        )

    empty = F.struct(F.lit("").alias("city"), F.lit("").alias("region"), F.lit("").alias("country"))
    home = lambda a: F.when(a["region"].isin(*STATES.values()) & (a["country"] == ""), put(a, country=F.lit("United States"))).otherwise(a)
    return F.aggregate(F.coalesce(read, F.array()), empty, step, home)


def with_place(df: DataFrame, out: str, city: Column | None, region: Column | None, country: Column | None, free: Column | None = None) -> DataFrame:
    """df with out, a struct<city, region, country> in normal form: state names for abbreviations, labels for countries (a word of over
    three letters that is none in title case), free text where the three are blank. Null if nothing is left.

    It goes in steps, each a projection, as an expression that is named several times is else computed as often.
    """
    parts = {k: (F.coalesce(clean_blank(collapse(c)), F.lit("")) if c is not None else F.lit("")) for k, c in (("city", city), ("region", region), ("country", country))}
    name = lambda k: f"{out}_{k}"
    df = df.withColumns({name(k): c for k, c in parts.items()} | ({name("free"): split_place(free)} if free is not None else {}))
    if free is not None:
        none = (F.col(name("city")) == "") & (F.col(name("region")) == "") & (F.col(name("country")) == "")
        df = df.withColumns({name(k): F.when(none, F.col(name("free"))[k]).otherwise(F.col(name(k))) for k in parts})
    df = df.withColumn(name("state"), F.try_element_at(_map(STATES), F.upper(name("region"))))
    df = df.withColumn(name("land"), F.when(F.col(name("state")).isNotNull() & (F.col(name("country")) == ""), "United States").otherwise(F.col(name("country"))))
    df = df.withColumn(name("label"), F.coalesce(country_label(F.col(name("land"))), F.when(F.length(name("land")) > 3, F.initcap(name("land"))), F.lit("")))
    found = F.struct(F.col(name("city")).alias("city"), F.coalesce(name("state"), name("region")).alias("region"), F.col(name("label")).alias("country"))
    some = (F.col(name("city")) != "") | (F.col(name("region")) != "") | (F.col(name("label")) != "")
    return df.withColumn(out, F.when(some, found)).drop(*[name(k) for k in (*parts, "free", "state", "land", "label")])
