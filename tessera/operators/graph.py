"""The relationship graph: counts, neighbourhoods, components. Nodes have id, label, type; edges src, dst, type."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapse, norm, split_multi
from tessera.operators.terms import contained
from tessera.shared import cut

#: How sure a derived edge is, surest first; which type wins a name.
CONFIDENCE = ["structured", "event", "fingerprint", "text"]
TYPES = ["artist", "object", "studio", "technique", "collector"]
#: Node types that stay without edges.
ALONE = ("artist", "object", "collector")


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without loops: a, b."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return both.unionAll(both.select("b", "a")).where("a <> b").distinct()


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or edge), type, n."""
    count = lambda df, kind: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(nodes, "node").unionAll(count(edges, "edge"))


def neighbors(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """id, label, type, distance of the nodes within `depth` (1 to 4) steps of start, itself left out."""
    links = undirected(edges)
    seen = nodes.where(F.col("id") == start).select(F.col("id").alias("a"), F.lit(0).alias("distance"))
    for step in range(1, max(1, min(depth, 4)) + 1):
        edge = seen.where(F.col("distance") == step - 1).select("a").join(links, "a").select(F.col("b").alias("a")).distinct()
        seen = cut(seen.unionAll(edge.join(seen, "a", "left_anti").select("a", F.lit(step).alias("distance"))))
    return nodes.join(seen.where("distance > 0").withColumnRenamed("a", "id"), "id").select("id", "label", "type", "distance")


def neighbor_groups(edges: DataFrame, start: str) -> DataFrame:
    """type, direction (in or out), n: the direct neighbours of start."""
    out = edges.where(F.col("src") == start).select("type", F.lit("out").alias("direction"), F.col("dst").alias("id"))
    into = edges.where(F.col("dst") == start).select("type", F.lit("in").alias("direction"), F.col("src").alias("id"))
    return out.unionAll(into).groupBy("type", "direction").agg(F.countDistinct("id").alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """id, root: the smallest id of each linked node's component.

    Each round hangs every node below the smallest root near it, then below that root's own root, so paths halve; the
    loop ends when nothing moves. Rounds are checkpointed.
    """
    links = cut(undirected(edges))
    root = cut(links.groupBy("a").agg(F.least("a", F.min("b")).alias("root")))
    while True:
        near = links.join(root.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = root.join(near, "a").select("a", F.least("root", "near").alias("up"), "root")
        above = root.select(F.col("a").alias("up"), F.col("root").alias("top"))
        moved = cut(step.join(above, "up").select("a", F.least("up", "top").alias("root"), (F.least("up", "top") != F.col("root")).alias("moved")))
        root = moved.select("a", "root")
        if moved.where("moved").isEmpty():
            return root.withColumnRenamed("a", "id")


def _order(c: str, values: list[str]):
    return F.coalesce(*[F.when(F.col(c) == v, i) for i, v in enumerate(values)], F.lit(len(values)))


def resolve_nodes(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """ref, id for each row of refs (ref): a node's id, else a label (any case), else a label that contains it.

    Earlier types win, then shorter labels, then smaller ids. Contained labels are looked for by the words that a ref is made of:
    a label must have the ref's longest word inside one of its own words, by runs of three letters.
    """
    low = F.lower(F.trim("ref"))
    refs = refs.select("ref", low.alias("k")).where("k <> ''").distinct()
    by_id = refs.join(nodes.select("id"), (F.col("id") == F.trim("ref")) | (F.col("id") == F.col("k"))).select("ref", "id").groupBy("ref").agg(F.min("id").alias("id"))
    named = nodes.select("id", "type", F.lower("label").alias("l"))
    exact = refs.join(named, F.col("k") == F.col("l")).withColumn("how", F.lit(1))
    gram = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))
    asked = refs.withColumn("g", F.get(gram(F.col("k")), 0))
    inside = asked.join(named.withColumn("g", F.explode(F.array_distinct(F.concat(gram(F.col("l")), F.transform(gram(F.col("l")), lambda x: F.left(x, F.lit(2))), F.transform(gram(F.col("l")), lambda x: F.left(x, F.lit(1))))))), "g")
    inside = inside.where(F.contains("l", F.col("k"))).select(*exact.columns[:-1]).withColumn("how", F.lit(2))
    first = F.row_number().over(Window.partitionBy("ref").orderBy("how", _order("type", TYPES), F.length("l"), "id"))
    named_hit = exact.unionByName(inside).withColumn("_n", first).where("_n = 1").select("ref", "id")
    return by_id.unionByName(named_hit.join(by_id.select("ref"), "ref", "left_anti"))


def path_edges(path: DataFrame, edges: DataFrame) -> DataFrame:
    """step (from 0), and the edges between each node of a shortest_path and the next, in whichever direction they go."""
    own = path.select("step", F.col("id").alias("a"))
    pairs = own.join(own.select((F.col("step") - 1).alias("step"), F.col("a").alias("b")), "step")
    ends = pairs.select("step", F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(pairs.select("step", F.col("b").alias("src"), F.col("a").alias("dst")))
    return F.broadcast(ends).join(edges, ["src", "dst"]).select("step", *edges.columns)


def neighbor_edges(edges: DataFrame, near: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """The edges that `neighbors` goes along: those with an end fewer than `depth` steps away."""
    inner = near.where(F.col("distance") < max(1, min(depth, 4))).select("id")
    inner = inner.unionAll(edges.sparkSession.createDataFrame([(start,)], "id string"))
    hit = edges.join(inner.select(F.col("id").alias("src")), "src", "left_semi").unionByName(edges.join(inner.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return hit.distinct()


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, end: str, most: int | None = None) -> DataFrame:
    """step (from 0), id, label, type of the nodes on a shortest undirected path; no rows if there is none (within `most` steps, where given).

    A breadth-first frontier with the smallest parent of each node; steps are checkpointed and end when `end` is reached.
    """
    links = cut(undirected(edges))
    seen = cut(nodes.where(F.col("id") == start).select(F.col("id").alias("a"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("step")))
    for step in count(1) if most is None else range(1, most + 1):
        if not seen.where(F.col("a") == end).isEmpty():
            break
        front = seen.where(F.col("step") == step - 1).select(F.col("a").alias("parent"))
        found = front.join(links, front.parent == links.a).select(F.col("b").alias("a"), "parent").join(seen.select("a"), "a", "left_anti")
        found = cut(found.groupBy("a").agg(F.min("parent").alias("parent")).withColumn("step", F.lit(step)))
        if found.isEmpty():
            break
        seen = seen.unionByName(found)
    path, at = [], end
    while at is not None and (row := seen.where(F.col("a") == at).first()) is not None:  # one row for each step of the path
        path.append((row["step"], at))
        at = row["parent"]
    out = nodes.sparkSession.createDataFrame(path, "step int, id string")
    return F.broadcast(out).join(nodes, "id").select("step", "id", "label", "type")


def dedupe_edges(edges: DataFrame, undirected_types: tuple[str, ...] = ("similar_to",)) -> DataFrame:
    """Each (src, dst, type) once, in the surest derivation; pairs of undirected types with the smaller id first."""
    flip = F.col("type").isin(*undirected_types) & (F.col("src") > F.col("dst"))
    put = edges.withColumns({"src": F.when(flip, F.col("dst")).otherwise(F.col("src")), "dst": F.when(flip, F.col("src")).otherwise(F.col("dst"))})
    first = F.row_number().over(Window.partitionBy("src", "dst", "type").orderBy(_order("confidence", CONFIDENCE), F.desc("weight")))
    return put.withColumn("_n", first).where("_n = 1").drop("_n")


def drop_orphans(nodes: DataFrame, edges: DataFrame, keep: tuple[str, ...] = ALONE) -> DataFrame:
    """nodes less those without an edge, but for the types that stay."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).distinct()
    return nodes.join(ends.withColumn("_on", F.lit(True)), "id", "left").where(F.col("type").isin(*keep) | F.col("_on")).drop("_on")


def text_mentions(texts: DataFrame, names: DataFrame, least: int = 5) -> DataFrame:
    """id, name_id of the names of `least` letters or more that a text contains (both in lower case, spaces collapsed).

    texts: id, text. names: name_id, name. See terms.contained: one pass over the texts while all names together are small, else a
    join by each name's rarest run of letters.
    """
    own = names.select("name_id", norm(F.col("name")).alias("p")).where(F.length("p") >= least)
    t = texts.select("id", norm(F.col("text")).alias("t")).where(F.length("t") >= least)
    return contained(t, own).select("id", "p").distinct().join(own.distinct(), "p").select("id", "name_id").distinct()


def build_graph(submissions: DataFrame, directory: DataFrame, studios: DataFrame, objects: DataFrame, lineage: DataFrame, claims: DataFrame, similar: DataFrame | None = None, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, label, type, source; edges: src, dst, type, confidence, weight, relation) of gated tables, by rule.

    submissions: name, techniques (apart by " | "), studied_under, text. directory: name, technique, text. studios: name. objects: id,
    title, maker, techniques (apart by commas or bars), locations (an array, of their events). lineage: student, mentor, relation. claims:
    object_id, collector_uid, collector_name, status. similar: a, b, similarity of objects. labels: label, the spelling of techniques.

    People, studios and techniques are one node for each name (any case, spaces collapsed), in the spelling of the first source that has
    it: submission, directory, object, lineage; of one source's the smallest. Rules: uses; made_by, whoever made a piece; based_at, a studio's
    name in an event's place or in a person's text; studied_under, a lineage row, or a known person's name in what a submission says of
    its teachers; similar_to; collected_by, held claims. Names of fewer than five letters aren't looked for in texts. Of equal edges the
    surest stands. Techniques and studios without an edge are left out.
    """
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), norm(F.col(c)))
    named = lambda df, c: df.where(F.coalesce(norm(F.col(c)), F.lit("")) != "")
    edge = lambda df, src, dst, kind, sure, weight=None, relation=None: df.select(
        F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), F.lit(sure).alias("confidence"), (F.lit(1.0) if weight is None else F.col(weight)).cast("double").alias("weight"), (F.col(relation) if relation else F.lit(None)).cast("string").alias("relation"))
    subs, known = (named(df, "name").withColumn("id", key("artist", "name")) for df in (submissions, directory))
    pieces = objects.where(F.coalesce(F.col("id").cast("string"), F.lit("")) != "").withColumn("id", F.concat(F.lit("object:"), F.col("id").cast("string")))
    made = named(pieces, "maker").withColumn("dst", key("artist", "maker"))
    taught = named(named(lineage, "student"), "mentor").where(norm(F.col("student")) != norm(F.col("mentor"))).select(key("artist", "student").alias("id"), key("artist", "mentor").alias("dst"), "student", "mentor", F.coalesce(F.nullif(F.trim("relation"), F.lit("")), F.lit("Studied under")).alias("relation"))
    people = [subs.select("id", F.col("name").alias("label"), F.lit(0).alias("k")), known.select("id", F.col("name").alias("label"), F.lit(1).alias("k")), made.select(F.col("dst").alias("id"), F.col("maker").alias("label"), F.lit(2).alias("k"))]
    people += [taught.select(F.col(i).alias("id"), F.col(c).alias("label"), F.lit(3).alias("k")) for i, c in (("id", "student"), ("dst", "mentor"))]
    first = lambda frames: reduce(DataFrame.unionByName, frames).withColumn("label", collapse(F.col("label"))).groupBy("id").agg(F.min(F.struct("k", "label")).alias("f"))
    artists = cut(first(people).select("id", "f.label", F.element_at(F.array(*map(F.lit, ("submission", "directory", "object", "lineage"))), F.col("f.k") + 1).alias("source")))
    shops = cut(named(studios, "name").select(key("studio", "name").alias("id"), "name").groupBy("id").agg(F.min(collapse(F.col("name"))).alias("label")))

    words = subs.select("id", F.explode(F.split("techniques", r" \| ")).alias("t")).unionAll(known.select("id", F.col("technique").alias("t"))).unionAll(pieces.select("id", F.explode(split_multi(F.col("techniques"), "[,|]")).alias("t")))
    uses = named(words, "t").withColumn("dst", key("technique", "t"))
    techniques = uses.groupBy(F.col("dst").alias("id")).agg(F.min(collapse(F.col("t"))).alias("label"))
    if labels is not None:
        spelt = labels.groupBy(key("technique", "label").alias("id")).agg(F.min("label").alias("own"))
        techniques = techniques.join(spelt, "id", "left").select("id", F.coalesce("own", "label").alias("label"))

    def mentions(texts: DataFrame, nodes: DataFrame, low) -> DataFrame:
        """id, dst: the nodes whose label stands in a text of texts (id, t)."""
        own = nodes.select(F.col("id").alias("dst"), F.lower("label").alias("p")).where(F.length("p") >= 5)
        return contained(texts.select("id", low(F.col("t")).alias("t")), own).select("id", "p").distinct().join(own, "p").select("id", "dst").distinct()

    places = pieces.select("id", F.explode("locations").alias("t"))
    texts = subs.select("id", F.col("text").alias("t")).unionAll(known.select("id", F.col("text").alias("t")))
    held = claims.where(F.col("status").isin("verified", "approved") & (F.coalesce(F.trim("collector_uid"), F.lit("")) != "")).select(F.concat(F.lit("object:"), F.col("object_id").cast("string")).alias("id"), F.concat(F.lit("collector:"), F.trim("collector_uid")).alias("dst"), "collector_name")
    held = held.join(pieces.select("id"), "id", "left_semi")
    collectors = held.groupBy(F.col("dst").alias("id")).agg(F.coalesce(F.min(F.nullif(collapse(F.col("collector_name")), F.lit(""))), F.lit("a collector")).alias("label"))
    edges = [
        edge(uses, "id", "dst", "uses", "structured"), edge(made, "id", "dst", "made_by", "structured"), edge(mentions(places, shops, norm), "id", "dst", "based_at", "event"), edge(taught, "id", "dst", "studied_under", "structured", relation="relation"),
        edge(mentions(subs.select("id", F.col("studied_under").alias("t")), artists, F.lower), "id", "dst", "studied_under", "text"), edge(mentions(texts, shops, F.lower), "id", "dst", "based_at", "text"), edge(held, "id", "dst", "collected_by", "structured"),
    ]
    if similar is not None:
        edges.append(edge(similar.select(F.concat(F.lit("object:"), F.col("a").cast("string")).alias("id"), F.concat(F.lit("object:"), F.col("b").cast("string")).alias("dst"), F.round("similarity", 3).alias("w")), "id", "dst", "similar_to", "fingerprint", "w"))
    found = dedupe_edges(reduce(DataFrame.unionByName, edges).where("src <> dst"))
    none = F.lit(None).cast("string")
    titled = pieces.select("id", F.coalesce(F.nullif(collapse(F.col("title")), F.lit("")), F.lit("Untitled")).alias("label")).dropDuplicates(["id"])
    nodes = artists.select("id", "label", F.lit("artist").alias("type"), "source")
    for df, kind in ((titled, "object"), (shops, "studio"), (techniques, "technique"), (collectors, "collector")):
        nodes = nodes.unionByName(df.select("id", "label", F.lit(kind).alias("type"), none.alias("source")))
    return drop_orphans(nodes, found), found
