"""N-gram Jaccard join by grouped prefixes.

Shingles are put in one order, rare before frequent. Two sets that reach the threshold share a
shingle in their prefixes. Documents with the same prefix and size are one group, so copies are
one entry in the lists of documents by prefix shingle. Group pairs in a list are filtered by size
and by the place of the shingle, expanded to their members and verified on whole sets.

No list is turned into all its pairs. First every list's groups are compared with one of them, its
hub, and linked documents joined to components; then only members of different components of a
list are compared, each with each, until no list has an untested pair of components left.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import returned, text_of, text_slices, unused, written
from plumbline.llm.components import components
from plumbline.llm.line_dedup import row_key
from plumbline.llm.shingles import SIZE, WordHashes, scramble, shingle_set, sketch
from plumbline.model import col

BITS = 20
LIST = 8192
ROW_BITS = 27
RECENT = 100_000


def prefix_length(n: int, percent: int) -> int:
    """How many leading shingles two sets must share one of: all but those that may miss, and one."""
    return n - (percent * n + 99) // 100 + 1


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def class_of(items: np.ndarray) -> int:
    """The digest of a set."""
    return int(signed(scramble(items ^ np.uint64(len(items)))).sum())


def frequencies(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """Occurrences over all documents, by the leading bits of the shingle hash."""

    def slots_of():
        known = WordHashes()

        def find(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for part in text_slices(batch, "text"):
                sets = [shingle_set(t.as_py(), known, size) for t in part.column("text")]
                yield (np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64)

        return find

    return sketch(docs.select("text"), slots_of, bits)


def signatures(docs: DataFrame, size: int, percent: int, bits: int) -> DataFrame:
    """Per row: ``n`` shingles, ``cls`` (digest of the set), ``grp`` (of prefix and size) and the prefix.

    The prefix is left out where the task has just seen the same group, which takes copies out
    before anything is shuffled. ``splits`` is in how many parts the list of a shingle is cut.
    """
    counts = docs.sparkSession.sparkContext.broadcast(np.minimum(frequencies(docs, size, bits), 2**31 - 1).astype(np.int32))  # 2 ** bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, often = WordHashes(), set(), counts.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                n, cls, grp, prefixes, splits = [], [], [], [], []
                for text in part.column("text"):
                    s = shingle_set(text.as_py(), known, size)
                    n.append(len(s))
                    cls.append(class_of(s) if len(s) else 0)
                    if not len(s):
                        grp.append(0)
                        prefixes.append(None)
                        splits.append(None)
                        continue
                    f = often[(s >> np.uint64(64 - bits)).astype(np.int64)]
                    p = prefix_length(len(s), percent)
                    first = np.lexsort((s, f))[:p]
                    prefix = signed(s[first])
                    g = int(signed(scramble(s[first] * np.uint64(2 * len(s) + 1))).sum())
                    grp.append(g)
                    if g in seen:
                        prefixes.append(None)
                        splits.append(None)
                    else:
                        if len(seen) > RECENT:
                            seen.clear()
                        seen.add(g)
                        prefixes.append(prefix)
                        splits.append((f[first] // LIST + 1).astype(np.int32))
                arrays = [pa.array(n, pa.int32()), pa.array(cls, pa.int64()), pa.array(grp, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(splits, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("row"), *arrays], names=["doc", "row", "n", "cls", "grp", "prefix", "splits"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(lambda batches: returned(run(batches)), f"doc {kind}, row long, n int, cls long, grp long, prefix array<long>, splits array<int>")


def may_link(n1: Column, at1: Column, n2: Column, at2: Column, percent: int) -> Column:
    """Whether sets of these sizes, with their first common shingle at these places, can reach the threshold."""
    least = F.ceil((n1 + n2) * percent / (100 + percent))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (F.least(n1 - at1, n2 - at2) >= least)


def prefix_lists(signed_docs: DataFrame) -> DataFrame:
    """Groups by prefix shingle, without lists of one group: token, cut, grp, n, at; and the hub of the list or its part."""
    rows = signed_docs.where("prefix is not null").select("grp", "n", "splits", F.posexplode("prefix").alias("at", "token"))
    split = F.element_at("splits", F.col("at") + 1)
    part = F.pmod(F.xxhash64("grp"), split)
    # narrow rows: one number names the list or its part, the shingle itself goes along only for lists in parts
    rows = rows.select(
        F.when(split > 1, F.xxhash64("token", part)).otherwise(F.col("token")).alias("list"),
        "grp",
        (F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")).alias("place"),
        F.when(split > 1, F.col("token")).alias("whole"),
    )
    here = Window.partitionBy("list")
    at = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    # the hub has the fewest rarer shingles of its own, so it is the most alike to the others
    listed = rows.withColumn("hub", F.min(F.struct(at.alias("rarer"), F.xxhash64("grp").alias("draw"), "grp", "place")).over(here)).withColumn("last", F.max("grp").over(here)).withColumn("first", F.min("grp").over(here))
    n_of = lambda c: F.shiftright(c, 32).cast("int").alias("n")
    at_of = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at")
    hub = F.struct(F.col("hub.rarer"), F.col("hub.draw"), F.col("hub.grp"), n_of(F.col("hub.place")), at_of(F.col("hub.place"))).alias("hub")
    listed = listed.where("whole is not null or first <> last")
    return listed.select(F.coalesce("whole", "list").alias("token"), F.col("whole").isNotNull().alias("cut"), "grp", n_of(F.col("place")), at_of(F.col("place")), hub)


def hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Group pairs of every list's hub with its other groups; the hubs of a cut list meet at the list's own hub."""
    hubs = lists.where("cut").select("token", "hub").distinct()
    top = hubs.groupBy("token").agg(F.min("hub").alias("top"))
    upper = hubs.join(top, "token").select("top.grp", "top.n", "top.at", F.col("hub.grp").alias("grp2"), F.col("hub.n").alias("n2"), F.col("hub.at").alias("at2"))
    lower = lists.select("hub.grp", "hub.n", "hub.at", F.col("grp").alias("grp2"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    pairs = lower.unionByName(upper).where((F.col("grp") != F.col("grp2")) & may_link(F.col("n"), F.col("at"), F.col("n2"), F.col("at2"), percent))
    return pairs.select(F.least("grp", "grp2").alias("grp"), F.greatest("grp", "grp2").alias("grp2")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The class pairs (a, b) whose whole sets reach the threshold."""
    one = sets.select(F.col("cls").alias("a"), F.col("items").alias("items_a"))
    two = sets.select(F.col("cls").alias("b"), F.col("items").alias("items_b"))
    joined = pairs.join(two, "b").join(one, "a")
    both = F.size(F.array_intersect("items_a", "items_b"))
    either = F.size("items_a") + F.size("items_b") - both
    return joined.where(both * 100 >= either * percent).select("a", "b")


def row_bitmap(rows: DataFrame) -> np.ndarray:
    """A fixed-size bitmap of row keys by their low bits: no key is missed, few others match."""
    slot = F.pmod(F.col("row"), F.lit(1 << ROW_BITS))
    blocks = rows.select(F.shiftright(slot, 15).alias("block"), slot.bitwiseAND(F.lit(0x7FFF)).alias("at"))
    out = np.zeros((1 << (ROW_BITS - 15), 4096), np.uint8)
    for r in blocks.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator():
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def whole_sets(docs: DataFrame, pairs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """(cls, items) for the classes in ``pairs``: one text of each is cut into shingles again.

    The documents to read are told by a bitmap of their row keys, so no text is shuffled; the few
    others that match it add sets that no pair asks for.
    """
    classes = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    bitmap = docs.sparkSession.sparkContext.broadcast(row_bitmap(chosen.join(classes, "cls").select("row")))  # 2 ** ROW_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = WordHashes(), bitmap.value
        for batch in batches:
            slot = batch.column("row").to_numpy() & ((1 << ROW_BITS) - 1)
            batch = batch.filter(pa.array(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1))
            for part in text_slices(batch, "text", 2 << 20):
                sets = [shingle_set(t.as_py(), known, size) for t in part.column("text")]
                sets = [s for s in sets if len(s)]
                columns = [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([signed(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["cls", "items"])

    return docs.select("row", "text").mapInArrow(lambda batches: returned(run(batches)), "cls long, items array<long>")


def verified_pairs(docs: DataFrame, pairs: DataFrame, chosen: DataFrame, size: int, percent: int) -> DataFrame:
    pairs = written(pairs, "pairs")
    items = written(whole_sets(docs, pairs, chosen, size), "sets")
    return written(verified(pairs, items, percent), "links")


def similar_sets(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, size: int = SIZE, bits: int = BITS) -> DataFrame:
    """Per row: ``doc``, ``row`` (see ``row_key``), ``n_shingles``, ``component_id``, ``kept``.

    A text's words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; its set is its distinct
    ``size``-word shingles, with fewer words all of them as one. Two rows link when 100 times the
    intersection is at least ``percent`` times the union; empty sets (null or empty text, or white
    space only) link with nothing. ``component_id`` is the smallest id reachable over links, the
    row's own included; null if none has an id. ``kept`` marks one row key of every component: its
    smallest id, of those the smallest row key. Rows that repeat id and text have one row key.
    Shingles and sets are known by 64-bit hashes.
    """
    docs = df.select(col(key).alias("doc"), row_key(key, text).alias("row"), text_of(text).alias("text"))
    table = written(signatures(docs, size, percent, bits), "signatures")
    sets = table.where("n > 0")
    lists = written(prefix_lists(sets), "prefix-lists")
    # Groups with several sets, and the groups of lists, are all that can link; one text stands for each set.
    members = sets.groupBy("grp", "n", "cls").agg(F.min("row").alias("row"))
    several = members.groupBy("grp").agg(F.count("cls").alias("sets"), F.min("cls").alias("lead"))
    listed = lists.select("grp").distinct().withColumn("listed", F.lit(True))
    chosen = members.join(several, "grp").join(listed, "grp", "left").where("listed or sets > 1")
    chosen = written(chosen.select("grp", "n", "cls", "row", "lead"), "candidates")
    lead = chosen.select("grp", "lead").distinct()
    by_hub = hub_pairs(lists, percent).join(lead, "grp").join(lead.select(F.col("grp").alias("grp2"), F.col("lead").alias("lead2")), "grp2")
    inside = chosen.where("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b"))
    first = by_hub.select(F.col("lead").alias("a"), F.col("lead2").alias("b")).unionByName(inside).distinct()
    links = verified_pairs(docs, first, chosen, size, percent)
    found = written(components(links), "components-by-hub")

    more = verified_pairs(docs, open_pairs(lists, chosen, found, percent), chosen, size, percent)
    if not more.isEmpty():
        found = written(components(links.unionByName(more)), "components")
    return labelled(table, found)


def open_pairs(lists: DataFrame, chosen: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets that stand in one list, or in one group, and in different components."""
    placed = chosen.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    entries = lists.select("token", "grp", "at").distinct().join(placed.select("grp", "n", "cls", "component"), "grp")
    within = placed.select(F.col("grp").alias("token"), "grp", F.lit(0).alias("at"), "n", "cls", "component")
    mixed = placed.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("grp")
    entries = entries.withColumn("kind", F.lit("list")).unionByName(within.join(mixed, "grp", "left_semi").withColumn("kind", F.lit("group")))
    parts = entries.groupBy("kind", "token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("kind", "token")
    open_rows = written(entries.join(parts, ["kind", "token"], "left_semi"), "open-lists")
    # what a component has in a list: entries, sizes, and the most shingles left from the list's one on
    left = (F.col("n") - F.col("at")).alias("left")
    sides = open_rows.groupBy("kind", "token", "component").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(left).alias("left"))
    other = sides.select("kind", "token", *[F.col(c).alias(f"{c}2") for c in ("component", "m", "lo", "hi", "left")])
    smaller = F.struct("m", "component") < F.struct(F.col("m2").alias("m"), F.col("component2").alias("component"))
    meets = sides.select("kind", "token", "component", "m").join(other, ["kind", "token"]).where(smaller)
    # the entries of the smaller side first, those alone that some size of the other side lets through
    one = open_rows.select("kind", "token", "component", F.col("cls").alias("a"), "n", "at")
    fit = F.greatest(F.col("lo2"), F.ceil(F.col("n") * percent / 100))
    least = F.ceil((F.col("n") + fit) * percent / (100 + percent))
    some = (fit <= F.least(F.col("hi2"), F.floor(F.col("n") * 100 / percent))) & (F.col("n") - F.col("at") >= least) & (F.col("left2") >= least)
    hopeful = meets.join(one, ["kind", "token", "component"]).where(some).select("kind", "token", "component2", "a", "n", "at")
    two = open_rows.select("kind", "token", F.col("component").alias("component2"), F.col("cls").alias("b"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    pairs = hopeful.join(two, ["kind", "token", "component2"])
    pairs = pairs.where(may_link(F.col("n"), F.col("at"), F.col("n2"), F.col("at2"), percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labelled(table: DataFrame, found: DataFrame) -> DataFrame:
    """The result rows from signatures and components of sets."""
    least = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("least")
    classes = table.where("n > 0").groupBy("cls").agg(least).join(found.withColumnRenamed("node", "cls"), "cls", "left")
    joined = classes.where("component is not null")
    whole = joined.groupBy("component").agg(F.min("least").alias("best"))
    best = classes.where("component is null").select("cls", F.col("least").alias("best")).unionByName(joined.join(whole, "component").select("cls", "best"))
    rows = table.select("doc", "row", "n", "cls")
    out = rows.where("n > 0").join(best, "cls").select(
        "doc", "row", "n", F.col("best.doc").alias("component_id"), (F.col("best.row") == F.col("row")).alias("kept")
    )
    alone = rows.where("n = 0").select("doc", "row", "n", F.col("doc").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone).select("doc", "row", F.col("n").cast("long").alias("n_shingles"), "component_id", "kept")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, size: int = SIZE) -> DataFrame:
    """``df`` with one document of every component, and every document that links with nothing; same columns, whatever their names."""
    (own,) = unused(df, "_row")
    kept = similar_sets(df, key, text, percent, size).where("kept").select(F.col("row").alias(own)).distinct()
    rows = df.withColumn(own, row_key(key, text)).join(kept, own, "left_semi")
    return rows.dropDuplicates([own]).select(*[col(c) for c in df.columns])
