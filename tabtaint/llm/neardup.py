"""MinHash near-dedup (operator 2) with fast similarity sketching.

A document's set holds its distinct 5-word shingles.  Its sketch has ``ROWS * BANDS`` coordinates,
filled in rounds: in each of the first ``t`` rounds every shingle is hashed to one bin and a value, in
the next ``t`` rounds all shingles go to the round's own bin, and a coordinate keeps the least
(round, value) it gets.  So each coordinate is filled for certain, the share of equal coordinates is
an unbiased estimate of the Jaccard similarity with Chernoff-type concentration, and a set of n
shingles costs O(n + t log t) hash steps, not O(n t).  Sets with J >= 0.75 share a band with
probability of at least 1 - (1 - 0.75 ** 7) ** 72 > 0.99996.

Candidates never become all pairs.  Equal sets are one class.  Each class is compared with the least ones of its
buckets, one a round and only while they lie in different components; verified links give components.  After that only members outside the
bucket's largest component are compared with the members of other components: directly where they
are few; in a crowded bucket, as sets that share a passage fill it, in one task that holds the bucket's
full sets, so that only links leave it, as long as it has at most ``GROUP`` members; a larger one is split by
second bands before.  Sets of over ``GROUP_SHINGLES`` shingles together are compared by their sketches
first: by the concentration bound a pair with J >= 0.75 has fewer than 60 % equal coordinates with
probability below 1e-9.  Links are confirmed on the full sets.

A class is known by a number of its own, given in the order of its first row by (id, text hash), so
the least number of a component is the class of the row that is kept.

Defined cases: null and empty texts have the empty set, are linked with nothing and stay; fewer
than five words give one shingle; rows sharing an id, and rows with a null id, which come after all
others, are judged by their own texts; of equal rows one is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.llm.common import bounded, join_id, own_columns, ready, row_key, sized, split_id, stored
from tabtaint.llm.graph import components
from tabtaint.llm.text import U64, Words, mixed

SHINGLE = 5
ROWS, BANDS = 7, 72
BINS = ROWS * BANDS
SLICE_BYTES = 2 << 20
#: Members outside a bucket's largest component that are compared directly; members of a bucket that
#: one task compares; further bands in the key of a larger one.
DIRECT, GROUP, REFINEMENTS = 8, 2000, 2
#: Shingles of a bucket's sets that one task holds (8 bytes each).
GROUP_SHINGLES = 4 << 20
AGREEMENT = 0.6
#: Rounds in which a member is compared with one of its buckets' least nodes.
CENTER_ROUNDS = 2
#: What tells rows apart, in the order in which they are preferred.
ROW = ("no_id", "doc_id", "a", "b")


# ---- sets and sketches --------------------------------------------------------------------

def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    h, text, _ = w.windows(SHINGLE)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    sets = []
    for i in range(len(texts)):
        n = int(w.counts[i])
        if 0 < n < SHINGLE:
            words = w.hashes[w.first[i]:w.first[i + 1]]
            whole = U64(n)
            for x in words:
                whole = mixed(np.array([whole ^ x], U64), n)[0]
            sets.append(np.array([whole], U64))
        else:
            sets.append(np.unique(h[bounds[i]:bounds[i + 1]]))
    return sets


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` coordinates for each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.empty(0, U64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    empty = np.iinfo(np.uint64).max
    out = np.full(len(sets) * bins, empty, U64)
    low = U64(0xFFFFFFFF)
    for i in range(2 * bins):
        h = mixed(values, i + 1)
        at = ((h >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(out, owner * bins + at, (U64(i) << U64(32)) | (h & low))
        if i % 4 == 3 or i < 4:
            open_ = (out.reshape(len(sets), bins) == empty).any(axis=1)
            if not open_.any():
                break
            left = open_[owner]
            values, owner = values[left], owner[left]
    return out.reshape(len(sets), bins)


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.reshape(len(sketch), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=U64), rows.shape[:2])
    for r in range(ROWS):
        h = mixed(h ^ rows[:, :, r], r + 1)
    return h.astype(np.int64)


def slices(batch: pd.DataFrame, limit: int = SLICE_BYTES) -> Iterator[pd.DataFrame]:
    """Parts of a batch of about ``limit`` text bytes."""
    size = batch["text"].map(lambda t: len(t or b"") + 64).cumsum()
    for _, part in batch.groupby(size // limit, sort=False):
        yield part


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(list(part["text"]))
            some = [i for i, s in enumerate(sets) if len(s)]
            bands = band_hashes(sketches([sets[i] for i in some])) if some else []
            keys, rows = [None] * len(sets), [None] * len(sets)
            for k, i in enumerate(some):
                keys[i] = hashlib.blake2b(sets[i].astype("<u8").tobytes(), digest_size=16).digest()
                rows[i] = bands[k]
            yield pd.DataFrame({**{c: part[c] for c in ROW}, "n_shingles": [len(s) for s in sets],
                                "set": keys, "bands": rows})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices(batch.drop_duplicates("node")):
            yield pd.DataFrame({"node": part["node"], "shingles": [
                s.astype("<u8").tobytes() for s in shingle_sets(list(part["text"]))]})


# ---- links --------------------------------------------------------------------------------

def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        good = []
        for a, b in zip(batch["a"], batch["b"], strict=True):
            x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            at = np.searchsorted(x, y)
            same = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
            good.append(100 * same >= 75 * (len(x) + len(y) - same) > 0)
        yield batch.loc[good, ["u", "v"]]


def _verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs (``u``, ``v``) whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return stored(pairs.join(b, "v").join(a, "u").select("u", "v", "a", "b").mapInPandas(_links, "u bigint, v bigint"), name)


def _similar_size(a: str, b: str):
    return 100 * F.least(a, b) >= 75 * F.greatest(a, b)


def _buckets(rows: DataFrame) -> DataFrame:
    """Rows (``h, node, n``) of buckets with two nodes or more, each with the bucket's least one."""
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")
    least = dealt.groupBy("h").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("last")) \
        .where("first.node <> last").select("h", F.col("first.node").alias("center"), F.col("first.n").alias("center_n"))
    return dealt.join(least, "h")


def _open(members: DataFrame, n: int) -> DataFrame:
    """Members (``h, node, n, component``) of buckets that hold several components, with the bucket's
    largest component, the number of members ``outside`` it and the ``shingles`` of all."""
    parts = sized(members.groupBy("h", "component").agg(F.count("*").alias("k"), F.sum("n").alias("total")), n)
    by = parts.groupBy("h").agg(F.max_by("component", F.struct("k", "component")).alias("largest"),
                                F.count("*").alias("parts"), F.sum("k").alias("size"), (F.sum("k") - F.max("k")).alias("outside"),
                                F.sum("total").alias("shingles")).where("parts > 1")
    return stored(sized(members.join(sized(by, n).drop("parts"), "h"), n), "open-buckets")


def _across(opened: DataFrame) -> DataFrame:
    """Pairs of members outside the largest component with members of other components."""
    x = opened.where("component <> largest").select("h", F.col("node").alias("x"), F.col("n").alias("x_n"),
                                                    F.col("component").alias("x_c"))
    return opened.join(x, "h").where((F.col("component") != F.col("x_c")) & _similar_size("n", "x_n")) \
        .select(F.least("x", "node").alias("u"), F.greatest("x", "node").alias("v"))


def _codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One byte for each coordinate of the sketch."""
    for batch in batches:
        for part in slices(batch.rename(columns={"shingles": "text"})):
            sketch = sketches([np.frombuffer(x, "<u8") for x in part["text"]])
            codes = mixed(sketch).astype(np.uint8)
            yield pd.DataFrame({"node": part["node"], "code": [c.tobytes() for c in codes]})


def _alike_in(bucket: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a bucket's members in different components whose sketches agree enough."""
    code = np.stack([np.frombuffer(c, np.uint8) for c in bucket["code"]])
    component, node = bucket["component"].to_numpy(), bucket["node"].to_numpy()
    out = [np.empty((0, 2), np.int64)]
    for i in np.flatnonzero(component != bucket["largest"].to_numpy()):
        other = np.flatnonzero(component != component[i])
        same = (code[other] == code[i]).mean(axis=1) >= AGREEMENT
        out.append(np.stack([np.minimum(node[i], node[other[same]]), np.maximum(node[i], node[other[same]])], axis=1))
    return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["u", "v"])


def _linked_in(bucket: pd.DataFrame) -> pd.DataFrame:
    """Links between a bucket's members in different components, by their full sets."""
    sets = [np.frombuffer(x, "<u8") for x in bucket["set"]]
    n = np.array([len(x) for x in sets])
    start = np.cumsum(n) - n
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    component, node = bucket["component"].to_numpy(), bucket["node"].to_numpy()
    out = [np.empty((0, 2), np.int64)]
    for i in np.flatnonzero(component != bucket["largest"].to_numpy()):
        own = np.zeros(len(values), bool)
        own[at[start[i]:start[i] + n[i]]] = True
        same = np.add.reduceat(own[at], start, dtype=np.int64)
        good = (component != component[i]) & (100 * same >= 75 * (n + n[i] - same))
        out.append(np.stack([np.minimum(node[i], node[good]), np.maximum(node[i], node[good])], axis=1))
    return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["u", "v"])


def _sets_of(opened: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    return sets.join(bounded(sized(opened.select("node").distinct(), n), "crowded-nodes"), "node")


def _linked(opened: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    own = _sets_of(opened, sets, n).select("node", F.col("shingles").alias("set"))
    found = opened.select("h", "node", "component", "largest").join(own, "node").groupBy("h") \
        .applyInPandas(_linked_in, "u bigint, v bigint")
    return stored(sized(found.distinct(), n), "links")


def _alike(opened: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    codes = _sets_of(opened, sets, n).mapInPandas(_codes, "node bigint, code binary")
    return opened.select("h", "node", "component", "largest").join(codes, "node").groupBy("h") \
        .applyInPandas(_alike_in, "u bigint, v bigint")


def _center_links(pairs: DataFrame, sets: DataFrame, r: int) -> tuple[DataFrame, DataFrame]:
    """Verified links among the pairs (``u, v, k``) of a bucket's least node and a member, ``k`` buckets having
    them, and the components.  A member is compared with the one it shares most buckets with; in the next round with
    another, if that one is in another component; in the last with all such.  So the members of a large
    group cost a comparison each, and any two nodes of a similar pair end in one component."""
    links = label = None
    for step in range(CENTER_ROUNDS + 1):
        if links is not None:
            at = {x: label.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in "uv"}
            pairs = stored(sized(pairs.join(tried, ["u", "v"], "left_anti").join(at["u"], "u", "left").join(at["v"], "v", "left")
                                 .where(F.coalesce("c_u", "u") != F.coalesce("c_v", "v")).select("u", "v", "k"), r), "centers")
            if pairs.isEmpty():
                break
        best = F.max_by("u", F.struct("k", -F.col("u"))).alias("u")
        tried = pairs.select("u", "v") if step == CENTER_ROUNDS else \
            stored(sized(pairs.groupBy("v").agg(best).select("u", "v"), r), "tried")
        found = _verified(sized(tried, r), sets, "links")
        links = found if links is None else links.unionByName(found)
        label = stored(components(links), "components")
    return links, label


def link_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links (``u``, ``v``) that connect the classes (``node, first, n, bands``), ``first``
    being the row of ``docs`` that stands for the class.

    Every link joins nodes of one component; every two similar nodes that share a band end up in
    one component, though not each such pair is listed."""
    rows = classes.select("node", "n", F.explode("bands").alias("h"))
    members = stored(_buckets(rows), "buckets")
    r = members.count()
    nodes = bounded(classes.select("node", *[f"first.{c}" for c in ROW]).join(
        sized(members.select("node").distinct(), r), "node"), "bucket-nodes")
    sets = stored(docs.join(nodes, list(ROW)).select("node", "text").mapInPandas(
        _sets, "node bigint, shingles binary"), "shingle-sets")
    if sets.count() > nodes.count():  # equal rows
        sets = stored(sets.dropDuplicates(["node"]), "shingle-sets")
    pairs = members.where((F.col("node") != F.col("center")) & _similar_size("n", "center_n")) \
        .groupBy(F.col("center").alias("u"), F.col("node").alias("v")).agg(F.count("*").alias("k"))
    links, label = _center_links(stored(sized(pairs, r), "centers"), sets, r)
    m = sized(members.select("h", "node", "n").join(label, "node", "left"), r) \
        .withColumn("component", F.coalesce("component", "node"))
    more, inside = [], []
    for step in range(REFINEMENTS + 1):
        opened = _open(m, r)
        crowded = F.col("outside") > DIRECT
        huge = crowded & (F.col("size") > GROUP)
        more.append(_across(opened.where(~crowded if step < REFINEMENTS else ~crowded | huge)))
        small = F.col("shingles") <= GROUP_SHINGLES
        held, grouped = opened.where(crowded & ~huge & small), opened.where(crowded & ~huge & ~small)
        if not held.isEmpty():
            inside.append(_linked(held, sets, r))
        if not grouped.isEmpty():
            more.append(_alike(grouped, sets, r))
        if step == REFINEMENTS or opened.where(huge).isEmpty():
            break
        left = opened.where(huge).select("h", "node", "n", "component")
        these = classes.join(bounded(sized(left.select("node").distinct(), r), "crowded-nodes"), "node") \
            .select("node", F.explode("bands").alias("other"))
        m = left.join(these, "node").where("other <> h").select(
            F.xxhash64(F.least("h", "other"), F.greatest("h", "other")).alias("h"), "node", "n", "component").distinct()
        m = stored(_buckets(m).select("h", "node", "n", "component"), "buckets")
        r = m.count()
    more = stored(sized(reduce(DataFrame.unionByName, more).distinct(), r), "pairs")
    if not more.isEmpty():
        inside.append(_verified(more, sets, "links"))
    if not inside:
        return links
    return links.unionByName(stored(sized(reduce(DataFrame.unionByName, inside).distinct(), r), "links"))


def _judged(docs: DataFrame, text: str) -> DataFrame:
    """Per row: ``ROW``, ``n_shingles, component_id, kept, n_links``, and whether it equals the
    component's kept row in id and text (``first_row``)."""
    ready(docs)
    d = docs.select(*split_id(), row_key(text).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text")) \
        .select("doc_id", "no_id", "row.a", "row.b", "text")
    sk = stored(d.mapInPandas(_sketch, "no_id boolean, doc_id bigint, a bigint, b int, n_shingles bigint, set binary, bands array<bigint>")
                .withColumn("copy", F.monotonically_increasing_id()), "sketches")
    classes = sk.where("set IS NOT NULL").groupBy("set").agg(
        F.min(F.struct(*ROW, "copy")).alias("first"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes.orderBy("first").withColumn("node", F.monotonically_increasing_id()), "classes")
    links = link_classes(d, classes.select("node", "first", "n", "bands"))
    label = components(links)
    ends = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node")))
    n_links = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    least = bounded(label.select("component").distinct().join(classes.select(
        F.col("node").alias("component"), F.when(~F.col("first.no_id"), F.col("first.doc_id")).alias("component_id")),
        "component"), "components")
    own = F.when(~F.col("first.no_id"), F.col("first.doc_id"))
    of = classes.select("set", "node", "first").join(label, "node", "left").join(n_links, "node", "left") \
        .join(least, "component", "left") \
        .select("set", F.when(F.col("component").isNull(), own).otherwise(F.col("component_id")).alias("component_id"),
                F.when(F.coalesce(F.col("component") == F.col("node"), F.lit(True)), F.col("first")).alias("first"), "n_links")
    j = sk.drop("bands").join(of, "set", "left")
    alone, id_ = F.col("set").isNull(), F.when(~F.col("no_id"), F.col("doc_id"))
    first_row = alone | F.coalesce(F.struct(*ROW) == F.struct(*[f"first.{c}" for c in ROW]), F.lit(False))
    return j.select(*ROW, "n_shingles", F.when(alone, id_).otherwise(F.col("component_id")).alias("component_id"),
                    (alone | F.coalesce(F.col("copy") == F.col("first.copy"), F.lit(False))).alias("kept"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"), first_row.alias("first_row"))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id`` (least id of the component), ``kept`` (one row of
    each component), ``n_links`` (verified links of its class)."""
    return join_id(_judged(docs, text)).select("doc_id", "n_shingles", "component_id", "kept", "n_links")


@own_columns
def keep_first_of_group(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each group, the one of the least id (of equal rows any one), with the columns of ``docs`` only."""
    dropped = stored(join_id(_judged(docs, text).where("NOT kept").select(*ROW, "first_row").distinct()), "near-duplicates")
    keys = dropped.select(F.col("doc_id").alias("__id"), F.struct("a", "b").alias("__row"), "first_row")

    def without(rows: DataFrame, some: DataFrame, how: str = "left_anti") -> DataFrame:
        return rows.join(some, rows["doc_id"].eqNullSafe(some["__id"]) & (row_key(text) == some["__row"]), how)

    left = without(docs, bounded(keys.where("NOT first_row").drop("first_row"), "dropped-rows"))
    again = keys.where("first_row").drop("first_row")
    if again.isEmpty():
        return left
    again = bounded(again, "equal-rows")
    one = without(left, again, "left_semi").withColumn("__key", row_key(text)).dropDuplicates(["doc_id", "__key"]).drop("__key")
    return without(left, again).unionByName(one)
