"""Exact n-gram Jaccard self-join by partitioning the universe of shingles (pigeonhole principle).

Documents are sets of hashed ``k``-word shingles; two link when |A n B| >= similarity * |A u B|.  Equal sets are
joined at once and go on as one node, named by 64 bits of the set's digest.

Signatures.  Sizes are cut into bands, each ``BAND_RATIO`` wide.  Two linked sets whose larger one has at most u
shingles differ in at most H = floor(2u (1-s)/(1+s)) of them.  Per band, shingle hashes are dealt to m segments
with allowances a_j of 0 (equal) or 1 (one shingle more or less) such that sum(a_j + 1) = H + 1 + spare.  Segments
that differ by more than their allowance use up H, so the others have at least 1 + spare between them.  Indexed are:
  * each segment with allowance 0 that holds shingles, by the hash of its subset;
  * each segment with allowance 1, by its hash and all its one-deletion neighbourhoods;
  * empty segments, alike in many sets, only where a set has more than ``spare`` of them: linked sets that agree in
    nothing else agree in 1 + spare empty ones.
How many segments get allowance 1 is a matter of cost, per band: rows to index against pairs expected to meet by
chance, from the band's number of sets.  A set is indexed in its own band, and in the next one when it is large
enough to link with a set there.

Candidates.  Buckets with the same members are one bucket.  A bucket is cut into blocks of ``BLOCK`` sets, large
ones into all pairs of blocks; a block compares 1024-bit parity sketches, whose difference never exceeds that of
the sets, so the test loses no link.  Of the pairs that pass, a block emits the edges of a minimum spanning forest
only: linear in its members, whatever their number.

Verification is exact, on the shingles of both texts.  Where an edge fails, its block is taken again with what is
known - components so far and pairs refuted - until no edge fails; the third time it emits all that is left.
Components are found by label propagation with checkpoints.

Defined results: null text or no words: an empty set, linked with nothing.  A text of fewer than k words is one
shingle.  Rows with equal sets link whatever their ids; a component's id is the smallest id in it, null ids last.
An empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from busguard.llm.common import CREATED, col, drop_scratch, give_back, may_have, stage_table, text_or_empty, tidy
from busguard.llm.words import in_batches, mix, shingle_sets
from busguard.session import cut_lineage

BAND_RATIO = 1.4
BLOCK = 1024
SKETCH_BITS = 1024
SALTS = 32
SLOTS = 1 << 16
PASSES = 4  # over the keys, so that a shuffle holds a part of them; one for each PASS_ROWS keys at most
PASS_ROWS = 1 << 22
TEXTS = 512  # most texts in a Python worker at once
CHANCE = 0.1  # assumed chance that a shingle of one set is in another by accident; weighs costs, never decides links
FORESTS = 2  # rounds of spanning forests before a block emits all it has left

_U = np.uint64
NO_KEYS = np.empty(0, dtype=np.uint64)


# ---- bands and signatures ---------------------------------------------------------------------------------------

def max_difference(size: int, similarity: Fraction) -> int:
    """Largest symmetric difference of two linked sets of at most ``size`` shingles each."""
    return math.floor(2 * size * (1 - similarity) / (1 + similarity))


def band_of(size: int) -> int:
    band = max(0, int(math.log(size, BAND_RATIO)))
    while band_start(band + 1) <= size:
        band += 1
    while band_start(band) > size:
        band -= 1
    return band


def band_start(band: int) -> int:
    return math.ceil(BAND_RATIO ** band)


def plan(band: int, n_sets: int, similarity: Fraction) -> tuple[int, int, int]:
    """(segments, how many of them have allowance 1, spare) of a band with the lowest cost."""
    largest = band_start(band + 1) - 1
    smallest = max(1.0, float(similarity * band_start(band)))
    need = max_difference(largest, similarity) + 1

    def spare_for(segments: int) -> int:
        empty = segments * math.exp(-smallest / segments)  # expected number of empty segments
        return math.ceil(empty + 3 * math.sqrt(empty))

    spare = 1
    while spare < spare_for(need + spare) and spare < need // 3 + 1:
        spare += 1

    def cost(ones: int) -> float:
        segments = need + spare - ones
        held = largest / segments
        pairs = n_sets * n_sets / 2 * ((segments - ones) * CHANCE ** held + ones * (1 + held) * CHANCE ** max(held - 1, 0))
        return n_sets * (segments + ones * held) + pairs

    ones = min(range(min((need + spare) // 2, 4) + 1), key=cost)
    return need + spare - ones, ones, spare


def signatures(sets: list[np.ndarray], bands: list[int], plans: dict[int, tuple[int, int, int]]) -> list[np.ndarray]:
    """Index keys of each set in its given band, for many sets as one array; in a band's plan of (segments, ones,
    spare), segments 0 .. ones-1 have allowance 1."""
    if not sets:
        return []
    lengths = np.array([len(s) for s in sets])
    segments = np.array([plans[b][0] for b in bands])
    ones = np.array([plans[b][1] for b in bands])
    spare = np.array([plans[b][2] for b in bands])
    salts = (np.array(bands, dtype=np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
    owner = np.repeat(np.arange(len(sets)), lengths)
    base = np.concatenate([[0], np.cumsum(segments)])
    dealt = mix(np.concatenate(sets) + salts[owner])
    segment = ((dealt >> _U(33)) % segments.astype(np.uint64)[owner]).astype(np.int64)
    place = base[owner] + segment
    order = np.argsort(place, kind="stable")
    place, parts = place[order], mix(dealt[order])
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    total = int(base[-1])
    sums = np.zeros(total, dtype=np.uint64)
    sums[place[first]] = np.add.reduceat(parts, first)
    of = np.repeat(np.arange(len(sets)), segments)
    number = np.arange(total) - base[of]
    names = mix(number.astype(np.uint64) + salts[of])
    allowed = number < ones[of]
    indexed = allowed.copy()
    indexed[place[first]] = True
    indexed |= (np.bincount(of[~indexed], minlength=len(sets)) > spare)[of]
    keys, owners = [mix(sums ^ names)[indexed]], [of[indexed]]
    near = allowed[place]  # one-deletion neighbourhoods
    keys.append(mix((sums[place] - parts) ^ names[place])[near])
    owners.append(of[place][near])
    key, own = np.concatenate(keys), np.concatenate(owners)
    along = np.argsort(own, kind="stable")
    return np.split(key[along], np.searchsorted(own[along], np.arange(1, len(sets))))


def sketch(hashes: np.ndarray) -> bytes:
    """Parity of the set's members in each of SKETCH_BITS classes: sets differ in as many bits as members, at most."""
    counts = np.bincount((mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5)) % _U(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits(counts & 1).tobytes()


def node_id(hashes: np.ndarray) -> int:
    """64 bits of a digest of the whole set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def described_frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows whose first value is a 64-bit node or None (kept exact: not by way of floats)."""
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pd.DataFrame({n: pd.array(c, dtype="Int64") if i == 0 else pd.Series(c, dtype=object) if n != "size" else c
                         for i, (n, c) in enumerate(zip(names, columns))})


# ---- candidates within blocks -----------------------------------------------------------------------------------

def forest(distance: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest; a distance below 0 is no edge.  Prim's algorithm over whole rows."""
    n = len(distance)
    far = np.iinfo(np.int32).max
    dist = np.where(distance < 0, far, distance)
    best = np.full(n, far, dtype=np.int64)
    origin = np.full(n, -1)
    left = np.ones(n, dtype=bool)
    edges = []
    for _ in range(n):
        i = int(np.where(left, best, far + 1).argmin())
        left[i] = False
        if origin[i] >= 0:
            edges.append((int(origin[i]), i))
        closer = left & (dist[i] < best)
        best[closer] = dist[i][closer]
        origin[closer] = i
    return edges


def block_edges(nodes: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, labels: np.ndarray,
                refuted: set[tuple[int, int]], rate: tuple[int, int], everything: bool) -> list[tuple[int, int]]:
    """Pairs of one block to verify; ``rate``: links differ in at most rate[0] / rate[1] of their sizes' sum."""
    n = len(nodes)
    distance = np.full((n, n), -1, dtype=np.int32)
    for start in range(0, n, 64):
        rows = slice(start, min(n, start + 64))
        differ = np.bitwise_count(sketches[rows, None, :] ^ sketches[None, :, :]).sum(axis=2, dtype=np.int32)
        allowed = (sizes[rows, None] + sizes[None, :]) * rate[0] // rate[1]
        fits = (differ <= allowed) & (np.abs(sizes[rows, None] - sizes[None, :]) <= allowed)
        fits &= labels[rows, None] != labels[None, :]
        distance[rows] = np.where(fits, differ, -1)
    if refuted:
        at = {int(x): i for i, x in enumerate(nodes)}
        for a, b in refuted:
            if a in at and b in at:
                distance[at[a], at[b]] = distance[at[b], at[a]] = -1
    if everything:
        i, j = np.nonzero(np.triu(distance >= 0, 1))
        pairs = zip(i.tolist(), j.tolist())
    elif len(np.unique(labels)) == n:
        pairs = forest(distance)
    else:  # members of a component are one vertex: keep the closest pair between two components
        pairs = component_forest(distance, labels)
    return [(min(int(nodes[i]), int(nodes[j])), max(int(nodes[i]), int(nodes[j]))) for i, j in pairs]


def component_forest(distance: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Minimum spanning forest over components, as member pairs (Kruskal's algorithm)."""
    i, j = np.nonzero(np.triu(distance >= 0, 1))
    order = np.argsort(distance[i, j], kind="stable")
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        ra, rb = root(int(labels[a])), root(int(labels[b]))
        if ra != rb:
            parent[ra] = rb
            edges.append((a, b))
    return edges


EDGES = "block string, a long, b long"


def edges_of_sorted(frames: Iterator[pd.DataFrame], rate: tuple[int, int], everything: bool) -> Iterator[pd.DataFrame]:
    """Edges of all blocks of a partition; rows come sorted by block, so one block is held at a time."""
    held: list[pd.DataFrame] = []

    def solve(rows: pd.DataFrame) -> list[tuple[str, int, int]]:
        members = rows[rows["member"]]
        known = rows[~rows["member"]]
        nodes = members["node"].to_numpy(np.int64)
        if len(nodes) < 2:
            return []
        sketches = np.frombuffer(b"".join(members["sketch"]), dtype=np.uint64).reshape(len(nodes), -1)
        refuted = set(zip(known["a"].tolist(), known["b"].tolist()))
        name = rows["block"].iloc[0]
        return [(name, a, b) for a, b in block_edges(
            nodes, members["size"].to_numpy(np.int64), sketches, members["label"].to_numpy(np.int64), refuted, rate,
            everything)]

    def pairs_at_once(two: pd.DataFrame) -> pd.DataFrame:
        """Blocks of two plain members, all in a few array operations."""
        nodes = two["node"].to_numpy(np.int64).reshape(-1, 2)
        sizes = two["size"].to_numpy(np.int64).reshape(-1, 2)
        labels = two["label"].to_numpy(np.int64).reshape(-1, 2)
        sketches = np.frombuffer(b"".join(two["sketch"]), dtype=np.uint64).reshape(len(nodes), 2, -1)
        differ = np.bitwise_count(sketches[:, 0] ^ sketches[:, 1]).sum(axis=1, dtype=np.int64)
        allowed = sizes.sum(axis=1) * rate[0] // rate[1]
        ok = (differ <= allowed) & (np.abs(sizes[:, 0] - sizes[:, 1]) <= allowed) & (labels[:, 0] != labels[:, 1])
        return pd.DataFrame({"block": two["block"].to_numpy()[::2][ok], "a": nodes.min(axis=1)[ok],
                             "b": nodes.max(axis=1)[ok]})

    def finish(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        size = rows.groupby("block", sort=False)["block"].transform("size").to_numpy()
        plain = rows["member"].groupby(rows["block"], sort=False).transform("all").to_numpy()
        two = (size == 2) & plain
        if two.any():
            yield pairs_at_once(rows[two])
        for _, part in rows[~two & (size > 1)].groupby("block", sort=False):
            if found := solve(part):
                yield pd.DataFrame(found, columns=["block", "a", "b"])

    for frame in frames:
        if not len(frame):
            continue
        last = frame["block"].iloc[-1]
        ended = frame["block"] != last
        if ended.any():
            yield from finish(pd.concat([*held, frame[ended]]))
            held = []
        held.append(frame[~ended])
    if held:
        yield from finish(pd.concat(held))


# ---- the join ---------------------------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): label is the least node of its component.

    Each round takes the least label among neighbours, then the label's own label, so long paths halve.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label"))
                         .withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = (labels.join(seen, labels["node"] == seen["a"])
                 .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        up = lower.select(F.col("node").alias("at"), F.col("label").alias("above"))
        labels = cut_lineage(lower.join(up, lower["label"] == up["at"])
                             .select("node", "old", F.least("label", "above").alias("label")))
        if labels.filter("label != old").isEmpty():
            return labels.select("node", "label")


def described_sets(texts: list[str], k: int, similarity: Fraction, plans: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """(node, size, sketch, keys in the own band, keys in the band above) of each text; no node without words."""
    out = []
    for part in in_batches(texts):
        sets = shingle_sets(part, k)
        bands = [band_of(len(s)) if len(s) else 0 for s in sets]
        # a set that links with equal sets alone needs no index
        own = [i for i, s in enumerate(sets) if len(s) * (1 - similarity) >= similarity]
        below = [i for i in own if len(sets[i]) >= similarity * band_start(bands[i] + 1)]
        own_keys = dict(zip(own, signatures([sets[i] for i in own], [bands[i] for i in own], plans)))
        below_keys = dict(zip(below, signatures([sets[i] for i in below], [bands[i] + 1 for i in below], plans)))
        out += [(node_id(s) if len(s) else None, len(s), sketch(s) if len(s) else None,
                 own_keys.get(i, NO_KEYS).view(np.int64), below_keys.get(i, NO_KEYS).view(np.int64))
                for i, s in enumerate(sets)]
    return out


class Plans(dict):
    """Plan of every band, made when it is asked for."""

    def __init__(self, counts: dict[int, int], similarity: Fraction):
        super().__init__()
        self.counts, self.similarity = counts, similarity

    def __missing__(self, band: int) -> tuple[int, int, int]:
        self[band] = plan(band, self.counts.get(band, 0) + self.counts.get(band - 1, 0), self.similarity)
        return self[band]


def key_rows(keyed: DataFrame) -> DataFrame:
    """(key, node, is_own) of every key of every set."""
    both = keyed.select("node", F.size("own").alias("n_own"), F.posexplode(F.concat("own", "below")).alias("at", "key"))
    return both.select("key", "node", (F.col("at") < F.col("n_own")).alias("is_own"))


def slot_of(key: str) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def full_slots(rows: DataFrame, key: str) -> tuple[list[int], int]:
    """The classes of key hashes (of ``SLOTS``) with far more rows than most, and the number of all rows."""
    counts = stage_table(rows.groupBy(slot_of(key).alias("slot")).count(), "jaccard-slots")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    full = counts.filter(F.col("count") > 2 * total / SLOTS + 8 * BLOCK).select("slot").collect()
    return [r["slot"] for r in full], total


def one_of_each(keyed: DataFrame) -> DataFrame:
    """One row of each node.  Rows whose node comes once stay where they are; a bitmap over nodes tells most of them."""
    again = keyed.groupBy("node").count().filter("count > 1")
    maybe = may_have(again, "node")(F.col("node"))
    repeated = stage_table(keyed.filter(maybe).dropDuplicates(["node"]), "jaccard-repeated")
    return keyed.filter(~maybe).unionByName(repeated)


def shared_keys(keyed: DataFrame) -> Iterator[DataFrame]:
    """(key, node, n, who, lo, hi): the rows of keys that several sets hold, one of them in its own band, and what
    tells the key's members: their number, least, greatest and the parity of their hashes; a table for each pass.

    Counts of key hashes in ``SLOTS`` classes (a bounded table) tell where a key may be frequent.  All other keys
    are taken together by one shuffle; those of full classes are counted first and joined, so that no task need
    hold all rows of a frequent key.
    """
    full, total = full_slots(key_rows(keyed), "key")  # copies included: an upper bound
    passes = max(1, min(PASSES, -(-total // PASS_ROWS)))
    once = key_rows(one_of_each(keyed))
    told = {"n": lambda: F.count(F.lit(1)), "who": lambda: F.expr("bit_xor(xxhash64(node))"),
            "lo": lambda: F.min("node"), "hi": lambda: F.max("node"), "has_own": lambda: F.max("is_own")}
    several = (F.col("lo") != F.col("hi")) & F.col("has_own")
    columns = ("key", "node", "n", "who", "lo", "hi")
    of_key, slot = Window.partitionBy("key"), slot_of("key")
    # a pass has the keys of some of the shuffle's partitions, where a set's keys lie together and pack well
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn_of = F.floor(F.pmod(F.hash("key"), F.lit(parts)) * passes / parts)
    for turn in range(passes):
        rows = once.filter(turn_of == turn) if passes > 1 else once
        out = (rows.filter(~slot.isin(full)) if full else rows).withColumns(
            {name: made().over(of_key) for name, made in told.items()}).filter(several).select(*columns)
        if full:
            frequent = rows.filter(slot.isin(full))
            counted = stage_table(frequent.groupBy("key").agg(*(made().alias(name) for name, made in told.items()))
                                  .filter(several).select("key", "n", "who", "lo", "hi"), "jaccard-frequent")
            out = out.unionByName(frequent.select("key", "node").join(counted, "key").select(*columns))
        yield out


def candidate_blocks(keyed: DataFrame) -> DataFrame:
    """(block, node): the members of every block to compare."""
    members = functools.reduce(DataFrame.unionByName, [
        stage_table(rows, "jaccard-members") for rows in shared_keys(keyed.filter(F.size("own") > 0))])
    # buckets with the same members: one is enough
    buckets = members.groupBy("n", "who", "lo", "hi").agg(F.min("key").alias("key")).select("key")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    members = members.join(buckets, "key", "left_semi").withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.col("part"))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: q != F.col("part")))
    members = members.select("key", "node", "part", F.explode(others).alias("other"))
    block = F.concat_ws(":", F.col("key").cast("string"), F.least("part", "other").cast("string"),
                        F.greatest("part", "other").cast("string"))
    return members.select(block.alias("block"), "node")


def verified(pairs: DataFrame, docs: DataFrame, facts: DataFrame, k: int, similarity: Fraction) -> DataFrame:
    """(a, b, linked) with the exact Jaccard test on both sets.  Texts travel, packed tighter than their hashes."""
    up, down = similarity.numerator, similarity.denominator

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(x: str, y: str) -> bool:
            both = np.concatenate(shingle_sets([x.encode(), y.encode()], k))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            return down * common >= up * (len(both) - common)

        for left, right in batches:
            yield pd.Series([one(x, y) for x, y in zip(left, right)], dtype=bool)
        give_back()

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    rows = stage_table(facts.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")),
                       "jaccard-wanted")
    maybe = may_have(rows, "row")
    texts = docs.filter(maybe(F.col("row"))).dropDuplicates(["row"])
    for end in "ab":
        pairs = pairs.join(rows.select(F.col("node").alias(end), F.col("row").alias(f"row_{end}")), end)
    for end in "ab":
        pairs = pairs.join(texts.select(F.col("row").alias(f"row_{end}"), F.col("text").alias(f"text_{end}")).hint("merge"),
                           f"row_{end}")
    return pairs.select("a", "b", linked("text_a", "text_b").alias("linked"))


def similarity_components(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5,
                          similarity: float | Fraction = Fraction(8, 10)) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles`` (size of its set) and ``component_id`` (the smallest id
    reachable by links)."""
    spark, begun = docs.sparkSession, len(CREATED)
    similarity = Fraction(similarity).limit_denominator(10_000)
    slack = (1 - similarity) / (1 + similarity)
    rate = (slack.numerator, slack.denominator)
    body = text_or_empty(col(docs, text))
    # a name for the text of a row: rows with equal texts may stand for each other
    named = docs.select(F.md5(body.cast("binary")).alias("row"), body.alias("text"))
    # sets per band, for the costs only: a word has some six bytes
    about = F.floor(F.log(F.greatest(F.octet_length(body) / 6, F.lit(1))) / math.log(BAND_RATIO)).cast("int")
    counts = {r["band"]: r["count"] for r in docs.groupBy(about.alias("band")).count().collect()}

    @F.pandas_udf("node long, size long, sketch binary, own array<long>, below array<long>")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        plans = Plans(counts, similarity)
        for texts in batches:
            yield described_frame(described_sets(texts.tolist(), k, similarity, plans),
                                  ["node", "size", "sketch", "own", "below"])
        give_back()

    facts = docs.select(col(docs, id).alias("id"), F.md5(body.cast("binary")).alias("row"), described(body).alias("f"))
    facts = stage_table(facts.select("id", "row", "f.*"), "jaccard-sets", TEXTS)
    sets = facts.filter("node is not null")
    blocks = stage_table(candidate_blocks(sets.select("node", "own", "below")), "jaccard-blocks")
    nodes = stage_table(sets.select("node", "size", "sketch").dropDuplicates(["node"]), "jaccard-nodes")
    facts = stage_table(facts.select("id", "row", "node", "size"), "jaccard-rows")
    drop_scratch(spark, begun, keep=3)  # the keys are done with: most of the disk
    labels = linked_nodes(named, facts, nodes, blocks, k, similarity, rate)

    member = stage_table(facts.join(labels, "node", "left").select(
        "id", "size", F.coalesce("label", "node").alias("label")), "jaccard-labels")
    full, _ = full_slots(member, "label")
    salts = F.when(slot_of("label").isin(full), F.lit(SALTS)).otherwise(F.lit(1)) if full else F.lit(1)
    least = member.filter("label is not null").groupBy("label").agg(F.min("id").alias("least"))
    # a row for each salt of a label with very many rows; Spark sizes it by the rows before: not to be broadcast
    salted = least.select("label", "least", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).hint("merge")
    dealt = member.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
    out = stage_table(dealt.join(salted, ["label", "salt"], "left").select(
        F.col("id").alias(id), F.col("size").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id")), "jaccard-result")
    drop_scratch(spark, begun)
    return out


def linked_nodes(docs: DataFrame, facts: DataFrame, nodes: DataFrame, blocks: DataFrame, k: int, similarity: Fraction,
                 rate: tuple[int, int]) -> DataFrame:
    """(node, label) of all nodes that link with another one."""
    spark = docs.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    refuted = spark.createDataFrame([], EDGES)
    labels = spark.createDataFrame([], "node long, label long")
    known = spark.createDataFrame([], "a long, b long, linked boolean")
    todo = blocks.withColumn("label", F.col("node"))
    for turn in itertools.count(1):
        none = F.lit(0).cast("long")  # no nulls: pandas would make floats of the 64-bit columns
        # sketches pack badly, and blocks well: not to be broadcast by the size of their files
        rows = todo.join(nodes.hint("merge"), "node").select(
            "block", F.lit(True).alias("member"), "node", "size", "sketch", "label", none.alias("a"), none.alias("b"))
        if turn > 1:
            rows = rows.union(refuted.select("block", F.lit(False), none, none, F.lit(b""), none, "a", "b"))
        last = turn > FORESTS
        edges = stage_table(
            rows.repartition("block").sortWithinPartitions("block", "node")
            .mapInPandas(tidy(lambda frames, last=last: edges_of_sorted(frames, rate, last)), EDGES), "jaccard-edges")
        pairs = edges.select("a", "b").distinct()
        fresh = pairs.join(known, ["a", "b"], "left_anti") if turn > 1 else pairs
        fresh = stage_table(fresh, "jaccard-pairs")
        judged = stage_table(verified(fresh, docs, facts, k, similarity), "jaccard-verified", TEXTS)
        if judged.count() != fresh.count():
            raise RuntimeError("a pair to verify has lost one of its texts")
        known = known.union(judged)
        links = links.union(judged.filter("linked").select("a", "b"))
        labels = components(links)
        bad = edges.join(known.filter("not linked"), ["a", "b"]).select("block", "a", "b")
        refuted = stage_table(refuted.union(bad), "jaccard-refuted")
        if last or bad.isEmpty():
            return labels
        open_blocks = bad.select("block").distinct()
        todo = (blocks.join(open_blocks, "block", "left_semi").join(labels, "node", "left")
                .withColumn("label", F.coalesce("label", "node")))
        refuted = refuted.join(open_blocks, "block", "left_semi")
