"""Time chunks of a bus by a budget of rows.

A chunk is a stretch of time on one bus; its frames are one task's work.  The grid is ``chunk_ns`` long.  Where a grid
cell holds more than ``chunk_rows`` events it is cut further: an event is a frame entering (at its time) or the last
moment it stands in one of the trailing windows (time plus window), since both reach the chunk's task.  The cuts
come from counts per fine slice, a running sum over the small table of counts, and finer slices again inside a slice that
alone exceeds the budget, down to one nanosecond.  Frames of one and the same nanosecond stay together.

Chunks are numbered ``cell * SUB + part``, ascending in time.  Where no cell exceeds the budget there is no table of
cuts and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busguard.params import DetectorParams
from busguard.session import stage_table

SUB = 1 << 20
FINER = 1024  # slices that a dense slice is cut into
BROADCAST_SLOTS = 2_000_000  # 64 MB of slots and cut times


def floor_div(x: Column, n: int) -> Column:
    return ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("bigint") if n > 1 else x


def spans(params: DetectorParams) -> tuple[int, int]:
    """Lengths of the two trailing windows that need chunks: bus and identifier counts, and payload repeats."""
    return params.traffic_window_ns, params.repeat_window_ns


def events(frames: DataFrame, params: DetectorParams) -> DataFrame:
    """A row (_bus, u) for every moment at which a frame enters, or is for the last time inside, a window."""
    at = F.array(F.col("t"), *(F.col("t") + F.lit(w) for w in spans(params)))
    return frames.select("_bus", F.explode(at).alias("u"))


def time_cuts(frames: DataFrame, params: DetectorParams) -> DataFrame | None:
    """_bus, _cell, cuts (ascending times inside the cell) of the cells that exceed the budget; None if none does."""
    half = max(1, params.chunk_rows // 2)
    length = params.chunk_ns
    moments = events(frames, params)
    dense = (moments.groupBy("_bus", floor_div(F.col("u"), length).alias("slice")).count()
             .filter(F.col("count") > params.chunk_rows).select("_bus", "slice").persist())
    found, held = None, [dense]
    while not dense.isEmpty():
        fine = max(1, length // FINER)
        inside = moments.withColumn("slice", floor_div(F.col("u"), length)).join(dense, ["_bus", "slice"], "left_semi")
        counts = inside.groupBy("_bus", "slice", floor_div(F.col("u"), fine).alias("fine")).count()
        before = Window.partitionBy("_bus", "slice").orderBy("fine")
        part = F.floor((F.sum("count").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")) / half)
        counts = counts.withColumn("part", part)
        opens = (F.col("part") > F.lag("part").over(before)) | (F.lag("count").over(before) > half) | (F.col("count") > half)
        counts = counts.withColumn("opens", F.coalesce(opens, F.col("count") > half)).persist()
        held.append(counts)
        cuts = counts.filter("opens").select("_bus", (F.col("fine") * fine).alias("cut"))
        found = cuts if found is None else found.unionByName(cuts)
        if fine == 1:
            break
        length = fine
        dense = counts.filter(F.col("count") > half).select("_bus", F.col("fine").alias("slice")).persist()
        held.append(dense)
    if found is not None:
        found = found.groupBy("_bus", floor_div(F.col("cut"), params.chunk_ns).alias("_cell")) \
            .agg(F.sort_array(F.collect_set("cut")).alias("cuts"))
        found = stage_table(found, "cuts")[0]  # small, and read in every plan that follows
    for df in held:
        df.unpersist()
    return found


def slotted(cuts: DataFrame, chunk_ns: int) -> DataFrame:
    """_bus, _cell, ``n`` (the number of cuts) and, for each slot of the cell, ``upto`` (how many cuts lie at or before its
    begin) and ``inside`` (the cuts after its begin): a frame finds its place in one step, whatever the number of cuts."""
    length = max(1, chunk_ns // FINER)
    begin = lambda s: F.col("_cell") * chunk_ns + s * length
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit((chunk_ns - 1) // length).cast("bigint"))
    upto = F.transform(slots, lambda s: F.size(F.filter("cuts", lambda c: c <= begin(s))))
    inside = F.transform(slots, lambda s: F.filter("cuts", lambda c: (c > begin(s)) & (c < begin(s + 1))))
    return cuts.select("_bus", "_cell", F.size("cuts").alias("n"), upto.alias("upto"), inside.alias("inside"))


def with_passed(df: DataFrame, ask: dict[str, tuple[Column, Column]], most: int) -> DataFrame:
    """For each name how many of the ascending times in an array (at most ``most``; null: none) lie at or before a moment.
    Halving steps, each a column over the one before, so a row's work grows with the logarithm of the number of times."""
    df = df.withColumns({n: F.lit(0) for n in ask})
    for step in (1 << i for i in reversed(range(int(most).bit_length()))):
        df = df.withColumns({n: F.col(n) + F.when(F.get(times, F.col(n) + (step - 1)) <= moment, step).otherwise(0)
                             for n, (times, moment) in ask.items()})
    return df


def with_chunk(df: DataFrame, params: DetectorParams, cuts: DataFrame | None) -> DataFrame:
    """``_chunk`` of every frame, ``_last1`` and ``_last3``: the chunks in which it is for the last time inside a window
    of the two lengths; with cuts also ``_parts``, the number of cuts of its cell."""
    if params.chunk_ns < params.halo_ns:
        raise ValueError(f"chunk_ns ({params.chunk_ns}) must be at least halo_ns ({params.halo_ns})")
    cell = floor_div(F.col("t"), params.chunk_ns)
    lasts = {f"_last{i}": F.col("t") + F.lit(w) for i, w in zip((1, 3), spans(params))}
    if cuts is None:
        return df.withColumns({"_chunk": cell * SUB} | {c: floor_div(u, params.chunk_ns) * SUB for c, u in lasts.items()})
    cuts = slotted(cuts, params.chunk_ns)
    widest = F.array_max(F.transform("inside", F.size))
    held = F.size("upto") + F.col("n")
    most, n_slots = cuts.agg(F.coalesce(F.max(widest), F.lit(0)), F.coalesce(F.sum(held), F.lit(0))).first()
    sized = F.broadcast if n_slots <= BROADCAST_SLOTS else (lambda x: x)
    entry = F.struct("n", "upto", "inside") if most else F.struct("n", "upto")
    here, following = cuts.select("_bus", "_cell", entry.alias("_cuts0")), \
        cuts.select("_bus", (F.col("_cell") - 1).alias("_cell"), entry.alias("_cuts1"))
    df = df.withColumn("_cell", cell)
    df = df.join(sized(here), ["_bus", "_cell"], "left").join(sized(following), ["_bus", "_cell"], "left")

    moments = {"_chunk": F.col("t")} | lasts
    at = {c: floor_div(u, params.chunk_ns) for c, u in moments.items()}
    slot = {c: floor_div(F.pmod(u, F.lit(params.chunk_ns)), max(1, params.chunk_ns // FINER)).cast("int")
            for c, u in moments.items()}

    def of_slot(field: str, c: str) -> Column:
        own, next_ = (F.get(F.col(x)[field], slot[c]) for x in ("_cuts0", "_cuts1"))
        return F.when(at[c] == F.col("_cell"), own).otherwise(next_)

    passed = {c: F.coalesce(of_slot("upto", c), F.lit(0)) for c in moments}
    if most:  # cuts inside a slot of the grid: its alone are searched
        df = df.withColumns({f"_of{c}": of_slot("inside", c) for c in moments})
        df = with_passed(df, {f"_n{c}": (F.col(f"_of{c}"), u) for c, u in moments.items()}, most)
        passed = {c: x + F.col(f"_n{c}") for c, x in passed.items()}
    return df.withColumns({c: at[c] * SUB + x for c, x in passed.items()}
                          | {"_parts": F.coalesce(F.col("_cuts0.n"), F.lit(0))}) \
        .drop("_cuts0", "_cuts1", "_cell", *(f"{x}{c}" for x in ("_of", "_n") for c in moments))


def between(last: str) -> Column:
    """The chunks strictly between ``_chunk`` and column ``last`` (needs ``_parts``), ascending."""
    own, end = F.col("_chunk"), F.col(last)
    step = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    cell, end_cell = F.shiftright(own, 20), F.shiftright(end, 20)
    same = step(own + 1, end - 1)
    across = F.concat(step(own + 1, cell * SUB + F.col("_parts")), step(end_cell * SUB, end - 1))
    return F.when(cell == end_cell, same).otherwise(across)
