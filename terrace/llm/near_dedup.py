"""Near-duplicate documents by SetSketch registers, banding, joint estimates and an exact check.

A document is its set of 5-word shingles. Its sketch has 256 registers: each keeps the least of exponentially spaced
draws of the shingles, on a logarithmic scale of base 1.001. Sketches of unions are register-wise maxima, and equal
registers are about as frequent as shared shingles. Documents that agree on a band of registers are candidates;
similarity is estimated by maximum likelihood from the registers and the set sizes, and what may reach the threshold
is confirmed on the full sets.

No bucket is expanded into all its pairs beyond ``SMALL_BUCKET`` members. In larger buckets every member is compared
with the most central one. Those still apart from the bucket's main component are then compared with the others by
their registers, part by part, after an exact bound from the shingles that a document has alone among all documents of
large buckets; only pairs that may be links are built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import _GOLD, blocks, buffers, gram_hashes, gram_rows, mix, word_hashes, word_spans
from .components import connected
from .tables import aside, bitmap_filter, keep_keys, stage

_U = np.uint64
REGISTERS = 256
BAND = 3
#: A pair at the threshold shares no band with this probability at most, as far as the registers go (from 73 % on).
MISS = 2.1e-9
BASE = 1.001
SHINGLE = 5
#: Buckets up to this size are compared pair by pair.
SMALL_BUCKET = 24
#: Pairs estimated so many standard errors of 256 registers below the threshold are dropped.
MARGIN = 5.16
#: Members of a large bucket that one task compares with as many others at a time.
PART = 256
#: Members of one bucket that are dealt to one task where a bucket's row is joined to its members.
DEAL = 1024
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def band_count(percent: int) -> int:
    """How many bands a threshold takes: 21 at 85 %, 28 at 80 %. The first of the registers are banded; all of them serve estimates."""
    alone = 1 - (percent / 100) ** BAND
    return int(np.clip(np.ceil(np.log(MISS) / np.log(alone)), 1, REGISTERS // BAND)) if 0 < alone < 1 else 1 if alone <= 0 else REGISTERS // BAND


def least_estimate(percent: int) -> float:
    """The estimate below which no pair is confirmed."""
    share = percent / 100
    return share - MARGIN * float(np.sqrt(share * (1 - share) / REGISTERS))


def shingle_sets(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row (upper 12 bits) and 52-bit shingle hash of every distinct shingle, ascending; and the set size of each row.

    A row of fewer than 5 words, but not none, has its whole word sequence as its one shingle.
    """
    starts, ends, first = word_spans(data, cut)
    words = word_hashes(data, starts, ends)
    place, row = gram_rows(first, SHINGLE)
    keys = (row.astype(_U) << _U(52)) | (gram_hashes(words, SHINGLE)[place] >> _U(12)) if len(place) else np.zeros(0, _U)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    whole = [(_U(r) << _U(52)) | (gram_hashes(words[first[r] : first[r + 1]], int(counts[r]))[0] >> _U(12)) for r in short.tolist()]
    keys = np.sort(np.concatenate([keys, np.array(whole, _U)]))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    return keys, np.bincount((keys >> _U(52)).astype(np.int64), minlength=len(cut) - 1)


def registers(keys: np.ndarray, rows: int) -> np.ndarray:
    """(rows, 256) registers as uint16; rows without shingles have none and get zeros.

    A shingle's draws ascend: draw t lies in the t-th of 256 equally probable slices of the exponential distribution
    and goes to a register of its own, so a row is done once all registers hold a value.
    """
    least = np.full(rows * REGISTERS, _NONE)
    row = (keys >> _U(52)).astype(np.int64)
    seed = mix((keys & _U((1 << 52) - 1)) + _GOLD)
    for t in range(REGISTERS):
        if not len(row):
            break
        register = ((seed + _U(t) * ((seed >> _U(8)) | _U(1))) & _U(REGISTERS - 1)).astype(np.int64)
        draw = mix(seed + _U((t + 1) * int(_GOLD) & (1 << 64) - 1)) >> _U(8)
        np.minimum.at(least, row * REGISTERS + register, draw | (_U(t) << _U(56)))
        if t < REGISTERS - 1:
            open_row = (least.reshape(rows, REGISTERS) == _NONE).any(axis=1)
            more = open_row[row]
            row, seed = row[more], seed[more]
    share = (least.reshape(rows, REGISTERS).astype(np.float64) + 0.5) / 2.0**64
    value = np.floor(30000.0 - np.log(-np.log1p(-np.minimum(share, 1.0 - 2.0**-53))) / np.log(BASE))
    return np.clip(value, 0, 65535).astype(np.uint16)


def bands(values: np.ndarray, count: int) -> np.ndarray:
    """(rows, count) hashes of three registers each."""
    parts = values[:, : BAND * count].reshape(len(values), count, BAND).astype(_U)
    joined = parts[:, :, 0] | (parts[:, :, 1] << _U(16)) | (parts[:, :, 2] << _U(32)) | (np.arange(count, dtype=_U) << _U(48))[None, :]
    return mix(joined + _GOLD)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("regs", pa.binary()), ("bands", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, count: int) -> DataFrame:
    """(doc_id, n, s1, s2, regs, bands): set size, a 128-bit digest of the set, registers and ``count`` band hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch["text"])
            for i, j in blocks(off):
                keys, n = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                rows = j - i
                value = registers(keys, rows)
                edge = np.concatenate([[0], np.cumsum(n)])
                digest = []
                for salt in (1, 2):
                    sums = np.zeros(len(keys) + 1, _U)
                    np.cumsum(mix((keys & _U((1 << 52) - 1)) + _U(salt * int(_GOLD) * 3 & (1 << 64) - 1)), out=sums[1:])
                    digest.append((sums[edge[1:]] - sums[edge[:-1]]).view(np.int64))
                band = bands(value, count).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(i, rows).cast(pa.int64()), pa.array(n, pa.int64()), *(pa.array(d, pa.int64()) for d in digest),
                        pa.array([v.tobytes() for v in value], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * count, pa.int32()), pa.array(band.ravel(), pa.int64())),
                    ],
                    schema=_SKETCH,
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, regs binary, bands array<long>")


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each row of registers a with that of b, by maximum likelihood; na, nb: set sizes.

    With set sizes known, the counts of registers that are larger, smaller and equal are multinomial in the
    similarity j; the likelihood is compared over a grid of j.
    """
    up, down = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    share = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)
    j = np.minimum(np.linspace(0.0, 1.0, 101)[None, :], np.minimum(na / nb, nb / na)[:, None])
    p_up, p_down = share(u - v * j), share(v - u * j)
    likely = up * np.log(p_up) + down * np.log(p_down) + (REGISTERS - up - down) * np.log(np.clip(1 - p_up - p_down, 1e-9, 1))
    return j[np.arange(len(j)), likely.argmax(axis=1)]


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def estimate(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, similar): the pairs whose estimated similarity is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch[c].to_numpy().astype(float) for c in ("n_a", "n_b"))
            best = similarity(_registers_of(batch["regs_a"]), _registers_of(batch["regs_b"]), na, nb)
            keep = pa.array(best >= least)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep), pa.array(best[best >= least])], names=["a", "b", "similar"])

    return pairs.select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(run, "a long, b long, similar double")


def compare_parts(parts: DataFrame, percent: int, least: float) -> DataFrame:
    """(a, b): from rows (band, xs, ys) of bucket parts, the pairs of different components that may reach the threshold.

    Set sizes and own shingles must allow a link and the estimate must be ``least`` or more. A pair that shares
    several bands comes from the first of them alone. Parts are bounded, and no pair is built that fails.
    """

    count = band_count(percent)

    def unpack(items: pa.StructArray) -> list[np.ndarray]:
        return [*(items.field(k).to_numpy() for k in range(4)), _registers_of(items.field(4))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for band, xs, ys in zip(batch["band"].to_pylist(), batch["xs"], batch["ys"]):
                (idx, cx, nx, ox, rx), (idy, cy, ny, oy, ry) = unpack(xs.values), unpack(ys.values)
                top = np.minimum((nx - ox)[:, None], (ny - oy)[None, :])
                may = (cx[:, None] != cy[None, :]) & (100 * top >= percent * (nx[:, None] + ny[None, :] - top))
                for i in range(len(idx)):
                    k = np.flatnonzero(may[i])
                    k = k[(ry[k] == rx[i]).sum(axis=1) >= (least - 0.02) * REGISTERS]
                    if not len(k):
                        continue
                    shared = (ry[k, : BAND * count].reshape(-1, count, BAND) == rx[i, : BAND * count].reshape(count, BAND)).all(axis=2)
                    k = k[bands(rx[i : i + 1], count).view(np.int64)[0][shared.argmax(axis=1)] == band]
                    if len(k):
                        k = k[similarity(np.broadcast_to(rx[i], (len(k), REGISTERS)), ry[k], np.full(len(k), float(nx[i])), ny[k].astype(float)) >= least]
                        out_a.append(np.minimum(idx[i], idy[k]))
                        out_b.append(np.maximum(idx[i], idy[k]))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return parts.select("band", "xs", "ys").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""
    pairs = stage(pairs.select("a", "b"))
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    texts = stage(keep_keys(docs.select("doc_id", "text"), wanted, "doc_id"))  # a plain side, so that Spark can split a document of many pairs
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = buffers(batch["text_a"]), buffers(batch["text_b"])
            for i, j in blocks(oa + ob):
                ka, na = shingle_sets(da[oa[i] : oa[j]], oa[i : j + 1] - oa[i])
                kb, nb = shingle_sets(db[ob[i] : ob[j]], ob[i : j + 1] - ob[i])
                every = np.sort(np.concatenate([ka, kb]))
                shared = np.bincount((every[1:][every[1:] == every[:-1]] >> _U(52)).astype(np.int64), minlength=j - i)
                keep = pa.array(100 * shared >= percent * (na + nb - shared))
                yield pa.RecordBatch.from_arrays([batch["a"].slice(i, j - i).filter(keep), batch["b"].slice(i, j - i).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def own_shingles(docs: DataFrame) -> DataFrame:
    """(doc_id, own): for each document, how many of its shingles no other of these documents has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch["text"])
            ids = batch["doc_id"].to_numpy()
            for i, j in blocks(off):
                keys, n = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i:j], n)), pa.array((keys & _U((1 << 52) - 1)).astype(np.int64))], names=["doc_id", "shingle"])

    each = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingle long")
    once = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("doc_id")).filter("c = 1")
    return once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))


def _may_link(percent: int) -> Column:
    """True unless set sizes and unshared shingles (n_a, n_b, own_a, own_b) rule the threshold out."""
    top = F.least(F.col("n_a") - F.col("own_a"), F.col("n_b") - F.col("own_b"))
    return 100 * top >= percent * (F.col("n_a") + F.col("n_b") - top)


def _with(pairs: DataFrame, info: DataFrame, *names: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(info.select(F.col("doc_id").alias(side), *[F.col(n).alias(f"{n}_{side}") for n in names]), side)
    return pairs


def near_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Words are runs of characters other than ASCII white space, A-Z as a-z; a set has the distinct runs of 5 words, or
    the whole sequence of a shorter text. Documents of ``percent`` % Jaccard similarity are linked; component_id is
    the least doc_id that links reach, and kept marks that document. Null, empty and blank texts have no shingles and
    stand alone; a null id stays null, has no component and is kept; rows repeat as in the input, as one document each
    with the same id. Other columns are left out; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    sketched = stage(sketches(docs, band_count(percent)))
    classes = stage(
        sketched.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min("regs").alias("regs"), F.min("bands").alias("bands"))
    )
    links = _links(docs, classes, percent)
    found = connected(links).withColumnsRenamed({"id": "cid", "component": "component_id"})
    keys = [F.col(k).alias(f"c_{k}") for k in ("n", "s1", "s2")]
    own = classes.select(*keys, F.col("doc_id").alias("cid")).join(found, "cid", "left").withColumn("component_id", F.coalesce("component_id", "cid"))
    out = sketched.drop("regs", "bands").join(own, (F.col("n") == F.col("c_n")) & (F.col("s1") == F.col("c_s1")) & (F.col("s2") == F.col("c_s2")) & F.col("doc_id").isNotNull(), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes, enough to connect every component."""
    least = least_estimate(percent)
    entries = classes.select("doc_id", F.explode("bands").alias("band"))
    sizes = stage(entries.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = stage(entries.join(sizes, "band"))
    info = classes.select("doc_id", "n", "regs")

    groups = members.filter(F.col("size") <= SMALL_BUCKET).groupBy("band").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    pairs = groups.select(F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, 1, i), y -> named_struct('a', y, 'b', x))))")).alias("p")).select("p.*").distinct()
    pairs = pairs.filter("a < b")
    near = stage(estimate(_with(pairs, info, "n", "regs").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")), least))

    # large buckets: how much of each member is its own, and a star around the member with the least of it
    large = members.filter(F.col("size") > SMALL_BUCKET)
    hot = large.select("doc_id").distinct()
    own = own_shingles(keep_keys(docs, hot, "doc_id"))
    rated = hot.join(classes.select("doc_id", "n"), "doc_id").join(own, "doc_id", "left").fillna(0, ["own"]).filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    large = stage(large.join(rated, "doc_id").withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / DEAL))))
    centre = large.groupBy("band").agg(F.min_by("doc_id", F.struct(F.col("own") / F.col("n"), "doc_id")).alias("a"), F.first("size").alias("size"))
    star = large.join(_dealt(centre, DEAL, "deal").drop("size"), ["band", "deal"]).filter("a <> doc_id").select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct()
    rated = large.select("doc_id", "n", "own").distinct()
    star = estimate(_with(_with(star, rated, "n", "own").filter(_may_link(percent)).select("a", "b"), info, "n", "regs"), least)

    # first the best partner of each document, then whatever still joins two components
    best = near.groupBy("b").agg(F.max_by("a", F.struct("similar", -F.col("a"))).alias("a")).select("a", "b")
    first = stage(confirm(best.union(star.select("a", "b")).distinct(), docs, percent))
    joined = stage(connected(first))
    rest = _apart(near.select("a", "b").join(best, ["a", "b"], "left_anti"), joined)
    of = large.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    counted = of.groupBy("band", "component").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size"))
    main = counted.groupBy("band").agg(F.max_by("component", F.struct("c", -F.col("component"))).alias("main"), (F.sum("c") - F.max("c")).alias("others"), F.first("size").alias("size")).filter("others > 0")
    of = of.drop("size").join(_dealt(main, DEAL, "deal"), ["band", "deal"])
    # one row for each two parts that meet, dealt by both: a hot bucket is spread over as many tasks as it has such rows
    x, y = F.ceil(F.col("others") / PART), F.ceil(F.col("size") / PART)
    outside = _parts(of.filter("component <> main").withColumn("x", F.pmod(F.xxhash64("doc_id"), x)), info, "x", "xs", F.sequence(F.lit(0), y - 1).alias("y"))
    every = _parts(of.withColumn("y", F.pmod(F.xxhash64("doc_id"), y)), info, "y", "ys", F.sequence(F.lit(0), x - 1).alias("x"))
    meet = outside.withColumn("y", F.explode("y")).join(every.withColumn("x", F.explode("x")), ["band", "x", "y"])
    late = compare_parts(meet, percent, least)
    second = confirm(rest.union(late).distinct(), docs, percent)
    return first.union(second)


def _dealt(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Rows of buckets repeated for each ``most`` of their ``size`` members, numbered by ``name``."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / most) - 1)))


def _parts(members: DataFrame, info: DataFrame, part: str, name: str, others: Column) -> DataFrame:
    """(band, part, others, name): the members of each part of a bucket, and the parts that it meets."""
    rows = members.join(info.select("doc_id", "regs"), "doc_id")  # dealt by document, so that the grouping deals by band and part anew
    return rows.groupBy("band", part).agg(F.collect_list(F.struct("doc_id", "component", "n", "own", "regs")).alias(name), F.first(others).alias("y" if part == "x" else "x"))


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for side in ("a", "b"):
        pairs = pairs.join(joined.select(F.col("id").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return pairs.filter("ca <> cb").select("a", "b")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one row of each near-duplicate component, that of the least id; the columns stay as they are.

    Every row is a document of its own: of rows with equal ids and texts one stays, and one without an id stays only if
    its component has none with an id. Texts without words stay.
    """
    own, back = aside(docs, ("__row",))
    rows = stage(own.withColumn("__row", F.monotonically_increasing_id()))  # written, so that all reads see the same numbers
    found = stage(near_components(rows.select(F.col("__row").alias("doc_id"), "text"), percent).withColumnsRenamed({"doc_id": "__row"}))
    groups = found.join(found.filter("NOT kept").select("component_id").distinct(), "component_id", "left_semi").select("__row", "component_id")
    ids = keep_keys(rows.select("__row", "doc_id"), groups, "__row").join(groups, "__row")
    first = stage(ids.groupBy("component_id").agg(F.min_by("__row", F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("__row")))
    lost = stage(groups.select("__row").join(first, "__row", "left_anti"))
    out = bitmap_filter(rows, lost, "__row").join(lost, "__row", "left_anti").unionByName(bitmap_filter(rows, lost, "__row", inside=False))
    return out.drop("__row").withColumnsRenamed(back).select(*[F.col(f"`{c}`") for c in docs.columns])
