"""Sign codes of log-Gabor responses, and distances of codes and images under circular shifts.

An image is rows x columns in one row-major array; a code is packed bits, so what moves between tasks is an eighth of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloc.operators.retrieval import kept

SCALES, WAVELENGTH, GROWTH, SPREAD, FAINT = 4, 18.0, 1.6, 0.75, 1e-4
#: Codes of a block, and codes whose numbers of bits are compared at once.
CODES, COUNTED = 16, 512
#: Up to this share of all pairs is aligned pair by pair; more are aligned in blocks of codes.
PAIRWISE = 1 / 64


def responses(image: np.ndarray, scales: int = SCALES, wavelength: float = WAVELENGTH, growth: float = GROWTH, spread: float = SPREAD) -> np.ndarray:
    """Complex log-Gabor responses (..., scales, rows, columns) of each row's frequencies from 1 to half the columns; the inverse transform isn't scaled."""
    n = image.shape[-1]
    f = np.arange(1, n // 2 + 1) / n
    out = np.zeros((*image.shape[:-2], scales, *image.shape[-2:]), complex)
    spectrum = np.fft.fft(image, axis=-1)
    for s in range(scales):
        gain = np.zeros(n)
        gain[1 : n // 2 + 1] = np.exp(-(np.log(f * (wavelength * growth**s)) ** 2) / (2 * np.log(spread) ** 2))
        out[..., s, :, :] = np.fft.ifft(spectrum * gain, axis=-1) * n
    return out


def sign_code(image: np.ndarray, **options) -> tuple[np.ndarray, np.ndarray]:
    """Bits and mask, (2 * scales * rows, columns): signs of real parts by scale, then of imaginary parts; faint responses are masked."""
    r = responses(image, **options)
    shape = (*image.shape[:-2], -1, image.shape[-1])
    real, imag, faint = ((x.reshape(shape)) for x in (r.real > 0, r.imag > 0, np.abs(r) < FAINT))
    return np.concatenate([real, imag], -2), np.concatenate([faint, faint], -2)


def encode(images: DataFrame, rows: int, columns: int, **options) -> DataFrame:
    """frame_id, t, m: packed code and mask of each image (frame_id, v). Images of another size, or null, get null codes."""

    def run(batches):
        for b in batches:
            t, m = [], []
            for v in b.column(1).to_pylist():
                if v is None or len(v) != rows * columns or None in v:
                    t.append(None), m.append(None)
                    continue
                bits, mask = sign_code(np.array(v, float).reshape(rows, columns), **options)
                t.append(np.packbits(bits).tobytes()), m.append(np.packbits(mask).tobytes())
            yield pa.record_batch([b.column(0), pa.array(t, pa.binary()), pa.array(m, pa.binary())], names=["frame_id", "t", "m"])

    return images.select("frame_id", "v").mapInArrow(run, "frame_id long, t binary, m binary")


def encode_cells(cells: DataFrame, rows: int, columns: int, **options) -> DataFrame:
    """frame_id, t, m as encode, from long cells (frame_id, r, c, v) whose empty ones are 0; images grow dense in the task alone."""

    def run(batches):
        for b in batches:
            t, m = [], []
            for p in b.column(1):
                image = np.zeros(rows * columns)
                image[p.values.field("at").to_numpy()] = p.values.field("v").to_numpy()
                bits, mask = sign_code(image.reshape(rows, columns), **options)
                t.append(np.packbits(bits).tobytes()), m.append(np.packbits(mask).tobytes())
            yield pa.record_batch([b.column(0), pa.array(t, pa.binary()), pa.array(m, pa.binary())], names=["frame_id", "t", "m"])

    at = (F.col("r") * columns + F.col("c")).cast("long").alias("at")
    packed = cells.groupBy("frame_id").agg(F.collect_list(F.struct(at, F.col("v").cast("double").alias("v"))).alias("p"))
    return packed.mapInArrow(run, "frame_id long, t binary, m binary")


def phases(image: np.ndarray) -> np.ndarray:
    """Unit phases of each row's frequencies (..., frequencies, rows), 0 where a response is faint."""
    f = np.fft.rfft(image.astype(np.float32), axis=-1)
    size = np.abs(f)
    seen = size > 1e-3
    return np.ascontiguousarray(np.moveaxis(np.where(seen, f / np.where(seen, size, 1), 0).astype(np.complex64), -1, -2))


def spectral_shifts(a: np.ndarray, b: np.ndarray, columns: int) -> np.ndarray:
    """Of each image in a with each in b (phases), the columns that b's turns right by to lie on a's: peak of the rows' summed phase correlation. The rows are summed by one product of matrices a frequency, before the inverse transform."""
    summed = np.matmul(a.swapaxes(0, 1), np.conj(b).transpose(1, 2, 0))
    return np.argmax(np.round(np.fft.irfft(summed.transpose(1, 2, 0), columns), 4), -1)


def spectral_shift(a: np.ndarray, b: np.ndarray) -> int:
    """spectral_shifts of two images."""
    return int(spectral_shifts(phases(a)[None], phases(b)[None], a.shape[-1])[0, 0])


def hamming(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shifts) -> tuple[float, int]:
    """Smallest share of unlike bits among those that neither mask hides, and its shift of a; first wins. Shifts that hide all don't count: NaN if none is left."""
    best = (float("nan"), 0)
    for s in shifts:
        hidden = np.roll(a[1], s, -1) | b[1]
        seen = hidden.size - np.count_nonzero(hidden)
        if seen:
            d = round(np.count_nonzero((np.roll(a[0], s, -1) ^ b[0]) & ~hidden) / seen, 9)
            if not d >= best[0]:
                best = (d, s)
    return best


def by_column(bits: np.ndarray) -> np.ndarray:
    """The bits (rows, columns) of each column as bytes, so that turning a code moves whole rows."""
    return np.packbits(np.ascontiguousarray(bits.T), axis=1)


def hamming_by_column(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shifts, size: int) -> tuple[float, int]:
    """hamming of codes of `size` bits as by_column has them."""
    best = (float("nan"), 0)
    for s in shifts:
        hidden = np.roll(a[1], s, 0) | b[1]
        seen = size - int(np.bitwise_count(hidden).sum(dtype=np.int64))
        if seen:
            d = round(int(np.bitwise_count((np.roll(a[0], s, 0) ^ b[0]) & ~hidden).sum(dtype=np.int64)) / seen, 9)
            if not d >= best[0]:
                best = (d, s)
    return best


def least_l1(a: np.ndarray, b: np.ndarray, shifts) -> tuple[float, int]:
    """Smallest summed difference of a turned right by a shift and b; first wins."""
    return min((round(float(np.abs(np.roll(a, s, -1) - b).sum()), 9), i, s) for i, s in enumerate(shifts))[::2]


def compare_codes(pairs: DataFrame, codes: DataFrame, rows: int, columns: int, around: int = 2, opposite: str = "as_is", shift: str = "none") -> DataFrame:
    """q, c, dist, shift for pairs (q, c): Hamming distance of packed codes (frame_id, t, m) for `around` columns about a start.

    The start is 0, or with shift "spectral" the codes' phase correlation; "opposite" adds half a turn to it, and
    "both" takes the better of the two.
    """
    return compare_joined(_both(pairs.select("q", "c"), codes, ("t", "m")), rows, columns, around, opposite, shift)


def compare_joined(wide: DataFrame, rows: int, columns: int, around: int = 2, opposite: str = "as_is", shift: str = "none") -> DataFrame:
    """As compare_codes, for rows that hold both codes: q, c, ta, ma, tb, mb."""
    half = {"as_is": [0], "opposite": [columns // 2], "both": [0, columns // 2]}[opposite]

    def read(t, m):
        t, m = (np.unpackbits(np.frombuffer(x, np.uint8), count=rows * columns).reshape(rows, columns).astype(bool) for x in (t, m))
        return (by_column(t), by_column(m)), phases(t & ~m) if shift == "spectral" else None

    def run(batches):
        last = None, None  # pairs of one query often follow one another
        for b in batches:
            got = []
            for i in range(b.num_rows):  # one by one, as a code is many bytes
                ta, ma, tb, mb = (b.column(c)[i].as_py() for c in ("ta", "ma", "tb", "mb"))
                if None in (ta, ma, tb, mb):
                    got.append((None, None))
                    continue
                if last[0] != (ta, ma):
                    last = (ta, ma), read(ta, ma)
                (one, p), (other, r) = last[1], read(tb, mb)
                # b's turn onto a is a's turn onto b backwards.
                s0 = int(-spectral_shifts(p[None], r[None], columns)[0, 0]) % columns if shift == "spectral" else 0
                tried = [hamming_by_column(one, other, [s0 + h + k for k in range(-around, around + 1)], rows * columns) for h in half]
                got.append(min(tried, key=lambda t: (t[0] != t[0], t[0])))
            yield pa.record_batch([b.column("q"), b.column("c"), pa.array([d for d, _ in got], pa.float64()), pa.array([s for _, s in got], pa.int32())], names=["q", "c", "dist", "shift"])

    return wide.select("q", "c", "ta", "ma", "tb", "mb").mapInArrow(run, "q long, c long, dist double, shift int")


def least_unlike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """What the distances of codes in a and in b (by row, unmasked set bits and masked ones) are at least, whatever the shift: turns leave the numbers of a row as they are, and masks hide no more bits than they hold."""
    (own, hid), (other, over) = ((x[:, None].astype(np.int64), y[:, None].astype(np.int64)) for x, y in (a, b))
    other, over = other.swapaxes(0, 1), over.swapaxes(0, 1)
    unlike = np.maximum(np.maximum(own - other - over, other - own - hid), 0).sum(2)
    return unlike / np.maximum(size - np.maximum(hid, over).sum(2), 1)


def least_of(own: np.ndarray, hid: np.ndarray, other: np.ndarray, over: np.ndarray, size: int) -> np.ndarray:
    """least_unlike of codes that lie row by row beside one another, or of one code (one row) with all others."""
    unlike = np.maximum(np.maximum(own - other - over, other - own - hid), 0).sum(-1, dtype=np.int64)
    return unlike / np.maximum(size - np.maximum(hid, over).sum(-1, dtype=np.int64), 1)


def counted(coded: DataFrame, rows: int, columns: int) -> DataFrame:
    """frame_id, own, hid: how many bits of each row of a code (frame_id, t, m) are set and unmasked, and how many are masked, as little-endian 32-bit numbers."""

    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                t, m = (np.unpackbits(np.frombuffer(b.column(c)[i].as_py(), np.uint8), count=rows * columns).reshape(rows, columns).astype(bool) for c in (1, 2))
                out.append(tuple(x.sum(1).astype("<i4").tobytes() for x in (t & ~m, m)))
            yield pa.record_batch([b.column(0), *(pa.array([x[k] for x in out], pa.binary()) for k in (0, 1))], names=["frame_id", "own", "hid"])

    known = coded.dropna(subset=["frame_id", "t", "m"]).select(F.col("frame_id").cast("long").alias("frame_id"), "t", "m")
    return known.mapInArrow(run, "frame_id long, own binary, hid binary")


def _counts(x: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(x, "<i4").reshape(-1, rows)


def least_of_pairs(pairs: DataFrame, counts: DataFrame, rows: int, columns: int) -> DataFrame:
    """q, c, least of pairs (q, c): what their codes (counts: `counted`) differ by at least; pairs without codes are left out."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, COUNTED):
                part = b.slice(at, COUNTED)
                sides = (_counts(b"".join(part.column(x).to_pylist()), rows) for x in ("owna", "hida", "ownb", "hidb"))
                yield pa.record_batch([part.column("q"), part.column("c"), pa.array(least_of(*sides, rows * columns))], names=["q", "c", "least"])

    return _both(pairs.select("q", "c"), counts, ("own", "hid")).select("q", "c", "owna", "hida", "ownb", "hidb").mapInArrow(run, "q long, c long, least double")


def nearest_of_pairs(pairs: DataFrame, coded: DataFrame, rows: int, columns: int, n: int, **options) -> DataFrame:
    """As compare_codes, but only the n nearest of each query are sure to be among the rows: pairs whose numbers of bits tell that they differ by more than the query's n-th best aren't aligned."""
    bounded = kept(least_of_pairs(pairs, kept(counted(coded, rows, columns)), rows, columns))
    order = F.row_number().over(Window.partitionBy("q").orderBy("least", "c"))
    ranked = kept(bounded.withColumn("rk", order))
    first = kept(compare_codes(ranked.filter(F.col("rk") <= n), coded, rows, columns, **options))
    rest = ranked.filter(F.col("rk") > n).join(_nth_best(first, n), "q", "left").filter("most is null or least <= most + 1e-9")
    return first.unionByName(compare_codes(rest, coded, rows, columns, **options))


def _nth_best(scored: DataFrame, n: int) -> DataFrame:
    """q, most: the n-th smallest distance, of queries that have so many."""
    known = scored.filter("dist is not null and not isnan(dist)")
    ranked = known.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy("dist")))
    return ranked.filter(F.col("rk") == n).select("q", F.col("dist").alias("most"))


def nearest_codes(queries: DataFrame, entries: DataFrame, rows: int, columns: int, n: int, parts: int, around: int = 2) -> DataFrame:
    """q, c, dist, shift as compare_all with n, of which only the n nearest of each query are sure to be among the rows.

    Numbers of bits, some kilobytes a code, meet in blocks first: the n entries that a query may be nearest to by them are
    aligned, and then those that may be as near as the n-th of these. Where they rule out too little for that, codes
    meet in blocks.
    """
    qs, cs = (kept(counted(x, rows, columns)) for x in (queries, entries))
    size, all_pairs = rows * columns, qs.count() * cs.count()

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, COUNTED):
                part = b.slice(at, COUNTED)
                most = part.column("most").to_numpy(zero_copy_only=False) if "most" in b.schema.names else np.zeros(0)
                yield pa.record_batch([pa.array([x], pa.binary()) for x in (part.column("frame_id").to_numpy().astype("<i8").tobytes(), *(b"".join(part.column(x).to_pylist()) for x in ("own", "hid")), most.astype("<f8").tobytes())], names=["ids", "own", "hid", "most"])

    def blocks(counts):
        return counts.mapInArrow(pack, "ids binary, own binary, hid binary, most binary").repartition(parts, "ids")

    def met(counts, told):
        """q, c, least of what `told` picks for each query of a block from the bounds of a block of entries."""

        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    qi, qo, qh, most, ci, co, ch = (b.column(k)[i].as_py() for k in range(7))
                    qi, ci, most = np.frombuffer(qi, "<i8"), np.frombuffer(ci, "<i8"), np.frombuffer(most, "<f8")
                    qo, qh, co, ch = (_counts(x, rows) for x in (qo, qh, co, ch))
                    group = -(-rows // 64)
                    at = np.arange(0, rows, group)
                    coarse = [np.add.reduceat(x, at, axis=1) for x in (qo, qh, co, ch)]
                    q, c, d = [], [], []
                    for j in range(len(qi)):
                        bound = least_of(coarse[0][j], coarse[1][j], coarse[2], coarse[3], size)  # sums of rows differ by no more than the rows
                        own = told(bound, most[j] if len(most) else None)
                        least = least_of(qo[j], qh[j], co[own], ch[own], size)
                        if len(most):
                            own, least = own[least <= most[j] + 1e-9], least[least <= most[j] + 1e-9]
                        q.append(np.full(len(own), qi[j])), c.append(ci[own]), d.append(least)
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in (q, c, d)], names=["q", "c", "least"])

        wide = blocks(counts).toDF("qi", "qo", "qh", "most").crossJoin(blocks(cs).toDF("ci", "co", "ch", "_").drop("_"))
        return wide.mapInArrow(run, "q long, c long, least double")

    def align(pairs):
        asked, searched = (x.dropna(subset=["frame_id", "t", "m"]) for x in (queries, entries))
        wide = pairs.select("q", "c")
        for side, mark, coded in (("c", "b", searched), ("q", "a", asked)):
            wide = wide.join(coded.select(F.col("frame_id").cast("long").alias(side), F.col("t").alias(f"t{mark}"), F.col("m").alias(f"m{mark}")), side)
        return compare_joined(wide, rows, columns, around, shift="spectral")

    few = met(qs, lambda bound, _: np.argpartition(bound, n - 1)[:n] if n < len(bound) else np.arange(len(bound)))
    few = kept(few.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy("least", "c"))).filter(F.col("rk") <= n))
    first = kept(align(few))
    asked = qs.join(_nth_best(first, n), qs.frame_id == F.col("q"), "left").select("frame_id", "own", "hid", F.coalesce("most", F.lit(float("inf"))).alias("most"))
    near = met(asked, lambda bound, most: np.nonzero(bound <= most + 1e-9)[0])
    rest = kept(near.join(few.select("q", "c"), ["q", "c"], "left_anti"))
    if rest.count() > max(PAIRWISE * all_pairs, COUNTED):
        return compare_all(queries, entries, rows, columns, parts, around, n)
    return first.unionByName(align(rest))


def compare_all(queries: DataFrame, entries: DataFrame, rows: int, columns: int, parts: int, around: int = 2, n: int | None = None, compared=None) -> DataFrame:
    """q, c, dist, shift as compare_codes with shift "spectral", of each query's code with each entry's (frame_id, t, m); null codes have no distance.

    With n, only the n nearest entries of each query are sure to be among them: a query goes through a block's codes in
    the order of what their distances are at least, and stops when that is over its n-th best so far in the task. The
    accumulator `compared`, if given, counts the pairs that were compared.

    Codes travel in blocks of CODES, over `parts` tasks, and a block's phases are computed once for all codes of the other side's block.
    """

    def pack(batches):
        held = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                held.append(row)
                if len(held) == CODES:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    def block(held):
        ids, t, m = zip(*held, strict=True)
        return pa.record_batch([pa.array([np.array(ids, "<i8").tobytes()]), pa.array([b"".join(t)]), pa.array([b"".join(m)])], names=["ids", "t", "m"])

    def blocks(coded):
        known = coded.dropna(subset=["frame_id", "t", "m"]).select(F.col("frame_id").cast("long"), "t", "m")
        return known.mapInArrow(pack, "ids binary, t binary, m binary").repartition(parts, "ids")

    def read(ids, t, m):
        ids = np.frombuffer(ids, "<i8")
        t, m = (np.unpackbits(np.frombuffer(x, np.uint8).reshape(len(ids), -1), axis=1, count=rows * columns).reshape(-1, rows, columns).astype(bool) for x in (t, m))
        return ids, t, m, phases(t & ~m), ((t & ~m).sum(2), m.sum(2))

    def sought(sides, best):
        (qi, qt, qm, qp, qn), (ci, ct, cm, cp, cn) = sides
        least, out = least_unlike(qn, cn, rows * columns), []
        for i in range(len(qi)):
            found = best.setdefault(i, [])
            for j in np.argsort(least[i], kind="stable").tolist():
                if len(found) == n and least[i, j] > found[-1] + 1e-9:  # distances are rounded
                    break
                start = int(-spectral_shifts(qp[i : i + 1], cp[j : j + 1], columns)[0, 0] % columns)
                d, s = hamming((qt[i], qm[i]), (ct[j], cm[j]), [start + k for k in range(-around, around + 1)])
                out.append((int(qi[i]), int(ci[j]), d, s))
                if d == d:
                    found.append(d)
                    found.sort()
                    del found[n:]
        if compared is not None:
            compared.add(len(out))
        return pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int32()))], names=["q", "c", "dist", "shift"])

    def run(batches):
        last, best = {}, {}
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                sides = []
                for side, parts in (("q", row[:3]), ("c", row[3:])):
                    if last.get(side, (None,))[0] != parts:
                        last[side] = parts, read(*parts)
                        if side == "q":
                            best = {}
                    sides.append(last[side][1])
                (qi, qt, qm, qp, qn), (ci, ct, cm, cp, cn) = sides
                if n is not None:
                    yield sought(sides, best)
                    continue
                start = -spectral_shifts(qp, cp, columns) % columns  # c's turn onto q is q's turn onto c backwards
                got = [hamming((qt[i], qm[i]), (ct[j], cm[j]), [int(start[i, j]) + k for k in range(-around, around + 1)]) for i in range(len(qi)) for j in range(len(ci))]
                yield pa.record_batch([pa.array(np.repeat(qi, len(ci))), pa.array(np.tile(ci, len(qi))), pa.array([d for d, _ in got], pa.float64()), pa.array([s for _, s in got], pa.int32())], names=["q", "c", "dist", "shift"])

    asked = blocks(queries).toDF("qi", "qt", "qm")
    return asked.crossJoin(blocks(entries)).mapInArrow(run, "q long, c long, dist double, shift int")


def compare_images(pairs: DataFrame, images: DataFrame, rows: int, columns: int, shifts: int) -> DataFrame:
    """q, c, dist, shift for pairs (q, c): L1 distance of images (frame_id, v) under the first `shifts` shifts."""

    def run(batches):
        for b in batches:
            a, m = (b.column(x).flatten().to_numpy(zero_copy_only=False).reshape(-1, rows, columns) for x in ("va", "vb"))
            got = [least_l1(x, y, range(shifts)) for x, y in zip(a, m, strict=True)]
            yield pa.record_batch([b.column("q"), b.column("c"), pa.array([d for d, _ in got], pa.float64()), pa.array([s for _, s in got], pa.int32())], names=["q", "c", "dist", "shift"])

    whole = images.filter(F.size("v") == rows * columns).select("frame_id", F.col("v").cast("array<double>").alias("v"))
    return _both(pairs.select("q", "c"), whole, ("v",)).mapInArrow(run, "q long, c long, dist double, shift int")


def _both(pairs: DataFrame, by_frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Pairs with the columns of q's frame (suffix a) and of c's (suffix b)."""
    for side, mark in (("q", "a"), ("c", "b")):
        pairs = pairs.join(by_frame.select(F.col("frame_id").alias(side), *(F.col(x).alias(x + mark) for x in columns)), side)
    return pairs
