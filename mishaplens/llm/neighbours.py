"""The most similar vectors for every vector, through learned partitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from mishaplens.llm.router import Router, balanced_parts, neighbour_graph

#: Vectors of a part, on average; parts of the first level, at most, and of a part of it on the second.
PART_ROWS, MAX_PARTS, MAX_INNER = 2000, 1024, 64
#: Vectors of the sample the parts are learned from, per part and at most.
SAMPLE_PER_PART, MAX_SAMPLE = 160, 60_000
#: Rows of one side that a task compares at a time; parts with more are cut into cells.
CELL_ROWS = 20_000
#: Cells that one task compares, about.
CELLS_A_TASK = 4
#: Cosines that differ by less are equal.
TIE = np.float32(1e-6)


@dataclass
class Index:
    """What executors need to place a vector: the classifier, those inside its parts if there are two levels, how far below the best part a part is still searched, and the cells of each part."""

    router: Router | None
    margin: float
    base_cells: np.ndarray
    query_cells: np.ndarray
    inner: dict[int, Router] | None = None
    n_inner: int = 1

    def locate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, part, whether it is the row's own part) of all parts to search for unit vectors."""
        if self.router is None:
            return np.arange(len(x)), np.zeros(len(x), "int64"), np.ones(len(x), bool)
        odds = _log_shares(self.router.log_odds(x))
        row, part = np.nonzero(odds >= odds.max(1, keepdims=True) - self.margin)
        score = odds[row, part]
        if self.inner is not None:
            rows, parts, scores = [], [], []
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p)
                sub = self.inner.get(p)
                more = _log_shares(sub.log_odds(x[row[at]])) if sub else np.zeros((len(at), 1), "f4")
                i, j = np.nonzero(more >= more.max(1, keepdims=True) - self.margin)
                rows.append(row[at[i]]), parts.append(p * self.n_inner + j), scores.append(score[at[i]] + more[i, j])
            row, part, score = map(np.concatenate, (rows, parts, scores))
            best = np.full(len(x), -np.inf, "f4")
            np.maximum.at(best, row, score)
            keep = score >= best[row] - self.margin
            row, part, score = row[keep], part[keep], score[keep]
        order = np.lexsort((part, -score, row))
        row, part = row[order], part[order]
        return row, part.astype("int64"), np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)


def _log_shares(odds: np.ndarray) -> np.ndarray:
    z = odds - odds.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype("f4")


def usable_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """(entry_id, vec): vectors of ``dim`` finite numbers, not all zero, as bytes whose order is that of the vectors; once per entry, of differing ones the least."""

    def packed(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            lists = b.column(1)
            full = pc.and_(pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False), pc.is_valid(b.column(0)))
            b = b.filter(full)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("f4")
            top = np.abs(x).max(1, initial=0)  # NaN stays NaN
            good = np.isfinite(top) & (top > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in _ordered(x[good])], pa.binary())], names=["entry_id", "vec"])

    rows = vectors.select(F.col("entry_id").cast("bigint"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(packed, "entry_id bigint, vec binary")
    return rows.groupBy("entry_id").agg(F.min("vec").alias("vec"))


def _ordered(x: np.ndarray) -> np.ndarray:
    """Numbers as big-endian bits that sort as they do: the sign flipped, negative ones inverted."""
    bits = (x + np.float32(0)).view("u4")
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(">u4")


def _numbers(vecs, dim: int) -> np.ndarray:
    bits = np.frombuffer(b"".join(bytes(v) for v in vecs), ">u4").astype("u4").reshape(-1, dim)
    return np.where(bits >> 31, bits & np.uint32((1 << 31) - 1), ~bits).view("f4")


def _scaled(x: np.ndarray) -> list[bytes]:
    """Vectors as 16-bit integers, which moves a cosine by about 0.00001 and halves what is shuffled."""
    x = x.astype("f8")
    return [r.tobytes() for r in np.rint(x / np.abs(x).max(1, initial=0)[:, None] * 32767).astype("<i2")]


def _learned(x: np.ndarray, parts: int, seed: int, **how) -> Router:
    graph = neighbour_graph(x, 10)
    return Router.fit(x, graph, balanced_parts(graph, parts, seed), parts, seed=seed, **how)


def _unpacked(vecs, dim: int) -> np.ndarray:
    """Unit vectors of 16-bit integers."""
    return _unit(np.frombuffer(b"".join(bytes(v) for v in vecs), "<i2").reshape(-1, dim).astype("f4"))


def _units(vecs, dim: int) -> np.ndarray:
    x = _numbers(vecs, dim).astype("f8")
    return _unit(x / np.abs(x).max(1, initial=0)[:, None])


def _shortened(dim: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scaled(_numbers(b.column(1).to_pylist(), dim)), pa.binary())], names=["entry_id", "vec"])

    return run


def _sampled(vectors: DataFrame, dim: int, share: float, seed: int) -> DataFrame:
    return usable_vectors(vectors.filter(F.pmod(F.xxhash64("entry_id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))), dim)


def fit_index(vectors: DataFrame, dim: int, margin: float, seed: int = 0) -> Index:
    """Learn the parts from samples; their number follows the number of vectors.

    The sample's rows (by a hash of the id, MAX_SAMPLE at most) tell how many
    rows are usable, and give the
    neighbour graph, its balanced cut and the training rows. All vectors are
    later placed by the classifier. The first level has as many parts as
    MAX_SAMPLE gives SAMPLE_PER_PART rows each, and MAX_PARTS at most; where
    these would be too large, each is cut again in the same way, by a sample
    of its own on the executors; these classifiers are small and bounded in number. The shares
    of the parts in the samples only decide into how many cells the work on a
    part is cut.
    """
    rows = vectors.count()
    if not rows:
        return Index(None, margin, *[np.ones(1, "int64")] * 2)
    most = min(MAX_PARTS, MAX_SAMPLE // SAMPLE_PER_PART)  # each part of the first level has its full share of the sample
    share = min(1.0, min(MAX_SAMPLE, max(4000, SAMPLE_PER_PART * rows / (0.75 * PART_ROWS))) / rows)
    picked = _sampled(vectors, dim, share, seed).limit(2 * MAX_SAMPLE).mapInArrow(_shortened(dim), "entry_id bigint, vec binary").toPandas().sort_values("entry_id")
    n = max(1, round(len(picked) / share))  # usable entries, about
    parts = inner = 1
    while 2 * parts <= most and n / parts > 1.5 * PART_ROWS:
        parts *= 2
    while inner < MAX_INNER and n / (parts * inner) > 1.5 * PART_ROWS:
        inner *= 2
    if parts == 1:
        whole = np.full(1, max(1, -(-n // CELL_ROWS)), "int64")
        return Index(None, margin, whole, whole)
    whole = np.ones(1, "int64")
    x = _unpacked(picked["vec"], dim)
    index = Index(_learned(x, parts, seed), margin, whole, whole)
    if inner > 1:
        index.inner, index.n_inner = _inner_routers(vectors, dim, index, parts, inner, n, seed), inner
    row, part, own = index.locate(x)
    grown = n / len(x)
    up = lambda v: np.maximum(1, np.ceil(v * grown / CELL_ROWS)).astype("int64")
    index.base_cells = up(np.bincount(part[own], minlength=parts * inner))
    index.query_cells = up(np.bincount(part, minlength=parts * inner))
    return index


def _inner_routers(vectors: DataFrame, dim: int, index: Index, parts: int, inner: int, n: int, seed: int) -> dict[int, Router]:
    """A classifier inside each part, fitted where the part's sample is."""
    each = max(1000, SAMPLE_PER_PART * inner)
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def parted(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                row, part, own = shared.value.locate(_units(b.column(1).to_pylist(), dim))
                yield pa.RecordBatch.from_arrays([pa.array(part[own]), b.column(0), b.column(1)], names=["part", "entry_id", "vec"])

    def fit(pdf):
        import pickle

        import pandas as pd

        pdf = pdf.sort_values("entry_id").head(4 * each)  # a sample is a sample; all vectors are placed later
        part = int(pdf["part"].iloc[0])
        if len(pdf) < 4 * inner:
            return pd.DataFrame({"part": [], "weights": []})
        r = _learned(_units(pdf["vec"], dim), inner, seed + part, hidden=64)
        return pd.DataFrame({"part": [part], "weights": [pickle.dumps(r.weights)]})

    sample = _sampled(vectors, dim, parts * each / n, seed + 1).mapInArrow(parted, "part bigint, entry_id bigint, vec binary")
    import pickle

    found = sample.groupBy("part").applyInPandas(fit, "part bigint, weights binary").collect()  # at most MAX_PARTS small models
    return {r.part: Router(pickle.loads(bytes(r.weights))) for r in found}


def _placed(index: Index, dim: int, divisor: int = 1):
    """Copies of each vector for the cells it is kept in and looked for in: (cell, entry_id, owner, vec, kept, asked)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            numbers = _numbers(b.column(2).to_pylist(), dim)
            vec = pa.array(_scaled(numbers), pa.binary())
            row, part, own = index.locate(_unit(numbers / np.abs(numbers).max(1, initial=0)[:, None]))
            spread = (ids.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype("int64")
            nb, nq = index.base_cells[part], index.query_cells[part]
            i0, j0 = spread[row] % nb, spread[row] % nq
            at, i, j, keep, ask = [], [], [], [], []

            def add(sel, ii, jj, k, a):
                at.append(sel), i.append(ii), j.append(jj), keep.append(np.full(len(sel), k)), ask.append(np.full(len(sel), a))

            every = np.arange(len(row))
            mine = every[own]
            add(mine, i0[mine], j0[mine], True, True)
            for jj in range(int(nq.max())):  # kept rows meet the other queries of their part
                s = mine[(jj < nq[mine]) & (jj != j0[mine])]
                add(s, i0[s], np.full(len(s), jj), True, False)
            for ii in range(int(nb.max())):
                s = every[(ii < nb) & ~(own & (ii == i0))]
                add(s, np.full(len(s), ii), j0[s], False, True)
            at, i, j, keep, ask = map(np.concatenate, (at, i, j, keep, ask))
            ask &= ids[row[at]] % divisor == 0
            cell = (part[at].astype("int64") << 40) + (i << 20) + j
            take = pa.array(row[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), b.column(0).take(take), b.column(1).take(take), vec.take(take), pa.array(keep), pa.array(ask)],
                names=["cell", "entry_id", "owner", "vec", "kept", "asked"],
            )

    return run


def _compared(k: int, dim: int, least: float | None):
    """Best ``k`` of a cell for each row that asks, without itself and rows of the same owner."""

    def run(pdf):
        import pandas as pd

        x = _unpacked(pdf["vec"], dim)
        ids, owner = pdf["entry_id"].to_numpy("int64"), pdf["owner"].to_numpy("int64")
        kept, asked = np.flatnonzero(pdf["kept"].to_numpy()), np.flatnonzero(pdf["asked"].to_numpy())
        base, bids, bown = x[kept], ids[kept], owner[kept]
        found = []
        for lo in range(0, len(asked) if len(kept) else 0, 256):
            q = asked[lo : lo + 256]
            s = x[q] @ base.T
            if least is None:
                s[(ids[q][:, None] == bids) | ((owner[q][:, None] == bown) & (bown != 0))] = -2
                low = np.partition(s, max(0, s.shape[1] - k), 1)[:, max(0, s.shape[1] - k)]
                r, c = np.nonzero(s >= np.maximum(low - TIE, -1.5)[:, None])  # all that tie with the last
                v = s[r, c]
                ok = v > -1.5
            else:
                r, c = np.nonzero(s >= np.float32(least - 1e-4))
                v = s[r, c]
                ok = (ids[q][r] != bids[c]) & ((owner[q][r] != bown[c]) | (bown[c] == 0))
            r, c, v = r[ok], c[ok], np.round(v[ok].astype("f8"), 6)
            order = np.lexsort((bids[c], -v, r))
            r, c, v = r[order], c[order], v[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            best = place < k
            found.append((ids[q][r[best]], bids[c[best]], v[best]))
        a, b, v = (np.concatenate(p) for p in zip(*found)) if found else (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))
        return pd.DataFrame({"entry_id": a, "neighbour_id": b, "cosine": v})

    return run


def nearest_neighbours(vectors: DataFrame, owners: DataFrame, k: int = 5, dim: int = 64, margin: float = 2.0, min_cosine: float | None = None) -> DataFrame:
    """For every usable vector the up to ``k`` most similar ones of other owners: entry_id, neighbour_id, cosine, place.

    ``vectors`` has (entry_id, embedding), ``owners`` (entry_id, owner);
    repeated rows count once (of differing ones the least is taken). A vector
    is usable if it has ``dim`` finite numbers that are not all zero; others,
    and null ids, take part in nothing. An entry without an owner, or whose
    owner is null, is left out for no one. With ``min_cosine``, neighbours
    below it are not given. Ties go to the smaller id. No vectors give no rows.

    Method: parts are learned from a bounded sample (fit_index). Every vector
    is kept in its most probable part, and looked for in each part whose log
    probability is within ``margin`` of the best; there it is compared with
    all that is kept, and the best of all parts win. A larger margin finds
    more and costs in proportion; README has the recall.
    """
    return _searched(vectors, owners, k, dim, fit_index(vectors, dim, margin), min_cosine)


def exact_neighbours(vectors: DataFrame, owners: DataFrame, k: int = 5, dim: int = 64, every: int = 50) -> DataFrame:
    """As nearest_neighbours, for the entries whose id is divisible by ``every``, compared with all others block by block: what recall is measured against."""
    n = vectors.count()
    whole = np.full(1, max(1, -(-n // CELL_ROWS)), "int64")
    return _searched(vectors, owners, k, dim, Index(None, 0.0, whole, np.ones(1, "int64")), None, every)


def _searched(vectors: DataFrame, owners: DataFrame, k: int, dim: int, index: Index, min_cosine: float | None, every: int = 1) -> DataFrame:
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(index)
    who = owners.select(F.col("entry_id").cast("bigint").alias("entry_id"), "owner").dropna().groupBy("entry_id").agg(F.xxhash64(F.min("owner")).alias("owner"))
    rows = usable_vectors(vectors, dim).join(who, "entry_id", "left").select("entry_id", F.coalesce("owner", F.lit(0).cast("bigint")).alias("owner"), "vec")

    def place(batches):
        yield from _placed(shared.value, dim, every)(batches)

    copies = rows.mapInArrow(place, "cell bigint, entry_id bigint, owner bigint, vec binary, kept boolean, asked boolean")
    cells = int((index.base_cells * index.query_cells).sum())
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cells // CELLS_A_TASK)  # a task's share does not grow with the data
    found = copies.repartition(wide, "cell").groupBy("cell").applyInPandas(_compared(k, dim, min_cosine), "entry_id bigint, neighbour_id bigint, cosine double")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "neighbour_id"))), 1, k)
    merged = found.groupBy("entry_id").agg(best.alias("best")).select("entry_id", F.posexplode("best").alias("i", "n"))
    out = merged.select("entry_id", "n.neighbour_id", (-F.col("n.d")).alias("cosine"), (F.col("i") + 1).alias("place"))
    return out if min_cosine is None else out.filter(F.col("cosine") >= min_cosine)
