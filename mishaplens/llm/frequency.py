"""Frequency of every distinct value and term."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mishaplens.operators.skew import HEAVY_SHARE, heavy_keys, split_join
from mishaplens.session import stage

#: Identifiers per block, as a power of two.
BLOCK_BITS = 12
# Fixed value: a term.
TERM = "[a-z0-9]+"


class _Blocks:
    """Count arrays by block of identifiers: occurrences and records."""

    def __init__(self) -> None:
        self.blocks: dict[int, tuple] = {}

    def add(self, ids, occurrences, records) -> None:
        """Counts of distinct identifiers in ascending order."""
        import numpy as np

        size = 1 << BLOCK_BITS
        which = ids >> BLOCK_BITS
        cuts = np.flatnonzero(np.diff(which)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(ids)]):
            if lo < hi:
                occ, rec = self.blocks.setdefault(int(which[lo]), (np.zeros(size, "int64"), np.zeros(size, "int64")))
                at = ids[lo:hi] & (size - 1)
                occ[at] += occurrences[lo:hi]
                rec[at] += records[lo:hi]

    def taken(self, above: int = 0):
        """What has been counted, without its zeros, as one batch if there are more than ``above`` blocks."""
        import numpy as np
        import pyarrow as pa

        if len(self.blocks) <= above:
            return
        found = [(b, np.flatnonzero((occ > 0) | (rec > 0)), occ, rec) for b, (occ, rec) in self.blocks.items()]
        self.blocks = {}
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, *_ in found], pa.int64()), pa.array([at.astype("int32") for _, at, _, _ in found], pa.list_(pa.int32())),
                pa.array([occ[at] for _, at, occ, _ in found], pa.list_(pa.int64())), pa.array([rec[at] for _, at, _, rec in found], pa.list_(pa.int64())),
            ],
            names=["block", "at", "occ", "rec"],
        )


#: Blocks a task holds before it hands them on: 64 MB of arrays.
_HELD = 1000


def _of_pairs(batches):
    """Count arrays of rows (id, n), one per record and identifier."""
    import numpy as np

    blocks = _Blocks()
    for b in batches:
        ids, at = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
        occ = np.zeros(len(ids), "int64")
        np.add.at(occ, at, b.column(1).to_numpy(zero_copy_only=False))
        blocks.add(ids, occ, np.bincount(at, minlength=len(ids)))
        yield from blocks.taken(_HELD)
    yield from blocks.taken()


def _of_records(batches):
    """Count arrays of rows (record, n, ids, times) in the order of records: a record's identifiers count once, also where it spans batches."""
    import numpy as np
    import pyarrow.compute as pc

    blocks = _Blocks()
    last, held = None, np.zeros(0, "int64")  # the record that may go on, and its identifiers so far

    def close():
        blocks.add(held, np.zeros(len(held), "int64"), np.ones(len(held), "int64"))

    for b in batches:
        if not b.num_rows:
            continue
        names, n, lists = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        record = np.r_[0, np.cumsum(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False))]
        every = lists.flatten().to_numpy(zero_copy_only=False)
        ids, at = np.unique(every, return_inverse=True)
        occ = np.zeros(len(ids), "int64")
        np.add.at(occ, at, np.repeat(n, sizes) * b.column(3).flatten().to_numpy(zero_copy_only=False))
        if names[0].as_py() != last:
            close()
            held = np.zeros(0, "int64")
        pairs = np.unique(np.repeat(record, sizes) * len(ids) + at)
        whole, which = pairs // max(1, len(ids)), pairs % max(1, len(ids))
        again = (whole == 0) & np.isin(ids[which], held)  # counted with the batch before, or when it closes
        if record[-1] > 0:
            close()
            held = ids[which[whole == record[-1]]]
            counted = (whole < record[-1]) & ~again
        else:
            held = np.union1d(held, ids[which])
            counted = np.zeros(len(pairs), bool)
        last = names[-1].as_py()
        blocks.add(ids, occ, np.bincount(which[counted], minlength=len(ids)))
        yield from blocks.taken(_HELD)
    close()
    yield from blocks.taken()


def _summed_arrays(batches):
    """Sum the arrays of each block; the rows of a block arrive together."""
    import numpy as np
    import pyarrow as pa

    size = 1 << BLOCK_BITS
    now, occ, rec = None, None, None

    def done():
        at = np.flatnonzero(rec)
        return pa.RecordBatch.from_arrays([pa.array((now << BLOCK_BITS) + at, pa.int64()), pa.array(occ[at]), pa.array(rec[at])], names=["id", "occurrences", "records"])

    for batch in batches:
        for b, at, o, r in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
            if b != now:
                if now is not None:
                    yield done()
                now, occ, rec = b, np.zeros(size, "int64"), np.zeros(size, "int64")
            at = at.values.to_numpy(zero_copy_only=False)
            occ[at] += o.values.to_numpy(zero_copy_only=False)
            rec[at] += r.values.to_numpy(zero_copy_only=False)
    if now is not None:
        yield done()


def token_frequencies(records: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Occurrences and records of every distinct value and of every term in the values.

    ``records`` has (field_label, record, value); rows with a null in any of
    them take part in nothing, other columns are ignored. Result:
    field_label, unit_label ('value' or 'term'), token, occurrences (each row,
    and each time a term stands in it), records (distinct), n_records (those
    of the field). Empty values and values without a term have no terms. No
    rows give no rows.

    Method: a global dictionary gives each distinct value and term an integer
    identifier. Values are cut into terms once, in the dictionary, not once a
    row. Encoded rows are brought together by record; each task adds a
    record's identifiers once, and all occurrences, to count arrays by block of identifiers, kept where
    they are not zero, and the arrays of a block are summed in one place. A
    record with a large share of the rows is spread by identifier instead.
    Values with a large share are encoded by a broadcast of their few
    entries, all others by a shuffled join.
    """
    inc = stage(records.select("field_label", "record", "value").dropna().groupBy("field_label", "record", "value").agg(F.count("*").alias("n")), "value_records")
    values = stage(inc.groupBy("field_label", "value").agg(F.count("*").alias("n")), "values")
    on = ["field_label", "value"]
    terms = stage(
        values.select(*on, F.explode(F.regexp_extract_all("value", F.lit(TERM), F.lit(0))).alias("term")).groupBy(*on, "term").agg(F.count("*").alias("times")),
        "value_terms",
    )
    tokens = values.select("field_label", F.lit("value").alias("unit_label"), F.col("value").alias("token")).unionByName(
        terms.select("field_label", F.lit("term").alias("unit_label"), F.col("term").alias("token")).distinct()
    )
    dictionary = stage(tokens.withColumn("id", F.monotonically_increasing_id()), "dictionary")
    value_ids = dictionary.filter("unit_label = 'value'").select("field_label", F.col("token").alias("value"), F.col("id").alias("value_id"))
    term_ids = dictionary.filter("unit_label = 'term'").select("field_label", F.col("token").alias("term"), F.col("id").alias("term_id"))
    per_term = terms.groupBy("field_label", "term").agg(F.count("*").alias("n"))
    coded_terms = split_join(terms, term_ids, ["field_label", "term"], heavy_keys(per_term, ["field_label", "term"], share=heavy_share))
    lists = coded_terms.groupBy(*on).agg(F.collect_list(F.struct(F.col("term_id").alias("id"), "times")).alias("terms"))
    own = F.array(F.struct(F.col("value_id").alias("id"), F.lit(1).cast("bigint").alias("times")))
    codes = stage(
        value_ids.join(lists, on, "left").select(*on, F.when(F.col("terms").isNull(), own).otherwise(F.concat(own, "terms")).alias("codes")),
        "value_codes",
    )
    encoded = split_join(inc, codes, on, heavy_keys(values, on, share=heavy_share))
    encoded = encoded.select("record", "n", F.transform("codes", lambda c: c["id"]).alias("ids"), F.transform("codes", lambda c: c["times"]).alias("times"))
    arrays = "block bigint, at array<int>, occ array<bigint>, rec array<bigint>"
    per_record = inc.groupBy("record").agg(F.count("*").alias("n"))
    hot = [r.record for r in heavy_keys(per_record, ["record"], share=heavy_share).collect()]  # at most 1 / heavy_share
    usual = encoded.filter(~F.col("record").isin(hot)) if hot else encoded
    partial = usual.repartition("record").sortWithinPartitions("record").mapInArrow(_of_records, arrays)
    if hot:  # a record with a large share of all rows is spread by identifier
        pairs = encoded.filter(F.col("record").isin(hot)).select("record", "n", F.explode(F.arrays_zip("ids", "times")).alias("c")).groupBy("record", "c.ids").agg(F.sum(F.col("n") * F.col("c.times")).alias("n"))
        partial = partial.unionByName(pairs.select("ids", "n").mapInArrow(_of_pairs, arrays))
    by_block = partial.repartition("block").sortWithinPartitions("block")
    counts = by_block.mapInArrow(_summed_arrays, "id bigint, occurrences bigint, records bigint")
    totals = inc.groupBy("field_label").agg(F.countDistinct("record").alias("n_records"))
    return (
        dictionary.join(counts, "id")
        .join(F.broadcast(totals), "field_label")
        .select("field_label", "unit_label", "token", "occurrences", "records", "n_records")
    )


def marked(frequencies: DataFrame, common_part: int = 10, rare_records: int = 2) -> DataFrame:
    """With ``mark``: 'common' in at least one record of ``common_part``, else 'rare' in at most ``rare_records``, else null."""
    common = common_part * F.col("records") >= F.col("n_records")
    return frequencies.withColumn("mark", F.when(common, "common").when(F.col("records") <= rare_records, "rare"))
