"""Ordered patterns that many sequences share, gaps allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mishaplens.operators.groups import positioned
from mishaplens.operators.skew import heavy_keys, split_join
from mishaplens.session import stage

#: Sequences with more steps than this are reduced before they are collected, so many steps at a time.
LONG = 1000
#: Up to so many frequent items or patterns are broadcast. Beyond, items are joined by a shuffle and patterns do not prune; the result is the same.
MAX_FREQUENT = 2_000_000
#: Distinct sequences in one tree, and their steps.
TREE, TREE_STEPS = 200_000, 2_000_000


class CodedTree:
    """A prefix tree of weighted sequences with ancestor codes.

    Nodes are numbered in preorder; the last number below a node makes, with
    its own, the code that tells ancestors from others: x is above y if
    x < y <= last[x]. ``same[x]`` is the nearest node above x with the same
    label (-1: none), so the first occurrences of a label below a node need
    no walk. The tree is built once; mining only selects ranges in it.
    """

    def __init__(self, sequences: list, weights) -> None:
        """``sequences`` in lexical order, so that shared prefixes are adjacent."""
        import numpy as np

        label, count, last, same = [], [], [], []
        path: list[int] = []
        on_path: dict[int, list[int]] = {}
        prior: tuple = ()
        for s, w in zip(sequences, weights):
            k, most = 0, min(len(s), len(prior))
            while k < most and s[k] == prior[k]:
                k += 1
            while len(path) > k:
                node = path.pop()
                last[node] = len(label) - 1
                on_path[label[node]].pop()
            for node in path:
                count[node] += w
            for x in s[k:]:
                node = len(label)
                above = on_path.setdefault(x, [])
                label.append(x)
                count.append(w)
                last.append(node)
                same.append(above[-1] if above else -1)
                above.append(node)
                path.append(node)
            prior = s
        for node in path:
            last[node] = len(label) - 1
        self.label, self.last, self.same = (np.array(v, "int64") for v in (label, last, same))
        self.count = np.array(count, "int64")

    def mine(self, steps: int, allowed=None):
        """Yield (pattern, support) for all patterns of ``steps`` labels.

        ``allowed``: the frequent patterns of one step less, as a set; a
        pattern is only extended to, or yielded, if all its parts of that
        length are in it.
        """
        import numpy as np

        order = np.argsort(self.label, kind="stable")
        first = order[self.same[order] < 0]  # header links, first occurrences only
        labels = self.label[first]
        cuts = np.flatnonzero(np.diff(labels)) + 1
        for roots in np.split(first, cuts) if len(first) else []:
            yield from self._below((int(self.label[roots[0]]),), np.sort(roots), steps, allowed, np)

    def _below(self, pattern, roots, steps, allowed, np):
        if len(pattern) == steps:
            yield pattern, int(self.count[roots].sum())
            return
        sizes = self.last[roots] - roots
        total = int(sizes.sum())
        if not total:
            return
        above = np.repeat(roots, sizes)
        start = np.repeat(roots + 1 - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        nodes = start + np.arange(total)
        nodes = nodes[self.same[nodes] <= above]
        labels = self.label[nodes]
        if len(pattern) + 1 == steps:
            found, at = np.unique(labels, return_inverse=True)
            support = np.bincount(at, self.count[nodes])
            for x, n in zip(found.tolist(), support.tolist()):
                p = (*pattern, x)
                if allowed is None or all(p[:i] + p[i + 1 :] in allowed for i in range(steps)):
                    yield p, int(n)
            return
        order = np.argsort(labels, kind="stable")
        nodes, labels = nodes[order], labels[order]
        for part in np.split(nodes, np.flatnonzero(np.diff(labels)) + 1) if len(nodes) else []:
            p = (*pattern, int(self.label[part[0]]))
            if allowed is None or len(p) != steps - 1 or p in allowed:
                yield from self._below(p, part, steps, allowed, np)


def _mined(sequences: DataFrame, steps: int, allowed: set | None) -> DataFrame:
    """Support of every pattern of ``steps`` codes; ``sequences`` has distinct (codes, weight) in ranges of lexical order."""
    known = sequences.sparkSession.sparkContext.broadcast(allowed)

    def trees(batches):
        import pyarrow as pa

        held, weights, n_steps = [], [], 0

        def flush():
            tree = CodedTree(held, weights)
            patterns, support = [], []
            for p, n in tree.mine(steps, known.value):
                patterns.append(p)
                support.append(n)
                if len(patterns) == 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.list_(pa.int64())), pa.array(support, pa.int64())], names=["pattern", "support"])
                    patterns, support = [], []
            if patterns:
                yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.list_(pa.int64())), pa.array(support, pa.int64())], names=["pattern", "support"])

        for b in batches:
            for codes, weight in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append(codes)
                weights.append(weight)
                n_steps += len(codes)
                if len(held) >= TREE or n_steps >= TREE_STEPS:
                    yield from flush()
                    held, weights, n_steps = [], [], 0
        if held:
            yield from flush()

    return sequences.mapInArrow(trees, "pattern array<bigint>, support bigint").groupBy("pattern").agg(F.sum("support").alias("support"))


def reduced_word(word, steps: int):
    """Which places of ``word`` to keep so that it has the same patterns of up to ``steps`` labels.

    A place is reached by x steps from the left (each to the next place of
    some label) and y from the right; where x + y exceeds steps + 1, every
    pattern through it has another way (Simon's congruence). What is left is
    bounded by the number of labels and steps, not by the length.
    """
    n, top = len(word), steps + 1

    def reach(order, skip, limit):
        """Fewest steps to each place in this direction, ``top`` at most; places beyond ``limit`` are dropped on the way."""
        out, at_label, latest = [top] * n, {}, [-1] * (top + 1)
        for seen, i in enumerate(order):
            if skip[i]:
                continue
            prior = at_label.get(word[i], -1)
            x = 1 if prior < 0 else 1 + next((v for v in range(1, top) if latest[v] >= prior), top - 1)
            if limit is not None and limit[i] + x > top:
                skip[i] = True
                continue
            out[i] = min(x, top)
            at_label[word[i]] = latest[out[i]] = seen
        return out

    dropped = [False] * n
    left = reach(range(n), dropped, None)
    reach(range(n - 1, -1, -1), dropped, left)
    return [not d for d in dropped]


def _reduced(coded: DataFrame, steps: int) -> DataFrame:
    """Long sequences without steps that no pattern can tell apart: (sequence, at, code).

    A sequence is cut into blocks of LONG steps, each reduced on its own, and
    what is left is cut and reduced again until a round takes away less than a
    tenth. Reducing a block keeps its patterns, so the whole keeps its own.
    """

    def kept(pdf):
        pdf = pdf.sort_values("position")
        return pdf.loc[reduced_word(pdf["code"].tolist(), steps), ["sequence", "p1", "p2", "code"]]

    rows = coded.select("sequence", F.col("at.place_1").alias("p1"), F.col("at.place_2").alias("p2"), "code")
    n = None
    while True:
        placed = positioned(rows, "sequence", ["p1", "p2"]).withColumn("block", F.expr(f"position div {LONG}"))
        rows = stage(placed.groupBy("sequence", "block").applyInPandas(kept, rows.schema), "reduced")
        prior, n = n, rows.count()
        if prior is not None and n > 0.9 * prior or not n:
            break
    return rows.select("sequence", F.struct(F.col("p1").alias("place_1"), F.col("p2").alias("place_2"), "code").alias("at"), "code")


def frequent_subsequences(steps_of: DataFrame, steps: int = 3, min_support: int = 3, min_share: int = 400) -> DataFrame:
    """Patterns of ``steps`` items (2 or more) at increasing places of a sequence, with the number of sequences that have them.

    ``steps_of`` has (sequence, place_1, place_2, item): rows alike in all
    four count once; a sequence is ordered by place_1, place_2 (null as ''),
    item. Rows with a null sequence, place_1 or item take part in nothing;
    other columns are ignored. Result: step_1 .. step_n, support,
    n_sequences, for patterns with support >= min_support and
    ``min_share * support >= n_sequences``. A sequence supports a pattern
    once, however often it holds it. No rows give no patterns.

    Method: items too rare for any pattern are dropped, equal sequences are
    merged with a weight, and each range of them in lexical order becomes
    prefix trees with ancestor codes. The frequent patterns of one step less
    are mined first and prune the next mining. Supports of the trees are
    summed, as each sequence is in one tree. Long sequences are reduced to
    an equivalent short one, block by block, before they are collected. Nothing that grows with the
    number of sequences is broadcast: only patterns (MAX_FREQUENT at most; more of them do not prune).
    """
    if steps < 2:
        raise ValueError("patterns have two steps or more")
    rows = (
        steps_of.select("sequence", "place_1", F.coalesce("place_2", F.lit("")).alias("place_2"), "item")
        .filter(F.col("sequence").isNotNull() & F.col("place_1").isNotNull() & F.col("item").isNotNull())
        .distinct()
    )
    rows = stage(rows, "steps")
    lengths = rows.groupBy("sequence").agg(F.count("*").alias("n"))
    total, longest = lengths.agg(F.count("*"), F.max("n")).first()
    at_least = max(min_support, -(-total // min_share))
    supports = rows.select("sequence", "item").distinct().groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)
    names = stage(supports.orderBy("item").withColumn("code", F.monotonically_increasing_id()), "frequent_items")  # codes in the order of items
    few = names.count() <= MAX_FREQUENT
    named = names.select("item", "code")
    coded = rows.join(F.broadcast(named), "item") if few else split_join(rows, named, ["item"], heavy_keys(names, ["item"]))
    coded = coded.select("sequence", F.struct("place_1", "place_2", "code").alias("at"), "code")
    if (longest or 0) > LONG:
        coded = stage(coded, "coded_steps")
        kept = coded.groupBy("sequence").agg(F.count("*").alias("n")).withColumn("long", F.col("n") > LONG)
        heavy = heavy_keys(kept, ["sequence"])
        marked = stage(split_join(coded, kept.select("sequence", "long"), ["sequence"], heavy), "marked_steps")
        coded = marked.filter("not long").drop("long").unionByName(_reduced(marked.filter("long").drop("long"), steps))
    lists = coded.groupBy("sequence").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    merged = lists.filter(F.size("ats") >= min(steps, 2)).select(F.transform("ats", lambda a: a["code"]).alias("codes")).groupBy("codes").agg(F.count("*").alias("weight"))
    merged = stage(merged, "distinct_sequences")
    trees = merged.repartitionByRange("codes").sortWithinPartitions("codes")
    allowed = None
    for k in range(2, steps):
        shorter = _mined(trees, k, allowed).filter(F.col("support") >= at_least).select("pattern").limit(MAX_FREQUENT + 1).collect()
        allowed = {tuple(r.pattern) for r in shorter} if len(shorter) <= MAX_FREQUENT else None
    out = _mined(trees, steps, allowed).filter(F.col("support") >= at_least)
    for i in range(steps):
        side = names.select(F.col("code").alias(f"c{i}"), F.col("item").alias(f"step_{i + 1}"))
        out = out.withColumn(f"c{i}", F.element_at("pattern", i + 1)).join(F.broadcast(side) if few else side, f"c{i}")
    return out.select(*[f"step_{i + 1}" for i in range(steps)], "support", F.lit(total).cast("bigint").alias("n_sequences"))
